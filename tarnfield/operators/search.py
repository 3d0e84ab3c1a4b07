"""Retrieval for a DataFrame of queries: BM25, exact vectors, rank fusion, filters, pages.

A single query is the one-row case. Filters come before ranking, so a selective one
never leaves fewer than k hits when there are k. Queries are a stated set and go to the
executors in blocks of bounded size.
"""

from __future__ import annotations

import base64
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tarnfield.functions import text as T
from tarnfield.operators.lexical import Index, passing_index, search_index

DEFAULT_K, RRF_K, FANOUT = 10, 60, 2
TRUST = {"primary": 3, "secondary": 2, "generated": 1}

# filters ---------------------------------------------------------------------------------------
@dataclass
class Filters:
    """All given ones hold together; values within one are alternatives; empty means no filter."""

    tags_any: list[str] = field(default_factory=list)
    lang: str | None = None
    trust_min: str | None = None
    media: list[str] = field(default_factory=list)
    code_lang: list[str] = field(default_factory=list)
    repo: list[str] = field(default_factory=list)
    source_type: list[str] = field(default_factory=list)
    source_id: list[str] = field(default_factory=list)
    ingested_after: datetime | None = None
    doc_id: str | None = None
    path_glob: str | None = None

    def apply(self, docs: DataFrame, tags: DataFrame | None = None, crossing_glob: bool = False) -> DataFrame:
        """Documents that pass."""
        tests = [F.col("lang") == self.lang] if self.lang else []
        if self.trust_min:
            tests.append(trust_rank(F.col("trust_level")) >= TRUST.get(self.trust_min, 0))
        for name in ("media", "code_lang", "repo", "source_type", "source_id"):
            if values := getattr(self, name):
                tests.append(F.col(name).isin(*values))
        if self.ingested_after is not None:
            tests.append(F.col("updated_at") >= F.lit(self.ingested_after))
        if self.doc_id is not None:
            tests.append(F.col("doc_id") == self.doc_id)
        if self.path_glob:
            tests.append(F.col("workspace_path").rlike(T.glob_regex(self.path_glob, crossing_glob)))
        for t in tests:
            docs = docs.where(t)
        if self.tags_any:
            docs = docs.join(tags.where(F.col("tag").isin(*self.tags_any)), "doc_id", "left_semi")
        return docs


def trust_rank(level: Column) -> Column:
    out = F
    for name, rank in TRUST.items():
        out = out.when(level == name, rank)
    return out.otherwise(0)


# lexical ---------------------------------------------------------------------------------------
def index_of(corpus: DataFrame | Index, body_copies: int = 2) -> Index:
    """A stored index as it is; for chunks, one that is made for them in the shared folder."""
    return corpus if isinstance(corpus, Index) else passing_index(corpus, body_copies)


def match_scores(queries: DataFrame, corpus: DataFrame | Index, body_copies: int = 2, within: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, doc_id, raw (negative, lower is better) of all chunks for which a query's expression holds.

    ``within`` restricts hits to documents; the statistics stay those of the whole corpus.
    """
    return search_index(queries, index_of(corpus, body_copies), None, within)


def squash(raw: Column) -> Column:
    """Score shown to users."""
    return -raw / (1 + F.abs(raw))


def top_k(df: DataFrame, order: list[Column], k: int, key: str = "query_id") -> DataFrame:
    """Rows with their 1-based ``rank`` for each query, up to k."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def lexical(queries: DataFrame, corpus: DataFrame | Index, k: int = DEFAULT_K, body_copies: int = 2, within: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, doc_id, score, rank. k = 0 stands for 10."""
    hits = search_index(queries, index_of(corpus, body_copies), k or DEFAULT_K, within)
    return hits.select("query_id", "chunk_id", "doc_id", squash(F.col("raw")).alias("score"), "rank")


# vectors ---------------------------------------------------------------------------------------
def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays in double precision; NaN or null for a zero vector."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def shifted(cos: Column) -> Column:
    """Cosine mapped to 0..1; what isn't a number is 0."""
    return F.coalesce(F.nanvl((cos + 1) / 2, F.lit(0.0)), F.lit(0.0))


def vector_set(embeddings: DataFrame, model: str, dim: int) -> DataFrame:
    """The vectors of one model and width."""
    return embeddings.where((F.col("model_id") == model) & (F.size("embedding") == dim))


#: Query vectors that go to the executors at once, in bytes, and how many meet a batch at a time.
VECTOR_BYTES, VECTOR_ROWS = 32 << 20, 64


def _vector_blocks(queries: DataFrame) -> Iterator[dict[int, tuple[list, np.ndarray]]]:
    """Query ids and unit vectors by width, block after block; the next block is fetched when the last is planned."""
    rows, used, made = [], 0, False
    for r in queries.select("query_id", "embedding").where("embedding is not null and size(embedding) > 0").toLocalIterator():
        rows.append((r["query_id"], r["embedding"]))
        used += 8 * len(r["embedding"])
        if used >= VECTOR_BYTES:
            yield _by_width(rows)
            rows, used, made = [], 0, True
    if rows or not made:
        yield _by_width(rows)


def _by_width(rows: list) -> dict[int, tuple[list, np.ndarray]]:
    out = {}
    for width in sorted({len(v) for _, v in rows}):
        own = [(i, v) for i, v in rows if len(v) == width]
        m = np.array([[np.nan if x is None else x for x in v] for _, v in own], dtype=float)
        out[width] = [i for i, _ in own], m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    return out


def _best(names: np.ndarray, rounded: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties by name."""
    if len(rounded) > k:
        own = np.flatnonzero(rounded >= np.partition(rounded, len(rounded) - k)[len(rounded) - k])
    else:
        own = np.arange(len(rounded))
    return own[np.lexsort((names[own], -rounded[own]))][:k]


def vector(queries: DataFrame, embeddings: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """Exact nearest neighbours of each query row (query_id, embedding) among (chunk_id, doc_id, embedding).

    Query vectors are broadcast up to ``VECTOR_BYTES`` at a time, and one pass over the
    embeddings serves them all. A task keeps the k best of each query, so no more than k
    rows per query and task go to the ranking shuffle. A query meets the vectors of its own
    width only; null and empty vectors meet nothing, a component that is null or not a
    number makes the score 0.
    """
    spark, out = embeddings.sparkSession, None
    kind, query_type = queries.schema["query_id"].dataType.simpleString(), to_arrow_type(queries.schema["query_id"].dataType)
    schema = f"query_id {kind}, chunk_id {embeddings.schema['chunk_id'].dataType.simpleString()}, doc_id {embeddings.schema['doc_id'].dataType.simpleString()}, score double"
    rows = embeddings.select("chunk_id", "doc_id", F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
    for block in _vector_blocks(queries):
        shared = spark.sparkContext.broadcast(block)

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            kept: dict = {}  # (width, query's place) -> (names, documents, scores) of the best so far
            types = None
            for batch in batches:
                types = batch.schema.field("chunk_id").type, batch.schema.field("doc_id").type
                lists = batch.column("embedding")
                widths = lists.value_lengths().to_numpy(zero_copy_only=False)
                for width, (_, unit) in shared.value.items():
                    own = np.flatnonzero(widths == width)
                    if not len(own):
                        continue
                    part = batch.take(pa.array(own))
                    names, docs = (np.array(part.column(c).to_pylist(), dtype=object) for c in ("chunk_id", "doc_id"))
                    m = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
                    norm = np.linalg.norm(m, axis=1)
                    for at in range(0, len(unit), VECTOR_ROWS):
                        q = unit[at : at + VECTOR_ROWS]
                        score = (q @ m.T / np.where(norm > 0, norm, 1) + 1) / 2
                        score[:, ~(norm > 0)] = 0
                        score[~(np.linalg.norm(q, axis=1) > 0)] = 0
                        score = np.nan_to_num(score)
                        for j in range(len(q)):
                            had = kept.get((width, at + j))
                            n, d, s = (names, docs, score[j]) if had is None else (np.concatenate(x) for x in zip(had, (names, docs, score[j]), strict=True))
                            top = _best(n, np.round(s, 10), k)
                            kept[width, at + j] = n[top], d[top], s[top]
            for (width, j), (n, d, s) in kept.items():
                ids = shared.value[width][0]
                yield pa.RecordBatch.from_pydict({"query_id": pa.array([ids[j]] * len(n), query_type), "chunk_id": pa.array(list(n), types[0]), "doc_id": pa.array(list(d), types[1]), "score": pa.array(s)})

        got = rows.mapInArrow(best, schema)
        out = got if out is None else out.unionByName(got)
    # a query's k best of every task meet here: one row for each chunk of a query
    ranked = top_k(out.dropDuplicates(["query_id", "chunk_id"]), [F.round("score", 10).desc(), F.col("chunk_id")], k)
    return ranked.select("query_id", "chunk_id", "doc_id", "score", "rank")


# fusion ----------------------------------------------------------------------------------------
def fuse(lex: DataFrame, vec: DataFrame, k: int = DEFAULT_K, k_rrf: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion; rank 1 on both sides is 1.0. Rows found by both take the lexical side's other columns."""
    own = ("query_id", "chunk_id", "rank", "score")
    more = [c for c in dict.fromkeys([*lex.columns, *vec.columns]) if c not in own]
    a = lex.select("query_id", "chunk_id", F.struct(F.col("rank").alias("r"), F.col("score").alias("s"), *[c for c in more if c in lex.columns]).alias("_l"))
    b = vec.select("query_id", "chunk_id", F.struct(F.col("rank").alias("r"), F.col("score").alias("s"), *[c for c in more if c in vec.columns]).alias("_v"))
    part = lambda c: F.coalesce(1 / (F.lit(float(k_rrf)) + F.col(c)), F.lit(0.0))
    both = a.join(b, ["query_id", "chunk_id"], "full_outer").withColumn("score", (part("_l.r") + part("_v.r")) / (2 / (k_rrf + 1)))
    ranked = top_k(both, [F.round("score", 10).desc(), F.asc_nulls_last("_l.r"), F.col("chunk_id")], k)
    # the side that has the row gives its payload as a whole, nulls included
    payload = [F.when(F.col("_l").isNotNull(), F.col(f"_l.{c}")).otherwise(F.col(f"_v.{c}")) if c in lex.columns and c in vec.columns else F.col(f"_l.{c}" if c in lex.columns else f"_v.{c}") for c in more]
    return ranked.select("query_id", "chunk_id", *[p.alias(c) for p, c in zip(payload, more, strict=True)], "score", "rank", F.col("_l.r").alias("lex_rank"), F.col("_v.r").alias("vec_rank"), F.col("_l.s").alias("lex_score"), F.col("_v.s").alias("vec_score"))


def hybrid(queries: DataFrame, corpus: DataFrame | Index, embeddings: DataFrame, k: int = DEFAULT_K, within: DataFrame | None = None) -> DataFrame:
    """Both sides are asked for twice k, then fused."""
    if within is not None:
        embeddings = embeddings.join(within.select("doc_id"), "doc_id", "left_semi")
    return fuse(lexical(queries, corpus, FANOUT * k, within=within), vector(queries, embeddings, FANOUT * k), k)


def search(queries: DataFrame, corpus: DataFrame | Index, embeddings: DataFrame | None = None, mode: str = "hybrid", k: int = DEFAULT_K, within: DataFrame | None = None) -> DataFrame:
    """Hits by mode: lexical, vector or hybrid."""
    if mode == "lexical":
        return lexical(queries, corpus, k, within=within)
    if embeddings is None:
        raise ValueError(f"mode {mode} needs embeddings")
    if mode == "vector":
        return vector(queries, embeddings if within is None else embeddings.join(within.select("doc_id"), "doc_id", "left_semi"), k)
    if mode != "hybrid":
        raise ValueError(f"unknown mode {mode}")
    return hybrid(queries, corpus, embeddings, k, within)


def trace(queries: DataFrame, corpus: DataFrame | Index, embeddings: DataFrame, k: int = DEFAULT_K, offset: int = 0, timed: bool = False) -> dict[str, DataFrame]:
    """The lists before fusion, their union and the fused hits after ``offset``; with ``timed``, the lists are made at once and ``timings`` (stage, ms) tells how long each took."""
    depth, took = offset + k, []

    def stage(name: str, df: DataFrame) -> DataFrame:
        if timed:
            began = time.perf_counter()
            df = df.persist()
            df.count()
            took.append((name, (time.perf_counter() - began) * 1000))
        return df

    lex = stage("lexical", lexical(queries, corpus, FANOUT * depth))
    vec = stage("vector", vector(queries, embeddings, FANOUT * depth))
    fused = stage("fused", page(fuse(lex, vec, depth), offset, k))
    out = {"lexical": lex, "vector": vec, "union": union_of(lex, vec), "fused": fused}
    return out | {"timings": queries.sparkSession.createDataFrame(took, "stage string, ms double")} if timed else out


def union_of(lex: DataFrame, vec: DataFrame) -> DataFrame:
    """Candidates of both sides with their ranks."""
    return lex.select("query_id", "chunk_id", F.col("rank").alias("lex_rank")).join(vec.select("query_id", "chunk_id", F.col("rank").alias("vec_rank")), ["query_id", "chunk_id"], "full_outer")


def dedup_hits(hits: DataFrame) -> DataFrame:
    """The best-ranked row of each chunk of a query; ranks are dealt anew without gaps."""
    first = hits.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("rank"))).where("_n = 1").drop("_n")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_id")))


def hydrate(hits: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits with their chunk's text and their document's columns; texts are read for hits alone."""
    return hits.join(chunks.drop("doc_id"), "chunk_id").join(docs, "doc_id", "left")


def with_labels(hits: DataFrame, docs: DataFrame, columns: tuple[str, ...] = ("code_lang", "repo")) -> DataFrame:
    """Labels that a hit lacks come from its document."""
    own = docs.select("doc_id", *[F.col(c).alias(f"_doc_{c}") for c in columns])
    out = hits.join(own, "doc_id", "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(c, f"_doc_{c}") if c in hits.columns else F.col(f"_doc_{c}"))
    return out.drop(*[f"_doc_{c}" for c in columns])


def cap_snippets(hits: DataFrame, chars: int | None, snippet: str = "snippet") -> DataFrame:
    """Snippets of at most so many characters, if a number is given."""
    return hits if chars is None else hits.withColumn(snippet, F.substring(snippet, 1, chars))


def postfiltered(hits: DataFrame, passing: DataFrame, k: int) -> DataFrame:
    """The order of ranking first: of each query's hits the first 6k are tried, those in ``passing`` (doc_id) keep their order, and k stay at most."""
    tried = hits.where(F.col("rank") <= 6 * k).join(passing.select("doc_id").distinct(), "doc_id", "left_semi")
    return top_k(tried.withColumnRenamed("rank", "_rank"), [F.col("_rank")], k).drop("_rank")


def index_version(mode: str, lex: str = "lex:v1", model: str = "", version: str = "", dim: int = 0) -> str:
    vec = f"vec:{model}@{version}:{dim}"
    return {"lexical": lex, "vector": vec, "hybrid": f"hybrid:{lex}+{vec}"}[mode]


def with_staleness(hits: DataFrame, now: datetime, days: int, at: str = "indexed_at") -> DataFrame:
    """``stale`` is true where the row is older than ``days``; exactly as old is fresh, 0 turns it off."""
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))
    return hits.withColumn("stale", (age > days * 86_400_000_000) if days > 0 else F.lit(False))


# pages and budgets -----------------------------------------------------------------------------
class StaleCursor(ValueError):
    """The corpus has changed since the cursor was made."""


def encode_cursor(offset: int, revision: str) -> str:
    return base64.urlsafe_b64encode(json.dumps({"offset": offset, "corpus_revision": revision}).encode()).decode().rstrip("=")


def decode_cursor(cursor: str, revision: str) -> int:
    try:
        got = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        offset, own = int(got["offset"]), got["corpus_revision"]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("bad cursor") from e
    if own != revision:
        raise StaleCursor("stale_cursor")
    return offset


def page(hits: DataFrame, offset: int, k: int) -> DataFrame:
    """Ranks offset + 1 to offset + k."""
    return hits.where(F.col("rank").between(offset + 1, offset + k))


def next_cursor(returned: int, k: int, truncated: bool, offset: int, revision: str) -> str | None:
    """There is a next page if this one is full or was cut."""
    return encode_cursor(offset + returned, revision) if returned and (returned >= k or truncated) else None


def fit_budget(hits: DataFrame, max_tokens: int, snippet: str = "snippet", floor: int = 60, start: int = 220) -> DataFrame:
    """Snippets are halved down to ``floor`` characters, then the last hits go, until four characters a token hold a query's hits as a JSON array; one hit stays."""
    caps = [start]
    while caps[-1] > floor:
        caps.append(max(floor, caps[-1] // 2))
    cut = lambda cap: F.substring(F.coalesce(snippet, F.lit("")), 1, cap)
    length = lambda cap: F.length(F.to_json(F.struct(*[cut(cap).alias(c) if c == snippet else F.col(c) for c in hits.columns])))
    own, whole = Window.partitionBy("query_id").orderBy("rank"), Window.partitionBy("query_id")
    # brackets, the rows, a comma between two
    sized = hits.withColumns({f"_size{c}": length(c) + 1 for c in caps} | {"_no": F.row_number().over(own)})
    sized = sized.withColumns({f"_all{c}": F.sum(f"_size{c}").over(whole) + 1 for c in caps} | {"_upto": F.sum(f"_size{caps[-1]}").over(own.rowsBetween(Window.unboundedPreceding, 0)) + 1})
    text, keep = F, F
    for c in caps:
        text, keep = text.when(F.col(f"_all{c}") <= 4 * max_tokens, cut(c)), keep.when(F.col(f"_all{c}") <= 4 * max_tokens, F.lit(True))
    kept = sized.withColumn("_keep", keep.otherwise((F.col("_no") == 1) | (F.col("_upto") <= 4 * max_tokens))).withColumn(snippet, text.otherwise(cut(caps[-1])))
    return kept.where("_keep").select(*hits.columns)


def bulk(items: list[dict], limit: int = 100) -> list[dict]:
    """Checks bulk query objects: each gets a query or an error."""
    if len(items) > limit:
        raise ValueError(f"at most {limit} queries")
    out = []
    for k, item in enumerate(items):
        text = item.get("query") if isinstance(item, dict) else None
        out.append({"query_id": k, "text": text, "error": None} if isinstance(text, str) and text.strip() else {"query_id": k, "text": None, "error": "empty query"})
    return out
