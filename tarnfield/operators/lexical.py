"""Lexical search on a stored inverted index: build, update, query expressions, BM25.

The index is one Parquet table of entries. Chunks are taken in shards of up to
``SHARD_CHUNKS``; a shard has one row for each of its terms, with the chunks' places in the
shard, their term counts, lengths and positions, and one row that names its chunks. A task
writes the shards it makes one after another, each sorted by term, so no entry crosses the
network or is sorted by Spark, and a search reads the pages of its own terms and no text.
Beside them stand the terms with their document frequencies and one row of statistics.

A search deals the entries of its terms out by shard. A task evaluates all queries of a
block on its shard with numpy and keeps, where a top k is asked, the k best of each query;
shards are bounded, so no task holds more than some shards' entries, whatever a term's share
of the corpus. Queries are a stated set: their expressions are broadcast in blocks of
``BLOCK_QUERIES``. Names of chunks are read for hits alone.

Queries. A text in single quotes is an expression of its own: words, "phrases", prefixes*,
AND, OR, NOT, parentheses, text: and heading_path: before what should stand in that field;
words side by side must all occur. Any other text asks for the body only: for the whole
text as a phrase, or for all its words of two characters or more, each of which is a phrase
of its index tokens (``foo-bar`` is "foo bar"). Every phrase of the expression adds its BM25
part where it occurs, a word that stands twice in the query adds it twice; the whole text
and its words count once where they are the same. A word without index tokens asks nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import count
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, IntegerType, IntegralType, StringType, StructField, StructType

from tarnfield.functions import text as T
from tarnfield.scratch import drop_path, scratch_path

K1, B, FLOOR_IDF = 1.2, 0.75, 1e-6
#: Chunks of a shard, at most, and bytes of index tokens from which one ends early.
SHARD_CHUNKS, SHARD_BYTES = 16384, 8 << 20
#: Queries whose expressions are broadcast at once, and up to how many their hits come to the driver to be ranked.
BLOCK_QUERIES, NEAR_QUERIES = 10_000, 500
#: Up to so many terms are looked up in the entries by value; more are joined.
PRUNED_TERMS = 200
#: Hits up to this number come to the driver to be ranked; more are ranked by a shuffle.
NAMED_HITS = 100_000
#: Up to so many chunks, a shard's names travel with its entries; beyond that names are looked up for hits alone.
NAMED_CHUNKS = 1_000_000
#: Kinds of entries: a body term's, a heading term's, a shard's names; and, in a search, the chunks that pass its filter.
BODY, HEADING, NAMES, ALLOWED = 0, 1, 2, 3
FIELDS = {"text": (BODY,), "heading_path": (HEADING,)}

#: ``data`` holds 32-bit numbers, one list after another: the n chunks' places in the shard, their term counts, their lengths, and the cf positions.
ENTRIES = "term string, shard long, field int, n int, cf long, data binary, chunk_ids array<string>, doc_ids array<string>"


# queries ---------------------------------------------------------------------------------------
TOKEN = regex.compile(r"[\p{L}\p{N}]+")
FOLD = str.maketrans(T.FOLD_FROM, T.FOLD_TO)
RAW = regex.compile(r'\s*(?:"((?:[^"]|"")*)"|([\p{L}\p{N}_\x80-\U0010ffff]+)|([()*:+]))')


def index_tokens(text: str) -> tuple[str, ...]:
    """Tokens as the index has them."""
    return tuple(TOKEN.findall(text.lower().translate(FOLD)))


@dataclass(frozen=True)
class Phrase:
    """Tokens that must stand in turn in one of the fields; the last may be a prefix."""

    tokens: tuple[str, ...]
    fields: tuple[int, ...] = (BODY,)
    prefix: bool = False


@dataclass(frozen=True)
class Query:
    """Phrases, and how they must occur: a phrase's number, or (and | or | not, parts)."""

    phrases: tuple[Phrase, ...]
    tree: object


class BadQuery(ValueError):
    """An expression in single quotes that can't be read."""


def parse_query(text: str | None) -> Query | None:
    """The expression of a query text; None if it asks nothing."""
    text = (text or "").strip(T.SPACES)
    if len(text) >= 2 and text[0] == text[-1] == "'":
        return _Raw(text[1:-1]).query()
    words = [w for w in T.SPACE.split(text) if len(w) >= 2]
    phrases = [Phrase(p) for w in words if (p := index_tokens(w))]
    every = ("and", tuple(range(len(phrases)))) if phrases else None
    whole = Phrase(index_tokens(text))
    if len(text) < 2 or not whole.tokens or words == [text]:
        return Query(tuple(phrases), every) if every else None
    at = len(phrases)
    return Query((*phrases, whole), ("or", (every, at)) if every else at)


class _Raw:
    """Recursive descent: OR binds least, then AND, then NOT; words side by side bind most."""

    def __init__(self, text: str) -> None:
        self.items, self.phrases, at = [], [], 0
        text = text.strip()
        while at < len(text):
            m = RAW.match(text, at)
            if not m:
                raise BadQuery(f"can't read {text[at:]!r}")
            quoted, bare, mark = m.groups()
            self.items.append(("string", quoted.replace('""', '"')) if quoted is not None else ("word", bare) if bare else ("mark", mark))
            at = m.end()
        self.at = 0

    def peek(self, *kinds: tuple[str, str]) -> bool:
        return self.at < len(self.items) and self.items[self.at] in kinds

    def query(self) -> Query | None:
        if not self.items:
            return None
        tree = self.chain("OR", "or", lambda: self.chain("AND", "and", lambda: self.chain("NOT", "not", self.side_by_side)))
        if self.at < len(self.items):
            raise BadQuery("something follows the expression")
        return Query(tuple(self.phrases), tree) if tree is not None else None

    def chain(self, word: str, name: str, part):
        got = part()
        while self.peek(("word", word)):
            self.at += 1
            other = part()
            if name == "not":
                got = got if other is None or got is None else ("not", (got, other))
            else:
                got = other if got is None else got if other is None else (name, (got, other))
        return got

    def side_by_side(self, fields: tuple[int, ...] = (BODY, HEADING)):
        parts, any_ = [], False
        while self.at < len(self.items) and not self.peek(("mark", ")"), ("word", "OR"), ("word", "AND"), ("word", "NOT")):
            got, any_ = self.primary(fields), True
            if got is not None:
                parts.append(got)
        if not any_:
            raise BadQuery("an operand is missing")
        return ("and", tuple(parts)) if len(parts) > 1 else parts[0] if parts else None

    def primary(self, fields: tuple[int, ...]):
        kind, value = self.items[self.at]
        self.at += 1
        if kind == "word" and self.peek(("mark", ":")):
            if value not in FIELDS:
                raise BadQuery(f"no field {value}")
            self.at += 1
            if self.at >= len(self.items):
                raise BadQuery("an operand is missing")
            return self.primary(FIELDS[value])
        if (kind, value) == ("mark", "("):
            kept, self.fields = getattr(self, "fields", (BODY, HEADING)), fields
            got = self.chain("OR", "or", lambda: self.chain("AND", "and", lambda: self.chain("NOT", "not", lambda: self.side_by_side(self.fields))))
            self.fields = kept
            if not self.peek(("mark", ")")):
                raise BadQuery("a parenthesis is open")
            self.at += 1
            return got
        if kind == "mark":
            raise BadQuery(f"{value} has no place here")
        tokens = index_tokens(value)
        while self.peek(("mark", "+")):
            self.at += 2
            if self.at > len(self.items) or self.items[self.at - 1][0] == "mark":
                raise BadQuery("an operand is missing")
            tokens += index_tokens(self.items[self.at - 1][1])
        prefix = self.peek(("mark", "*"))
        self.at += prefix
        if not tokens:
            return None
        self.phrases.append(Phrase(tokens, fields, prefix))
        return len(self.phrases) - 1


# index -----------------------------------------------------------------------------------------
class Index:
    """A stored index: its folder and the tables in it, which never change."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    @cached_property
    def entries(self) -> DataFrame:
        """One row for each term, field and shard, and one that names each shard's chunks."""
        return self.spark.read.schema(ENTRIES).parquet(f"{self.path}/entries")

    @cached_property
    def terms(self) -> DataFrame:
        """term, df (chunks whose body has it), cf (how often)."""
        return self.spark.read.schema("term string, df long, cf long").parquet(f"{self.path}/terms")

    @cached_property
    def stats(self) -> tuple[int, float, int]:
        """Chunks, their mean length in indexed tokens, copies of the body."""
        r = self.spark.read.parquet(f"{self.path}/stats").first()
        return r["n_chunks"], r["avgdl"], r["body_copies"]

    def named(self) -> DataFrame:
        """shard, ord, chunk_id, doc_id of all chunks."""
        rows = self.entries.where(F.col("field") == NAMES).select("shard", F.posexplode(F.arrays_zip("chunk_ids", "doc_ids")).alias("ord", "c"))
        return rows.select("shard", "ord", "c.chunk_ids", "c.doc_ids").toDF("shard", "ord", "chunk_id", "doc_id")


#: Bytes of an Arrow batch that goes to Python while an index is built.
BATCH_BYTES = 8 << 20


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """What is written inside sends batches of ``BATCH_BYTES`` to Python, unless the session says how large they are."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is not None:
        yield
        return
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(name)


def _pieces(batches: Iterator[pa.RecordBatch], shard_chunks: int) -> Iterator[pa.Table]:
    """The rows of a shard, time after time; what waits for the next batch is copied, so that no slice keeps a whole batch."""
    held, rows, used, step = [], 0, 0, min(1024, shard_chunks)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            held.append(batch.slice(at, step))
            rows += held[-1].num_rows
            used += held[-1].column("body").nbytes
            if rows >= shard_chunks or used >= SHARD_BYTES:
                full, held, rows, used = pa.Table.from_batches(held), [], 0, 0
                yield full
                del full
        whole = range(max(0, len(held) - -(-batch.num_rows // step)), len(held))
        for k in whole:
            held[k] = held[k].take(pa.array(np.arange(held[k].num_rows)))
    if held:
        yield pa.Table.from_batches(held)


def entries_of(chunks: DataFrame, body_copies: int = 2, shard_chunks: int = SHARD_CHUNKS, generation: int = 0) -> DataFrame:
    """Index entries of chunks (chunk_id, doc_id, text, maybe heading_path), each task making shards of its own, sorted by field and term."""
    # tokens hold no spaces: joined by them they travel as one string
    heads = F.array_join(T.tokens(F.concat_ws(" ", "heading_path")), " ") if "heading_path" in chunks.columns else F.lit("")
    rows = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), F.array_join(T.tokens(F.col("text")), " ").alias("body"), heads.alias("head"))

    def shard_of(table: pa.Table, shard: int) -> Iterator[pa.RecordBatch]:
        table = table.sort_by([("chunk_id", "ascending"), ("doc_id", "ascending")]).combine_chunks()
        ids = {c: pa.array([table.column(c).to_pylist()], pa.list_(pa.string())) for c in ("chunk_id", "doc_id")}
        n_chunks, columns = table.num_rows, [table.column(c) for c in ("body", "head")]
        del table
        ends = [np.concatenate([[0], np.cumsum(_sizes(c))]) for c in columns]
        dl = (np.diff(ends[0]) * body_copies + np.diff(ends[1])).astype(np.int32)
        for field_ in (BODY, HEADING):
            offsets = ends[field_].astype(np.int32)
            if not offsets[-1]:
                continue
            coded = _flat(columns[field_]).dictionary_encode()
            columns[field_] = None
            # terms by their bytes, as the files' statistics compare them
            by_term = pc.sort_indices(coded.dictionary)
            names, rank = coded.dictionary.take(by_term), np.empty(len(by_term), dtype=np.int32)
            rank[by_term.to_numpy()] = np.arange(len(rank), dtype=np.int32)
            codes = rank[coded.indices.to_numpy()]
            del coded, by_term, rank
            order = np.argsort(codes, kind="stable").astype(np.int32)  # by term, then chunk, then place
            codes = codes[order]
            owner = np.repeat(np.arange(n_chunks, dtype=np.int32), np.diff(offsets))
            place = (order - offsets[owner[order]]).astype(np.int32)
            owner = owner[order]
            del order
            new_post = np.concatenate([[True], (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])])
            at = np.flatnonzero(new_post).astype(np.int32)
            tfs = np.diff(at, append=np.int32(len(codes)))
            terms_at = np.flatnonzero(np.concatenate([[True], codes[at][1:] != codes[at][:-1]]))
            post_ends = np.concatenate([terms_at, [len(at)]]).astype(np.int32)
            pos_ends = np.concatenate([at[terms_at], [len(codes)]]).astype(np.int32)
            owner = owner[at]
            del codes, new_post, at, terms_at
            size, n, cf = len(names), np.diff(post_ends), np.diff(pos_ends)
            base = np.concatenate([[0], np.cumsum(3 * n.astype(np.int64) + cf)])
            data = np.empty(base[-1], dtype="<i4")
            # where each list begins, less the postings or positions of the terms before it
            to = np.repeat((base[:-1] - post_ends[:-1]).astype(np.int32), n) + np.arange(len(owner), dtype=np.int32)
            step = np.repeat(n, n)
            for values in (owner, tfs, dl[owner]):
                data[to] = values
                to += step
            del owner, tfs, values, to, step
            to = np.repeat((base[:-1] + 3 * n - pos_ends[:-1]).astype(np.int32), cf) + np.arange(len(place), dtype=np.int32)
            data[to] = place
            del to, place
            blobs = pa.Array.from_buffers(pa.binary(), size, [None, pa.py_buffer((4 * base).astype(np.int32)), pa.py_buffer(data)])
            none = pa.nulls(size, pa.list_(pa.string()))
            whole = {"term": names, "shard": pa.array(np.full(size, shard)), "field": pa.array(np.full(size, field_, dtype=np.int32)), "n": pa.array(n.astype(np.int32)), "cf": pa.array(cf.astype(np.int64)), "data": blobs, "chunk_ids": none, "doc_ids": none}
            batch = pa.RecordBatch.from_pydict(whole)
            del data, blobs, whole, names
            for k in range(0, size, 4096):
                yield batch.slice(k, 4096)
            del batch
        yield pa.RecordBatch.from_pydict({"term": pa.array([""]), "shard": pa.array([shard], pa.int64()), "field": pa.array([NAMES], pa.int32()), "n": pa.array([n_chunks], pa.int32()), "cf": pa.array([int(dl.sum())], pa.int64()), "data": pa.nulls(1, pa.binary()), "chunk_ids": ids["chunk_id"], "doc_ids": ids["doc_id"]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = generation << 44 | TaskContext.get().partitionId() << 20
        pieces = _pieces(batches, shard_chunks)
        for number in count():
            if (piece := [next(pieces, None)])[0] is None:
                break
            yield from shard_of(piece.pop(), base | number)
            pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, ENTRIES)


def _sizes(column: pa.ChunkedArray) -> np.ndarray:
    """How many tokens each row of joined tokens has."""
    joined = pa.concat_arrays(column.chunks)
    return np.where(pc.binary_length(joined).to_numpy(zero_copy_only=False) > 0, pc.count_substring(joined, " ").to_numpy(zero_copy_only=False) + 1, 0)


def _flat(column: pa.ChunkedArray) -> pa.Array:
    """Tokens of a column of joined tokens."""
    tokens = pc.split_pattern(pa.concat_arrays(column.chunks), " ").flatten()
    some = pc.greater(pc.binary_length(tokens), 0)
    return tokens if pc.all(some).as_py() else tokens.filter(some)  # no tokens split into one empty one


def write_index(entries: DataFrame, path: str, body_copies: int) -> Index:
    """Writes entries as they come, terms and statistics to a new folder."""
    spark = entries.sparkSession
    with _small_batches(spark):
        entries.write.option("parquet.block.size", 8 << 20).option("parquet.page.row.count.limit", 1000).option("compression", "zstd").parquet(f"{path}/entries")
    own = Index(spark, path)
    body = own.entries.where(F.col("field") == BODY).groupBy("term").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf"))
    body.repartitionByRange("term").sortWithinPartitions("term").write.option("parquet.block.size", 1 << 20).parquet(f"{path}/terms")
    sums = own.entries.where(F.col("field") == NAMES).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"), (F.sum("cf") / F.sum("n")).alias("avgdl"))
    sums.withColumn("avgdl", F.coalesce("avgdl", F.lit(0.0))).withColumn("body_copies", F.lit(body_copies)).write.parquet(f"{path}/stats")
    return own


def build_index(chunks: DataFrame, path: str, body_copies: int = 2, shard_chunks: int = SHARD_CHUNKS) -> Index:
    """The index of all chunks in a new folder, by one pass over the texts."""
    return write_index(entries_of(chunks, body_copies, shard_chunks), path, body_copies)


def update_index(index: Index, chunks: DataFrame, changed: DataFrame, path: str, shard_chunks: int = SHARD_CHUNKS) -> Index:
    """The index after inserts, changes and deletions, in a new folder.

    ``chunks`` are all chunks as they are now, ``changed`` the doc_ids that came, changed
    or went. Shards that hold a changed document are made anew from what is left of them
    and from the new chunks; all other entries are carried over unread.
    """
    gone = changed.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
    named = index.named()
    hit = named.join(gone, "doc_id", "left_semi").select("shard").distinct()
    # what is left of the shards hit, chunk by chunk: a document may have others elsewhere
    left = named.join(hit, "shard", "left_semi").join(gone, "doc_id", "left_anti").select(F.col("chunk_id").alias("_c"), F.col("doc_id").alias("_d"))
    text = lambda c: F.col(c).cast("string")
    again = chunks.join(left, (text("chunk_id") == F.col("_c")) & (text("doc_id") == F.col("_d")), "left_semi").unionByName(chunks.join(gone.withColumnRenamed("doc_id", "_d"), text("doc_id") == F.col("_d"), "left_semi"))
    kept = index.entries.join(F.broadcast(hit), "shard", "left_anti")  # a number for each shard; entries stay in their order
    generation = (index.entries.agg(F.max("shard")).first()[0] or 0) // (1 << 44) + 1
    copies = index.stats[2]
    own = kept.select(*[f.name for f in index.entries.schema])
    return write_index(own.unionByName(entries_of(again, copies, shard_chunks, generation)), path, copies)


# search ----------------------------------------------------------------------------------------
class Shard:
    """The entries of one shard that the queries ask for."""

    def __init__(self, copies: int) -> None:
        self.copies, self.entries, self.allowed, self.names, self.memo = copies, {}, None, None, {}

    def clear(self) -> None:
        """Lets go of entries, names and what was found."""
        self.entries, self.allowed, self.names, self.memo = {}, None, None, {}

    def add(self, field_: int, term: str, ords: np.ndarray, tfs: np.ndarray, dls: np.ndarray, positions: np.ndarray) -> None:
        self.entries[field_, term] = ords, tfs, dls, positions

    def occurrences(self, phrase: Phrase) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunks that hold the phrase, how often (body copies included), and their lengths."""
        got = self.memo.get(phrase)
        if got is None:
            found = [x for f in phrase.fields for x in self._in_field(f, phrase)]
            if len(found) == 1:
                got = found[0]
            elif not found:
                got = (np.zeros(0, np.int64),) * 3
            else:
                ords, tfs, dls = (np.concatenate(x) for x in zip(*found, strict=True))
                own, first, inverse = np.unique(ords, return_index=True, return_inverse=True)
                got = own, np.bincount(inverse, weights=tfs).astype(np.int64), dls[first]
            self.memo[phrase] = got
        return got

    def _in_field(self, field_: int, phrase: Phrase) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        factor = self.copies if field_ == BODY else 1
        last = [t for f, t in self.entries if f == field_ and t.startswith(phrase.tokens[-1])] if phrase.prefix else [phrase.tokens[-1]]
        for end in last:
            own = [self.entries.get((field_, t)) for t in (*phrase.tokens[:-1], end)]
            if any(e is None for e in own):
                continue
            if len(own) == 1:
                yield own[0][0], own[0][1] * factor, own[0][2]
                continue
            starts = None
            for k, (ords, tfs, _, positions) in sorted(enumerate(own), key=lambda e: len(e[1][3])):
                at = np.repeat(ords.astype(np.int64), tfs) << 32 | (positions.astype(np.int64) - k) & 0xFFFFFFFF
                starts = at if starts is None else np.intersect1d(starts, at, assume_unique=True)
                if not len(starts):
                    break
            else:
                ords, counts = np.unique(starts >> 32, return_counts=True)
                yield ords, counts * factor, own[0][2][np.searchsorted(own[0][0], ords)]

    def matches(self, tree: object, phrases: tuple[Phrase, ...]) -> np.ndarray:
        """Chunks for which the expression holds."""
        if isinstance(tree, int):
            return self.occurrences(phrases[tree])[0]
        name, parts = tree
        got = [self.matches(p, phrases) for p in parts]
        if name == "and":
            return reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), sorted(got, key=len))
        return np.setdiff1d(got[0], got[1], assume_unique=True) if name == "not" else reduce(np.union1d, got)

    def hits(self, query: Query) -> np.ndarray:
        """Chunks that match and pass the filter."""
        ords = self.matches(query.tree, query.phrases)
        return ords if self.allowed is None else np.intersect1d(ords, self.allowed)

    def part(self, phrase: Phrase, ords: np.ndarray, avgdl: float) -> np.ndarray:
        """What the phrase adds to the scores of ``ords``, its idf aside."""
        own, tfs, dls = self.occurrences(phrase)
        out = np.zeros(len(ords))
        _, at, here = np.intersect1d(ords, own, assume_unique=True, return_indices=True)
        tf = tfs[here].astype(float)
        out[at] = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dls[here] / avgdl))
        return out

    def scored(self, query: Query, idf: dict[Phrase, float], avgdl: float) -> tuple[np.ndarray, np.ndarray]:
        """Chunks that match and their raw scores."""
        ords = self.hits(query)
        return ords, -sum((idf[p] * self.part(p, ords, avgdl) for p in query.phrases), np.zeros(len(ords)))


def _shards(batches: Iterator[pa.RecordBatch], copies: int) -> Iterator[tuple[int, Shard]]:
    """Shard after shard from rows sorted by shard; a shard is emptied when the next one begins."""
    shard, own = None, None
    for batch in batches:
        numbers, fields, terms = (batch.column(c).to_pylist() for c in ("shard", "field", "term"))
        sizes, blobs = batch.column("n").to_pylist(), batch.column("data")
        for k, number in enumerate(numbers):
            if number != shard:
                if own is not None:
                    yield shard, own
                    own.clear()
                shard, own = number, Shard(copies)
            if fields[k] == NAMES:
                own.names = [batch.column(c)[k].as_py() for c in ("chunk_ids", "doc_ids")]
            elif fields[k] == ALLOWED:  # chunks that a filter lets through
                own.allowed = np.sort(np.array(batch.column("ords")[k].as_py(), dtype=np.int64))
            else:
                lists, n = np.frombuffer(blobs[k].as_buffer(), dtype="<i4").copy(), sizes[k]
                own.add(fields[k], terms[k], lists[:n], lists[n : 2 * n], lists[2 * n : 3 * n], lists[3 * n :])
    if own is not None:
        yield shard, own
        own.clear()
    pa.default_memory_pool().release_unused()


ASKED = ("shard", "field", "term", "n", "data", "chunk_ids", "doc_ids", "ords")


def _shaped(entries: DataFrame) -> DataFrame:
    """Entries with a column for the places that a filter lets through."""
    return entries.withColumn("ords", F.lit(None).cast("array<int>")).select(*ASKED)


def _asked(index: Index, phrases: set[Phrase]) -> DataFrame:
    """Entries of the phrases' terms, with positions for the terms of phrases of several tokens; few terms go to the scan as a filter."""
    exact = {t for p in phrases for t in (p.tokens[:-1] if p.prefix else p.tokens)}
    starts = {p.tokens[-1] for p in phrases if p.prefix}
    fields = sorted({f for p in phrases for f in p.fields})
    several = [p for p in phrases if len(p.tokens) > 1]
    placed = exact if any(p.prefix for p in several) else {t for p in several for t in p.tokens}
    wanted = _shaped(index.entries.where(F.col("field").isin(fields)))
    alone = F.substring("data", F.lit(1), 12 * F.col("n"))  # the lists before the positions
    if len(exact) + len(starts) <= PRUNED_TERMS:
        tests = [F.col("term") == t for t in sorted(exact)] + [F.col("term").startswith(t) for t in sorted(starts)]
        got = wanted.where(reduce(or_, tests) if tests else F.lit(False))
        if any(p.prefix for p in several):
            return got
        return got.withColumn("data", F.when(F.col("term").isin(sorted(placed)), F.col("data")).otherwise(alone) if placed else alone)
    listed = F.broadcast(_listed(index, exact, placed))  # terms of one block of queries
    got = wanted.join(listed, "term").withColumn("data", F.when(F.col("placed"), F.col("data")).otherwise(alone)).select(*ASKED)
    if starts:
        more = reduce(or_, [F.col("term").startswith(t) for t in sorted(starts)])
        got = got.unionByName(wanted.where(more).join(listed, "term", "left_anti"))
    return got.select(*ASKED)


def _listed(index: Index, terms: set[str], placed: set[str] = frozenset()) -> DataFrame:
    """term, and whether its positions are asked for."""
    own = sorted(terms)
    return index.spark.createDataFrame(pa.table({"term": pa.array(own, pa.string()), "placed": pa.array([t in placed for t in own], pa.bool_())}), "term string, placed boolean")


def _idf(n: int, df: int) -> float:
    return float(np.log((n - df + 0.5) / (df + 0.5))) if 0 < 2 * df < n else FLOOR_IDF


def _is_term(phrase: Phrase) -> bool:
    """Whether the table of terms knows the phrase's document frequency."""
    return len(phrase.tokens) == 1 and phrase.fields == (BODY,) and not phrase.prefix


def term_frequencies(index: Index, phrases: set[Phrase]) -> dict[Phrase, int]:
    """Chunks that hold each phrase of one body term, from the table of terms."""
    single = {p for p in phrases if _is_term(p)}
    terms = {p.tokens[0] for p in single}
    if not terms:
        return {}
    got = index.terms.where(F.col("term").isin(sorted(terms))) if len(terms) <= PRUNED_TERMS else index.terms.join(F.broadcast(_listed(index, terms)), "term", "left_semi")
    df = {r["term"]: r["df"] for r in got.select("term", "df").collect()}
    return {p: df.get(p.tokens[0], 0) for p in single}


def phrase_frequencies(index: Index, phrases: set[Phrase]) -> dict[Phrase, int]:
    """Chunks that hold each of the other phrases, by a pass over the entries of their terms."""
    rest = sorted((p for p in phrases if not _is_term(p)), key=lambda p: (p.tokens, p.fields, p.prefix))
    if not rest:
        return {}
    shared, copies = index.spark.sparkContext.broadcast(rest), index.stats[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(shared.value), dtype=np.int64)
        for _, shard in _shards(batches, copies):
            counts += [len(shard.occurrences(p)[0]) for p in shared.value]
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"p": pa.array(own), "n": pa.array(counts[own])})

    rows = _asked(index, set(rest))
    counted = rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "p long, n long").groupBy("p").agg(F.sum("n").alias("n"))
    found = {r["p"]: r["n"] for r in counted.collect()}
    return {p: found.get(k, 0) for k, p in enumerate(rest)}


def _dealt(index: Index, phrases: set[Phrase], within: DataFrame | None, names: bool) -> DataFrame:
    """Entries of the phrases' terms shard by shard, with the chunks that pass a filter and, if asked, the chunks' names."""
    rows = _asked(index, phrases)
    if names:
        rows = rows.unionByName(_shaped(index.entries.where(F.col("field") == NAMES)))
    if within is not None:
        ok = within.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
        passed = index.named().join(ok, "doc_id", "left_semi").groupBy("shard").agg(F.collect_list("ord").alias("ords"))
        none = {c: F.lit(None).cast("array<string>") for c in ("chunk_ids", "doc_ids")} | {"data": F.lit(None).cast("binary")}
        rows = rows.unionByName(passed.withColumns({"field": F.lit(ALLOWED), "term": F.lit(""), "n": F.size("ords")} | none).select(*ASKED))
    return rows.repartition("shard").sortWithinPartitions("shard")


def _places(index: Index, queries: list[Query], known: dict[Phrase, int], k: int | None, within: DataFrame | None) -> DataFrame:
    """q (number of the query), shard, ord, raw of all hits, or of the k best in each shard."""
    phrases = {p for q in queries for p in q.phrases}
    n, avgdl, copies = index.stats
    idf = {p: _idf(n, df) for p, df in (known | phrase_frequencies(index, phrases)).items()}
    shared, filtered = index.spark.sparkContext.broadcast((queries, idf)), within is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, idf = shared.value
        for number, shard in _shards(batches, copies):
            if filtered and shard.allowed is None:
                continue
            q_, ords_, raw_ = [], [], []
            for q, query in enumerate(asked):
                ords, raw = shard.scored(query, idf, avgdl)
                if k is not None and len(ords) > k:
                    best = np.lexsort((ords, np.round(raw, 10)))[:k]
                    ords, raw = ords[best], raw[best]
                q_.append(np.full(len(ords), q, dtype=np.int32))
                ords_.append(ords.astype(np.int32))
                raw_.append(raw)
            q, ords, raw = (np.concatenate(x) for x in (q_, ords_, raw_))
            for at in range(0, len(q), 1 << 16):
                own = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_pydict({"q": pa.array(q[own]), "shard": pa.array(np.full(len(q[own]), number)), "ord": pa.array(ords[own]), "raw": pa.array(raw[own])})

    return _dealt(index, phrases, within, False).mapInArrow(run, "q int, shard long, ord int, raw double")


def _near(index: Index, queries: list[Query], known: dict[Phrase, int], k: int, within: DataFrame | None) -> list[tuple] | None:
    """(q, shard, ord, chunk_id, doc_id, raw) of all chunks that may be among the k best, in one pass; None if they are too many.

    The pass doesn't know yet how frequent phrases of several tokens are: it counts them,
    and a chunk stays unless k others of its shard are better whatever the counts will be.
    """
    phrases = {p for q in queries for p in q.phrases}
    n, avgdl, copies = index.stats
    idf, most = {p: _idf(n, df) for p, df in known.items()}, _idf(n, 1)
    names, filtered = n <= NAMED_CHUNKS, within is not None
    shared = index.spark.sparkContext.broadcast((queries, idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, idf = shared.value
        for number, shard in _shards(batches, copies):
            out = {c: [] for c in ("q", "shard", "ord", "chunk_id", "doc_id", "base", "parts")}

            def add(*row, out=out) -> None:
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)

            for q, query in enumerate(asked):
                open_ = [p for p in query.phrases if p not in idf]
                if open_ and any(counts := [len(shard.occurrences(p)[0]) for p in open_]):
                    add(q, number, -1, None, None, 0.0, [float(c) for c in counts])
                if filtered and shard.allowed is None or not len(ords := shard.hits(query)):
                    continue
                base = sum((idf[p] * shard.part(p, ords, avgdl) for p in query.phrases if p in idf), np.zeros(len(ords)))
                parts = np.stack([shard.part(p, ords, avgdl) for p in open_], axis=1) if open_ else np.zeros((len(ords), 0))
                if len(ords) > k:
                    low = base + FLOOR_IDF * parts.sum(axis=1)
                    kept = base + most * parts.sum(axis=1) >= np.partition(low, len(low) - k)[len(low) - k] - 1e-9
                    ords, base, parts = ords[kept], base[kept], parts[kept]
                for o, b, p in zip(ords.tolist(), base.tolist(), parts.tolist(), strict=True):
                    add(q, number, o, *((shard.names[0][o], shard.names[1][o]) if names else (None, None)), b, p)
            types = {"q": pa.int32(), "shard": pa.int64(), "ord": pa.int32(), "chunk_id": pa.string(), "doc_id": pa.string(), "base": pa.float64(), "parts": pa.list_(pa.float64())}
            if out["q"]:
                yield pa.RecordBatch.from_pydict({c: pa.array(v, types[c]) for c, v in out.items()})

    schema = "q int, shard long, ord int, chunk_id string, doc_id string, base double, parts array<double>"
    got = _dealt(index, phrases, within, names).mapInArrow(run, schema).limit(NAMED_HITS + 1).toArrow()
    if got.num_rows > NAMED_HITS:
        return None
    rows = got.to_pylist()
    frequency: dict[int, np.ndarray] = {}
    for r in rows:
        if r["ord"] < 0:
            frequency[r["q"]] = frequency.get(r["q"], 0) + np.array(r["parts"])
    idfs = {q: np.array([_idf(n, int(c)) for c in counts]) for q, counts in frequency.items()}
    hits = [(r["q"], r["shard"], r["ord"], r["chunk_id"], r["doc_id"], -(r["base"] + float(np.dot(idfs[r["q"]], r["parts"]) if r["q"] in idfs else 0.0))) for r in rows if r["ord"] >= 0]
    if names or not hits:
        return hits
    # of each query only those that tie with the k-th or are better get names
    hits.sort(key=lambda h: (h[0], round(h[5], 10)))
    near, last, seen = [], None, []
    for h in hits:
        seen = seen if h[0] == last else []
        last = h[0]
        seen.append(round(h[5], 10))
        if len(seen) <= k or seen[-1] == seen[k - 1]:
            near.append(h)
    wanted: dict[int, set[int]] = {}
    for h in near:
        wanted.setdefault(h[1], set()).add(h[2])
    listed = index.spark.createDataFrame(pa.table({"shard": pa.array(list(wanted), pa.int64()), "wanted": pa.array([sorted(o) for o in wanted.values()], pa.list_(pa.int32()))}), "shard long, wanted array<int>")
    pick = lambda c: F.transform("wanted", lambda o: F.get(c, o))
    rows = index.entries.where((F.col("field") == NAMES) & F.col("shard").isin(sorted(wanted))).join(F.broadcast(listed), "shard")
    own = {r["shard"]: dict(zip(r["wanted"], zip(r["c"], r["d"], strict=True), strict=True)) for r in rows.select("shard", "wanted", pick("chunk_ids").alias("c"), pick("doc_ids").alias("d")).collect()}
    return [(*h[:3], *own[h[1]][h[2]], h[5]) for h in near]


def _ranked(hits: list[tuple], k: int) -> list[tuple]:
    """(q, chunk_id, doc_id, raw, rank) up to rank k."""
    out, last, rank = [], None, 0
    for h in sorted(hits, key=lambda h: (h[0], round(h[5], 10), h[3], h[4])):
        rank, last = (rank + 1 if h[0] == last else 1), h[0]
        if rank <= k:
            out.append((h[0], h[3], h[4], h[5], rank))
    return out


def find(text: str, index: Index, k: int = 10, within: DataFrame | None = None) -> list[dict]:
    """The k best hits of one query, at once: chunk_id, doc_id, score, rank."""
    query = parse_query(text)
    if query is None:
        return []
    known = term_frequencies(index, set(query.phrases))
    hits = _near(index, [query], known, k, within)
    if hits is None:
        queries = index.spark.createDataFrame([(0, text)], "query_id int, text string")
        return [{"chunk_id": r["chunk_id"], "doc_id": r["doc_id"], "score": -r["raw"] / (1 + abs(r["raw"])), "rank": r["rank"]} for r in search_index(queries, index, k, within).orderBy("rank").collect()]
    return [{"chunk_id": c, "doc_id": d, "score": -raw / (1 + abs(raw)), "rank": rank} for _, c, d, raw, rank in _ranked(hits, k)]


def _blocks(queries: DataFrame) -> Iterator[tuple[list, list[Query]]]:
    """Ids and expressions of the queries that ask anything, block after block."""
    few = queries.select("query_id", "text").limit(BLOCK_QUERIES + 1).collect()
    ids, asked, made = [], [], False
    for r in few if len(few) <= BLOCK_QUERIES else queries.select("query_id", "text").toLocalIterator():
        if (q := parse_query(r["text"])) is not None:
            ids.append(r["query_id"])
            asked.append(q)
        if len(ids) == BLOCK_QUERIES:
            yield ids, asked
            ids, asked, made = [], [], True
    if ids or not made:
        yield ids, asked


def _hit_type(kind) -> StructType:
    fields = (("query_id", kind), ("chunk_id", StringType()), ("doc_id", StringType()), ("raw", DoubleType()), ("rank", IntegerType()))
    return StructType([StructField(n, t) for n, t in fields])


def _local(spark: SparkSession, rows: list[tuple], schema: StructType) -> DataFrame:
    """Rows of the driver as a table; those of plain types come as Arrow, without workers of another kind beside those of the searches."""
    if not all(isinstance(f.dataType, (StringType, IntegralType, DoubleType)) for f in schema):
        return spark.createDataFrame(rows, schema)
    columns = zip(*rows, strict=True) if rows else ((),) * len(schema)
    return spark.createDataFrame(pa.table([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, schema, strict=True)], names=schema.names), schema)


def _with_ids(rows: DataFrame, ids: list, kind) -> DataFrame:
    """q becomes query_id."""
    names = _local(rows.sparkSession, list(enumerate(ids)), StructType([StructField("q", IntegerType()), StructField("query_id", kind)]))
    return rows.join(F.broadcast(names), "q").drop("q")  # one block of queries


def search_index(queries: DataFrame, index: Index, k: int | None = None, within: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, doc_id, raw (negative, lower is better) of all hits, or of the k best with their ``rank``.

    Ranks go by the raw score rounded to ten places, then chunk_id. With a k the search
    of up to ``NEAR_QUERIES`` queries runs at once: what may be among their k best comes to
    the driver, up to ``NAMED_HITS`` rows; more hits, and those of more queries, are ranked
    and named by shuffles.
    Without a k the hits are a plan, in which chunks get their names by a join.
    """
    kind, out = queries.schema["query_id"].dataType, None
    for ids, asked in _blocks(queries):
        known = term_frequencies(index, {p for q in asked for p in q.phrases})
        few = k is not None and len(asked) <= NEAR_QUERIES
        if few and (hits := _near(index, asked, known, k, within) if asked else []) is not None:
            part = _local(index.spark, [(ids[q], *rest) for q, *rest in _ranked(hits, k)], _hit_type(kind))
        else:
            named = _places(index, asked, known, k, within).join(index.named(), ["shard", "ord"])
            if k is not None:
                order = Window.partitionBy("q").orderBy(F.round("raw", 10), "chunk_id", "doc_id")
                named = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            part = _with_ids(named, ids, kind).select("query_id", "chunk_id", "doc_id", "raw", *["rank"] * (k is not None))
        out = part if out is None else out.unionByName(part)
    return out


# indexes of this session -----------------------------------------------------------------------
_held: dict[tuple[str, str, int], Index] = {}


def held_index(chunks: DataFrame, key: str, body_copies: int = 2) -> Index:
    """The index of ``chunks`` under a key that stands for their contents, built in the shared folder when first asked for."""
    spark = chunks.sparkSession
    at = spark.sparkContext.applicationId, key, body_copies
    if at not in _held:
        _held[at] = build_index(chunks, scratch_path(spark, "lexical-index"), body_copies)
    return _held[at]


def passing_index(chunks: DataFrame, body_copies: int = 2) -> Index:
    """An index of its own for chunks that are searched once; ``release`` removes it."""
    return build_index(chunks, scratch_path(chunks.sparkSession, "lexical-index"), body_copies)


def release(index: Index) -> None:
    """Removes the folder of an index that nothing reads any more."""
    drop_path(index.spark, index.path)
    for key in [k for k, v in _held.items() if v == index]:
        del _held[key]
