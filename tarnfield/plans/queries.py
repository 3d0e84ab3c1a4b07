"""Named queries over the given tables, each with the DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnfield.functions import citation as C
from tarnfield.functions import text as T
from tarnfield.operators import chunk, evals, rag, search, stats, store
from tarnfield.plans.adapters import SQL_DOCS, SQL_EVENTS, SQL_ITEMS, SQL_SPACE, SQL_WORDS, chunks, documents, embeddings, index, ocr_events, queries, read, sql_tokens, tags, vector_queries, word_queries
from tarnfield.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# lexical ---------------------------------------------------------------------------------------
def _idf(n: str) -> str:
    return f"greatest(ln((n_chunks - {n} + 0.5) / ({n} + 0.5)), 1e-6)"


_SAT = "tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))"


def _lex(asked: str = SQL_ITEMS) -> str:
    """Hits of queries: all words of two characters or more as phrases of their tokens, and the whole text as one."""
    return rf"""
b AS (SELECT doc_id AS chunk_id, doc_id, tokens, 2 * len(tokens) AS dl FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, {sql_tokens('text')} AS tokens FROM documents)),
st AS (SELECT count(*) AS n_chunks, avg(dl) AS avgdl FROM b),
q AS (SELECT query_id, text, list_filter(pieces, lambda w: length(w) >= 2) AS words, len(list_filter(pieces, lambda w: length(w) > 0)) AS n_pieces, {sql_tokens('text')} AS whole FROM (SELECT *, regexp_split_to_array(coalesce(text, ''), '{SQL_SPACE}') AS pieces FROM ({asked}))),
qp AS (SELECT query_id, ph, array_to_string(ph, ' ') AS key, count(*) AS times FROM (SELECT query_id, {sql_tokens('w')} AS ph FROM (SELECT query_id, unnest(words) AS w FROM q)) WHERE len(ph) > 0 GROUP BY ALL),
nq AS (SELECT query_id, count(*) AS nt FROM qp GROUP BY query_id),
p AS (SELECT chunk_id, term, 2 * count(*) AS tf FROM (SELECT chunk_id, unnest(tokens) AS term FROM b) GROUP BY ALL),
several AS (SELECT DISTINCT ph, key FROM qp WHERE len(ph) > 1),
occ AS (SELECT term AS key, chunk_id, tf FROM p WHERE term IN (SELECT key FROM qp WHERE len(ph) = 1) UNION ALL
  SELECT * FROM (SELECT key, chunk_id, 2 * len(list_filter(range(1, len(tokens) - len(ph) + 2), lambda i: tokens[i:i + len(ph) - 1] = ph)) AS tf FROM several JOIN p ON term = ph[1] JOIN b USING (chunk_id)) WHERE tf > 0),
df AS (SELECT key, count(*) AS df FROM occ GROUP BY key),
m AS (SELECT query_id, chunk_id, doc_id, dl, sum(times * {_idf('df')} * {_SAT}) AS s FROM occ JOIN df USING (key) JOIN qp USING (key) JOIN b USING (chunk_id) JOIN nq USING (query_id), st GROUP BY query_id, chunk_id, doc_id, dl HAVING count(*) = any_value(nt)),
ph AS (SELECT * FROM (SELECT query_id, chunk_id, 2 * len(list_filter(range(1, len(tokens) - len(whole) + 2), lambda i: tokens[i:i + len(whole) - 1] = whole)) AS tf FROM m JOIN q USING (query_id) JOIN b USING (chunk_id) WHERE n_pieces > 1) WHERE tf > 0),
pd AS (SELECT query_id, count(*) AS pdf FROM ph GROUP BY query_id),
hits AS (SELECT query_id, chunk_id, doc_id, -(s + coalesce({_idf('pdf')} * {_SAT}, 0)) AS raw FROM m LEFT JOIN ph USING (query_id, chunk_id) LEFT JOIN pd USING (query_id), st)"""


LEX = _lex()


def _lex_sql(within: str = "TRUE", k: int = 10, lex: str = LEX) -> str:
    return f"""WITH {SQL_DOCS}, {lex}, ok AS (SELECT doc_id FROM docs WHERE {within})
SELECT query_id, chunk_id, doc_id, round(-raw / (1 + abs(raw)), 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 10), chunk_id) AS rank FROM hits SEMI JOIN ok USING (doc_id)) WHERE rank <= {k}"""


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round("score", 6))


def _filtered(spark: SparkSession, sf: str, **kw: object) -> DataFrame:
    within = search.Filters(**kw).apply(documents(spark, sf), tags(spark, sf))
    return _rounded(search.lexical(word_queries(spark, sf), index(spark, sf), within=within))


@query(_lex_sql())
def lex_topk_and(spark, sf):
    return _rounded(search.lexical(queries(spark, sf), index(spark, sf)))


@query(_lex_sql(lex=_lex(SQL_WORDS)))
def lex_topk_words(spark, sf):
    return _rounded(search.lexical(word_queries(spark, sf), index(spark, sf)))


@query(_lex_sql("lang = 'en' AND source_id IN ('src1', 'src2', 'src3')", lex=_lex(SQL_WORDS)))
def lex_filtered_lang_source(spark, sf):
    return _filtered(spark, sf, lang="en", source_id=["src1", "src2", "src3"])


@query(_lex_sql("trust_level IN ('primary', 'secondary')", lex=_lex(SQL_WORDS)))
def lex_trust_min(spark, sf):
    return _filtered(spark, sf, trust_min="secondary")


@query(_lex_sql("n IN (SELECT doc_id FROM labels WHERE toxic = 1)", lex=_lex(SQL_WORDS)))
def lex_tags_semi(spark, sf):
    return _filtered(spark, sf, tags_any=["toxic"])


@query(_lex_sql("regexp_matches(workspace_path, '^notes/src1[^/]*/en/[^/]*\\.md$')", lex=_lex(SQL_WORDS)))
def lex_glob_path(spark, sf):
    return _filtered(spark, sf, path_glob="notes/src1*/en/*.md")


@query(_lex_sql("updated_at >= TIMESTAMP '2024-02-01 00:00:00'", lex=_lex(SQL_WORDS)))
def lex_after_ts(spark, sf):
    return _filtered(spark, sf, ingested_after=datetime(2024, 2, 1))


@query(_lex_sql("doc_id = '7'", lex=_lex(SQL_WORDS)))
def lex_doc_id(spark, sf):
    return _filtered(spark, sf, doc_id="7")


@query(f"WITH {LEX} SELECT query_id, chunk_id, round(raw, 6) AS raw FROM hits")
def bm25_scores(spark, sf):
    return search.match_scores(queries(spark, sf), index(spark, sf)).select("query_id", "chunk_id", F.round("raw", 6).alias("raw"))


@query(f"WITH {LEX} SELECT query_id, count(*) AS n_phrase FROM ph GROUP BY query_id")
def lex_phrase_or(spark, sf):
    """Chunks that hold a whole item, by the expression of a quoted phrase."""
    quoted = queries(spark, sf).select("query_id", F.concat(F.lit("'text : \""), F.replace("text", F.lit('"'), F.lit('""')), F.lit("\"'")).alias("text"))
    return search.match_scores(quoted, index(spark, sf)).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_phrase"))


@query(f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({sql_tokens('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def postings_stats(spark, sf):
    return index(spark, sf).terms


@query(f"WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(coalesce(text, ''), '{SQL_SPACE}'), lambda x: length(x) >= 2) AS w FROM conversations) SELECT conv_id, turn, CAST(len(w) AS INTEGER) AS n_words, CAST(len(list_distinct(flatten(list_transform(w, lambda x: {sql_tokens('x')})))) AS INTEGER) AS n_terms FROM w")
def lex_min_token_len(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", F.size(T.query_words(F.col("text"))).alias("n_words"), F.size(T.query_tokens(F.col("text"))).alias("n_terms"))


@query(f"WITH {SQL_DOCS} SELECT doc_id, workspace_path FROM docs WHERE regexp_matches(workspace_path, '^notes/.*doc1.*$') AND lang = 'en'")
def list_docs_glob_crossing(spark, sf):
    return search.Filters(lang="en", path_glob="notes/*doc1*").apply(documents(spark, sf), crossing_glob=True).select("doc_id", "workspace_path")


# vectors and fusion ----------------------------------------------------------------------------
VEC = """e AS (SELECT CAST(vec_id AS VARCHAR) AS chunk_id, vec_id AS n, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
vs AS (SELECT q.chunk_id AS query_id, e.chunk_id, e.n, (list_cosine_similarity(q.v, e.v) + 1) / 2 AS score FROM e, e AS q WHERE q.n % 50 = 0)"""


def _vec_sql(where: str = "TRUE", k: int = 10) -> str:
    return f"""WITH {VEC} SELECT query_id, chunk_id, chunk_id AS doc_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, chunk_id) AS rank FROM vs WHERE {where}) WHERE rank <= {k}"""


@query(_vec_sql())
def vec_topk_cosine(spark, sf):
    return _rounded(search.vector(vector_queries(spark, sf), embeddings(spark, sf)))


@query(_vec_sql("n % 7 <> 0"))
def vec_committed_only(spark, sf):
    return _rounded(search.vector(vector_queries(spark, sf), store.committed(embeddings(spark, sf))))


@query(f"""WITH {VEC}, h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, chunk_id) AS rank FROM vs)
SELECT query_id, chunk_id, rank FROM h WHERE rank <= 5""")
def vec_dedup(spark, sf):
    hits = search.vector(vector_queries(spark, sf), embeddings(spark, sf), 5)
    return search.dedup_hits(hits.unionByName(hits.withColumn("rank", F.col("rank") + 100))).select("query_id", "chunk_id", "rank")


HYB = f"""{SQL_DOCS}, {LEX},
lx AS (SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 10), chunk_id) AS lex_rank FROM hits) WHERE lex_rank <= 20),
e AS (SELECT CAST(vec_id AS VARCHAR) AS chunk_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
vx AS (SELECT * FROM (SELECT CAST(item_id AS VARCHAR) AS query_id, e.chunk_id, row_number() OVER (PARTITION BY item_id ORDER BY round((list_cosine_similarity(x.v, e.v) + 1) / 2, 10) DESC, e.chunk_id) AS vec_rank
  FROM benchmark JOIN e AS x ON x.chunk_id = CAST(item_id AS VARCHAR), e) WHERE vec_rank <= 20),
u AS (SELECT query_id, chunk_id, lex_rank, vec_rank, (coalesce(1 / (60.0 + lex_rank), 0) + coalesce(1 / (60.0 + vec_rank), 0)) / (2 / 61.0) AS score FROM lx FULL JOIN vx USING (query_id, chunk_id))"""


def _both(spark: SparkSession, sf: str) -> DataFrame:
    return queries(spark, sf).join(embeddings(spark, sf).select(F.col("chunk_id").alias("query_id"), "embedding"), "query_id", "left")


@query(f"""WITH {HYB} SELECT query_id, chunk_id, round(score, 6) AS score, rank, lex_rank, vec_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, lex_rank ASC NULLS LAST, chunk_id) AS rank FROM u) WHERE rank <= 10""")
def hybrid_topk(spark, sf):
    return _rounded(search.search(_both(spark, sf), index(spark, sf), embeddings(spark, sf))).select("query_id", "chunk_id", "score", "rank", "lex_rank", "vec_rank")


@query(f"WITH {HYB} SELECT query_id, chunk_id, lex_rank, vec_rank FROM u")
def hybrid_trace_union(spark, sf):
    return search.trace(_both(spark, sf), index(spark, sf), embeddings(spark, sf))["union"]


@query(f"""WITH {HYB} SELECT query_id, CAST(count(*) AS BIGINT) AS n, round(sum(score), 4) AS total FROM u GROUP BY query_id""")
def rrf_fuse(spark, sf):
    t = search.trace(_both(spark, sf), index(spark, sf), embeddings(spark, sf), k=10)
    return search.fuse(t["lexical"], t["vector"], k=1000).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("total"))


@query(_vec_sql(k=10).replace("rank <= 10", "rank BETWEEN 6 AND 10"))
def page_two(spark, sf):
    offset = search.decode_cursor(search.encode_cursor(5, "r1"), "r1")
    return _rounded(search.page(search.vector(vector_queries(spark, sf), embeddings(spark, sf), offset + 5), offset, 5))


@query(f"""WITH {SQL_DOCS} SELECT doc_id, date_diff('microsecond', updated_at, TIMESTAMP '2024-02-29 00:00:00') > 30 * 86400000000 AS stale FROM docs""")
def stale_flags(spark, sf):
    d = documents(spark, sf).select("doc_id", F.col("updated_at").alias("indexed_at"))
    return search.with_staleness(d, datetime(2024, 2, 29), 30).select("doc_id", "stale")


@query(f"""WITH {LEX}, one AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 10), chunk_id) AS rank FROM hits),
qt AS (SELECT query_id, flatten(list_transform(words, lambda x: {sql_tokens('x')})) AS terms FROM q),
w AS (SELECT query_id, chunk_id, regexp_split_to_array(text, '\\s+') AS ws, terms FROM one JOIN qt USING (query_id) JOIN (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, text FROM documents) USING (chunk_id) WHERE rank <= 3),
f AS (SELECT *, list_position(list_transform(ws, lambda w: list_has_any({sql_tokens('w')}, terms)), true) AS p FROM w),
g AS (SELECT *, greatest(least(CASE WHEN p > 0 THEN p ELSE 1 END, len(ws) - 55 + 1), 1) AS s FROM f)
SELECT query_id, chunk_id, substring((CASE WHEN s > 1 THEN '…' ELSE '' END) || array_to_string(ws[s:s + 54], ' ') || (CASE WHEN s + 55 <= len(ws) THEN '…' ELSE '' END), 1, 220) AS snippet FROM g""")
def snippet_first_match(spark, sf):
    hits = search.lexical(queries(spark, sf), index(spark, sf), 3).join(queries(spark, sf).select("query_id", T.query_tokens(F.col("text")).alias("terms")), "query_id")
    return hits.join(chunks(spark, sf).drop("doc_id"), "chunk_id").select("query_id", "chunk_id", T.snippet(F.col("text"), F.col("terms")).alias("snippet"))


@query(f"""WITH {LEX}, h AS (SELECT * FROM (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 10), chunk_id) AS INTEGER) AS rank FROM hits) WHERE rank <= 10),
t AS (SELECT h.*, text FROM h JOIN (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, text FROM documents) USING (chunk_id)),
z AS (SELECT *, sum(length(to_json({{'query_id': query_id, 'chunk_id': chunk_id, 'rank': rank, 'snippet': substring(text, 1, 220)}})) + 1) OVER w + 1 AS a, sum(length(to_json({{'query_id': query_id, 'chunk_id': chunk_id, 'rank': rank, 'snippet': substring(text, 1, 110)}})) + 1) OVER w + 1 AS b,
  sum(length(to_json({{'query_id': query_id, 'chunk_id': chunk_id, 'rank': rank, 'snippet': substring(text, 1, 60)}})) + 1) OVER w + 1 AS c, sum(length(to_json({{'query_id': query_id, 'chunk_id': chunk_id, 'rank': rank, 'snippet': substring(text, 1, 60)}})) + 1) OVER (PARTITION BY query_id ORDER BY rank) + 1 AS upto FROM t WINDOW w AS (PARTITION BY query_id))
SELECT query_id, chunk_id, rank, substring(text, 1, CASE WHEN a <= 320 THEN 220 WHEN b <= 320 THEN 110 ELSE 60 END) AS snippet FROM z WHERE a <= 320 OR b <= 320 OR c <= 320 OR rank = 1 OR upto <= 320""")
def budget_shrink(spark, sf):
    hits = search.lexical(queries(spark, sf), index(spark, sf)).join(chunks(spark, sf).drop("doc_id"), "chunk_id").select("query_id", "chunk_id", "rank", F.substring("text", 1, 220).alias("snippet"))
    return search.fit_budget(hits, 80)


@query(f"""WITH {LEX}, r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 10), chunk_id) AS rank FROM hits)
SELECT query_id, rank, doc_id, lang, source AS source_id FROM r JOIN (SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source FROM documents) USING (doc_id) WHERE rank <= 10""")
def bulk_topk(spark, sf):
    hits = search.lexical(queries(spark, sf), index(spark, sf))
    return search.hydrate(hits, chunks(spark, sf), documents(spark, sf).select("doc_id", "lang", "source_id")).select("query_id", "rank", "doc_id", "lang", "source_id")


# citations and text ----------------------------------------------------------------------------
@query("""SELECT turn, conv_id, 'c/' || conv_id || '.md' || CASE turn % 3 WHEN 0 THEN '#L' || (turn + 1) || CASE WHEN turn > 0 THEN '-L' || (2 * turn + 1) ELSE '' END
  WHEN 1 THEN '#p=' || (turn + 1) ELSE '#t=' || printf('%02d:%02d:%02d.%03d', 0, 0, turn + 1, 0) || ',' || printf('%02d:%02d:%02d.%03d', 0, 0, 2 * turn + 1, 0) || '&speaker=' || role END AS uri FROM conversations""")
def citation_uri(spark, sf):
    c = read(spark, sf, "conversations")
    kind = F.when(F.col("turn") % 3 == 0, "line").when(F.col("turn") % 3 == 1, "page").otherwise("time")
    scale = F.when(kind == "time", 1000).otherwise(1)
    return c.select("turn", "conv_id", C.uri(F.concat(F.lit("c/"), F.col("conv_id").cast("string"), F.lit(".md")), kind, (F.col("turn") + 1) * scale, (2 * F.col("turn") + 1) * scale, speaker=F.col("role")).alias("uri"))


@query("SELECT conv_id, turn, 'c/' || conv_id || '.md' AS path, CASE turn % 2 WHEN 0 THEN 'line' ELSE 'page' END AS kind, turn + 1 AS start, turn + 1 + CASE turn % 2 WHEN 0 THEN 4 ELSE 0 END AS \"end\" FROM conversations")
def citation_parse(spark, sf):
    c = read(spark, sf, "conversations")
    kind = F.when(F.col("turn") % 2 == 0, "line").otherwise("page")
    u = C.uri(F.concat(F.lit("c/"), F.col("conv_id").cast("string"), F.lit(".md")), kind, F.col("turn") + 1, F.col("turn") + 5)
    return c.select("conv_id", "turn", C.parse(u).alias("p")).select("conv_id", "turn", "p.path", "p.kind", "p.start", "p.end")


@query("SELECT doc_id, CAST(ceil(strlen(text) / 3.0) AS BIGINT) AS chunk_tokens, CAST(ceil(length(text) / 4.0) AS BIGINT) AS prompt_tokens FROM documents")
def token_estimates(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.chunk_token_estimate(F.col("text")).alias("chunk_tokens"), T.prompt_token_estimate(F.col("text")).alias("prompt_tokens"))


@query(f"SELECT g, count(*) AS n FROM (SELECT unnest(list_transform(range(1, CAST(length(t) AS BIGINT)), lambda k: substring(t, k, 2))) AS g FROM (SELECT unnest({sql_tokens('text')}) AS t FROM documents) WHERE length(t) >= 3) GROUP BY g")
def hangul_style_bigrams(spark, sf):
    t = read(spark, sf, "documents").select(F.explode(T.tokens(F.col("text"))).alias("t"))
    return t.select(F.explode(T.bigrams(F.col("t"))).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))


#: Documents as they are, with two kana and a box, with the mark of a missing table once, with nothing but such marks, and mostly such marks.
_QUALITY = "CASE n % 5 WHEN 0 THEN text WHEN 1 THEN text || 'ア゠□' WHEN 2 THEN text || '?Identity-H Unimplemented?' WHEN 3 THEN repeat('?Identity-H Unimplemented? ', 3) ELSE 'ok □□' || repeat('?Identity-H Unimplemented?', 4) END"


@query(rf"""WITH {SQL_DOCS}, t AS (SELECT doc_id, {_QUALITY} AS t FROM docs), c AS (SELECT doc_id, t, replace(t, '?Identity-H Unimplemented?', '') AS c FROM t),
r AS (SELECT *, CASE WHEN length(c) = 0 THEN 0 ELSE length(regexp_replace(c, '[^\x09\x0A\x0D\x20-\x7E\x{{A0}}-\x{{24F}}\x{{1100}}-\x{{11FF}}\x{{3130}}-\x{{318F}}\x{{4E00}}-\x{{9FFF}}\x{{AC00}}-\x{{D7A3}}\x{{2010}}\x{{2013}}\x{{2014}}\x{{2015}}\x{{2018}}\x{{2019}}\x{{201C}}\x{{201D}}\x{{201E}}\x{{2026}}\x{{2027}}\x{{2032}}\x{{2033}}]', '', 'g')) / length(c) END AS share FROM c)
SELECT doc_id, round(CAST(CASE WHEN t <> c AND trim(c) = '' THEN 0 WHEN t <> c AND strlen(t) - strlen(c) > strlen(c) THEN least(share, 0.3) ELSE share END AS DOUBLE), 6) AS quality FROM r""")
def text_quality_ratio(spark, sf):
    d = documents(spark, sf).withColumn("t", F.expr(_QUALITY))
    return d.select("doc_id", F.round(T.text_quality(F.col("t")), 6).alias("quality"))


#: Pages behind each mark of a generated file and behind what only looks like one.
_MARKED = "concat(element_at(array('// @Generated by x', '# code generated by y', 'DO NOT EDIT', '/* do not modify */', 'automatically generated', 'Auto-Generated', 'autogenerated file', 'this file was generated', 'generated'), CAST(page_id % 9 + 1 AS INT)), chr(10), html)"
_FIRST = "CASE WHEN strlen(t) <= 512 THEN t ELSE coalesce(substring(t, 1, list_position(list_transform(range(1, 513), lambda k: strlen(substring(t, 1, k))), 512)), '') END"


@query(f"""WITH p AS (SELECT page_id, (['// @Generated by x', '# code generated by y', 'DO NOT EDIT', '/* do not modify */', 'automatically generated', 'Auto-Generated', 'autogenerated file', 'this file was generated', 'generated'])[page_id % 9 + 1] || chr(10) || html AS t FROM pages),
f AS (SELECT page_id, lower(array_to_string(string_split({_FIRST}, chr(10))[1:10], chr(10))) AS h FROM p)
SELECT page_id, contains(h, '@generated') OR contains(h, 'code generated by') OR contains(h, 'do not edit') OR contains(h, 'do not modify') OR contains(h, 'automatically generated') OR contains(h, 'auto-generated') OR contains(h, 'autogenerated') AS generated FROM f""")
def generated_marker(spark, sf):
    return read(spark, sf, "pages").select("page_id", T.is_generated(F.expr(_MARKED)).alias("generated"))


@query("SELECT page_id, strlen(html) > 2000 OR len(string_split(html, chr(10))) - CASE WHEN html = '' OR ends_with(html, chr(10)) THEN 1 ELSE 0 END > 40 AS oversize FROM pages")
def oversize_filter(spark, sf):
    return read(spark, sf, "pages").select("page_id", T.is_oversize(F.col("html"), 2000, 40).alias("oversize"))


@query(f"WITH {SQL_DOCS} SELECT doc_id, CASE n % 6 WHEN 0 THEN 'markdown' WHEN 1 THEN 'pdf' WHEN 2 THEN 'image' WHEN 3 THEN 'audio' WHEN 4 THEN 'code' ELSE 'other' END AS media FROM docs")
def media_kind(spark, sf):
    return documents(spark, sf).select("doc_id", T.media_kind(F.col("workspace_path")).alias("media"))


@query(f"""WITH {SQL_DOCS} SELECT doc_id, CASE WHEN regexp_matches(workspace_path, '^notes/src1/.*$') THEN 'gitignore' WHEN ends_with(workspace_path, '.png') THEN 'ownignore' WHEN lang = 'de' THEN 'not_included' END AS skip FROM docs""")
def ignore_category(spark, sf):
    return documents(spark, sf).select("doc_id", files.skip_category(F.col("workspace_path"), gitignore=["notes/src1/**"], ownignore=["**/*.png"], include=["**/en/*", "**/fr/*", "**/es/*"]).alias("skip"))


@query(f"""WITH {SQL_DOCS} SELECT doc_id, CASE n % 3 WHEN 0 THEN 'T' || doc_id WHEN 1 THEN 'H' || doc_id ELSE 'doc' || doc_id END AS title FROM docs""")
def title_precedence(spark, sf):
    d, none = documents(spark, sf), F.lit(None).cast("string")
    at = lambda k, p: F.when(F.col("n") % 3 == k, F.concat(F.lit(p), "doc_id"))
    return d.select("doc_id", T.title(at(0, "T"), at(1, "H"), none, F.when(F.col("n") % 3 == 2, " "), F.col("workspace_path")).alias("title"))


# chunks ----------------------------------------------------------------------------------------
def _windows_sql(w: int, o: int) -> str:
    return f"""WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, string_split(text, chr(10)) AS x FROM documents), s AS (SELECT doc_id, x, unnest(range(0, greatest(0, len(x) - {o} - 1) + 1, {w - o})) AS s FROM l)
SELECT doc_id, s // {w - o} AS ordinal, s + 1 AS start, least(s + {w}, len(x)) AS "end", array_to_string(x[s + 1:s + {w}], chr(10)) AS text FROM s"""


@query(_windows_sql(10, 3))
def chunk_line_windows(spark, sf):
    return chunk.line_windows(documents(spark, sf), 10, 3).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("""WITH l AS (SELECT CAST(page_id AS VARCHAR) AS doc_id, unnest(string_split(html, chr(10))) AS line, generate_subscripts(string_split(html, chr(10)), 1) AS k FROM pages),
i AS (SELECT *, sum(CASE WHEN regexp_full_match(line, '\\s*') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS island FROM l)
SELECT doc_id, min(k) AS start, max(k) AS "end", string_agg(line, chr(10) ORDER BY k) AS text FROM i WHERE NOT regexp_full_match(line, '\\s*') GROUP BY doc_id, island""")
def chunk_paragraph_islands(spark, sf):
    p = read(spark, sf, "pages").select(F.col("page_id").cast("string").alias("doc_id"), F.col("html").alias("text"))
    return chunk.paragraphs(p)


# statistics ------------------------------------------------------------------------------------
@query(f"WITH {SQL_DOCS} SELECT (SELECT count(*) FROM docs) AS n_docs, (SELECT max(updated_at) FROM docs) AS last_updated, (SELECT count(*) FROM documents) AS n_chunks, (SELECT count(*) FROM pages) AS n_assets")
def stats_counts(spark, sf):
    return stats.counts(documents(spark, sf), chunks(spark, sf), read(spark, sf, "pages")).withColumn("last_updated", F.col("last_updated").cast("timestamp_ntz"))


@query(f"WITH {SQL_DOCS}, m AS (SELECT CASE n % 6 WHEN 0 THEN 'markdown' WHEN 1 THEN 'pdf' WHEN 2 THEN 'image' WHEN 4 THEN 'code' END AS media FROM docs WHERE n % 6 IN (0, 1, 2, 4)) SELECT coalesce(k.media, m.media) AS media, count(m.media) AS n FROM (VALUES ('markdown'), ('pdf'), ('image'), ('audio'), ('other')) k(media) FULL JOIN m ON k.media = m.media GROUP BY 1")
def stats_media_zero_padded(spark, sf):
    d = documents(spark, sf).withColumn("media", T.media_kind(F.col("workspace_path")))
    return stats.by_media(d.where("media not in ('audio', 'other')"))


@query("SELECT coalesce(CASE WHEN lang <> 'de' THEN lang END, 'null') AS value, count(*) AS n FROM documents GROUP BY 1")
def stats_lang_null(spark, sf):
    d = read(spark, sf, "documents")
    return stats.by_value(d, F.when(F.col("lang") != "de", F.col("lang")), "null")


@query("SELECT json_extract_string(props, '$.k') AS value, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1")
def stats_json_breakdown(spark, sf):
    return stats.by_value(read(spark, sf, "events"), F.get_json_object("props", "$.k"))


@query(f"WITH {SQL_DOCS} SELECT count(*) FILTER (updated_at < TIMESTAMP '2024-01-30 00:00:00') AS n_stale FROM docs")
def stats_stale(spark, sf):
    return stats.stale_count(documents(spark, sf), datetime(2024, 2, 29), 30)


@query(f"WITH {SQL_EVENTS} SELECT count(*) AS n_events, count(*) FILTER (success) AS n_success, count(*) FILTER (NOT success) AS n_failure, count(DISTINCT run_id) AS n_runs, round(avg(CAST(success AS INT)), 4) AS success_rate FROM ocr")
def ocr_stats(spark, sf):
    return stats.ocr_stats(ocr_events(spark, sf))


@query(f"""WITH {SQL_EVENTS}, l AS (SELECT engine, list_sort(list(ms)) AS s, count(ms) AS c FROM ocr WHERE ms IS NOT NULL GROUP BY engine)
SELECT engine, s[(c - 1) * 50 // 100 + 1] AS p50, s[(c - 1) * 90 // 100 + 1] AS p90, s[(c - 1) * 99 // 100 + 1] AS p99, s[c] AS max FROM l""")
def ocr_percentiles(spark, sf):
    return stats.lower_percentile(ocr_events(spark, sf), "ms", by=["engine"])


@query(f"WITH {SQL_EVENTS} SELECT doc_id, count(*) AS failures FROM ocr WHERE NOT success GROUP BY doc_id ORDER BY failures DESC, doc_id LIMIT 10")
def ocr_top_failing(spark, sf):
    return stats.top_failing(ocr_events(spark, sf))


@query(f"WITH {SQL_DOCS} SELECT doc_id, workspace_path, count(c.page_id) AS n_chunks FROM docs LEFT JOIN pages c ON c.page_id = docs.n GROUP BY ALL")
def list_docs_summary(spark, sf):
    pages = read(spark, sf, "pages").select(F.col("page_id").cast("string").alias("doc_id"))
    return stats.doc_summaries(documents(spark, sf), pages).select("doc_id", "workspace_path", "n_chunks")


# lookups ---------------------------------------------------------------------------------------
@query("""WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, string_split(text, chr(10)) AS x FROM documents)
SELECT doc_id, CASE WHEN len(x) >= 3 THEN array_to_string(x[3:5], chr(10)) ELSE '' END AS span_text, CAST(CASE WHEN len(x) < 3 THEN 2 ELSE least(5, len(x)) END AS INTEGER) AS effective_end FROM l""")
def fetch_span(spark, sf):
    return stats.fetch_span(documents(spark, sf), 3, 5)


@query("""WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, conv_id || '-' || turn AS chunk_id, turn AS ordinal FROM conversations), t AS (SELECT * FROM c WHERE ordinal = 1)
SELECT t.chunk_id AS target, doc_id, c.chunk_id, c.ordinal FROM t JOIN c USING (doc_id) WHERE abs(c.ordinal - t.ordinal) <= 1""")
def fetch_context(spark, sf):
    c = read(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), F.col("turn").alias("ordinal"))
    return stats.neighbours(c, c.where("ordinal = 1").select("chunk_id"))


# evaluation ------------------------------------------------------------------------------------
GOLD = """g AS (SELECT q.chunk_id AS query_id, list(x.chunk_id) FILTER (x.n % 10 = 1) AS expected FROM e q JOIN e x ON q.label = x.label WHERE q.n % 50 = 0 GROUP BY 1),
h AS (SELECT * FROM (SELECT query_id, chunk_id AS doc_id, n, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, chunk_id) AS rank FROM vs) WHERE rank <= 10),
f AS (SELECT g.query_id, coalesce(len(expected), 0) AS ne, min(rank) FILTER (list_contains(expected, doc_id)) AS fr, """ + ", ".join(f"count(*) FILTER (list_contains(expected, doc_id) AND rank <= {k}) AS r{k}" for k in evals.KS) + " FROM g LEFT JOIN h USING (query_id) GROUP BY g.query_id, expected)"


def golden(spark: SparkSession, sf: str) -> DataFrame:
    """Vector queries; expected are the vectors of the same label whose ids end in 1."""
    e = embeddings(spark, sf)
    byl = e.where("n % 10 = 1").groupBy("label").agg(F.collect_list("chunk_id").alias("expected_doc_ids"))
    none = F.array().cast("array<string>")
    return vector_queries(spark, sf).select("query_id", "label").join(byl, "label", "left").select("query_id", F.col("expected_doc_ids"), F.col("expected_doc_ids").alias("expected_chunk_ids"), none.alias("must_contain"), none.alias("forbidden"), F.col("label").cast("string").alias("group"))


def _vec_hits(spark: SparkSession, sf: str, k: int = 10, where: str = "true") -> DataFrame:
    return search.vector(vector_queries(spark, sf), embeddings(spark, sf).where(where), k)


def _avg(v: str, cond: str = "ne > 0") -> str:
    return f"round(coalesce(avg({v}) FILTER ({cond}), 0), 4)"


@query(f"WITH {VEC}, {GOLD} SELECT " + ", ".join(f"{_avg(f'CASE WHEN fr <= {k} THEN 1.0 ELSE 0.0 END')} AS hit_at_{k}" for k in evals.KS) + f", {_avg('CASE WHEN fr <= 10 THEN 1.0 / fr ELSE 0.0 END')} AS mrr FROM f")
def eval_hit_mrr(spark, sf):
    return evals.metrics(golden(spark, sf), _vec_hits(spark, sf)).select(*[f"hit_at_{k}" for k in evals.KS], "mrr")


@query(f"WITH {VEC}, {GOLD} SELECT " + ", ".join(f"{_avg(f'r{k} / {k}.0')} AS precision_at_{k}" for k in evals.KS) + " FROM f")
def eval_precision(spark, sf):
    return evals.metrics(golden(spark, sf), _vec_hits(spark, sf)).select(*[f"precision_at_{k}" for k in evals.KS])


@query(f"WITH {VEC}, {GOLD} SELECT " + ", ".join(f"{_avg(f'r{k} / CAST(ne AS DOUBLE)')} AS recall_at_{k}" for k in evals.KS) + " FROM f")
def eval_recall_doc(spark, sf):
    return evals.metrics(golden(spark, sf), _vec_hits(spark, sf)).select(*[f"recall_at_{k}" for k in evals.KS])


def _answers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = read(spark, sf, "conversations").where("role = 'assistant'").withColumn("query_id", F.concat_ws("-", "conv_id", "turn"))
    none = F.array().cast("array<string>")
    g = c.select("query_id", F.array(F.lit("the")).alias("must_contain"), F.array(F.lit("$$$")).alias("forbidden"), F.when(F.col("turn") % 2 == 0, none).otherwise(F.array(F.lit("x"))).alias("expected_doc_ids"))
    a = c.select("query_id", F.col("text").alias("answer"), (F.col("turn") % 3 == 0).alias("grounded"), F.when(F.col("turn") % 4 == 0, F.array(F.lit("p"), F.lit(""))).otherwise(F.array(F.lit("p"))).alias("citations"), F.when(F.col("conv_id") % 10 == 0, "e").alias("error"))
    return g, a


_A = "(SELECT *, contains(text, 'the') AND NOT contains(text, '$$$') AS holds FROM conversations WHERE role = 'assistant')"


@query(f"SELECT coalesce(round(avg(CAST(holds AS INT)) FILTER (conv_id % 10 <> 0), 4), 0) AS groundedness FROM {_A}")
def eval_groundedness(spark, sf):
    return evals.answer_metrics(*_answers(spark, sf)).select("groundedness")


@query(f"SELECT round(avg(CASE WHEN turn % 4 = 0 THEN 0.0 ELSE 1.0 END) FILTER (turn % 3 = 0), 4) AS citation_coverage, round(avg(CASE WHEN turn % 3 = 0 THEN 0.0 ELSE 1.0 END) FILTER (turn % 2 = 0), 4) AS refusal_correctness FROM {_A}")
def eval_refusal_citation(spark, sf):
    return evals.answer_metrics(*_answers(spark, sf)).select("citation_coverage", "refusal_correctness")


@query(f"WITH {LEX}, r AS (SELECT q.query_id, count(hits.chunk_id) AS n FROM q LEFT JOIN hits USING (query_id) GROUP BY q.query_id) SELECT count(*) AS total, count(*) FILTER (CAST(query_id AS INT) % 9 = 0) AS failed, round(avg(CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END), 4) AS empty_result_rate FROM r")
def eval_totals(spark, sf):
    hits = search.match_scores(queries(spark, sf), index(spark, sf)).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    run = queries(spark, sf).join(hits, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n_hits"), (F.col("query_id").cast("int") % 9 == 0).alias("failed"))
    return evals.metrics(golden(spark, sf), _vec_hits(spark, sf), run=run).select("total", "failed", "empty_result_rate")


@query(f"""WITH {VEC}, {GOLD}, h2 AS (SELECT * FROM (SELECT query_id, chunk_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, chunk_id) AS rank FROM vs WHERE n % 3 <> 0) WHERE rank <= 10),
f2 AS (SELECT g.query_id, min(rank) FILTER (list_contains(expected, doc_id)) AS fr FROM g LEFT JOIN h2 USING (query_id) GROUP BY g.query_id)
SELECT query_id, f.fr AS a_rank, f2.fr AS b_rank, CASE WHEN f.fr IS NULL AND f2.fr IS NULL THEN 'draw' WHEN f.fr IS NULL THEN 'win' WHEN f2.fr IS NULL THEN CASE WHEN ne > 0 THEN 'regression' ELSE 'loss' END
  WHEN f2.fr < f.fr THEN 'win' WHEN f2.fr > f.fr THEN 'loss' ELSE 'draw' END AS kind FROM f JOIN f2 USING (query_id)""")
def eval_compare(spark, sf):
    g = golden(spark, sf)
    return evals.compare(evals.first_ranks(g, _vec_hits(spark, sf)), evals.first_ranks(g, _vec_hits(spark, sf, where="n % 3 <> 0")), g)


@query(f"""WITH {VEC}, {GOLD.replace('rank <= 10) ,', 'rank <= 50) ,')}, w AS (SELECT * FROM (SELECT query_id, chunk_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, chunk_id) AS rank FROM vs) WHERE rank <= 50),
v AS (SELECT g.query_id, any_value(coalesce(len(expected), 0)) AS n, count(*) FILTER (list_contains(expected, doc_id) AND rank <= 10) AS cn, count(*) FILTER (list_contains(expected, doc_id)) AS cw, max(rank) AS deepest FROM g LEFT JOIN w USING (query_id) GROUP BY g.query_id),
c AS (SELECT label, CASE WHEN v.n > 0 THEN cn / CAST(v.n AS DOUBLE) ELSE 0 END AS rn, deepest, CASE WHEN v.n = 0 THEN 'no_expected' WHEN cn = v.n THEN 'ok' WHEN cw > cn THEN 'misranked' ELSE 'missing' END AS kind FROM v JOIN e ON e.chunk_id = v.query_id)
SELECT CAST(label AS VARCHAR) AS "group", round(max(rn) - min(rn), 4) AS spread, round(min(rn), 4) AS worst, bool_and(kind = 'ok') AS consistent, count(*) FILTER (kind = 'misranked') AS n_misranked, count(*) FILTER (kind = 'missing') AS n_missing, coalesce(max(deepest), 0) < 50 AS pool_possibly_truncated FROM c GROUP BY label""")
def eval_variants(spark, sf):
    return evals.variant_groups(evals.variants(golden(spark, sf), _vec_hits(spark, sf, 50)))


@query("""SELECT 'unknown_doc' AS fault, CAST(item_id AS VARCHAR) AS key FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'duplicate_id', CAST(turn AS VARCHAR) FROM conversations GROUP BY turn HAVING count(*) > 1
UNION ALL SELECT 'group_mismatch', role FROM conversations GROUP BY role HAVING count(DISTINCT turn) > 1 UNION ALL SELECT 'unknown_doc', k FROM (SELECT DISTINCT 't' || turn AS k FROM conversations)""")
def golden_integrity(spark, sf):
    b = read(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.lit(None).cast("string").alias("group"), F.array(F.col("item_id").cast("string")).alias("expected_doc_ids"))
    c = read(spark, sf, "conversations").select(F.col("turn").cast("string").alias("id"), F.col("role").alias("group"), F.array(F.concat(F.lit("t"), F.col("turn").cast("string"))).alias("expected_doc_ids"))
    return files.golden_faults(b, documents(spark, sf)).unionByName(files.golden_faults(c, documents(spark, sf)))


# storage ---------------------------------------------------------------------------------------
def _stored(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = documents(spark, sf).select("workspace_path", "doc_id", F.sha2("text", 256).alias("asset_id"), F.lit("p1").alias("parser_version"), F.lit("c1").alias("chunker_version"), F.lit("e1").alias("embedding_version"), "n")
    stored = d.where("n % 5 <> 0").withColumn("asset_id", F.when(F.col("n") % 5 == 1, "old").otherwise(F.col("asset_id")))
    return d.where("n % 5 <> 4"), stored


@query(f"WITH {SQL_DOCS} SELECT doc_id, CASE n % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'updated' ELSE 'unchanged' END AS status FROM docs WHERE n % 5 <> 4")
def ingest_status(spark, sf):
    return store.ingest_status(*_stored(spark, sf)).select("doc_id", "status")


@query(f"WITH {SQL_DOCS} SELECT doc_id FROM docs WHERE n % 5 = 4 AND n % 2 = 0")
def deleted_sweep(spark, sf):
    scanned, stored = _stored(spark, sf)
    return store.deleted(stored, scanned, documents(spark, sf).where("n % 2 = 1")).select("doc_id")


@query(f"WITH {SQL_DOCS} SELECT doc_id, CASE WHEN n % 5 = 0 THEN 1 WHEN n % 3 = 0 THEN 4 ELSE 3 END AS doc_version, n % 5 <> 0 AND n % 3 <> 0 AS untouched FROM docs WHERE n % 5 <> 0 OR n % 3 = 0")
def upsert_versions(spark, sf):
    d, then, now = documents(spark, sf), datetime(2024, 1, 1), datetime(2024, 6, 1)
    stored = d.where("n % 5 <> 0").select("doc_id", "text", F.lit(3).alias("doc_version"), F.lit(then).alias("created_at"), F.lit(then).alias("updated_at"))
    got = store.upsert(stored, d.where("n % 3 = 0").select("doc_id", "text"), now)
    return got.select("doc_id", "doc_version", (F.col("updated_at") == F.lit(then)).alias("untouched"))


@query(f"""WITH {SQL_DOCS}, kept AS (SELECT * FROM docs WHERE lang <> 'de') SELECT 'documents' AS tbl, count(*) AS n FROM kept UNION ALL SELECT 'chunks', count(*) FROM kept
UNION ALL SELECT 'embeddings', count(*) FROM embeddings WHERE vec_id IN (SELECT n FROM kept) UNION ALL SELECT 'assets', count(*) FROM (SELECT DISTINCT source_id, lang FROM docs) WHERE lang <> 'de'""")
def cascade_purge(spark, sf):
    d = documents(spark, sf).withColumn("asset_id", F.concat_ws("/", "source_id", "lang"))
    got = store.purge(d.where("lang = 'de'"), d, chunks(spark, sf), embeddings(spark, sf), d.select("asset_id").distinct())
    out = None
    for name, df in got.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT CASE WHEN hit THEN 'hit' ELSE 'miss' END AS kind, CASE WHEN hit THEN count(*) ELSE count(DISTINCT text) END AS n FROM (SELECT text, bool_or(doc_id % 4 = 0) OVER (PARTITION BY text) AS hit FROM documents) GROUP BY hit")
def cache_hit_miss(spark, sf):
    wanted = read(spark, sf, "documents").select("doc_id", store.cache_key("embed", F.col("text")).alias("cache_key"))
    cache = wanted.where("doc_id % 4 = 0").select("cache_key").distinct().withColumn("payload", F.lit("x"))
    hits, misses = store.cache_split(wanted, cache)
    return hits.agg(F.count(F.lit(1)).alias("n")).select(F.lit("hit").alias("kind"), "n").unionByName(misses.agg(F.count(F.lit(1)).alias("n")).select(F.lit("miss").alias("kind"), "n"))


@query(f"WITH {SQL_EVENTS} SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id) AS r FROM ocr WHERE ts >= TIMESTAMP '2024-01-10 00:00:00') WHERE r <= 5")
def retention_prune(spark, sf):
    return store.retain(ocr_events(spark, sf), datetime(2024, 2, 1), 22, keep=5).select("event_id")


# answers ---------------------------------------------------------------------------------------
_CONV = "(SELECT CAST(conv_id AS VARCHAR) AS query_id, turn + 1 AS rank, role, text, conv_id || '-' || turn AS chunk_id FROM conversations)"


def _conv_hits(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("query_id"), (F.col("turn") + 1).alias("rank"), F.col("role").alias("source"), F.lit(None).cast("string").alias("trust"), F.concat_ws("-", "conv_id", "turn").alias("doc"), F.lit("h").alias("heading"), F.lit("s").alias("span"), "text", F.concat_ws("-", "conv_id", "turn").alias("chunk_id"))


@query(f"""WITH h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS m FROM {_CONV}),
b AS (SELECT query_id, m, chunk_id, CAST(sum(ceil(length('[#' || m || '] source=' || role || ' trust=unknown doc=' || chunk_id || ' heading=h span=s' || chr(10) || text) / 4.0)) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS used_tokens FROM h)
SELECT query_id, CAST(m AS INTEGER) AS marker, chunk_id, used_tokens FROM b WHERE m = 1 OR used_tokens <= 120""")
def pack_context(spark, sf):
    return rag.pack_context(_conv_hits(spark, sf), 120).select("query_id", "marker", "chunk_id", "used_tokens")


@query(_lex_sql(k=10).replace("SELECT query_id, chunk_id, doc_id, round", "SELECT q0.query_id, max(s.score) AS top_score, CASE WHEN max(s.score) IS NULL THEN 'no_chunks' WHEN max(s.score) < 0.8 THEN 'score_gate' END AS refusal FROM (SELECT query_id FROM q) q0 LEFT JOIN (SELECT query_id, round", 1).replace("WHERE rank <= 10", "WHERE rank <= 10) s USING (query_id) GROUP BY q0.query_id"))
def score_gate(spark, sf):
    got = rag.gate(queries(spark, sf), search.lexical(queries(spark, sf), index(spark, sf)), 0.8)
    return got.select("query_id", F.round("top_score", 6).alias("top_score"), "refusal")


@query("""SELECT conv_id || '-' || turn AS query_id, turn % 4 IN (0, 1) AS grounded, CASE turn % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'a,b' WHEN 2 THEN '' ELSE 'b' END AS cites FROM conversations""")
def answer_markers(spark, sf):
    c = read(spark, sf, "conversations").withColumn("query_id", F.concat_ws("-", "conv_id", "turn"))
    tail = F.element_at(F.array(*map(F.lit, (" x [#1]", " y [#2] [#1] [#2]", " z [1]", " w [#2] [#9]"))), (F.col("turn") % 4 + 1).cast("int"))
    answers = c.select("query_id", F.concat(F.regexp_replace("text", r"\[#", ""), tail).alias("answer"), F.lit(False).alias("cancelled"))
    packed = c.select("query_id", F.explode(F.array(F.struct(F.lit(1).alias("marker"), F.lit("a").alias("chunk_id")), F.struct(F.lit(2).alias("marker"), F.lit("b").alias("chunk_id")))).alias("p")).select("query_id", "p.*")
    return rag.verdict(answers, packed).select("query_id", "grounded", F.array_join("citations", ",").alias("cites"))


@query("""WITH h AS (SELECT role AS query_id, conv_id AS sub_q, turn AS rank, CAST(length(text) % 40 AS VARCHAR) AS chunk_id FROM conversations),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY sub_q, rank) AS r FROM h) WHERE r = 1)
SELECT query_id, chunk_id, sub_q, rank, pool_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sub_q, rank, chunk_id) AS pool_rank FROM o) WHERE pool_rank <= 15""")
def multihop_pool(spark, sf):
    h = read(spark, sf, "conversations").select(F.col("role").alias("query_id"), F.col("conv_id").alias("sub_q"), F.col("turn").alias("rank"), (F.length("text") % 40).cast("string").alias("chunk_id"))
    return rag.pool(h).select("query_id", "chunk_id", "sub_q", "rank", "pool_rank")


# plain shapes ----------------------------------------------------------------------------------
@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def agg_pricing(spark, sf):
    li = read(spark, sf, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS n_orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def join_revenue_by_nation(spark, sf):
    t = lambda n: read(spark, sf, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count_distinct("o_orderkey").alias("n_orders"))


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def window_top_orders(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return read(spark, sf, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rank")).where("rank <= 3")
