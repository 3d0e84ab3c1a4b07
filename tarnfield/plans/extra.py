"""Further named queries: parsing, filters on labels, lookups, jobs, runs and fixtures with written-out answers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tarnfield.functions import citation as C
from tarnfield.functions import text as T
from tarnfield.operators import chunk, evals, rag, search, stats, store
from tarnfield.plans.adapters import SQL_DOCS, SQL_EVENTS, SQL_WORDS, documents, embeddings, index, ocr_events, read, vector_queries, word_queries
from tarnfield.plans.queries import GOLD, VEC, _lex, _lex_sql, _rounded, _stored, _vec_hits, golden, query
from tarnfield.sources import files, markdown, wire

# files -----------------------------------------------------------------------------------------
_PATHS = ("node_modules/a.js", "a/target/b.rs", "x/__pycache__/c.py", ".venv/z", "pkg/venv/q.md", "env/r", "environment/s.md", ".git/config", "dist/t.js", "d/.DS_Store", "d/._x.md", "kept.md")
_LISTED = "element_at(array(" + ", ".join(f"'{p}'" for p in _PATHS) + "), CAST(n % 12 + 1 AS INT))"


@query(f"""WITH {SQL_DOCS} SELECT doc_id, CASE WHEN n % 12 <= 5 THEN 'builtin' WHEN n % 12 IN (9, 10) THEN 'other' END AS skip FROM docs""")
def ignore_builtin(spark, sf):
    return documents(spark, sf).select("doc_id", files.skip_category(F.expr(_LISTED)).alias("skip"))


@query(f"""WITH {SQL_DOCS} SELECT doc_id, CASE WHEN n % 5 = 0 THEN 'gitignore' WHEN n % 5 = 1 THEN 'ownignore' WHEN n % 5 = 2 AND n % 3 <> 0 THEN 'gitignore' END AS skip FROM docs""")
def ignore_lines(spark, sf):
    """Lines of ignore files: folders, anchors, the last line that fits, and what the own file takes back."""
    d = documents(spark, sf)
    path = F.concat(F.element_at(F.array(*map(F.lit, ("build/", "tmp/", "logs/", "docs/", "src/"))), (F.col("n") % 5 + 1).cast("int")), F.when(F.col("n") % 3 == 0, "keep").otherwise("doc"), F.col("doc_id"), F.lit(".txt"))
    return d.select("doc_id", files.skip_category(path, gitignore=["# no", "build/", "logs", "!/logs/keep*", "doc7*/", "/keep*"], ownignore=["tmp/**", "env/**", "!env/x"]).alias("skip"))


_TYPES = (
    ("a.md", "markdown", None), ("a.mdx", "markdown", None), ("a.markdown", "other", None), ("a.PDF", "pdf", None), ("a.tif", "image", None), ("a.tiff", "image", None), ("a.ogg", "audio", None), ("a.pyi", "code", "python"), ("a.mts", "code", "typescript"),
    ("a.cts", "code", "typescript"), ("a.mjs", "code", "javascript"), ("a.cjs", "code", "javascript"), ("a.hh", "code", "cpp"), ("a.hxx", "code", "cpp"), ("a.zsh", "code", "shell"), ("a.mk", "code", "make"), ("a.gradle", "code", "groovy"),
    ("go.mod", "code", "go-mod"), ("GNUmakefile", "code", "make"), ("Makefile", "code", "make"), ("Dockerfile", "code", "dockerfile"), ("Dockerfile.dev", "code", "dockerfile"), ("Dockerfile.", "other", None), ("build.gradle", "code", "groovy"),
    ("pom.xml", "code", "xml"), ("Cargo.toml", "code", "toml"), (".py", "other", None), ("a.txt", "other", None), ("noext", "other", None), ("d.rs/x", "other", None), ("a.b.kts", "code", "kotlin"),
)


def _values(rows: tuple[tuple, ...]) -> str:
    said = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(said, r)) + ")" for r in rows)


@query(f"SELECT d.doc_id, v.path, v.media, v.lang FROM documents d JOIN (SELECT *, row_number() OVER () - 1 AS k FROM (VALUES {_values(_TYPES)}) t(path, media, lang)) v ON d.doc_id % {len(_TYPES)} = v.k")
def media_by_name(spark, sf):
    path = F.element_at(F.array(*[F.lit(p) for p, _, _ in _TYPES]), (F.col("doc_id") % len(_TYPES) + 1).cast("int"))
    return read(spark, sf, "documents").select("doc_id", path.alias("path"), T.media_kind(path).alias("media"), T.code_language(path).alias("lang"))


@query(f"""WITH {SQL_DOCS} SELECT doc_id, CASE n % 6 WHEN 0 THEN 'pkg.m' || doc_id || '.f' WHEN 1 THEN 'pkg.f' WHEN 2 THEN 'lib2.m.f' WHEN 3 THEN 'web/m' || doc_id || '.f' WHEN 4 THEN 'm.f' ELSE 'f' END AS symbol FROM docs""")
def symbol_paths(spark, sf):
    at = {0: F.concat(F.lit("src/pkg/m"), "doc_id", F.lit(".py")), 1: F.lit("lib/pkg/__init__.py"), 2: F.lit("lib2/m.pyi"), 3: F.concat(F.lit("web/m"), "doc_id", F.lit(".test.ts").substr(6, 3)), 4: F.lit("crates/a/src/m.py"), 5: F.lit("__init__.py")}
    path = F
    for k, p in at.items():
        path = path.when(F.col("n") % 6 == k, p)
    return documents(spark, sf).select("doc_id", T.symbol_path(path, F.lit("f")).alias("symbol"))


# parsing ---------------------------------------------------------------------------------------
def _files(spark, sf, text):
    return documents(spark, sf).select(text.alias("text"), F.concat(F.lit("n/"), "doc_id", F.lit(".md")).alias("workspace_path"), F.concat(F.lit("a"), "doc_id").alias("asset_id"))


@query("""WITH d AS (SELECT 'n/' || doc_id || '.md' AS path, lang, source FROM documents),
b(position, kind, heading_path, ordinal, start, text) AS (SELECT * FROM (VALUES (0, 'heading', [], 0, 1, 'S'), (1, 'paragraph', ['S'], 0, 3, 'one'), (2, 'paragraph', ['S'], 1, 5, 'two'), (3, 'heading', ['S'], 0, 7, 'L'), (4, 'code', ['S', 'L'], 0, 9, 'x = 1'), (5, 'paragraph', ['S', 'L'], 0, 13, 'three'), (6, 'list', ['S', 'L'], 0, 15, 'a' || chr(10) || 'b')) t)
SELECT path AS workspace_path, CAST(position AS INTEGER) AS position, kind, array_to_string(list_transform(heading_path, lambda h: CASE h WHEN 'S' THEN source ELSE lang END), '/') AS heading_path, CAST(ordinal AS INTEGER) AS ordinal, CAST(start AS INTEGER) AS start, CASE text WHEN 'S' THEN source WHEN 'L' THEN lang ELSE text END AS text FROM d, b""")
def markdown_blocks(spark, sf):
    text = F.concat(F.lit("# "), F.col("source_id"), F.lit("\n\none\n\ntwo\n\n## "), F.col("lang"), F.lit("\n\n```py\nx = 1\n```\n\nthree\n\n- a\n- b\n"))
    own = _files(spark, sf, text)
    blocks, docs = markdown.blocks_of(own), markdown.documents_of(own).select("doc_id", "workspace_path")
    return blocks.join(docs, "doc_id").select("workspace_path", "position", "kind", F.array_join("heading_path", "/").alias("heading_path"), "ordinal", "start", "text")


@query(f"""WITH {SQL_DOCS} SELECT 'n/' || doc_id || '.md' AS workspace_path, CASE n % 3 WHEN 0 THEN 'Title ' || doc_id WHEN 1 THEN 'Head' ELSE doc_id END AS title, CASE WHEN n % 3 = 0 THEN lang ELSE 'en' END AS lang,
  CASE WHEN n % 3 = 0 THEN 'a,' || source_id ELSE '' END AS tags, CASE WHEN n % 3 = 0 THEN '2024-01-02T00:00:00+00:00' END AS created_at, CASE WHEN n % 3 = 0 THEN 'secondary' ELSE 'primary' END AS trust_level, CASE WHEN n % 3 = 0 THEN 'v' END AS odd,
  CAST(CASE WHEN n % 3 = 0 THEN 3 WHEN n % 3 = 1 THEN 3 ELSE 4 END AS INTEGER) AS n_events FROM docs""")
def markdown_documents(spark, sf):
    n = F.col("n") % 3
    front = F.concat(F.lit("---\ntitle: Title "), "doc_id", F.lit("\ntags: [a, "), F.col("source_id"), F.lit("]\nlang: "), F.col("lang"), F.lit("\ncreated: 2024-01-02\ntrust_level: secondary\nodd: v\n---\nwords here\n"))
    text = F.when(n == 0, front).when(n == 1, "# Head\n\nplain words here").otherwise("---\n: [\n---\n## \n")
    d = markdown.documents_of(_files(spark, sf, F.when(n == 2, F.lit("---\ntrust_level: odd\n---\n")).otherwise(text)))
    return d.select("workspace_path", "title", F.when(F.col("lang") == "und", "en").otherwise(F.col("lang")).alias("lang"), F.array_join("tags", ",").alias("tags"), "created_at", "trust_level", F.col("user")["odd"].alias("odd"), F.size("provenance").alias("n_events"))


@query(f"""WITH {SQL_DOCS} SELECT doc_id, '# ' || source_id || chr(10) || chr(10) || 'one' || chr(10) || chr(10) || '1. a' || chr(10) || '  - x' || chr(10) || '2. b' AS text FROM docs""")
def markdown_rendered(spark, sf):
    text = F.concat(F.lit("#  "), F.col("source_id"), F.lit(" #\n\n\none\n\n1. a\n   - x\n2. b\n"))
    own = _files(spark, sf, text)
    docs = markdown.documents_of(own).select("doc_id", F.regexp_extract("workspace_path", r"n/(.*)\.md", 1).alias("id"))
    return markdown.rendered(own).join(docs, "doc_id").select(F.col("id").alias("doc_id"), "text")


@query("SELECT doc_id, length(text) < 900 OR doc_id % 7 = 0 AS needs_ocr FROM documents")
def pdf_ocr_pages(spark, sf):
    """Pages with little text, and pages that are mostly marks of missing tables."""
    text = F.when(F.col("doc_id") % 7 == 0, F.repeat(F.lit(T.MOJIBAKE), 300)).otherwise(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", T.needs_ocr(text, 900, 0.5).alias("needs_ocr"))


@query("""WITH s AS (SELECT vec_id, list_transform(range(0, 8), lambda k: embedding[8 * k + 1:8 * k + 8]) AS rows FROM embeddings),
b AS (SELECT vec_id, list_transform(rows, lambda r: list_position(r, list_max(r)) - 1) AS c, list_transform(rows, lambda r: CAST(list_max(r) AS DOUBLE)) AS v FROM s),
k AS (SELECT vec_id, list_filter(range(1, 9), lambda i: c[i] > 0 AND (i = 1 OR c[i] <> c[i - 1])) AS i, c, v FROM b)
SELECT vec_id, array_to_string(list_transform(i, lambda j: substring('abcdefg', c[j], 1)), '') AS text, round(CASE WHEN len(i) > 0 THEN list_sum(list_transform(i, lambda j: v[j])) / len(i) ELSE 0 END, 6) AS confidence FROM k""")
def ctc_decoded(spark, sf):
    steps = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice(F.col("embedding").cast("array<double>"), 8 * k + 1, F.lit(8)))
    got = read(spark, sf, "embeddings").select("vec_id", T.ctc_greedy(steps, F.array(*map(F.lit, "abcdefg"))).alias("r"))
    return got.select("vec_id", "r.text", F.round("r.confidence", 6).alias("confidence"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS taken, round((event_id % 90 + 30 / 60.0 + 36 / 3600.0) * CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END, 6) AS lat FROM events")
def exif_fields(spark, sf):
    e = read(spark, sf, "events")
    ref = F.when(F.col("event_id") % 2 == 0, "s").otherwise("N")
    return e.select("event_id", T.exif_time(F.date_format("ts", "yyyy:MM:dd HH:mm:ss")).alias("taken"), F.round(T.gps_decimal(F.col("event_id") % 90, F.lit(30.0), F.lit(36.0), ref), 6).alias("lat"))


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '한국어,한국,국어,abc' WHEN 1 THEN '서울' ELSE '대한민국,대한,한민,민국,x한국어' END AS tokens FROM conversations")
def korean_bigrams(spark, sf):
    words = F.when(F.col("turn") % 3 == 0, F.array(F.lit("한국어"), F.lit("abc"))).when(F.col("turn") % 3 == 1, F.array(F.lit("서울"))).otherwise(F.array(F.lit("대한민국"), F.lit("x한국어")))
    return read(spark, sf, "conversations").select("conv_id", "turn", F.array_join(T.korean_tokens(words), ",").alias("tokens"))


# fixtures with written-out answers --------------------------------------------------------------
_MD = "intro words\n\n# One\n\nalpha beta\n\ngamma delta\n\n```py\nx = 1\n```\n\n## Two\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n![pic](p.png)\n\n" + "long line of words\n" * 9 + "\n# Three\n"
_MD_CHUNKS = (
    (0, "", "intro words", 1, 1, 4), (1, "One", "One\n\nalpha beta\n\ngamma delta", 3, 7, 10), (2, "One", "x = 1", 9, 11, 2), (3, "One/Two", "Two", 13, 13, 1), (4, "One/Two", "| a | b |\n|---|---|\n| 1 | 2 |", 15, 17, 10), (5, "One/Two", "pic", 19, 19, 0),
    (6, "One/Two", "long line of words\n" * 4 + "long line of words\n", 21, 29, 32), (7, "One/Two", "long line of words\n" * 3 + "long line of words", 21, 29, 25), (8, "Three", "Three", 31, 31, 2),
)


@query(f"SELECT CAST(ordinal AS INTEGER) AS ordinal, heading_path, text, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS \"end\", CAST(tokens AS BIGINT) AS token_estimate FROM (VALUES {_values(_MD_CHUNKS)}) t(ordinal, heading_path, text, start, stop, tokens)")
def md_heading_fixture(spark, sf):
    """Headings bound chunks, code, tables and images stand alone, an image has no tokens, and a long chunk is split without loss."""
    d = spark.createDataFrame([("d", _MD)], "doc_id string, text string")
    return chunk.markdown_chunks(d, 40, 8, 32).select("ordinal", F.array_join("heading_path", "/").alias("heading_path"), "text", "start", "end", "token_estimate")


_PAGES = ((1, "One two three. Four five six! Seven eight nine? Ten."), (2, "Alpha beta.\n\nGamma delta epsilon zeta."), (3, ""))
_PAGE_CHUNKS = ((1, 0, "One two three. Four five six! ", 0, 30), (1, 1, "Four five six! Seven eight nine? ", 15, 48), (1, 2, "Ten.", 48, 52), (2, 0, "Alpha beta.\n\n", 0, 13), (2, 1, "Gamma delta epsilon zeta.", 13, 38))


@query(f"SELECT CAST(page AS INTEGER) AS page, CAST(ordinal AS INTEGER) AS ordinal, text, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS \"end\" FROM (VALUES {_values(_PAGE_CHUNKS)}) t(page, ordinal, text, start, stop)")
def pdf_page_fixture(spark, sf):
    """No chunk crosses a page; chunks end at sentences and blank lines and overlap."""
    d = spark.createDataFrame([("d", p, t) for p, t in _PAGES], "doc_id string, page int, text string")
    return chunk.page_documents(d, 11, 6).select("page", "ordinal", "text", "start", "end")


_SOURCES = (
    ("rust", "use a;\n\n/// doc\npub struct A { x: i32 }\nimpl Show for A {\n    fn show(&self) -> char { '}' }\n}\nmod m { pub fn f() {} }\nmacro_rules! k { () => {} }\n"), ("go", "package p\n\nimport \"fmt\"\n\n// Doc\nfunc F() {}\n\nfunc (r *T) M() {}\n\ntype T struct{}\n"),
    ("java", "package c.x;\nimport a.b;\n\n@Ann\nclass A {\n    A() {}\n    void m(int q) { if (q) { n(); } }\n    enum K { X }\n}\n"), ("kotlin", "package c\n\nclass A {\n    companion object { fun of() = A() }\n}\nfun top() = 1\n"),
    ("typescript", "import { a } from \"b\";\n\nexport class A {\n  m(): void { }\n}\nexport default function () { }\ninterface I { x: string }\n"), ("javascript", "class B {\n  go() { return \"}\"; }\n}\nconst f = () => { };\n"),
    ("c", "#include <a.h>\n\nstruct S { int a; };\ntypedef struct { int b; } T;\nint f(int a)\n{\n    return a;\n}\n"), ("cpp", "namespace n {\nclass C {\n  void m() { }\n};\n}\nvoid n::C::z() { }\n"), ("python", "import x\n\n# note\n@d\ndef f():\n    pass\n\nclass A:\n    def m(self):\n        pass\n"),
)
_UNITS = (
    ("rust", "<module>", 1, 1), ("rust", "A", 3, 4), ("rust", "<top-level>", 5, 5), ("rust", "Show::show", 6, 6), ("rust", "<top-level>", 7, 7), ("rust", "m::f", 8, 8), ("rust", "k!", 9, 9), ("go", "<module>", 1, 3), ("go", "p.F", 5, 6), ("go", "p.(*T).M", 8, 8), ("go", "p.T", 10, 10),
    ("java", "<module>", 1, 2), ("java", "c.x.A", 4, 9), ("java", "c.x.A.A", 6, 6), ("java", "c.x.A.m", 7, 7), ("java", "c.x.A.K", 8, 8), ("kotlin", "<module>", 1, 1), ("kotlin", "c.A", 3, 5), ("kotlin", "c.A.Companion", 4, 4), ("kotlin", "c.A.Companion.of", 4, 4), ("kotlin", "c.top", 6, 6),
    ("typescript", "<module>", 1, 1), ("typescript", "w/u.A", 3, 5), ("typescript", "w/u.A.m", 4, 4), ("typescript", "w/u.default", 6, 6), ("typescript", "w/u.I", 7, 7), ("javascript", "w/u.B", 1, 3), ("javascript", "w/u.B.go", 2, 2), ("javascript", "<top-level>", 4, 4),
    ("c", "<top-level>", 1, 1), ("c", "S", 3, 3), ("c", "T", 4, 4), ("c", "f", 5, 8), ("cpp", "<top-level>", 1, 1), ("cpp", "n::C", 2, 4), ("cpp", "n::C::m", 3, 3), ("cpp", "<top-level>", 5, 5), ("cpp", "n::C::z", 6, 6),
    ("python", "<module>", 1, 1), ("python", "u.f", 3, 6), ("python", "u.A", 8, 10), ("python", "u.A.m", 9, 10),
)
_EXT = {"typescript": "w/u.ts", "javascript": "w/u.js", "python": "src/u.py"}


@query(f"SELECT lang, symbol, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS \"end\" FROM (VALUES {_values(_UNITS)}) t(lang, symbol, start, stop)")
def code_units_fixture(spark, sf):
    """Units, their symbols and lines in nine languages."""
    d = spark.createDataFrame([(lang, t, lang, _EXT.get(lang, "w/u")) for lang, t in _SOURCES], "doc_id string, text string, code_lang string, workspace_path string")
    return chunk.route(d).select(F.col("doc_id").alias("lang"), "symbol", "start", "end")


# filters and lookups ----------------------------------------------------------------------------
def labelled(spark, sf):
    """Documents with media, code language, repository and source type."""
    kinds = F.array(*map(F.lit, ("markdown", "note", "paper", "reference", "inbox")))
    path = F.col("workspace_path")
    return documents(spark, sf).withColumns({"media": T.media_kind(path), "code_lang": T.code_language(path), "repo": F.concat(F.lit("r"), (F.col("n") % 4).cast("string")), "source_type": F.element_at(kinds, (F.col("n") % 5 + 1).cast("int"))})


@query(_lex_sql("n % 6 IN (0, 4) AND n % 5 IN (1, 2)", lex=_lex(SQL_WORDS)))
def lex_media_source_type(spark, sf):
    within = search.Filters(media=["markdown", "code"], source_type=["note", "paper"]).apply(labelled(spark, sf))
    return _rounded(search.lexical(word_queries(spark, sf), index(spark, sf), within=within))


@query(_lex_sql("n % 6 = 4 AND n % 4 IN (0, 2)", lex=_lex(SQL_WORDS)))
def lex_code_lang_repo(spark, sf):
    within = search.Filters(code_lang=["python"], repo=["r0", "r2"]).apply(labelled(spark, sf))
    return _rounded(search.lexical(word_queries(spark, sf), index(spark, sf), within=within))


@query(f"""WITH {SQL_DOCS}, {VEC}, h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, chunk_id) AS rank FROM vs)
SELECT query_id, chunk_id, CASE WHEN rank % 2 = 0 THEN 'own' WHEN docs.n % 6 = 4 THEN 'python' END AS code_lang, 'r' || docs.n % 4 AS repo FROM h LEFT JOIN docs ON docs.doc_id = chunk_id WHERE rank <= 10""")
def hits_with_labels(spark, sf):
    hits = _vec_hits(spark, sf).withColumn("code_lang", F.when(F.col("rank") % 2 == 0, "own"))
    return search.with_labels(hits, labelled(spark, sf)).select("query_id", "chunk_id", "code_lang", "repo")


@query(f"""WITH {VEC}, h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, chunk_id) AS rank FROM vs),
f AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM h WHERE rank <= 18 AND n % 5 = 0) SELECT query_id, chunk_id, rank FROM f WHERE rank <= 3""")
def vec_postfilter(spark, sf):
    """Ranking first and filtering after it, which may leave fewer than k."""
    passing = embeddings(spark, sf).where("n % 5 = 0")
    return search.postfiltered(_vec_hits(spark, sf, 40), passing, 3).select("query_id", "chunk_id", "rank")


@query("""SELECT conv_id, turn, 'p' || conv_id || CASE turn % 5 WHEN 0 THEN '#L' || (turn + 1) || '-L' || (turn + 4) WHEN 1 THEN '#p=' || (turn + 1) WHEN 2 THEN '#xywh=1,2,' || turn || ',4' WHEN 3 THEN '#L1' ELSE '#t=00:00:01.000,00:00:02.500' END AS uri FROM conversations""")
def citation_first_span(spark, sf):
    k = F.col("turn") % 5
    kind = F.element_at(F.array(*map(F.lit, ("code", "page", "region", "byte", "time"))), (k + 1).cast("int"))
    span = F.struct(kind.alias("kind"), F.when(k == 4, 1000).otherwise(F.col("turn") + 1).cast("long").alias("start"), F.when(k == 4, 2500).otherwise(F.col("turn") + 4).cast("long").alias("end"), (F.col("turn") + 1).cast("long").alias("page"), F.array(F.lit(1), F.lit(2), F.col("turn").cast("int"), F.lit(4)).alias("box"), F.lit(None).cast("string").alias("speaker"))
    return read(spark, sf, "conversations").select("conv_id", "turn", C.first_citation(F.array(span, span), F.concat(F.lit("p"), F.col("conv_id").cast("string"))).alias("uri"))


@query("SELECT doc_id, substring(text, 1, 200) AS text, length(text) > 200 AS truncated FROM documents")
def fetch_doc(spark, sf):
    return stats.fetch_doc(read(spark, sf, "documents"), 50)


@query(f"""WITH {SQL_DOCS}, l AS (SELECT doc_id, n, string_split(text, chr(10)) AS x FROM docs)
SELECT doc_id, CASE WHEN n % 6 NOT IN (1, 3) THEN array_to_string(x[1:2], chr(10)) END AS span_text, CASE WHEN n % 6 NOT IN (1, 3) THEN CAST(least(2, len(x)) AS INTEGER) END AS effective_end, CASE WHEN n % 6 IN (1, 3) THEN 'span_not_supported' END AS error FROM l""")
def fetch_span_refused(spark, sf):
    return stats.fetch_span(documents(spark, sf).withColumn("media", T.media_kind(F.col("workspace_path"))), 1, 2)


@query(f"""WITH {SQL_DOCS}, k AS (SELECT * FROM docs WHERE n = 7) SELECT k.doc_id, lang, (SELECT count(*) FROM conversations WHERE conv_id = 7) AS n_chunks, coalesce((SELECT max(turn) FROM conversations WHERE conv_id = 7), -1) AS last_chunk, (SELECT coalesce(max('toxic'), '') FROM labels WHERE doc_id = 7 AND toxic = 1) AS tags FROM k""")
def inspect_doc(spark, sf):
    c = read(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").alias("ordinal"), "text")
    tags = read(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("toxic").alias("tag"))
    got = stats.inspect_doc("7", documents(spark, sf), c, c, tags)
    return got.select("doc_id", "lang", F.coalesce(F.size("chunks"), F.lit(0)).cast("long").alias("n_chunks"), F.coalesce(F.element_at("chunks", -1)["ordinal"], F.lit(-1)).alias("last_chunk"), F.array_join("tags", ",").alias("tags"))


# statistics and storage -------------------------------------------------------------------------
@query(f"WITH {SQL_EVENTS} SELECT engine AS value, count(*) AS n FROM ocr GROUP BY engine")
def events_per_engine(spark, sf):
    return stats.by_value(ocr_events(spark, sf), F.col("engine"))


@query(f"""WITH {SQL_EVENTS}, s AS (SELECT list_sort(list(ms)) AS s, count(ms) AS c FROM ocr WHERE ms IS NOT NULL) SELECT s[(c - 1) * 50 // 100 + 1] AS p50, s[(c - 1) * 90 // 100 + 1] AS p90, s[(c - 1) * 99 // 100 + 1] AS p99, s[c] AS max FROM s""")
def ocr_percentiles_overall(spark, sf):
    return stats.lower_percentile(ocr_events(spark, sf), "ms")


@query(f"WITH {SQL_EVENTS} SELECT event_id, ts FROM ocr WHERE NOT success ORDER BY ts DESC, event_id DESC LIMIT 10")
def ocr_failures(spark, sf):
    return stats.failures(ocr_events(spark, sf)).select("event_id", "ts")


@query(f"""WITH {SQL_DOCS} SELECT CASE WHEN n % 5 = 0 THEN 'new' ELSE 'updated' END AS status, CASE WHEN n % 4 = 0 THEN '<no-ext>' ELSE (['md','pdf','png','mp3','py','txt'])[n % 6 + 1] END AS ext, count(*) AS n FROM docs GROUP BY ALL""")
def ingest_by_extension(spark, sf):
    path = F.when(F.col("n") % 4 == 0, "x/.hidden").otherwise(F.col("workspace_path"))
    return stats.by_outcome(documents(spark, sf).select(path.alias("workspace_path"), F.when(F.col("n") % 5 == 0, "new").otherwise("updated").alias("status")))


@query(f"""WITH {SQL_DOCS} SELECT (SELECT count(*) FROM docs) AS n_docs, (SELECT count(*) FROM documents) AS n_chunks, (SELECT count(*) FROM pages) AS n_assets, 'p0,p1,p2' AS parsers, 'c0,c1' AS chunkers""")
def schema_stats(spark, sf):
    d = documents(spark, sf).withColumn("parser_version", F.when(F.col("n") % 4 == 3, "").otherwise(F.concat(F.lit("p"), (F.col("n") % 4).cast("string"))))
    c = d.select("doc_id", F.when(F.col("n") % 3 < 2, F.concat(F.lit("c"), (F.col("n") % 3).cast("string"))).alias("chunker_version"))
    got = stats.schema_stats(d, c, read(spark, sf, "pages"))
    return got.select("n_docs", "n_chunks", "n_assets", F.array_join("parser_versions", ",").alias("parsers"), F.array_join("chunker_versions", ",").alias("chunkers"))


@query("SELECT conv_id || '-' || turn AS job_id, CASE turn % 3 WHEN 0 THEN 'ingest' WHEN 1 THEN 'eval' ELSE 'reset' END AS kind FROM conversations WHERE role = 'user' AND turn % 3 = 1")
def jobs_filtered(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ("ingest", "eval", "reset"))), (F.col("turn") % 3 + 1).cast("int"))
    jobs = read(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("job_id"), kind.alias("kind"), F.when(F.col("role") == "user", "failed").otherwise("running").alias("status"), F.lit(datetime(2024, 1, 1)).alias("created_at"))
    return store.list_jobs(jobs, status="failed", kind="eval").select("job_id", "kind")


@query(f"""WITH {SQL_DOCS} SELECT 'trust_level' AS "column", trust_level AS value, count(*) AS n FROM docs WHERE trust_level = 'generated' GROUP BY 2 UNION ALL SELECT 'lang', CASE WHEN lang <> 'fr' THEN lang END, count(*) FROM docs WHERE lang NOT IN ('en', 'de') GROUP BY 2""")
def domain_faults(spark, sf):
    d = documents(spark, sf).withColumn("lang", F.when(F.col("lang") != "fr", F.col("lang")))
    return store.domain_faults(d, {"trust_level": ("primary", "secondary"), "lang": ("en", "de")})


@query(f"""WITH {SQL_DOCS} SELECT 'chunks' AS tbl, 'c' || n AS id FROM docs WHERE n % 7 = 0 UNION ALL SELECT 'embeddings', 'c' || n FROM docs WHERE n % 7 = 0 OR n % 11 = 0 UNION ALL SELECT 'assets', a FROM (SELECT source_id || lang AS a, bool_and(n % 7 = 0) AS gone FROM docs GROUP BY 1) WHERE gone""")
def orphan_rows(spark, sf):
    d = documents(spark, sf).withColumn("asset_id", F.concat("source_id", "lang"))
    ids = F.concat(F.lit("c"), F.col("n").cast("string")).alias("chunk_id")
    return store.orphans(d.where("n % 7 <> 0"), d.where("n % 11 <> 0 OR n % 7 = 0").select("doc_id", ids), d.select(ids), d.select("asset_id").distinct())


@query(f"""WITH {SQL_DOCS} SELECT doc_id FROM docs WHERE n % 5 = 1 AND n % 3 <> 0""")
def changed_assets(spark, sf):
    """Documents whose chunks come from another asset than the one now at their path."""
    now, stored = _stored(spark, sf)
    chunks = stored.where("n % 3 <> 0").select("doc_id")
    return store.stale_assets(chunks, stored, now).select("doc_id")


@query(f"""WITH {SQL_DOCS} SELECT doc_id, CASE WHEN n % 2 = 0 THEN 'old' ELSE 'p1+ocr=on+' || lang END AS parser_version FROM docs""")
def backfilled_versions(spark, sf):
    d = documents(spark, sf).select("doc_id", F.when(F.col("n") % 2 == 0, "old").alias("parser_version"), "lang")
    return store.backfill(d, "parser_version", store.effective_version(F.lit("p1"), F.lit("ocr=on"), F.col("lang"))).select("doc_id", "parser_version")


@query("""WITH c AS (SELECT DISTINCT text FROM documents WHERE doc_id % 4 = 0), u AS (SELECT DISTINCT text FROM documents WHERE doc_id % 3 = 0), f AS (SELECT DISTINCT text FROM documents WHERE doc_id % 5 = 0)
SELECT sha256('embed' || chr(31) || text) AS cache_key, 'old' AS payload FROM c WHERE text IN (SELECT text FROM u) AND text NOT IN (SELECT text FROM f) UNION ALL SELECT sha256('embed' || chr(31) || text), 'fresh' FROM f""")
def cache_after_run(spark, sf):
    """What is left of a cache once fresh payloads were put in, hits were touched and the rest has aged."""
    d = read(spark, sf, "documents").select("doc_id", store.cache_key("embed", F.col("text")).alias("cache_key"), F.lit("embed").alias("kind"))
    then, now = datetime(2024, 1, 1), datetime(2024, 3, 1)
    cache = d.where("doc_id % 4 = 0").select("cache_key", "kind").distinct().withColumns({"payload": F.lit("old"), "created_at": F.lit(then), "last_used_at": F.lit(then)})
    put = store.cache_put(cache, d.where("doc_id % 5 = 0").select("cache_key", "kind", F.lit("fresh").alias("payload")), now)
    return store.cache_gc(store.cache_touch(put, d.where("doc_id % 3 = 0"), now), now, 30).select("cache_key", "payload")


@query(f"""WITH {SQL_DOCS}, t AS (SELECT n % 4 AS k, n FROM docs WHERE n % 2 = 0) SELECT doc_id, CASE WHEN n % 3 = 0 THEN 'new' ELSE 'old' END AS tag FROM docs WHERE (n % 3 = 0 AND n % 6 = 0) OR (n % 3 <> 0 AND n % 2 = 0)""")
def replaced_tags(spark, sf):
    """Tags of documents that came again are replaced, also by none."""
    d = documents(spark, sf)
    old = d.where("n % 2 = 0").select("doc_id", F.lit("old").alias("tag"))
    return store.replace_children(old, d.where("n % 6 = 0").select("doc_id", F.lit("new").alias("tag")), of=d.where("n % 3 = 0"))


@query("SELECT to_json({'schema_version': 'chunk.v1', 'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars}) AS value FROM documents")
def wire_lines(spark, sf):
    return wire.to_wire(read(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "chunk.v1")


# answers and runs -------------------------------------------------------------------------------
@query("""WITH t AS (SELECT doc_id, text, (SELECT max(c) FROM (VALUES (1200), (600), (300), (150)) v(c) WHERE ceil(least(c, length(text)) / 4.0) <= 256) AS c FROM documents)
SELECT doc_id, least(length(text), 1600) AS premise, CAST(CASE WHEN ceil(least(1200, length(text)) / 4.0) <= 256 THEN least(1200, length(text)) ELSE least(600, length(text)) END AS INTEGER) AS hypothesis FROM t""")
def nli_inputs(spark, sf):
    d = read(spark, sf, "documents")
    return d.select("doc_id", F.length(rag.nli_premise(F.col("text"))).cast("long").alias("premise"), F.length(rag.nli_hypothesis(F.col("text"))).alias("hypothesis"))


@query("""WITH x AS (SELECT vec_id, list_transform(embedding[1:3], lambda v: exp(CAST(v AS DOUBLE))) AS e FROM embeddings), p AS (SELECT vec_id, e[1] / (e[1] + e[2] + e[3]) AS s FROM x)
SELECT vec_id, round(CASE WHEN vec_id % 9 <> 0 THEN s END, 6) AS entail, vec_id % 9 <> 0 AND s >= 0.35 AS passed, CASE WHEN vec_id % 9 = 0 THEN 'nli_model_unavailable' WHEN s < 0.35 THEN 'nli_verification' END AS refusal FROM p""")
def nli_verdicts(spark, sf):
    logits = F.when(F.col("vec_id") % 9 != 0, F.slice(F.col("embedding").cast("array<double>"), 1, 3))
    return rag.nli_gate(read(spark, sf, "embeddings").select("vec_id", logits.alias("logits")), 0.35).select("vec_id", F.round("entail", 6).alias("entail"), "passed", "refusal")


@query("SELECT conv_id, turn, greatest(turn, 10) AS k, greatest(64, 4096 - 300 * turn - 256) AS completion FROM conversations")
def ask_budgets(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", rag.effective_k(F.col("turn"), 10).alias("k"), rag.completion_budget(F.lit(4096), 300 * F.col("turn")).alias("completion"))


def _run(spark, sf, run_id, chunker, where="true"):
    found = embeddings(spark, sf).where(where)

    def find(asked):
        return search.vector(asked.select("query_id").join(vector_queries(spark, sf), "query_id"), found)

    g = golden(spark, sf).withColumn("text", F.col("query_id"))
    return g, evals.run_eval(g, find, run_id, {"chunker_version": chunker, "k": 10})


@query(f"""WITH {VEC}, h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, chunk_id) AS rank FROM vs WHERE n % 3 <> 0)
SELECT 'r1' AS run_id, query_id, count(*) FILTER (rank <= 10) AS n_hits, min(chunk_id) FILTER (rank = 1) AS first_chunk, false AS failed FROM h GROUP BY query_id""")
def eval_run_rows(spark, sf):
    return _run(spark, sf, "r1", "c1", "n % 3 <> 0")[1].queries.select("run_id", "query_id", "n_hits", F.col("first_hit.chunk_id").alias("first_chunk"), "failed")


@query(f"""WITH {VEC}, {GOLD}, h2 AS (SELECT * FROM (SELECT query_id, chunk_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, chunk_id) AS rank FROM vs WHERE n % 3 <> 0) WHERE rank <= 10),
f2 AS (SELECT g.query_id, min(rank) FILTER (list_contains(expected, doc_id)) AS fr FROM g LEFT JOIN h2 USING (query_id) GROUP BY g.query_id)
SELECT query_id, f.fr AS a_rank, f2.fr AS b_rank, CASE WHEN f.fr IS NULL AND f2.fr IS NULL THEN 'draw' WHEN f.fr IS NULL THEN 'win' WHEN f2.fr IS NULL THEN CASE WHEN ne > 0 THEN 'regression' ELSE 'loss' END WHEN f2.fr < f.fr THEN 'win' WHEN f2.fr > f.fr THEN 'loss' ELSE 'draw' END AS kind FROM f JOIN f2 USING (query_id)""")
def eval_compare_by_doc(spark, sf):
    """Runs of other chunker versions meet by documents: chunk ids that changed don't count as misses."""
    g, a = _run(spark, sf, "a", "c1")
    _, b = _run(spark, sf, "b", "c2", "n % 3 <> 0")
    other = g.withColumn("expected_chunk_ids", F.array(F.lit("gone")))
    return evals.compare_runs(a, b, other)["per_query"]


@query(f"""WITH {VEC}, {GOLD}, h2 AS (SELECT * FROM (SELECT query_id, chunk_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, chunk_id) AS rank FROM vs WHERE n % 3 <> 0) WHERE rank <= 10),
f2 AS (SELECT g.query_id, coalesce(len(expected), 0) AS ne, min(rank) FILTER (list_contains(expected, doc_id)) AS fr FROM g LEFT JOIN h2 USING (query_id) GROUP BY g.query_id, expected),
m AS (SELECT round(coalesce(avg(CASE WHEN fr <= 3 THEN 1.0 ELSE 0.0 END) FILTER (ne > 0), 0), 4) AS h, round(coalesce(avg(CASE WHEN fr <= 10 THEN 1.0 / fr ELSE 0.0 END) FILTER (ne > 0), 0), 4) AS r FROM f),
m2 AS (SELECT round(coalesce(avg(CASE WHEN fr <= 3 THEN 1.0 ELSE 0.0 END) FILTER (ne > 0), 0), 4) AS h, round(coalesce(avg(CASE WHEN fr <= 10 THEN 1.0 / fr ELSE 0.0 END) FILTER (ne > 0), 0), 4) AS r FROM f2)
SELECT round(m2.h - m.h, 4) AS hit_at_3, round(m2.r - m.r, 4) AS mrr FROM m, m2""")
def eval_deltas(spark, sf):
    g, a = _run(spark, sf, "a", "c1")
    _, b = _run(spark, sf, "b", "c1", "n % 3 <> 0")
    return evals.compare_runs(a, b, g)["deltas"].select("hit_at_3", "mrr")
