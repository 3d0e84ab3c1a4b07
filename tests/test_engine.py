"""Hand-computed answers for the engine's rules."""

import math
import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnfield.functions import citation as C
from tarnfield.functions import text as T
from tarnfield.operators import chunk, evals, rag, search, stats, store
from tarnfield.sources import files, markdown
from tarnfield.sources.code import code_units


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first()


def hits_of(spark, rows):
    return spark.createDataFrame(rows, "query_id string, chunk_id string, doc_id string, score double, rank int")


def test_bm25_with_common_term(spark):
    c = spark.createDataFrame([("c1", "d1", "alpha bravo charlie", ["Snap"]), ("c2", "d2", "bravo only here", ["Snap"]), ("c3", "d3", "alpha alpha", ["Snap"])], "chunk_id string, doc_id string, text string, heading_path array<string>")
    q = spark.createDataFrame([("q", "alpha")], "query_id string, text string")
    got = {r.chunk_id: (r.score, r.rank) for r in search.lexical(q, c, body_copies=1).collect()}
    assert got["c3"][1] == 1 and got["c3"][0] == pytest.approx(1.4490997e-6, rel=1e-5) and got["c1"][0] == pytest.approx(9.6414249e-7, rel=1e-5) and "c2" not in got


def test_ties_go_by_chunk_and_short_tokens_find_nothing(spark):
    c = spark.createDataFrame([("b", "d", "same text here"), ("a", "d", "same text here"), ("c", "d", "other")], "chunk_id string, doc_id string, text string")
    q = spark.createDataFrame([("q", "same text"), ("s", "a b"), ("m", "here same")], "query_id string, text string")
    got = [(r.query_id, r.chunk_id, r.rank) for r in search.lexical(q, c).orderBy("query_id", "rank").collect()]
    assert got == [("m", "a", 1), ("m", "b", 2), ("q", "a", 1), ("q", "b", 2)]


def test_globs(spark):
    paths = ["notes/a.md", "notes/sub/b.md"]
    keep = lambda g, x=False: [p for p in paths if __import__("re").search(T.glob_regex(g, x), p)]
    assert keep("notes/*.md") == paths[:1] and keep("notes/*.md", True) == paths and keep("notes/**/*.md") == paths and keep("**/{b,c}.md") == paths[1:] and keep("notes/[!b].md") == paths[:1]


def test_fusion(spark):
    lex = hits_of(spark, [("q", "a", "a", 1.0, 1), ("q", "b", "b", 0.9, 2)])
    vec = hits_of(spark, [("q", "b", "b", 1.0, 1), ("q", "c", "c", 0.9, 2)])
    got = search.fuse(lex, vec).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["b", "a", "c"] and got[0].score == pytest.approx((1 / 62 + 1 / 61) / (2 / 61)) and got[1].score <= 0.5
    tie = search.fuse(hits_of(spark, [("q", "z", "z", 1.0, 1)]), hits_of(spark, [("q", "a", "a", 1.0, 1)])).orderBy("rank").collect()
    assert [r.chunk_id for r in tie] == ["z", "a"]


def test_vector_scores(spark):
    e = spark.createDataFrame([("same", [1.0, 0.0]), ("side", [0.0, 2.0]), ("back", [-1.0, 0.0]), ("zero", [0.0, 0.0])], "chunk_id string, embedding array<float>").withColumn("doc_id", F.col("chunk_id"))
    q = spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, embedding array<float>")
    assert {r.chunk_id: r.score for r in search.vector(q, e).collect()} == {"same": 1.0, "side": 0.5, "back": 0.0, "zero": 0.0}
    r = one(spark, search.shifted(search.cosine(F.array(F.lit(1.0)), F.array(F.lit(0.0)))), search.shifted(search.cosine(F.array(F.lit(1.0)), F.array(F.lit(3.0)))))
    assert tuple(r) == (0.0, 1.0)
    with pytest.raises(ValueError, match="embeddings"):
        search.search(q, e, None, "vector")


def test_cursor_page_and_staleness(spark):
    cursor = search.encode_cursor(10, "r1")
    assert search.decode_cursor(cursor, "r1") == 10
    with pytest.raises(search.StaleCursor):
        search.decode_cursor(cursor, "r2")
    with pytest.raises(ValueError):
        search.decode_cursor("!!", "r1")
    assert search.next_cursor(5, 10, False, 0, "r") is None and search.next_cursor(10, 10, False, 0, "r")
    now = dt.datetime(2024, 3, 1)
    rows = spark.createDataFrame([(0, now - dt.timedelta(days=30)), (1, now - dt.timedelta(days=30, seconds=1))], "k int, indexed_at timestamp")
    assert [r.stale for r in search.with_staleness(rows, now, 30).orderBy("k").collect()] == [False, True]
    assert not any(r.stale for r in search.with_staleness(rows, now, 0).collect())


def test_budget_keeps_one_hit(spark):
    h = spark.createDataFrame([("q", k, "x" * 500) for k in range(1, 6)], "query_id string, rank int, snippet string")
    few = search.fit_budget(h, 20).collect()
    assert [r["rank"] for r in few] == [1] and len(few[0].snippet) == 60
    assert search.fit_budget(h, 10_000).count() == 5


def test_metrics(spark):
    none = []
    g = spark.createDataFrame([(k, [f"c{k}"], [f"d{k}"], none, none) for k in ("1", "2", "3")], "query_id string, expected_chunk_ids array<string>, expected_doc_ids array<string>, must_contain array<string>, forbidden array<string>")
    h = spark.createDataFrame([("1", 1, "c1", "d1"), ("2", 4, "c2", "d2"), ("3", 1, "x", "y")], "query_id string, rank int, chunk_id string, doc_id string")
    m = evals.metrics(g, h).first()
    assert (m.hit_at_1, m.hit_at_3, m.hit_at_5, m.hit_at_10, m.mrr) == (0.3333, 0.3333, 0.6667, 0.6667, 0.4167)
    assert m.precision_at_5 == round(2 / 15, 4) and m.recall_at_1 == 0.3333
    answers = spark.createDataFrame([], "query_id string, answer string, grounded boolean, citations array<string>, error string")
    a = evals.answer_metrics(g, answers).first()
    assert (a.groundedness, a.citation_coverage, a.refusal_correctness) == (0.0, None, None)
    ranks = lambda rows: spark.createDataFrame(rows, "query_id string, first_rank int")
    kinds = {r.query_id: r.kind for r in evals.compare(ranks([("1", 1), ("2", None), ("3", 3), ("4", 1)]), ranks([("1", None), ("2", 2), ("3", 1), ("4", None)]), g).collect()}
    assert kinds == {"1": "regression", "2": "win", "3": "win", "4": "loss"}
    assert evals.choose_level({"a"}, {"b"}) == "doc"


def test_percentiles(spark):
    r = stats.lower_percentile(spark.range(1, 101).withColumnRenamed("id", "ms"), "ms").first()
    assert (r.p50, r.p90, r.p99, r.max) == (50, 90, 99, 100)


@pytest.mark.parametrize(("n", "starts"), [(81, [0, 60]), (140, [0, 60]), (141, [0, 60, 120]), (80, [0])])
def test_paragraph_windows(spark, n, starts):
    d = spark.createDataFrame([("d", "\n".join(f"l{k}" for k in range(n)))], "doc_id string, text string")
    got = chunk.paragraph_windows(d).orderBy("start").collect()
    assert [r.start - 1 for r in got] == starts and got[-1].end == n


def test_verdicts(spark):
    packed = spark.createDataFrame([("a", k, f"c{k}") for k in (1, 2, 3)] + [("b", 1, "c1"), ("c", 1, "c1")], "query_id string, marker int, chunk_id string")
    answers = spark.createDataFrame([("a", "x [#1] y [#9]", False), ("b", "x [#1]", False), ("c", "x [1]", False)], "query_id string, answer string, cancelled boolean")
    got = {r.query_id: (r.grounded, r.citations) for r in rag.verdict(answers, packed).collect()}
    assert got == {"a": (False, ["c1"]), "b": (True, ["c1"]), "c": (False, [])}
    assert one(spark, rag.parse_questions(F.lit('```json\n[" a ", "", "b"]\n```')), rag.parse_questions(F.lit("no")))[0] == ["a", "b"]
    e = one(spark, rag.entailment(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))))[0]
    assert e == pytest.approx(1 / 3)


def test_estimates(spark):
    r = one(spark, T.chunk_token_estimate(F.lit("éé한")), T.prompt_token_estimate(F.lit("éé한x")), T.bigrams(F.lit("abc")), T.text_quality(F.lit("ok")), T.text_quality(F.lit("")))
    assert tuple(r) == (3, 1, ["ab", "bc"], 1.0, 0.0)


@given(st.text(max_size=200), st.integers(2, 40))
def test_oversize_split_is_lossless(text, budget):
    parts = chunk.split_oversize(text, budget)
    assert "".join(parts) == text and all(len(p.encode()) <= max(3 * budget, 4) for p in parts)


def test_citations_round_trip(spark):
    u = one(spark, C.uri(F.lit("a#b.md"), F.lit("line"), F.lit(3), F.lit(9)), C.uri(F.lit("v"), F.lit("time"), F.lit(61001), F.lit(3600000), speaker=F.lit("ann")), C.uri(F.lit("p"), F.lit("page"), F.lit(4), F.lit(4)), C.uri(F.lit("m.py"), F.lit("code"), F.lit(2), F.lit(2)))
    assert tuple(u) == ("a#b.md#L3-L9", "v#t=00:01:01.001,01:00:00.000&speaker=ann", "p#p=4", "m.py#L2")
    back = [one(spark, C.parse(F.lit(x)))[0] for x in [*u, "nothing", "x#L0"]]
    assert [(b.path, b.kind, b.start) for b in back[:4]] == [("a#b.md", "line", 3), ("v", "time", 61001), ("p", "page", 4), ("m.py", "line", 2)]
    assert back[4].error and back[5].error


def test_markdown():
    text = "---\ntitle: Hi\ntags: [a, b]\nodd: 1\n---\n# One\n\npara\nmore\n\n## Two\n\n- x\n  - y\n- z\n\n```py t\ncode\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n> q\n\n![alt](i.png)\n"
    fields, _, skipped = markdown.split_frontmatter(text)
    m = markdown.metadata(fields)
    assert (m["title"], m["tags"], m["user"], skipped) == ("Hi", ["a", "b"], {"odd": "1"}, 5)
    blocks = markdown.parse_blocks(text)
    assert [b["kind"] for b in blocks] == ["heading", "paragraph", "heading", "list", "code", "table", "quote", "image"]
    assert blocks[2]["heading_path"] == ["One"] and blocks[3]["heading_path"] == ["One", "Two"] and blocks[3]["text"] == "x\n  - y\nz" and blocks[4]["lang"] == "py" and blocks[1]["start"] == 8
    assert markdown.parse_blocks(markdown.to_markdown(blocks))[0]["text"] == "One"
    chunks = chunk.heading_chunks(blocks, 50)
    assert chunks[0]["text"] == "One\n\npara\nmore" and [c["text"] for c in chunks[2:4]] == ["code", "| a | b |\n|---|---|\n| 1 | 2 |"]
    assert markdown.split_frontmatter("---\nno end") == ({}, "---\nno end", 0)


def test_code_and_manifest_chunks(spark):
    code = "import x\n\n# note\n@d\ndef f():\n    pass\n\nclass A:\n    k = 1\n    def m(self):\n        pass\n"
    assert [u["symbol"] for u in code_units(code, 'python')] == ["<module>", "f", "A", "A.m"]
    long_ = chunk.code_chunks([{"symbol": "s", "text": "\n".join("" if k == 190 else "x" for k in range(250)), "start": 1, "end": 250}])
    assert [(c["symbol"], c["start"], c["end"]) for c in long_] == [("s [part 1/2]", 1, 191), ("s [part 2/2]", 192, 250)]
    yaml = "apiVersion: v1\nkind: Pod\nmetadata:\n  name: a\n  namespace: n\n---\nfoo: 1\n"
    assert [c["symbol"] for c in chunk.manifest_chunks(yaml)] == ["Pod/n/a"] and chunk.manifest_chunks("a: [") == []
    d = spark.createDataFrame([("1", code, "python"), ("2", "a: [", "yaml"), ("3", "def broken(", "python"), ("4", "x = 1", "toml")], "doc_id string, text string, code_lang string")
    assert {(r.doc_id, r.chunker) for r in chunk.route(d).select("doc_id", "chunker").collect()} == {("1", "code-ast-v1"), ("2", "none-v1"), ("3", "none-v1"), ("4", "file-v1")}


def test_storage(spark):
    d = spark.createDataFrame([("p", "1", "a", "v", "c", "e")], "workspace_path string, doc_id string, asset_id string, parser_version string, chunker_version string, embedding_version string")
    assert store.ingest_status(d, d).first().status == "unchanged" and store.ingest_status(d, d, force=True).first().status == "updated"
    cache = spark.createDataFrame([("k", "x", None)], "cache_key string, kind string, payload string")
    _, misses = store.cache_split(spark.createDataFrame([("k",), ("k",)], "cache_key string"), cache)
    assert misses.count() == 1
    now = dt.datetime(2024, 1, 31)
    c = spark.createDataFrame([("a", now - dt.timedelta(days=9)), ("b", now)], "cache_key string, last_used_at timestamp")
    assert store.cache_gc(c, now, 0).count() == 2 and store.cache_gc(c, now, 5).count() == 1
    v = spark.createDataFrame([("c", "m", 1)], "chunk_id string, model_id string, x int")
    assert store.upsert_vectors(v, v.withColumn("x", F.lit(2))).first().x == 2


def test_scan_and_publish(spark, tmp_path):
    root = tmp_path / "ws"
    (root / "node_modules").mkdir(parents=True)
    (root / "a.md").write_text("# hi")
    (root / "b.py").write_text("# Code generated by x\n")
    (root / "node_modules" / "c.md").write_text("x")
    got = {r.workspace_path: (r.media, r.skip) for r in files.scan(spark, str(root)).collect()}
    assert got == {"a.md": ("markdown", None), "b.py": ("code", "generated"), "node_modules/c.md": ("markdown", "builtin")}
    path = f"file://{tmp_path}/t"
    for n in (1, 2, 3):
        store.publish(spark, spark.range(n), path)
        assert store.published(spark, path).count() == n
    versions = [p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]
    assert len(versions) == 2
    # a version that was written without the pointer being turned is not seen
    spark.range(9).write.parquet(f"{path}/v-99999999999999999999-crashed")
    assert store.published(spark, path).count() == 3
    g = files.load_golden(spark, "- {id: a, query: x, expected_doc_ids: [z], group: g}\n- {id: a, query: y, group: g}\n")
    docs = spark.createDataFrame([("1",)], "doc_id string")
    assert {r.fault for r in files.golden_faults(g, docs).collect()} == {"duplicate_id", "group_mismatch", "unknown_doc"}


def test_streaming_ingest_sees_each_asset_once(spark, tmp_path):
    from tarnfield.streaming.ingest import asset_stream, run_available

    src, seen = f"{tmp_path}/in", []
    schema = "asset_id string, workspace_path string, discovered_at timestamp"
    for k in range(2):
        spark.createDataFrame([("a", "p", dt.datetime(2024, 1, 1 + k // 2)), (f"b{k}", "p", dt.datetime(2024, 1, 1, k))], schema).write.mode("append").parquet(src)
        run_available(asset_stream(spark, src, schema), lambda df, _: seen.extend(r.asset_id for r in df.collect()), f"{tmp_path}/cp").awaitTermination()
    assert sorted(seen) == ["a", "b0", "b1"]


def test_entry_and_registry(spark, sf):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "rank" in e.entry(spark).columns


def test_phrases_with_repeated_and_short_words(spark):
    """A phrase counts where all its words stand in turn, short and repeated ones included; each occurrence counts."""
    texts = {"c1": "go go go", "c2": "go stop go", "c3": "see a bee", "c4": "see bee a see", "c5": "none", "c6": "other", "c7": "words", "c8": "here"}
    chunks = spark.createDataFrame([(k, k, t) for k, t in texts.items()], "chunk_id string, doc_id string, text string")
    queries = spark.createDataFrame([("q1", "go go"), ("q2", "see a bee"), ("q3", "a"), ("q4", None)], "query_id string, text string")
    raw = {(r.query_id, r.chunk_id): r.raw for r in search.match_scores(queries, chunks, body_copies=1).collect()}
    mean = sum(len(t.split()) for t in texts.values()) / len(texts)

    def part(tf, df, dl):
        return max(math.log((8 - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))

    want = {
        # a word that stands twice in a query is a phrase of its expression twice
        ("q1", "c1"): -(2 * part(3, 2, 3) + part(2, 1, 3)), ("q1", "c2"): -2 * part(2, 2, 3),
        ("q2", "c3"): -(2 * part(1, 2, 3) + part(1, 1, 3)), ("q2", "c4"): -(part(2, 2, 4) + part(1, 2, 4)),
    }
    assert raw.keys() == want.keys() and all(abs(raw[k] - want[k]) < 1e-9 for k in want)


def test_whole_items_equal_brute_force(spark, tmp_path):
    """Whole items as queries: all their words must stand in a document, and phrases are as long as the items."""
    from tarnfield.plans import queries

    texts = ["one two three four five six", "one two six five four three", "one two other words here", "six five four three two one two three four five six", "x y", "go on go on go on", "more", "and more", "the last"]
    items = ["One two, three four five six.", "six five four three", "one two nowhere", "go on go on", "one", "a b", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, asked = [t.split() for t in texts], [t.lower().replace(",", "").replace(".", "").split() for t in items]
    mean = 2 * sum(map(len, docs)) / len(docs)

    def part(n, df, d):
        return max(math.log((len(docs) - df + 0.5) / (df + 0.5)), 1e-6) * 2 * n * 2.2 / (2 * n + 1.2 * (0.25 + 0.75 * 2 * len(d) / mean))

    raw, phrases = {}, {}
    for q, phrase in enumerate(asked):
        terms = [w for w in phrase if len(w) > 1]
        hits = {k: sum(d[i : i + len(phrase)] == phrase for i in range(len(d))) for k, d in enumerate(docs) if terms and set(terms) <= set(d)}
        n_phrase = sum(n > 0 for n in hits.values()) if len(phrase) > 1 else 0
        phrases |= {str(q): n_phrase or hits and sum(n > 0 for n in hits.values())} if any(hits.values()) else {}
        for k, n in hits.items():
            s = sum(part(docs[k].count(w), sum(w in d for d in docs), docs[k]) for w in terms)
            raw[str(q), str(k)] = -(s + (part(n, n_phrase, docs[k]) if n and n_phrase else 0))
    got = {(r.query_id, r.chunk_id): r.raw for r in queries.QUERIES["bm25_scores"](spark, str(tmp_path)).collect()}
    assert got.keys() == raw.keys() and all(abs(got[k] - raw[k]) < 1e-5 for k in raw) and ("0", "2") not in raw and ("0", "1") in raw
    assert {r.query_id: r.n_phrase for r in queries.QUERIES["lex_phrase_or"](spark, str(tmp_path)).collect()} == phrases == {"0": 2, "1": 2, "3": 1, "4": 4}
    top = {(r.query_id, r.rank): r.chunk_id for r in queries.QUERIES["lex_topk_and"](spark, str(tmp_path)).collect()}
    assert top == {(q, n): k for q in {q for q, _ in raw} for n, (_, k) in enumerate(sorted((round(x, 10), k) for (p, k), x in raw.items() if p == q), 1)}
    gate = {r.query_id: r.refusal for r in queries.QUERIES["score_gate"](spark, str(tmp_path)).collect()}
    assert {q for q, r in gate.items() if r == "no_chunks"} == {str(q) for q in range(len(items))} - {q for q, _ in raw}
