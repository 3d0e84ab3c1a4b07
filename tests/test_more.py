"""Rules of the further operators, by hand."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnfield.functions import citation as C
from tarnfield.functions import text as T
from tarnfield.operators import chunk, evals, rag, search, stats, store
from tarnfield.sources import files, markdown, wire
from tarnfield.sources.code import code_units
from tarnfield.streaming.ingest import event_windows


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first()


# files -----------------------------------------------------------------------------------------
def test_scan_strips_the_root_alone_and_reads_no_ignored_bytes(spark, tmp_path):
    """A parent folder may have the root's name; names may hold glob characters; ignore files are the root's."""
    root = tmp_path / "data" / "ws" / "data"
    (root / "sub" / "data").mkdir(parents=True)
    (root / "venv").mkdir()
    (root / "x.md").write_text("# x")
    (root / "sub" / "data" / "y[1].md").write_text("# y")
    (root / "sub" / "z.tmp").write_text("z")
    (root / "sub" / "keep.tmp").write_text("k")
    (root / "venv" / "a.py").write_text("1")
    (root / ".DS_Store").write_text("n")
    (root / "big.py").write_text("x = 1\n" * 6000)
    (root / ".gitignore").write_text("# comment\n*.tmp\n!keep.tmp\n")
    (root / ".searchignore").write_text("big.*\n")
    got = {r.workspace_path: r for r in files.scan(spark, str(root)).collect()}
    assert {p: r.skip for p, r in got.items() if not p.startswith(".g") and not p.startswith(".s")} == {"x.md": None, "sub/data/y[1].md": None, "sub/z.tmp": "gitignore", "sub/keep.tmp": None, "venv/a.py": "builtin", "big.py": "ownignore"}
    assert all((r.content is None) == (r.skip is not None) and (r.checksum is None) == (r.skip is not None) for r in got.values())
    (root / ".searchignore").write_text("!big.py\n")
    rows = files.scan(spark, f"file://{root}/")
    assert {r.workspace_path: r.skip for r in rows.collect()}["big.py"] == "oversize"
    both = files.scan_all(spark, [{"root": str(root), "source_id": "a"}, {"root": str(root / "sub"), "source_id": "b"}, {"root": str(root), "source_id": "c", "trust": "secondary"}])
    assert {(r.source_id, r.trust_level) for r in both.where("workspace_path = 'x.md'").collect()} == {("c", "secondary")} and both.where("source_id = 'b'").count() == 3
    summary = {r.skip: (r.n, r.examples) for r in files.skip_summary(both).collect()}
    assert summary["builtin"] == (1, ["venv/a.py"]) and summary["gitignore"][0] == 1
    sizes = stats.index_bytes(spark, str(root / "venv"), str(root / "sub")).collect()
    assert [(r.n_files, r.bytes) for r in sizes] == [(1, 1), (3, 5)]


def test_one_file_and_frontmatter(spark):
    r = files.one_file(spark, "stdin", b"body", title='a "b"\n', source_uri="http://x").first()
    assert bytes(r.content).decode().endswith("---\n\nbody") and markdown.split_frontmatter(bytes(r.content).decode())[0] == {"title": 'a "b"\n', "source_uri": "http://x"}
    assert r.workspace_path.startswith("_external/") and r.workspace_path.endswith(".md")
    assert files.one_file(spark, "a.PDF", b"x").first().workspace_path.endswith(".pdf")
    with pytest.raises(ValueError, match="frontmatter"):
        files.one_file(spark, "s", b"---\ntitle: x\n---\n", title="y")


def test_repositories(tmp_path):
    repo = tmp_path / "proj"
    (repo / ".git" / "refs" / "heads").mkdir(parents=True)
    (repo / "src").mkdir()
    (repo / ".git" / "HEAD").write_text("ref: refs/heads/main\n")
    assert files.detect_repo(str(repo / "src")) == {"name": "proj", "branch": "main", "commit": None}
    (repo / ".git" / "refs" / "heads" / "main").write_text("a" * 40 + "\n")
    assert files.detect_repo(str(repo / "src" / "f.py"))["commit"] == "a" * 40
    (repo / ".git" / "HEAD").write_text("b" * 40)
    assert files.detect_repo(str(repo)) == {"name": "proj", "branch": "detached", "commit": "b" * 40}
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / ".git").write_text("gitdir: x")
    assert files.detect_repo(str(tmp_path / "tree")) == {"name": "tree", "branch": None, "commit": None}


# text and code ---------------------------------------------------------------------------------
def test_text_rules(spark):
    marker = T.MOJIBAKE
    r = one(spark, T.text_quality(F.lit(marker * 9)), T.text_quality(F.lit(f"ok{marker}")), T.text_quality(F.lit(None).cast("string")), T.text_quality(F.lit("かな")), T.text_quality(F.lit("“한국어…”")))
    assert tuple(r) == (0.0, 0.3, 0.0, 0.0, 1.0)
    assert tuple(one(spark, T.is_generated(F.lit("# autogenerated file")), T.is_generated(F.lit("this file was generated")), T.is_generated(F.lit("x" * 505 + "é@generated")), T.is_generated(F.lit("\n" * 10 + "@generated")))) == (True, False, False, False)
    assert tuple(one(spark, T.line_count(F.lit("a\n")), T.line_count(F.lit("")), T.line_count(F.lit("a\n\nb")))) == (1, 0, 3)
    assert one(spark, T.exif_time(F.lit("2024:02:30 10:00:00")))[0] is None
    assert [markdown.detect_language(t) for t in ("plain words", "한국어 문장", "かなと漢字", "汉字汉字", "123")] == ["en", "ko", "ja", "zh", None]


def test_codes_that_are_hard_to_read():
    text = 'fn a() { let s = "}"; // }\n  let c = \'{\'; /* { */ }\nfn b<\'a>(x: &\'a str) {}\nimpl<T: Fn() -> u8> X<T> {\n  fn y() {}\n}\n'
    assert [(u["symbol"], u["start"], u["end"]) for u in code_units(text, "rust") if not u["symbol"].startswith("<")] == [("a", 1, 2), ("b", 3, 3), ("X<T>::y", 5, 5)]
    assert code_units("no code", "cobol") == [] and code_units("def broken(", "python") == []
    assert [u["symbol"] for u in code_units("const a = 1;\nlet b;\n", "javascript")] == ["<module>"]
    for lang in ("rust", "go", "java", "kotlin", "javascript", "typescript", "c", "cpp"):
        for odd in ("", "{{{", "}}}", '"', "/*", "(" * 50, "class", "fn", "func (", "type ("):
            code_units(odd, lang)


def test_shells_and_unknown_files_are_no_fallback(spark):
    d = spark.createDataFrame([("1", "echo a\n\necho b", "shell"), ("2", "x", None), ("3", "module m", "go-mod"), ("4", "fn (", "rust")], "doc_id string, text string, code_lang string")
    assert {(r.doc_id, r.chunker, r.text) for r in chunk.route(d).collect()} == {("1", "code-text-paragraph-v1", "echo a"), ("1", "code-text-paragraph-v1", "echo b"), ("2", "code-text-paragraph-v1", "x"), ("3", "file-v1", "module m"), ("4", "code-ast-v1", "fn (")}


def test_paragraphs_of_rows_with_one_id_stay_apart(spark):
    d = spark.createDataFrame([("d", "a\nb\n\nc"), ("d", "x\n \t\ny"), ("e", None), ("f", "")], "doc_id string, text string")
    assert sorted((r.doc_id, r.start, r.end, r.text) for r in chunk.paragraphs(d).collect()) == [("d", 1, 1, "x"), ("d", 1, 2, "a\nb"), ("d", 3, 3, "y"), ("d", 4, 4, "c")]
    assert "Exchange" not in chunk.paragraphs(d)._jdf.queryExecution().toString()


def test_segments_share_an_id(spark):
    text = "# T\n\n" + "word " * 400
    rows = chunk.markdown_chunks(spark.createDataFrame([("d", text)], "doc_id string, text string"), 50, 0, 100).collect()
    ids = [r.chunk_id for r in sorted(rows, key=lambda r: r.ordinal)]
    assert len(ids) > 2 and {i.split("#seg")[0] for i in ids} == {ids[0].split("#seg")[0]} and [i.split("#seg")[1] for i in ids] == [str(k) for k in range(len(ids))]
    assert len({(r.start, r.end) for r in rows}) == 1


# search ----------------------------------------------------------------------------------------
def test_vectors_that_are_null_empty_or_of_other_widths(spark):
    e = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", []), ("d", [1.0, 0.0, 0.0]), ("e", [0.0, 1.0]), ("f", [None, 1.0])], "chunk_id string, embedding array<float>").withColumn("doc_id", F.col("chunk_id"))
    q = spark.createDataFrame([("q", [1.0, 0.0]), ("w", [1.0, 1.0, 1.0]), ("n", None), ("z", [])], "query_id string, embedding array<float>")
    got = {(r.query_id, r.chunk_id): round(r.score, 6) for r in search.vector(q, e).collect()}
    assert got == {("q", "a"): 1.0, ("q", "e"): 0.5, ("q", "f"): 0.0, ("w", "d"): round((1 / np.sqrt(3) + 1) / 2, 6)}
    model = e.withColumn("model_id", F.when(F.col("chunk_id") < "d", "m").otherwise("n"))
    assert [r.chunk_id for r in search.vector_set(model, "m", 2).collect()] == ["a"]
    assert search.vector(q.where("false"), e).count() == 0 and search.vector(q, e.where("false")).count() == 0


def test_vectors_in_blocks_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    m = np.round(rng.normal(size=(300, 6)), 1)
    e = spark.createDataFrame([(f"{k:03d}", v.tolist()) for k, v in enumerate(m)], "chunk_id string, embedding array<double>").withColumn("doc_id", F.col("chunk_id")).repartition(5)
    q = e.where("chunk_id < '020'").select(F.col("chunk_id").alias("query_id"), "embedding")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    score = np.round((unit @ unit.T + 1) / 2, 10)
    want = {(f"{i:03d}", r): f"{j:03d}" for i in range(20) for r, j in enumerate(sorted(range(300), key=lambda j: (-score[i, j], j))[:7], 1)}
    for size in (search.VECTOR_BYTES, 100):
        monkeypatch.setattr(search, "VECTOR_BYTES", size)
        assert {(r.query_id, r["rank"]): r.chunk_id for r in search.vector(q, e, 7).collect()} == want


def test_fusion_takes_a_whole_side(spark):
    lex = spark.createDataFrame([("q", "a", "d1", None, 1.0, 1)], "query_id string, chunk_id string, doc_id string, path string, score double, rank int")
    vec = spark.createDataFrame([("q", "a", "d9", "vp", "m", 1.0, 1), ("q", "b", "d2", "bp", "m", 0.9, 2)], "query_id string, chunk_id string, doc_id string, path string, model string, score double, rank int")
    got = {r.chunk_id: r for r in search.fuse(lex, vec).collect()}
    assert (got["a"].doc_id, got["a"].path, got["a"].model) == ("d1", None, "m") and (got["b"].doc_id, got["b"].path) == ("d2", "bp")
    t = search.trace(spark.createDataFrame([("q", "x", [1.0])], "query_id string, text string, embedding array<double>"), spark.createDataFrame([("a", "a", "x y"), ("b", "b", "x")], "chunk_id string, doc_id string, text string"), spark.createDataFrame([("a", "a", [1.0]), ("b", "b", [0.5])], "chunk_id string, doc_id string, embedding array<double>"), k=1, offset=1, timed=True)
    assert [r["rank"] for r in t["fused"].collect()] == [2] and {r.stage for r in t["timings"].collect()} == {"lexical", "vector", "fused"} and t["union"].count() == 2
    hits = spark.createDataFrame([("q", "x" * 9)], "query_id string, snippet string")
    assert search.cap_snippets(hits, 4).first().snippet == "xxxx" and search.cap_snippets(hits, None).first().snippet == "x" * 9
    assert search.index_version("hybrid", model="m", version="1", dim=3) == "hybrid:lex:v1+vec:m@1:3"


def test_percentiles_by_group_and_slot(spark):
    rng = np.random.default_rng(4)
    rows = [(g, int(v)) for g, n in (("a", 1), ("b", 2), ("c", 997), (None, 50)) for v in rng.integers(0, 300, n)] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, ms int").repartition(4)
    want = {}
    for g in ("a", "b", "c", None):
        s = sorted(v for k, v in rows if k == g and v is not None)
        want[g] = (*[s[(len(s) - 1) * p // 100] for p in (50, 90, 99)], s[-1])
    for slots in (1, 7, 64):
        assert {r.g: (r.p50, r.p90, r.p99, r.max) for r in stats.lower_percentile(df, "ms", by=["g"], slots=slots).collect()} == want
    assert tuple(stats.lower_percentile(df.where("false"), "ms").first()) == (None,) * 4 and stats.lower_percentile(df.where("false"), "ms", by=["g"]).count() == 0


# storage ---------------------------------------------------------------------------------------
def test_upserts_of_repeated_rows_and_mixed_models(spark):
    now = dt.datetime(2024, 1, 2)
    stored = spark.createDataFrame([("1", "a", 1, now, now)], "doc_id string, text string, doc_version int, created_at timestamp, updated_at timestamp")
    fresh = spark.createDataFrame([("1", "b"), ("1", "c"), ("2", "x"), ("2", "x")], "doc_id string, text string").repartition(3)
    rows = store.upsert(stored, fresh, now).collect()
    assert sorted((r.doc_id, r.doc_version) for r in rows) == [("1", 2), ("2", 1)]
    assert {r.text for r in rows} == {r.text for r in store.upsert(stored, fresh.repartition(1), now).collect()}
    v = spark.createDataFrame([("c", "m", [1.0], "committed")], "chunk_id string, model_id string, embedding array<double>, status string")
    put = store.upsert_vectors(v, spark.createDataFrame([("d", "m", [2.0], "committed")], v.schema))
    assert {(r.chunk_id, r.status) for r in put.collect()} == {("c", "committed"), ("d", "pending")}
    assert store.committed(put).count() == 1 and store.committed(store.commit(put)).count() == 2
    for bad in (("d", "other", [2.0], "x"), ("d", "m", [2.0, 1.0], "x")):
        with pytest.raises(ValueError, match="mixed"):
            store.upsert_vectors(v, spark.createDataFrame([bad], v.schema))


def test_jobs_and_revisions(spark):
    at = dt.datetime(2024, 1, 1)
    jobs = store.new_job(spark, "ingest", {"b": 1, "a": 2}, at).unionByName(store.new_job(spark, "eval", {}, at + dt.timedelta(seconds=1)))
    first = jobs.where("kind = 'ingest'").first()
    assert (first.status, json.loads(first.payload)) == ("pending", {"a": 2, "b": 1}) and len(first.job_id) == 32
    ran = store.job_progress(jobs, first.job_id, {"done": 3}, at + dt.timedelta(minutes=1))
    done = store.job_finished(ran, first.job_id, "failed", at + dt.timedelta(minutes=2), "disk full")
    assert [r.status for r in store.list_jobs(ran).collect()] == ["running", "pending"]
    r = store.list_jobs(done, status="failed").first()
    assert json.loads(r.error) == {"message": "disk full"} and r.finished_at == at + dt.timedelta(minutes=2) and store.list_jobs(done, kind="eval").first().error is None
    with pytest.raises(ValueError):
        store.job_finished(done, first.job_id, "odd", at)
    items = spark.createDataFrame([("new",), ("updated",), ("unchanged",), ("error",)], "status string")
    report = store.run_report(items, "r", at, at + dt.timedelta(seconds=2)).first()
    assert (report.scanned, report.n_new, report.n_updated, report.n_skipped, report.n_error, report.duration_ms) == (4, 1, 1, 1, 1, 2000)
    assert store.next_revision(4, items) == 5 and store.next_revision(4, items.where("status = 'unchanged'")) == 4
    assert store.any_row(items) and not store.any_row(items.where("false"))


def test_wire_and_protocols(spark, tmp_path):
    rows = spark.createDataFrame([("q", "한", None)], "query_id string, text string, n int")
    assert json.loads(wire.to_wire(rows, "search_hit.v1").first().value) == {"schema_version": "search_hit.v1", "query_id": "q", "text": "한"}
    wire.write_lines(wire.error_rows(rows, "stale_cursor", "m"), "error.v1", f"{tmp_path}/o")
    assert json.loads(spark.read.text(f"{tmp_path}/o").first().value)["code"] == "stale_cursor"
    with pytest.raises(ValueError):
        wire.to_wire(rows, "none")
    v = wire.HashEmbedder(4).embed(rows).first().embedding
    assert len(v) == 4 and abs(sum(x * x for x in v) - 1) < 1e-5
    chunks = spark.createDataFrame([("a", "a", "x y")], "chunk_id string, doc_id string, text string")
    assert wire.IndexRetriever(search.index_of(chunks)).search(spark.createDataFrame([("q", "x")], "query_id string, text string").withColumn("text", F.lit("x y")), 3).count() == 1


def test_event_windows(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), "e", 10 * m) for m in (1, 2, 61)]
    spark.createDataFrame(rows, "ts timestamp, engine string, ms long").write.parquet(f"{tmp_path}/in")
    stream = event_windows(spark.readStream.schema("ts timestamp, engine string, ms long").parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.n, r.mean_ms) for r in spark.table("windows").collect()) == [(1, 610.0), (2, 15.0)]


# answers and runs ------------------------------------------------------------------------------
class Find:
    """Hits by a table from text to chunks; counts how often it is asked."""

    def __init__(self, spark, table):
        self.rows = spark.createDataFrame([(t, c, s, k) for t, own in table.items() for k, (c, s) in enumerate(own, 1)], "text string, chunk_id string, score double, rank int")
        self.calls = 0

    def __call__(self, asked):
        self.calls += 1
        return asked.join(self.rows, "text").select("query_id", "chunk_id", "score", "rank", F.concat(F.lit("s-"), "chunk_id").alias("snippet"))


def test_several_hops(spark):
    """Gates on the original query, rounds of sub-queries, the cap, the last round, unreadable replies."""
    table = {"q1": [("x", 0.9)], "q2": [("x", 0.1)], "q4": [("x", 0.9)], "q5": [("x", 0.9)], "q6": [("x", 0.9)], "s1": [("a", 0.8), ("b", 0.7)], "s2": [("b", 0.9), ("c", 0.6)], "s3": [("d", 0.5)], "low": [("z", 0.2)], "many": [(f"m{k}", 0.5) for k in range(5)]}
    find = Find(spark, table)
    queries = spark.createDataFrame([(k, k) for k in ("q1", "q2", "q3", "q4", "q5", "q6")], "query_id string, text string")
    replies = {"q1": '["s1", "s2"]', "q2": '["s1"]', "q3": '["s1"]', "q4": "no json", "q5": '["low"]', "q6": '["many", "s1"]'}
    decompose = spark.createDataFrame(list(replies.items()), "query_id string, reply string")
    seen = {}

    def decide(open_, no):
        seen[no] = {r.query_id: r.preview for r in open_.collect()}
        more = {1: {"q1": '["s3"]', "q5": "[]"}, 2: {"q1": '["s3", "s1"]'}}[no]
        return spark.createDataFrame(list(more.items()), "query_id string, reply string")

    got = rag.multihop(queries, find, decompose, decide, cap=4)
    assert {r.query_id: r.refusal for r in got["refusals"].collect()} == {"q2": "score_gate", "q3": "no_chunks", "q4": "decompose_failed", "q5": "score_gate"}
    pools = {}
    for r in got["pool"].orderBy("query_id", "pool_rank").collect():
        pools.setdefault(r.query_id, []).append(r.chunk_id)
    assert pools == {"q1": ["a", "b", "c", "d"], "q5": ["z"], "q6": ["m0", "m1", "m2", "m3"]}
    hops = {(r.query_id, r.iter): (r.kind, r.sub_queries, r.chunks_added, r.forced_stop) for r in got["hops"].collect()}
    assert hops == {
        ("q1", 0): ("decompose", ["s1", "s2"], 0, False), ("q5", 0): ("decompose", ["low"], 0, False), ("q6", 0): ("decompose", ["many", "s1"], 0, False),
        ("q1", 1): ("decide", ["s3"], 3, False), ("q5", 1): ("decide", [], 1, False), ("q6", 1): ("decide", [], 4, True), ("q1", 2): ("decide", ["s3", "s1"], 1, False), ("q1", 3): ("decide", [], 0, True),
    }
    assert seen[1] == {"q1": "[1] s-a\n\n[2] s-b\n\n[3] s-c", "q5": "[1] s-z"} and find.calls == 4


def test_answers_are_rows(spark, tmp_path):
    v = spark.createDataFrame([("q", "x [#1]", True, None, ["c"])], "query_id string, answer string, grounded boolean, refusal string, citations array<string>")
    rows = rag.answer_rows(v, spark.createDataFrame([("q", "what")], "query_id string, text string"), dt.datetime(2024, 1, 1), model="m", k=5)
    for _ in range(2):
        store.append(rows, f"{tmp_path}/answers")
    got = spark.read.parquet(f"{tmp_path}/answers").collect()
    assert len(got) == 2 and (got[0].query, got[0].model, got[0].k, len(got[0].trace_id)) == ("what", "m", 5, 32)
    assert rag.context_budget(1000, 100, 50) == 786
    long = one(spark, rag.nli_hypothesis(F.lit("x" * 5000)), rag.nli_hypothesis(F.lit("y" * 5000), lambda t: F.length(t) * 3))
    assert len(long[0]) == 600 and long[1] is None


def test_runs_are_saved_and_compared(spark, tmp_path):
    g = spark.createDataFrame([("1", "one", ["c1"], ["d1"]), ("2", "two", ["c2"], ["d2"]), ("3", "three", [], ["d3"])], "id string, query string, expected_chunk_ids array<string>, expected_doc_ids array<string>")
    golden = g.withColumnRenamed("id", "query_id").withColumns({"must_contain": F.array().cast("array<string>"), "forbidden": F.array().cast("array<string>")})
    hits = lambda rows: lambda asked: asked.select("query_id").join(spark.createDataFrame(rows, "query_id string, rank int, chunk_id string, doc_id string, score double"), "query_id")
    a = evals.run_eval(golden, hits([("1", 1, "c1", "d1", 1.0), ("2", 2, "c2", "d2", 0.5), ("3", 1, "z", "d3", 1.0)]), "a", {"chunker_version": "v1"})
    answers = spark.createDataFrame([("2", "text", True, ["p"], "boom")], "query_id string, answer string, grounded boolean, citations array<string>, error string")
    b = evals.run_eval(golden, hits([("1", 1, "n1", "d1", 1.0), ("2", 1, "n2", "d2", 0.5)]), "b", {"chunker_version": "v2"}, answers)
    for run in (a, b):
        evals.save_run(run, str(tmp_path))
    a, b = (evals.load_run(spark, str(tmp_path), r) for r in ("a", "b"))
    got = evals.compare_runs(a, b, golden)
    assert {r.query_id: (r.a_rank, r.b_rank, r.kind) for r in got["per_query"].collect()} == {"1": (1, 1, "draw"), "2": (2, 1, "win"), "3": (1, None, "regression")}
    assert got["level"].first().level == "doc" and got["deltas"].first().mrr is None and got["deltas"].first().recall_at_1 is not None
    with pytest.raises(ValueError, match="chunker"):
        evals.compare_runs(a, b, golden, strict=True)
    # by chunks where any are expected, else by documents
    same = evals.compare_runs(a, evals.Run("c", {"chunker_version": "v1"}, b.queries, b.hits), golden)
    assert {r.query_id: r.kind for r in same["per_query"].collect()} == {"1": "regression", "2": "regression", "3": "regression"} and same["level"].first().level == "exact"
    totals = evals.run_metrics(golden, b).first()
    assert (totals.total, totals.failed, totals.empty_result_rate) == (3, 1, 0.3333)
    assert {r.query_id: (r.n_hits, r.has_answer) for r in b.queries.collect()} == {"1": (1, False), "2": (1, True), "3": (0, False)}
    assert len((tmp_path / "a" / "per_query").read_text() if (tmp_path / "a" / "per_query").is_file() else spark.read.json(f"{tmp_path}/a/per_query").collect()) == 3
    with pytest.raises(ValueError):
        evals.run_eval(golden, hits([]), "x", {})


def test_citations_of_all_kinds(spark):
    n = F.lit(None).cast("int")
    u = one(spark, C.uri(F.lit("a.png"), F.lit("region"), n, n, F.array(*map(F.lit, (1, 2, 3, 4)))), C.uri(F.lit("a.png"), F.lit("caption"), n, n))
    assert tuple(u) == ("a.png#xywh=1,2,3,4", "a.png#caption")
    assert [one(spark, C.parse(F.lit(x)))[0].kind for x in u] == ["region", "caption"]
    none = F.array().cast("array<struct<kind:string,start:long,end:long,page:long,box:array<int>,speaker:string>>")
    assert one(spark, C.first_citation(none, F.lit("p")))[0] == "p#L1"


def test_canonical_documents():
    text = "---\ntitle: Café\nlang: fr\n---\n# H\n\np1\n\np2\n\n# H\n\np3\n"
    doc, blocks = markdown.canonical(text, "n/a.md", "asset")
    assert doc["title"] == "Café" and doc["lang"] == "fr" and [e["kind"] for e in doc["provenance"]] == ["discovered", "parsed", "normalized"]
    assert [(b["kind"], b["ordinal"]) for b in blocks] == [("heading", 0), ("paragraph", 0), ("paragraph", 1), ("heading", 1), ("paragraph", 2)] and len({b["block_id"] for b in blocks}) == 5
    assert markdown.canonical(text, "n/a.md", "asset")[0]["doc_id"] == doc["doc_id"] != markdown.canonical(text, "n/b.md", "asset")[0]["doc_id"]
    assert [markdown.derive_title(None, markdown.parse_blocks(t), p) for t, p in (("## B\n\n# A\n", "x"), ("text\n\n## B\n", "x"), ("w" * 100, "x"), ("", "d/na.me.md"), ("", ""))] == ["A", "B", "w" * 80, "na.me", "untitled"]
