"""Every operator and every stage on awkward rows beside columns named like their own, and on an empty table."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarnfield.llm import classifier, common, decontaminate, packing, pii, quality_rules, secrets, sharding, simhash, token_store, url_filter
from tests.llm.conftest import DOCS
from tests.llm.test_operators import ITEMS, URLS

#: Names that operators use inside or return, now or in the past, and those names behind the underscore that would dodge them.
NAMES = """_row _at _ids at row item_ids item_id ids hit n_hit n_items contaminated width key words start length offset sequence_id padded_to input_ids _rank _part _base _n _mid _salt salt row_no law shard slot
size text_crc32 grown_shard raw mark n_tokens part start_in_part _mark __mark _id0 _none _times _kept kept fp u v m node root least component_id fingerprint bucket block no other _text __text _match _piece _m _p _m_email _p_email
_match_email _piece_email _start_email _span_email _s_email _f_email spans n_email n_assign base_sha256 n_words word_chars base_failed anomaly quality held_out predicted host path rule verdict rule_verdict digest best url text_ doc""".split()


def awkward(spark, rows=DOCS):
    plain = spark.createDataFrame([(r[0], r[1], r[2], r[3], None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return plain, plain.select("*", *[F.lit(f"{n}!").alias(n) for n in NAMES]).repartition(3)


def labels(spark):
    return spark.createDataFrame([(1, 1), (14, 1), (6, 0), (99, 1), (2, 0), (15, 1), (None, 1), (1, None)], "doc_id long, quality int")


def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def tokens_of(docs):
    path = common.scratch_path(docs.sparkSession, "clash")
    token_store.write_tokens(docs, path)
    return token_store.digests(token_store.read_tokens(docs.sparkSession, path)).select("doc_id", "n_tokens", "ids_crc32")


READERS = {
    "scan_documents": lambda d: decontaminate.scan_documents(d, items(d.sparkSession)), "scan_documents, large": lambda d: decontaminate.scan_documents(d, items(d.sparkSession), set_bytes=0),
    "pack": lambda d: packing.pack(d, with_ids=False).select("doc_id", "start", "length", "ids_crc32", "doc_tokens"), "find_secrets": secrets.find_secrets, "judge": lambda d: quality_rules.judge(d, labels(d.sparkSession)),
    "classify": lambda d: classifier.classify(d, labels(d.sparkSession)).withColumn("score", F.round("score", 4)), "near_duplicates": simhash.near_duplicates, "shard": lambda d: sharding.shard(d).select("doc_id", "size", "text_crc32"), "tokens": tokens_of, "find_pii": pii.find_pii,
}


@pytest.mark.parametrize("name", READERS)
def test_readers_leave_other_columns_aside(spark, name):
    plain, wide = awkward(spark)
    want, got = READERS[name](plain), READERS[name](wide)
    assert got.schema == want.schema
    assert Counter(map(str, got.collect())) == Counter(map(str, want.collect()))
    assert READERS[name](wide.where("false")).count() == 0


CHANGERS = {
    "remove": lambda d: decontaminate.remove_contaminated(d, items(d.sparkSession)), "remove, large": lambda d: decontaminate.remove_contaminated(d, items(d.sparkSession), set_bytes=0),
    "cut": lambda d: decontaminate.remove_contaminated(d, items(d.sparkSession), how="spans"), "cut, large": lambda d: decontaminate.remove_contaminated(d, items(d.sparkSession), how="spans", set_bytes=0),
    "redact_secrets": secrets.redact_secrets, "keep_good": lambda d: quality_rules.keep_good(d, labels(d.sparkSession)), "keep_one": simhash.keep_one, "redact_pii": pii.redact_pii,
}


@pytest.mark.parametrize("name", CHANGERS)
def test_changers_pass_other_columns_through(spark, name):
    plain, wide = awkward(spark)
    want, got = CHANGERS[name](plain), CHANGERS[name](wide)
    assert want.columns == plain.columns and got.columns == wide.columns
    rows = got.collect()
    assert all(r[n] == f"{n}!" for r in rows for n in NAMES)
    assert Counter(tuple(r[c] for c in plain.columns) for r in rows) == Counter(map(tuple, want.collect()))
    assert CHANGERS[name](wide.where("false")).count() == 0


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_url_filter_leaves_other_columns_aside(spark, bound, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", bound)
    pages = spark.createDataFrame([(k % 7 or None, u) for k, u in enumerate(URLS)], "page_id long, url string")
    wide = pages.select("*", *[F.lit(f"{n}!").alias(n) for n in NAMES if n != "url"])
    assert Counter(map(str, url_filter.filter_urls(wide).collect())) == Counter(map(str, url_filter.filter_urls(pages).collect()))
    # equally long rules that both fit: the least string, on either way
    tied = [("b.a.com", "/x", "block"), ("a.com", "/xyz", "allow"), ("com", "/", "allow")]
    got = url_filter.filter_urls(spark.createDataFrame([(1, "http://c.b.a.com/xyz")], "page_id long, url string"), tied).first()
    assert (got.rule, got.verdict) == ("a.com/xyz", "allow")
    assert {r.verdict for r in url_filter.filter_urls(pages, []).collect()} == {"allow"}


@pytest.fixture(scope="module")
def stage_dir(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("stages")
    labels(spark).write.parquet(f"{at}/labels.parquet")
    items(spark).write.parquet(f"{at}/benchmark.parquet")
    return str(at)


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_on_awkward_rows(spark, stage_dir, k):
    """Nulls, empty and very long texts, repeated rows, clashing columns and an empty table, stage by stage."""
    name, stage = corpus_pipeline.STAGES[k]
    plain, wide = awkward(spark)
    rows, want = stage(spark, wide, stage_dir), stage(spark, plain, stage_dir)
    if k < len(corpus_pipeline.STAGES) - 1:
        assert rows.columns == wide.columns and want.columns == plain.columns, name
        own = plain.columns
    else:
        own = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset"]
    assert Counter(tuple(r[c] for c in own) for r in rows.collect()) == Counter(tuple(r[c] for c in own) for r in want.collect()), name
    assert stage(spark, wide.where("false"), stage_dir).count() == 0


def test_pipeline_drops_what_it_needs_no_more(spark, sf, tmp_path):
    """After run() the shared folder holds what its result reads and nothing else; a sweep leaves this application's tables."""
    import os
    from pathlib import Path

    at = Path(common.shared_dir(spark).removeprefix("file:")) / "tarnfield" / spark.sparkContext.applicationId
    common.clear_scratch(spark)
    rows = corpus_pipeline.run(spark, sf)
    left = {p.name.rsplit("-", 1)[0] for p in at.iterdir() if not p.name.startswith(".")}
    assert left == {"packed", "packed-starts"} and rows.count() > 0
    other = at.parent / "application_of_another"
    (other / "links-1").mkdir(parents=True)
    year = 24 * 365
    assert other.name not in common.sweep_scratch(spark, hours=year)
    for p in (other / "links-1", other):
        os.utime(p, (0, 0))
    assert other.name in common.sweep_scratch(spark, hours=year) and at.exists() and not other.exists()
    kept = common.settled(spark, lambda: common.scratch(spark.range(3), "inner").where("id > 0"), "outer")
    assert kept.count() == 2 and {p.name.rsplit("-", 1)[0] for p in at.iterdir() if not p.name.startswith(".")} == left | {"outer"}


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Context:
        master, _jsc = "spark://host:7077", None

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
    Context.master = "local-cluster[3,2,1024]"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_few_rows_are_broadcast_within_the_bound_alone(spark, monkeypatch):
    rows, few = spark.range(100).withColumnRenamed("id", "k"), spark.createDataFrame([(k, 2 * k) for k in range(100)], "k long, v long")
    for bound, how in ((1 << 20, "BroadcastHashJoin"), (0, "SortMergeJoin")):
        monkeypatch.setattr(common, "BROADCAST_BYTES", bound)
        joined = common.join_few(rows, few, 100, 16, ["k"])
        assert joined.count() == 100 and how in joined._jdf.queryExecution().toString()
    starts, parts, total = common.part_starts(spark.createDataFrame([(3, 5), (0, 2), (1, 0)], "p int, n long"), "p", "n", "s")
    assert {(r.p, r.s) for r in starts.collect()} == {(0, 0), (1, 2), (3, 2)} and (parts, total) == (3, 7)
