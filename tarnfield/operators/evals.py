"""Retrieval evaluation: metrics over golden queries, comparison of runs, paraphrase groups.

``golden``: query_id, expected_chunk_ids, expected_doc_ids, must_contain, forbidden (arrays), group.
``hits``: query_id, rank, chunk_id, doc_id. ``answers``: query_id, answer, grounded, citations (array of paths), error.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KS = (1, 3, 5, 10)
MRR_CUT = 10


def _count(c: Column) -> Column:
    return F.coalesce(F.size(F.when(c.isNotNull(), c)), F.lit(0))


def first_ranks(golden: DataFrame, hits: DataFrame, by: str = "chunk") -> DataFrame:
    """query_id, n_expected, first_rank (null: missed) by expected chunks or documents; by ``exact``, by chunks where any are expected, else by documents."""
    listed = lambda c: F.array_distinct(F.coalesce(f"expected_{c}_ids", F.array().cast("array<string>")))
    chunks = F.lit(by == "chunk") if by != "exact" else F.size(listed("chunk")) > 0
    expected = golden.select("query_id", F.when(chunks, listed("chunk")).otherwise(listed("doc")).alias("expected"), chunks.alias("_by_chunk")) if by != "doc" else golden.select("query_id", listed("doc").alias("expected"), F.lit(False).alias("_by_chunk"))
    own = F.when(F.col("_by_chunk"), F.col("chunk_id")).otherwise(F.col("doc_id"))
    found = hits.join(expected, "query_id").where(F.array_contains("expected", own)).groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return expected.select("query_id", F.size("expected").alias("n_expected")).join(found, "query_id", "left")


def per_query(golden: DataFrame, hits: DataFrame, by: str = "chunk") -> DataFrame:
    """One row for each golden query with expectations: first rank, relevant hits and covered documents at each k."""
    g = golden.select("query_id", F.array_distinct(f"expected_{by}_ids").alias("expected"), F.array_distinct("expected_doc_ids").alias("docs"))
    j = g.join(hits.select("query_id", "rank", "doc_id", F.col(f"{by}_id").alias("_hit")), "query_id", "left")
    hit = F.array_contains("expected", F.col("_hit"))
    covers = F.array_contains("docs", F.col("doc_id"))
    aggs = [F.min(F.when(hit, F.col("rank"))).alias("first_rank"), F.first(_count(F.col("expected"))).alias("n_expected"), F.first(_count(F.col("docs"))).alias("n_docs")]
    for k in KS:
        aggs += [F.count_if(hit & (F.col("rank") <= k)).alias(f"rel_{k}"), F.count_distinct(F.when(covers & (F.col("rank") <= k), F.col("doc_id"))).alias(f"cov_{k}")]
    return j.groupBy("query_id").agg(*aggs)


def metrics(golden: DataFrame, hits: DataFrame, answers: DataFrame | None = None, run: DataFrame | None = None, by: str = "chunk") -> DataFrame:
    """One row of metrics, rounded to four places.

    Ratios with an empty denominator are 0, but citation_coverage and
    refusal_correctness, which are null. precision@k divides by k even where fewer
    hits came back. ``run`` (query_id, n_hits, failed) counts rows without golden, too.
    """
    q = per_query(golden, hits, by)
    has = F.col("n_expected") > 0
    avg = lambda v, cond: F.round(F.coalesce(F.avg(F.when(cond, v)), F.lit(0.0)), 4)
    cols = []
    for k in KS:
        cols.append(avg(F.when(F.col("first_rank") <= k, 1.0).otherwise(0.0), has).alias(f"hit_at_{k}"))
        cols.append(avg(F.col(f"rel_{k}") / float(k), has).alias(f"precision_at_{k}"))
        cols.append(avg(F.col(f"cov_{k}") / F.col("n_docs"), F.col("n_docs") > 0).alias(f"recall_at_{k}"))
    cols.append(avg(F.when(F.col("first_rank") <= MRR_CUT, 1 / F.col("first_rank")).otherwise(0.0), has).alias("mrr"))
    out = q.agg(*cols)
    if run is not None:
        out = out.crossJoin(F.broadcast(run.agg(F.count(F.lit(1)).alias("total"), F.count_if("failed").alias("failed"), F.round(F.coalesce(F.avg((F.col("n_hits") == 0).cast("double")), F.lit(0.0)), 4).alias("empty_result_rate"))))
    if answers is not None:
        out = out.crossJoin(F.broadcast(answer_metrics(golden, answers)))
    return out


def answer_metrics(golden: DataFrame, answers: DataFrame) -> DataFrame:
    """groundedness, citation_coverage, refusal_correctness in one row."""
    j = answers.join(golden.select("query_id", "must_contain", "forbidden", "expected_doc_ids"), "query_id", "left")
    ok = F.col("error").isNull()
    asked = ok & (_count(F.col("must_contain")) + _count(F.col("forbidden")) > 0)
    text = F.coalesce("answer", F.lit(""))
    holds = F.coalesce(F.forall("must_contain", lambda m: F.contains(text, m)), F.lit(True)) & ~F.coalesce(F.exists("forbidden", lambda m: F.contains(text, m)), F.lit(False))
    cited = F.col("grounded") & (_count(F.col("citations")) > 0)
    refusable = F.col("expected_doc_ids").isNotNull() & (_count(F.col("expected_doc_ids")) == 0) & F.col("answer").isNotNull()
    share = lambda v, cond: F.round(F.avg(F.when(cond, v.cast("double"))), 4)
    return j.agg(
        F.coalesce(share(holds, asked), F.lit(0.0)).alias("groundedness"),
        share(F.forall("citations", lambda p: p != ""), cited).alias("citation_coverage"),
        share(~F.col("grounded"), refusable).alias("refusal_correctness"),
    )


def compare(a: DataFrame, b: DataFrame, golden: DataFrame) -> DataFrame:
    """query_id, a_rank, b_rank, kind (win, loss, draw, regression) of first ranks (query_id, first_rank) of two runs."""
    expected = golden.select("query_id", ((_count(F.col("expected_chunk_ids")) + _count(F.col("expected_doc_ids"))) > 0).alias("has"))
    j = a.select("query_id", F.col("first_rank").alias("a_rank")).join(b.select("query_id", F.col("first_rank").alias("b_rank")), "query_id", "full_outer").join(expected, "query_id", "left")
    ra, rb = F.col("a_rank"), F.col("b_rank")
    kind = F.when(ra.isNull() & rb.isNull(), "draw").when(ra.isNull(), "win").when(rb.isNull(), F.when(F.coalesce("has", F.lit(False)), "regression").otherwise("loss")).when(rb < ra, "win").when(rb > ra, "loss").otherwise("draw")
    return j.select("query_id", "a_rank", "b_rank", kind.alias("kind"))


def choose_level(a_versions: set[str], b_versions: set[str], strict: bool = False) -> str:
    """Runs with other chunker versions are compared by documents, or not at all."""
    if a_versions == b_versions:
        return "chunk"
    if strict:
        raise ValueError("chunker versions differ")
    return "doc"


@dataclass(frozen=True)
class Run:
    """One evaluation: its id and settings, a row for each query, and the hits."""

    run_id: str
    config: dict
    queries: DataFrame
    hits: DataFrame


def run_eval(golden: DataFrame, find: Callable[[DataFrame], DataFrame], run_id: str, config: dict, answers: DataFrame | None = None) -> Run:
    """Asks all golden queries at once: ``find`` takes (query_id, text) and returns hits (query_id, rank, chunk_id, doc_id, score).

    ``config`` must name the chunker_version. Answers, where there are any, come as data
    (query_id, answer, grounded, citations, error) and their errors mark queries as failed.
    """
    if "chunker_version" not in config:
        raise ValueError("config names no chunker_version")
    text = "query" if "query" in golden.columns else "text"
    key = "id" if "id" in golden.columns else "query_id"
    asked = golden.select(F.col(key).alias("query_id"), F.col(text).alias("text"))
    hits = find(asked).withColumn("run_id", F.lit(run_id))
    n = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"), F.min_by(F.struct("chunk_id", "doc_id", "score"), "rank").alias("first_hit"))
    rows = asked.join(n, "query_id", "left").withColumns({"n_hits": F.coalesce("n_hits", F.lit(0)), "run_id": F.lit(run_id)})
    if answers is not None:
        rows = rows.join(answers.select("query_id", F.lit(True).alias("has_answer"), "error"), "query_id", "left")
    else:
        rows = rows.withColumn("error", F.lit(None).cast("string"))
    has = F.coalesce("has_answer", F.lit(False)) if answers is not None else F.lit(False)
    return Run(run_id, dict(config), rows.select("run_id", "query_id", F.col("text").alias("query"), "n_hits", "first_hit", has.alias("has_answer"), "error", F.col("error").isNotNull().alias("failed")), hits)


def save_run(run: Run, path: str) -> None:
    """Settings, a JSON line for each query and the hits below ``path``/run_id."""
    spark = run.queries.sparkSession
    at = f"{path}/{run.run_id}"
    spark.createDataFrame([(run.run_id, json.dumps(run.config, sort_keys=True))], "run_id string, config string").write.parquet(f"{at}/run")
    run.queries.write.parquet(f"{at}/queries")
    run.queries.write.json(f"{at}/per_query")
    run.hits.write.parquet(f"{at}/hits")


def load_run(spark: SparkSession, path: str, run_id: str) -> Run:
    at = f"{path}/{run_id}"
    return Run(run_id, json.loads(spark.read.parquet(f"{at}/run").first()["config"]), spark.read.parquet(f"{at}/queries"), spark.read.parquet(f"{at}/hits"))


def run_metrics(golden: DataFrame, run: Run, answers: DataFrame | None = None) -> DataFrame:
    """The metrics of a run, its totals included."""
    return metrics(golden, run.hits, answers, run.queries.select("query_id", "n_hits", "failed"))


def compare_runs(a: Run, b: Run, golden: DataFrame, strict: bool = False) -> dict[str, DataFrame]:
    """per_query (query_id, a_rank, b_rank, kind), deltas and level (exact or doc) of two runs.

    Runs of other chunker versions are compared by documents, or not at all if ``strict``;
    deltas of metrics by chunk are null then.
    """
    level = "exact" if choose_level({a.config["chunker_version"]}, {b.config["chunker_version"]}, strict) == "chunk" else "doc"
    ids = a.queries.select("query_id").unionByName(b.queries.select("query_id")).distinct()
    known = golden.select("query_id", "expected_chunk_ids", "expected_doc_ids")
    g = ids.join(known, "query_id", "left")
    per_query = compare(first_ranks(g, a.hits, level), first_ranks(g, b.hits, level), golden)
    by_chunk = tuple(f"{m}_{k}" for k in KS for m in ("hit_at", "precision_at")) + ("mrr",)
    diff = deltas(run_metrics(golden, a), run_metrics(golden, b))
    if level == "doc":
        diff = diff.withColumns({c: F.lit(None).cast("double") for c in by_chunk})
    return {"per_query": per_query, "deltas": diff, "level": golden.sparkSession.createDataFrame([(level,)], "level string")}


def deltas(a: DataFrame, b: DataFrame) -> DataFrame:
    """b - a of each metric of two one-row frames; null where either is null."""
    return a.select(F.struct("*").alias("a")).crossJoin(b.select(F.struct("*").alias("b"))).select(*[F.round(F.col(f"b.{c}") - F.col(f"a.{c}"), 4).alias(c) for c in a.columns])


def variants(golden: DataFrame, hits: DataFrame, narrow: int = 10, wide: int = 50) -> DataFrame:
    """query_id, group, recall at both depths, class: ok, misranked, missing, no_expected."""
    g = golden.select("query_id", "group", F.array_distinct(F.coalesce("expected_doc_ids", F.array().cast("array<string>"))).alias("docs"))
    j = g.join(hits.select("query_id", "rank", "doc_id"), "query_id", "left")
    cov = lambda k: F.count_distinct(F.when(F.array_contains("docs", F.col("doc_id")) & (F.col("rank") <= k), F.col("doc_id")))
    q = j.groupBy("query_id", "group").agg(F.first(F.size("docs")).alias("n"), cov(narrow).alias("cn"), cov(wide).alias("cw"), F.max("rank").alias("deepest"))
    r = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(0.0)
    kind = F.when(F.col("n") == 0, "no_expected").when(r("cn") >= 1, "ok").when(r("cw") > r("cn"), "misranked").otherwise("missing")
    return q.select("query_id", "group", r("cn").alias("recall_narrow"), r("cw").alias("recall_wide"), kind.alias("kind"), "deepest")


def variant_groups(rows: DataFrame, wide: int = 50) -> DataFrame:
    """For each group: spread and worst of the narrow recall, whether all are ok, counts by class, whether the pool may have been cut short."""
    return rows.where("`group` is not null").groupBy("group").agg(
        F.round(F.max("recall_narrow") - F.min("recall_narrow"), 4).alias("spread"), F.round(F.min("recall_narrow"), 4).alias("worst"), F.bool_and(F.col("kind") == "ok").alias("consistent"),
        F.count_if(F.col("kind") == "misranked").alias("n_misranked"), F.count_if(F.col("kind") == "missing").alias("n_missing"), (F.coalesce(F.max("deepest"), F.lit(0)) < wide).alias("pool_possibly_truncated"),
    )
