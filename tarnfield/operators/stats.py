"""Corpus and run statistics, exact lower-rank percentiles, lookups."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Kinds that are reported even without documents; fixed values.
MEDIA_KINDS = ("markdown", "pdf", "image", "audio", "other")


def counts(docs: DataFrame, chunks: DataFrame, assets: DataFrame) -> DataFrame:
    one = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.max("updated_at").alias("last_updated"))
    return one.crossJoin(chunks.agg(F.count(F.lit(1)).alias("n_chunks"))).crossJoin(assets.agg(F.count(F.lit(1)).alias("n_assets")))


def by_media(docs: DataFrame) -> DataFrame:
    """Distinct documents for each kind; the five kinds always, others where they occur."""
    seen = docs.groupBy("media").agg(F.count_distinct("doc_id").alias("n"))
    kinds = docs.sparkSession.createDataFrame([(k,) for k in MEDIA_KINDS], "media string")
    return kinds.join(seen, "media", "full_outer").select("media", F.coalesce("n", F.lit(0)).alias("n"))


def by_value(docs: DataFrame, value: Column, null_as: str | None = None) -> DataFrame:
    """Rows for each value; nulls are left out or named."""
    out = docs.select(value.cast("string").alias("value"))
    out = out.where("value is not null") if null_as is None else out.select(F.coalesce("value", F.lit(null_as)).alias("value"))
    return out.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def stale_count(docs: DataFrame, now: datetime, days: int) -> DataFrame:
    return docs.agg(F.count_if(F.col("updated_at") < F.lit(now - timedelta(days=days))).alias("n_stale"))


def versions(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.coalesce(F.col(column), F.lit("")) != "").select(column).distinct().orderBy(column)


def as_map(rows: DataFrame, key: str, value: str) -> DataFrame:
    """One row with a map in the order of its keys."""
    return rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("counts"))


def lower_percentile(rows: DataFrame, value: str, percents: tuple[int, ...] = (50, 90, 99), by: list[str] | None = None, slots: int = 64) -> DataFrame:
    """Exact percentiles at the 0-based place (n - 1) * p div 100 of the sorted values, and the maximum.

    Values are counted first, so what is ranked is one row for each distinct value of a
    group. Groups are cut into slots at approximate quantiles of all values: the slots'
    sums tell where a percentile lies, and each slot is ranked by a task of its own.
    """
    by = by or []
    keys = [f"_k{i}" for i in range(len(by))]
    own = rows.where(F.col(value).isNotNull()).select(*[F.struct(F.col(c)).alias(k) for c, k in zip(by, keys, strict=True)], F.col(value).alias("_v"))
    hist = own.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    cuts = [k / slots for k in range(1, slots)]
    bounds = sorted(set(own.agg(F.percentile_approx(F.col("_v").cast("double"), cuts, 1000)).first()[0] or ())) if cuts else []
    slot = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("_v").cast("double"))) if bounds else F.lit(0)
    hist = hist.withColumn("_slot", slot)
    sums = hist.groupBy(*keys, "_slot").agg(F.sum("_c").alias("_s"))
    group = Window.partitionBy(*keys)
    sums = sums.withColumns({"_before": F.coalesce(F.sum("_s").over(group.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_n": F.sum("_s").over(group)})
    run = hist.join(sums, [*keys, "_slot"])
    run = run.withColumn("_upto", F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_slot").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    place = lambda p: F.floor((F.col("_n") - 1) * p / 100) + 1
    out = run.groupBy(*keys).agg(*[F.min(F.when(F.col("_upto") >= place(p), F.col("_v"))).alias(f"p{p}") for p in percents], F.max("_v").alias("max"))
    return out.select(*[F.col(f"{k}.{c}").alias(c) for c, k in zip(by, keys, strict=True)], *[f"p{p}" for p in percents], "max")


def ocr_stats(events: DataFrame) -> DataFrame:
    """Events, successes, failures, runs and success rate (0 without events)."""
    return events.agg(F.count(F.lit(1)).alias("n_events"), F.count_if("success").alias("n_success"), F.count_if(~F.col("success")).alias("n_failure"), F.count_distinct("run_id").alias("n_runs"), F.round(F.coalesce(F.avg(F.col("success").cast("double")), F.lit(0.0)), 4).alias("success_rate"))


def top_failing(events: DataFrame, n: int = 10) -> DataFrame:
    """Documents with the most failures, ties by id; a top-k report."""
    return events.where(~F.col("success")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("failures")).orderBy(F.desc("failures"), "doc_id").limit(n)


def failures(events: DataFrame, n: int = 10) -> DataFrame:
    return events.where(~F.col("success")).orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def by_outcome(items: DataFrame) -> DataFrame:
    """Items of an ingest run by outcome (status) and by extension; files without one count under ``<no-ext>``."""
    ext = F.when(F.regexp_extract("workspace_path", r"[^/]\.([^./]+)$", 1) == "", "<no-ext>").otherwise(F.lower(F.regexp_extract("workspace_path", r"[^/]\.([^./]+)$", 1)))
    return items.groupBy("status", ext.alias("ext")).agg(F.count(F.lit(1)).alias("n"))


def index_bytes(spark: SparkSession, *paths: str) -> DataFrame:
    """path, n_files, bytes of all files below each path; no content is read."""
    out = None
    for path in paths:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length")
        one = files.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).select(F.lit(path).alias("path"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def schema_stats(docs: DataFrame, chunks: DataFrame, assets: DataFrame) -> DataFrame:
    """One row: counts, and the sorted versions of parsers and chunkers in use (empty ones left out)."""
    used = lambda rows, c: F.array_sort(F.array_distinct(F.collect_set(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))))).alias(f"{c}s")
    return counts(docs, chunks, assets).crossJoin(docs.agg(used(docs, "parser_version"))).crossJoin(chunks.agg(used(chunks, "chunker_version")))


def inspect_doc(doc_id: str, docs: DataFrame, blocks: DataFrame, chunks: DataFrame, tags: DataFrame) -> DataFrame:
    """The document's row with its blocks and chunks in order and its sorted tags; no row for an unknown id."""
    own = lambda df: df.where(F.col("doc_id") == doc_id)
    # one document's children: their number is bounded by the document
    listed = lambda df, name, first: own(df).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(first, *[c for c in df.columns if c not in ("doc_id", first)]))).alias(name))
    out = own(docs).join(listed(blocks, "blocks", "ordinal"), "doc_id", "left").join(listed(chunks, "chunks", "ordinal"), "doc_id", "left")
    return out.join(own(tags).groupBy("doc_id").agg(F.array_sort(F.collect_set("tag")).alias("tags")), "doc_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def inspect_chunk(chunk_id: str, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """The chunk's row with its document's columns; no row for an unknown id."""
    own = chunks.where(F.col("chunk_id") == chunk_id)
    return own.join(docs.select("doc_id", *[F.col(c).alias(f"doc_{c}") for c in docs.columns if c != "doc_id"]), "doc_id", "left")


def fetch_doc(docs: DataFrame, max_tokens: int | None = None) -> DataFrame:
    """doc_id, text, truncated: whole texts, or their first four characters a token."""
    if max_tokens is None:
        return docs.select("doc_id", "text", F.lit(False).alias("truncated"))
    most = 4 * max_tokens
    return docs.select("doc_id", F.substring("text", 1, most).alias("text"), F.coalesce(F.length("text") > most, F.lit(False)).alias("truncated"))


def neighbours(chunks: DataFrame, targets: DataFrame, around: int = 1) -> DataFrame:
    """Chunks up to ``around`` places from each target chunk within its document."""
    t = targets.join(chunks.select("chunk_id", "doc_id", "ordinal"), "chunk_id").select(F.col("chunk_id").alias("target"), "doc_id", F.col("ordinal").alias("at"))
    return chunks.join(t, "doc_id").where(F.abs(F.col("ordinal") - F.col("at")) <= around).select("target", "doc_id", "chunk_id", "ordinal")


def fetch_span(docs: DataFrame, start: int, end: int) -> DataFrame:
    """Lines start..end (1-based, inclusive): text, effective_end. The end is clamped; a start past the end gives no text.

    Documents without lines (a ``media`` of pdf or audio) are refused: error says so, and they have no text.
    """
    if start < 1 or end < start:
        raise ValueError("a span starts at line 1 or later and doesn't end before it starts")
    lines = F.split("text", "\n")
    n = F.size(lines)
    last = F.when(F.lit(start) > n, start - 1).otherwise(F.least(F.lit(end), n))
    body = F.when(last >= start, F.array_join(F.slice(lines, F.lit(start), F.greatest(last - start + 1, F.lit(0))), "\n")).otherwise("")
    if "media" not in docs.columns:
        return docs.select("doc_id", body.alias("span_text"), last.cast("int").alias("effective_end"))
    refused = F.col("media").isin("pdf", "audio")
    return docs.select("doc_id", F.when(~refused, body).alias("span_text"), F.when(~refused, last.cast("int")).alias("effective_end"), F.when(refused, "span_not_supported").alias("error"))


def doc_summaries(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with their number of chunks, by path."""
    n = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    return docs.join(n, "doc_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
