"""Incremental ingest and storage as joins: statuses, sweeps, upserts, purges, caches, retention.

No table is changed in place: each function returns the new state, to be written to a
new path and then published.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnfield.scratch import store_of

VERSIONS = ("asset_id", "parser_version", "chunker_version", "embedding_version")


def effective_version(base: Column, *settings: Column) -> Column:
    """Parser version with the signature of the settings that change its output."""
    return F.concat_ws("+", base, *settings)


def ingest_status(scanned: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """Scanned assets with status new, updated or unchanged by path and all versions."""
    old = stored.select("workspace_path", *[F.col(c).alias(f"_{c}") for c in VERSIONS], F.lit(True).alias("_there"))
    same = F.lit(not force)
    for c in VERSIONS:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    status = F.when(F.col("_there").isNull(), "new").when(same, "unchanged").otherwise("updated")
    return scanned.join(old, "workspace_path", "left").withColumn("status", status).drop("_there", *[f"_{c}" for c in VERSIONS])


def deleted(stored: DataFrame, scanned: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Stored documents that are neither scanned nor on disk; what is out of scope but on disk stays."""
    return stored.join(scanned.select("workspace_path"), "workspace_path", "left_anti").join(on_disk.select("workspace_path"), "workspace_path", "left_anti")


def upsert(stored: DataFrame, fresh: DataFrame, now: datetime) -> DataFrame:
    """Documents by doc_id: new ones at version 1, known ones at the next with their creation time kept; others as they were.

    Of several fresh rows of one doc_id the one of least hash counts.
    """
    pick = F.min_by(F.struct(*fresh.columns), F.xxhash64(*fresh.columns)).alias("n")
    fresh = fresh.groupBy(F.col("doc_id").alias("_id")).agg(pick).select("n.*")
    old = stored.select("doc_id", F.struct(*stored.columns).alias("o"))
    new = fresh.select("doc_id", F.struct(*fresh.columns).alias("n"))
    j = old.join(new, "doc_id", "full_outer")
    came = F.col("n").isNotNull()
    cols = []
    for c in stored.columns:
        if c == "doc_version":
            v = F.when(came, F.coalesce(F.col("o.doc_version"), F.lit(0)) + 1).otherwise(F.col("o.doc_version"))
        elif c == "created_at":
            v = F.coalesce(F.col("o.created_at"), F.lit(now))
        elif c == "updated_at":
            v = F.when(came, F.lit(now)).otherwise(F.col("o.updated_at"))
        elif c == "doc_id":
            v = F.col("doc_id")
        else:
            v = F.when(came, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in fresh.columns else F.col(f"o.{c}")
        cols.append(v.alias(c))
    return j.select(*cols)


def replace_children(stored: DataFrame, fresh: DataFrame, key: str = "doc_id", of: DataFrame | None = None) -> DataFrame:
    """Children (blocks, chunks, tags) of the documents in ``of`` are replaced by those in ``fresh``; without it, of all documents that have any there."""
    return stored.join((fresh if of is None else of).select(key).distinct(), key, "left_anti").unionByName(fresh)


def purge(gone: DataFrame, docs: DataFrame, chunks: DataFrame, embeddings: DataFrame, assets: DataFrame) -> dict[str, DataFrame]:
    """All tables without the documents in ``gone``; assets go when no document is left to them."""
    left = docs.join(gone.select("doc_id"), "doc_id", "left_anti")
    kept_chunks = chunks.join(gone.select("doc_id"), "doc_id", "left_anti")
    return {"documents": left, "chunks": kept_chunks, "embeddings": embeddings.join(kept_chunks.select("chunk_id"), "chunk_id", "left_semi"), "assets": assets.join(left.select("asset_id"), "asset_id", "left_semi")}


def upsert_vectors(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Vectors by chunk, the fresh ones first; a table holds one model and one width.

    With a status column the fresh ones come as ``pending``: readers see them after commit.
    """
    shape = [F.col("model_id"), *[F.size("embedding")] * ("embedding" in fresh.columns)]
    if stored.select(*shape).unionByName(fresh.select(*shape)).distinct().limit(2).count() > 1:
        raise ValueError("mixed models")
    if "status" in fresh.columns:
        fresh = fresh.withColumn("status", F.lit("pending"))
    ranked = stored.withColumn("_f", F.lit(1)).unionByName(fresh.withColumn("_f", F.lit(0)))
    return ranked.withColumn("_n", F.row_number().over(Window.partitionBy("chunk_id", "model_id").orderBy("_f", F.xxhash64(*fresh.columns)))).where("_n = 1").drop("_f", "_n")


def commit(embeddings: DataFrame) -> DataFrame:
    """Pending vectors are visible from now on."""
    return embeddings.withColumn("status", F.when(F.col("status") == "pending", "committed").otherwise(F.col("status")))


def committed(embeddings: DataFrame) -> DataFrame:
    return embeddings.where("status = 'committed'")


def cache_key(kind: str, *content: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(kind), *content), 256)


def cache_split(wanted: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits with their payload, and the distinct misses; a null payload is a miss."""
    good = cache.where("payload is not null").select("cache_key", "payload")
    return wanted.join(good, "cache_key"), wanted.select("cache_key").distinct().join(good, "cache_key", "left_anti")


def cache_put(cache: DataFrame, fresh: DataFrame, now: datetime) -> DataFrame:
    """The cache with fresh payloads (cache_key, kind, payload)."""
    new = fresh.dropDuplicates(["cache_key"]).withColumn("created_at", F.lit(now)).withColumn("last_used_at", F.lit(now))
    return cache.join(new.select("cache_key"), "cache_key", "left_anti").unionByName(new)


def cache_touch(cache: DataFrame, used: DataFrame, now: datetime) -> DataFrame:
    hit = used.select("cache_key").distinct().withColumn("_hit", F.lit(True))
    return cache.join(hit, "cache_key", "left").withColumn("last_used_at", F.when(F.col("_hit"), F.lit(now)).otherwise(F.col("last_used_at"))).drop("_hit")


def cache_gc(cache: DataFrame, now: datetime, ttl_days: int) -> DataFrame:
    """Without what wasn't used for ``ttl_days``; 0 or less keeps all."""
    return cache if ttl_days <= 0 else cache.where(F.col("last_used_at") >= F.lit(now - timedelta(days=ttl_days)))


def backfill(chunks: DataFrame, column: str, value: Column) -> DataFrame:
    return chunks.withColumn(column, F.coalesce(column, value))


def retain(events: DataFrame, now: datetime, days: int, keep: int | None = None, partition: str = "run_id") -> DataFrame:
    """Events no older than ``days``; with ``keep``, also among the newest of their partition."""
    young = events.where(F.col("ts") >= F.lit(now - timedelta(days=days)))
    if keep is None:
        return young
    return young.withColumn("_n", F.row_number().over(Window.partitionBy(partition).orderBy(F.desc("ts"), "event_id"))).where(F.col("_n") <= keep).drop("_n")


def next_revision(revision: int, report: DataFrame) -> int:
    """One more if anything was new, updated or purged."""
    changed = report.where("status in ('new', 'updated', 'purged')").limit(1).count()
    return revision + (1 if changed else 0)


def orphans(docs: DataFrame, chunks: DataFrame, embeddings: DataFrame, assets: DataFrame) -> DataFrame:
    """tbl, id of what nothing refers to any more: chunks without a document, vectors without a chunk, assets without a document."""
    lost = chunks.join(docs.select("doc_id"), "doc_id", "left_anti").select(F.lit("chunks").alias("tbl"), F.col("chunk_id").alias("id"))
    blind = embeddings.join(chunks.join(docs.select("doc_id"), "doc_id", "left_semi").select("chunk_id"), "chunk_id", "left_anti").select(F.lit("embeddings").alias("tbl"), F.col("chunk_id").alias("id"))
    unused = assets.join(docs.select("asset_id"), "asset_id", "left_anti").select(F.lit("assets").alias("tbl"), F.col("asset_id").alias("id"))
    return lost.unionByName(blind).unionByName(unused)


def stale_assets(chunks: DataFrame, docs: DataFrame, assets: DataFrame) -> DataFrame:
    """Documents whose chunks were made from another asset than the one now at their path."""
    j = docs.join(assets.select("workspace_path", F.col("asset_id").alias("now_id")), "workspace_path").where(F.col("asset_id") != F.col("now_id"))
    return j.join(chunks.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "workspace_path", "asset_id", "now_id")


# jobs ------------------------------------------------------------------------------------------
JOB = "job_id string, kind string, status string, payload string, progress string, error string, created_at timestamp, updated_at timestamp, finished_at timestamp"
STATUSES = ("pending", "running", "succeeded", "failed", "canceled")


def new_job(spark: SparkSession, kind: str, payload: dict, now: datetime) -> DataFrame:
    """One pending job; equal payloads at other times have other ids."""
    text = json.dumps(payload, sort_keys=True, ensure_ascii=False)
    job_id = hashlib.sha256("\x1f".join([kind, text, now.isoformat()]).encode()).hexdigest()[:32]
    return spark.createDataFrame([(job_id, kind, "pending", text, None, None, now, now, None)], JOB)


def job_progress(jobs: DataFrame, job_id: str, progress: dict, now: datetime) -> DataFrame:
    """The first progress of a pending job makes it running."""
    own = F.col("job_id") == job_id
    status = F.when(own & (F.col("status") == "pending"), "running").otherwise(F.col("status"))
    return jobs.withColumns({"status": status, "progress": F.when(own, json.dumps(progress)).otherwise(F.col("progress")), "updated_at": F.when(own, F.lit(now)).otherwise(F.col("updated_at"))})


def job_finished(jobs: DataFrame, job_id: str, status: str, now: datetime, error: str | None = None) -> DataFrame:
    if status not in STATUSES:
        raise ValueError(f"unknown status {status}")
    own = F.col("job_id") == job_id
    told = F.lit(json.dumps({"message": error}) if error is not None else None).cast("string")
    return jobs.withColumns({"status": F.when(own, status).otherwise(F.col("status")), "error": F.when(own, told).otherwise(F.col("error")), "updated_at": F.when(own, F.lit(now)).otherwise(F.col("updated_at")), "finished_at": F.when(own, F.lit(now)).otherwise(F.col("finished_at"))})


def list_jobs(jobs: DataFrame, status: str | None = None, kind: str | None = None) -> DataFrame:
    """Jobs that pass, the oldest first."""
    for column, value in (("status", status), ("kind", kind)):
        jobs = jobs if value is None else jobs.where(F.col(column) == value)
    return jobs.orderBy("created_at", "job_id")


def run_report(items: DataFrame, run_id: str, started: datetime, finished: datetime) -> DataFrame:
    """One row: how many items (status) of an ingest run were new, updated, unchanged or skipped, or failed."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return items.agg(F.count(F.lit(1)).alias("scanned"), n("new").alias("n_new"), n("updated").alias("n_updated"), n("skipped", "unchanged").alias("n_skipped"), n("error").alias("n_error")).select(
        F.lit(run_id).alias("run_id"), "*", F.lit(int((finished - started).total_seconds() * 1000)).alias("duration_ms"), F.lit(started).alias("started_at"), F.lit(finished).alias("finished_at")
    )


# checks ----------------------------------------------------------------------------------------
#: Columns with a closed set of values; fixed values.
DOMAINS = {
    "storage_kind": ("copied", "reference"), "trust_level": ("primary", "secondary", "generated"), "source_type": ("markdown", "note", "paper", "reference", "inbox"), "status": ("pending", "committed", "tombstone"),
}


def domain_faults(rows: DataFrame, domains: dict[str, tuple[str, ...]]) -> DataFrame:
    """column, value, n of values outside their columns' domains; nulls count as outside."""
    out = None
    for column, allowed in domains.items():
        bad = rows.where(F.col(column).isNull() | ~F.col(column).isin(*allowed)).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(column).alias("column"), "value", "n")
        out = bad if out is None else out.unionByName(bad)
    return out


def any_row(rows: DataFrame) -> bool:
    """Whether there is a row; the search ends at the first."""
    return not rows.isEmpty()


# publishing ------------------------------------------------------------------------------------
POINTER = "CURRENT"


def publish(spark: SparkSession, df: DataFrame, path: str, keep: int = 2) -> str:
    """Writes a new version below ``path``, then turns the pointer to it by one rename; returns the version's path.

    Readers (``published``) see the old or the new version, and a crash at any point
    leaves the old one. The ``keep`` newest versions stay.
    """
    at, store = store_of(spark, path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    version = f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{path}/{version}")
    draft = hadoop.Path(f"{path}/.{POINTER}-{version}")
    out = store.create(draft, True)
    out.write(version.encode())
    out.close()
    uri = at.makeQualified(store.getUri(), store.getWorkingDirectory()).toUri()
    overwrite = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(uri, spark.sparkContext._jsc.hadoopConfiguration()).rename(store.makeQualified(draft), store.makeQualified(hadoop.Path(f"{path}/{POINTER}")), overwrite)
    versions = sorted(s.getPath().getName() for s in store.listStatus(at) if s.getPath().getName().startswith("v-"))
    for old in versions[: -max(keep, 1)]:
        if old != version:
            store.delete(hadoop.Path(f"{path}/{old}"), True)
    return f"{path}/{version}"


def published(spark: SparkSession, path: str) -> DataFrame:
    """The version that the pointer names."""
    name = spark.read.option("wholetext", True).text(f"{path}/{POINTER}").first()[0]
    return spark.read.parquet(f"{path}/{name}")


def append(df: DataFrame, path: str) -> None:
    """Rows are added to a table, answers or runs for instance."""
    df.write.mode("append").parquet(path)
