"""Streaming ingest: new asset files go through the incremental pipeline in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def asset_stream(spark: SparkSession, path: str, schema: str, at: str = "discovered_at", late: str = "1 day") -> DataFrame:
    """Parquet files of assets as they come, each asset once.

    Assets are remembered until the newest ``at`` is ``late`` past theirs, so the state is
    bounded; one that comes again after that is known to the store, where ingest_status
    calls it unchanged.
    """
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(["asset_id"])


def run_available(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs ``step`` on what is there and stops; the checkpoint makes each batch come once."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and mean durations of OCR events by window and engine, late rows up to ``late`` included."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "engine").agg(F.count(F.lit(1)).alias("n"), F.avg("ms").alias("mean_ms"))
