"""Shared plumbing of the training-data operators: Arrow kernels, names, numbering, samples.

Scratch tables (``tarnfield.scratch``) stand in for lineage cuts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.scratch import clear_scratch, drop_scratch, scratch, scratch_path, settled, shared_dir, sweep_scratch

__all__ = ["BROADCAST_BYTES", "LOWER", "LOWER_BYTES", "UPPER", "arrow_map", "clear_scratch", "crc_mod5", "drop_scratch", "fresh", "join_few", "one_text_each", "part_starts", "sample_by_hash", "scratch", "scratch_path", "settled", "shared_dir", "slices", "strings", "sweep_scratch", "table", "utf8", "with_ordinal"]

#: ASCII letters only; other letters keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows of known width are broadcast up to so many bytes; beyond that they are joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def join_few(df: DataFrame, few: DataFrame, rows: int, row_bytes: int, on: list[str], how: str = "inner") -> DataFrame:
    """Joins ``few``, counted rows of at most ``row_bytes``: broadcast within the bound, else by a sort-merge join."""
    return df.join(F.broadcast(few) if rows * row_bytes <= BROADCAST_BYTES else few.hint("merge"), on, how)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows: what a kernel holds as Python objects stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null becomes empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    """Texts as str; null becomes empty."""
    return [x or "" for x in column.to_pylist()]


def arrow_map(df: DataFrame, kernel: Callable[[pa.RecordBatch], dict], schema: str, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Run ``kernel`` over Arrow batches; ``carry`` columns go through, the kernel's arrays follow in order."""
    fields = df.select(*carry).schema
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in carry} | kernel(batch))

    return df.mapInArrow(run, out)


def part_starts(sizes: DataFrame, part: str, n: str, start: str) -> tuple[DataFrame, int, int]:
    """(part, start), the sums of ``n`` before each part; the number of parts and the sum of all.

    ``sizes`` has one row of two longs for each task or file: 16 bytes a task come to the driver.
    """
    got = sizes.select(F.col(part).cast("long").alias(part), F.col(n).cast("long").alias(n)).toArrow().sort_by(part)
    own = got.column(n).to_numpy()
    ends = np.cumsum(own)
    table = pa.table({part: got.column(part).combine_chunks(), start: pa.array(ends - own, pa.int64())})
    return sizes.sparkSession.createDataFrame(table, f"`{part}` long, `{start}` long"), len(own), int(ends[-1]) if len(ends) else 0


def with_ordinal(df: DataFrame, by: list[str], name: str) -> tuple[DataFrame, int]:
    """Add ``row_no`` (0-based, gapless, in the order of ``by``); returns the rows and their number.

    A range sort deals the rows out; each task numbers its own rows, and one count per
    task is summed up on the driver. Rows with equal keys are spread by a salt, so one
    key may hold any share.
    """
    salted = df.withColumn("_salt", F.monotonically_increasing_id())
    ordered = salted.repartitionByRange(*by, "_salt").sortWithinPartitions(*by, "_salt").drop("_salt")
    kept = scratch(ordered.withColumn("_mid", F.monotonically_increasing_id()), name)
    part = F.shiftright("_mid", 33)
    starts, parts, total = part_starts(kept.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")), "_part", "_n", "_base")
    numbered = join_few(kept.withColumn("_part", part), starts, parts, 16, ["_part"])
    row_no = F.col("_base") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn("row_no", row_no).drop("_part", "_base", "_mid"), total


def crc_mod5(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5: the fold that labels may not be learnt from is 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def one_text_each(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, label and text of the ids in ``chosen`` (doc_id, label; a bounded sample): of several rows with one id, the text of least hash.

    Each task reduces its rows of an id to one before they move, so an id may hold any share of the rows.
    """
    label = next(c for c in chosen.columns if c != "doc_id")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", label).agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def sample_by_hash(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows with the least hash of ``key``: a bounded, reproducible sample."""
    return df.orderBy(F.xxhash64(F.col(key)), key).limit(rows)
