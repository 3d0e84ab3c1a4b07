"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered in ascending doc_id order (ties by size and checksum). A keyed
four-round Feistel network permutes the least power of four that holds all rows;
positions beyond the last row walk on along their cycle. The place p of a row gives
shard p mod n and slot p div n, both computable from the row number alone, and
shard sizes differ by one row at most. The law is ``rows``; grown_shard is null.

Defined cases: a null text has size 1 and checksum 0; null doc_ids come first;
equal rows have places of their own, and rows equal in id, size and checksum are numbered
in the order in which they are read; very long texts count whole; an empty table gives no
rows; other columns of the documents are left aside, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.llm.common import with_ordinal

SEED = 20240229
ROUNDS = 4


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit mixer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _once(x: np.ndarray, half: int, seed: int, back: bool) -> np.ndarray:
    bits, low = np.uint64(half), np.uint64((1 << half) - 1)
    left, right = x >> bits, x & low
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        key = np.uint64((seed * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & (2**64 - 1))
        if back:
            left, right = right ^ (_mix(left + key) & low), left
        else:
            left, right = right, left ^ (_mix(right + key) & low)
    return left << bits | right


def permute(x: np.ndarray, n: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """Place of each row number below ``n``, or with ``back`` the row number of each place."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    out = _once(np.asarray(x, dtype=np.uint64), half, seed, back)
    while len(over := np.flatnonzero(out >= np.uint64(n))):
        out[over] = _once(out[over], half, seed, back)
    return out


def shard(docs: DataFrame, shards: int = 16, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, row_no, law, shard, slot, grown_shard for each row."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0).cast("long"))
    rows, n = with_ordinal(docs.select("doc_id", size.alias("size"), crc.alias("text_crc32")), ["doc_id", "size", "text_crc32"], "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = permute(batch.column("row_no").to_numpy(zero_copy_only=False), n, seed).astype(np.int64)
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("doc_id", "size", "text_crc32", "row_no")} | {
                "law": pa.array(["rows"] * len(p), pa.string()), "shard": pa.array((p % shards).astype(np.int32)), "slot": pa.array(p // shards), "grown_shard": pa.nulls(len(p), pa.int32()),
            })

    return rows.select("doc_id", "size", "text_crc32", "row_no").mapInArrow(run, "doc_id long, size long, text_crc32 long, row_no long, law string, shard int, slot long, grown_shard int")
