"""Packing by power-of-two decomposition.

A document's ids (end id included) are cut into pieces whose lengths are powers
of two: full pieces of the longest length first, then the binary digits of the
rest from high to low. Pieces of equal length form a bucket; each piece is a
sequence of its own, so no sequence crosses documents and none is padded.
Sequences are numbered bucket by bucket, the longest first, without gaps.

Defined cases: a null or empty text has the end id only, one piece of length 1;
equal rows and rows with equal or null doc_id are documents of their own; very long texts
are encoded whole and give as many full pieces as they hold; an empty table gives no rows;
other columns of the documents are left aside, whatever their names. Which of two pieces of
equal length comes first follows the order in which the documents are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.llm.common import join_few, scratch, slices, strings
from tarnfield.llm.tokens import END_ID, encoder

LONGEST = 2048


def pieces_of(n: int, longest: int = LONGEST) -> list[int]:
    """Lengths of the pieces of ``n`` ids, in order."""
    full, rest = divmod(n, longest)
    return [longest] * full + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, longest: int = LONGEST, vocabulary: str | None = None, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_to, and input_ids if asked.

    The pieces are written once to the shared folder. Their numbers are sums over the
    counts of each task and bucket, made in Spark; the driver sees one total a bucket.
    """
    if longest & (longest - 1):
        raise ValueError("the longest length must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, ranks = encoder(vocabulary, end_id).encode, TaskContext.get().partitionId(), {}
        for batch in slices(batches):
            owner, cols, ids = [], {k: [] for k in ("start", "length", "ids_crc32", "doc_tokens", "_rank")}, []
            for k, text in enumerate(strings(batch.column("text"))):
                raw = encode(text)
                start, n = 0, len(raw) // 4
                for length in pieces_of(n, longest):
                    piece = raw[4 * start : 4 * (start + length)]
                    rank = ranks.get(length, 0)
                    ranks[length] = rank + 1
                    owner.append(k)
                    for c, v in zip(cols.values(), (start, length, zlib.crc32(piece), n, rank), strict=True):
                        c.append(v)
                    if with_ids:
                        ids.append(piece)
                    start += length
            got = {"doc_id": batch.column("doc_id").take(pa.array(owner, pa.int64()))} | {c: pa.array(v, pa.int64()) for c, v in cols.items()}
            got["_part"] = pa.array(np.full(len(owner), part), pa.int64())
            if with_ids:
                flat = np.frombuffer(b"".join(ids), dtype="<i4")
                ends = np.concatenate([[0], np.cumsum(cols["length"])]).astype(np.int32)
                got["input_ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_pydict(got)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, _rank long, _part long" + ", input_ids array<int>" * with_ids
    kept = scratch(docs.select("doc_id", "text").mapInArrow(run, schema), "packed")
    counts = kept.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = scratch(counts.withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0))), "packed-starts")
    base, total = F, 0
    for r in sorted(starts.groupBy("length").agg(F.sum("_n").alias("n")).collect(), key=lambda r: -r["length"]):
        base = base.when(F.col("length") == r["length"], F.col("_base") + total)
        total += r["n"]
    first = starts.select("length", "_part", base.otherwise(F.col("_base")).alias("_base") if total else "_base")
    numbered = join_few(kept, first, starts.count(), 24, ["length", "_part"])
    return numbered.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_base") + F.col("_rank")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.col("length").alias("padded_to"), *["input_ids"] * with_ids
    )
