"""Token-id output: Parquet files of list columns in ascending doc_id order.

The file format: one row per document with doc_id, part (number of the file),
start_in_part, n_tokens and ids (list of 32-bit ids). Ids are dictionary-coded while a
chunk's dictionary holds, the numbers beside them delta-coded; ``encoding='delta'`` codes
the ids so, too. Row groups are bounded in bytes and pages in rows; page indexes are
written, so a reader with a doc_id range, or one that asks only for lengths, touches those
pages alone.

Texts are encoded where they are read, and what is put in order is their ids, in two bytes
each where they fit: texts are encoded once and never cross the network. The files' bounds
come from a sample of the doc_ids alone, which is read without the texts; where an id is
so frequent that it would fill a file, bounds within it come from a sample of its texts' hashes.

Defined cases: a null or empty text has the end id only; null doc_ids come first; rows of
one doc_id stay rows of their own, in the order of their texts' hashes, so the files hold
the same rows in the same order however the input was split; equal rows can't be told
apart; an id may hold any share of the rows; very long texts are encoded whole; an empty
table gives files without rows; other columns of the documents are left aside, whatever
their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.llm.common import join_few, part_starts, slices, strings
from tarnfield.llm.tokens import END_ID, encoder

ROW_GROUP_BYTES = 32 << 20
PAGE_ROWS = 2000
SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"
#: Rows of an output batch hold about so many ids.
BATCH_IDS = 1 << 19
#: Sampled rows for each file; the driver holds so many keys of 16 bytes a file.
SAMPLED = 60

#: A row's place: ids after nulls, then the id and the hash of its text.
Key = tuple[bool, int, int]
FIRST = -(1 << 63)


def _sampled(rows: DataFrame, files: int) -> list[Key]:
    """Sorted keys of a sample of rows (doc_id and, as the case may be, mark)."""
    n = rows.count()
    got = rows.sample(min(1.0, SAMPLED * files / max(n, 1)), seed=17).toArrow()
    marks = got.column("mark").to_pylist() if "mark" in got.column_names else [FIRST] * got.num_rows
    return sorted((i is not None, i or 0, m) for i, m in zip(got.column("doc_id").to_pylist(), marks, strict=True))


def bounds_of(docs: DataFrame, files: int) -> list[Key]:
    """Keys of the first rows of all files but the first; equal ones stand for the files that a hot key fills."""

    def cut(keys: list[Key]) -> list[Key]:
        return [keys[len(keys) * k // files] for k in range(1, files)] if keys else []

    keys = _sampled(docs.select("doc_id"), files)
    hot = [k for k, n in Counter(cut(keys)).items() if n > 1]
    if hot:
        ids = [i for there, i, _ in hot if there]
        own = F.col("doc_id").isin(ids) if len(hot) == len(ids) else F.col("doc_id").isNull() | F.col("doc_id").isin(ids)
        inside = _sampled(docs.where(own).select("doc_id", _mark().alias("mark")), files)
        by_id: dict[Key, list[Key]] = {}
        for k in inside:
            by_id.setdefault((*k[:2], FIRST), []).append(k)
        # a hot id's sampled rows take hashes from its own sample, spread evenly
        place, total = Counter(), Counter(keys)
        for at, k in enumerate(keys):
            if k in by_id:
                keys[at] = by_id[k][place[k] * len(by_id[k]) // total[k]]
                place[k] += 1
    return cut(keys)


def _mark():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def encoded(docs: DataFrame, vocabulary: str | None, end_id: int, bounds: list[Key]) -> DataFrame:
    """file (its number), doc_id, mark (hash of the text), n_tokens and raw (ids of two bytes each, or of four in rows where one needs them).

    Rows equal to a bound may go to any of the files that it bounds, being alike: they take turns.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, own, turns = encoder(vocabulary, end_id).encode, shared.value, Counter()
        for batch in slices(batches, 512):
            raws, sizes, files = [], [], []
            for doc_id, mark, text in zip(batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), strings(batch.column("text")), strict=True):
                key = (doc_id is not None, doc_id or 0, mark)
                low, high = bisect_left(own, key), bisect_right(own, key)
                if high > low:
                    turns[key] += 1
                    low += (turns[key] + TaskContext.get().partitionId()) % (high - low + 1)
                ids = np.frombuffer(encode(text), dtype="<u4")
                files.append(low)
                sizes.append(len(ids))
                raws.append(ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else ids.tobytes())
            yield pa.RecordBatch.from_pydict({"file": pa.array(files, pa.int32()), "doc_id": batch.column("doc_id"), "mark": batch.column("mark"), "n_tokens": pa.array(sizes, pa.int64()), "raw": pa.array(raws, pa.binary())})

    return docs.select("doc_id", _mark().alias("mark"), "text").mapInArrow(run, "file int, doc_id long, mark long, n_tokens long, raw binary")


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, row_group_bytes: int = ROW_GROUP_BYTES, page_rows: int = PAGE_ROWS, encoding: str = "dictionary") -> None:
    """Encode every text and write the files; a range exchange of the ids puts them in order."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = batch.column("n_tokens").to_numpy()
            # cut where about BATCH_IDS more ids have come together
            marks = np.flatnonzero(np.diff(np.cumsum(sizes) // BATCH_IDS)) + 1
            for at, end in zip([0, *marks], [*marks, len(sizes)], strict=True):
                if at == end:
                    continue
                own = sizes[at:end]
                ends = np.concatenate([[0], np.cumsum(own)])
                raws = batch.column("raw").slice(at, end - at).to_pylist()
                ids = np.concatenate([np.frombuffer(r, dtype="<u2" if len(r) == 2 * n else "<u4").astype(np.int32) for r, n in zip(raws, own.tolist(), strict=True)])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(at, end - at), "part": pa.array(np.full(len(own), part, dtype=np.int32)), "start_in_part": pa.array(start + ends[:-1]), "n_tokens": pa.array(own),
                    "ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)),
                })
                start += int(ends[-1])

    files = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = encoded(docs, vocabulary, end_id, bounds_of(docs, files)).repartitionById(files, F.col("file"))
    ordered = dealt.sortWithinPartitions("doc_id", "mark", "raw").select("doc_id", "n_tokens", "raw")
    writer = ordered.mapInArrow(run, SCHEMA).write.option("parquet.block.size", row_group_bytes).option("parquet.page.row.count.limit", page_rows)
    for column in ("doc_id", "part", "start_in_part", "n_tokens", *["ids.list.element"] * (encoding == "delta")):
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    writer.option("parquet.enable.dictionary", "true").option("parquet.writer.version", "v2").option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids.

    Only the lengths are read for the starts: one sum per file comes to the driver.
    """
    rows = spark.read.schema(SCHEMA).parquet(path)
    starts, parts, _ = part_starts(rows.groupBy("part").agg(F.sum("n_tokens").alias("n")), "part", "n", "_base")
    return join_few(rows, starts, parts, 16, ["part"]).select("doc_id", (F.col("_base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of rows as read_tokens returns them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lists = batch.column("ids")
            flat, ends = np.asarray(lists.values).astype("<u4", copy=False), np.asarray(lists.offsets)
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "start": batch.column("start"), "n_tokens": batch.column("n_tokens"), "ids_crc32": pa.array(crc, pa.int64())})

    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
