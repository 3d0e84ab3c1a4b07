"""Benchmark decontamination: broadcast hash set of normalised test n-grams.

Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters.
A benchmark window is ``n`` consecutive words of an item; an item of fewer words
is one window. Documents are scanned by rolling 64-bit hashes of their words
against the sorted hash set, and each hit is verified word by word.

Defined cases: a null text has no words; an item without words has no window; the
windows of an item with a null item_id hit like others, but there is no id to list and
n_items counts listed ids; repeated item rows count once; rows with a null or repeated
doc_id stay rows of their own; empty tables of documents or items give no rows or no
hits; very long texts are scanned whole, and other columns of the documents are left
aside by the scan and pass through the removal as they were, whatever their names.

Volume. Up to ``set_bytes`` of benchmark text the hash set is built on the driver with
the words and items behind it, and a task verifies its hits at once. A larger benchmark
becomes a table of windows in the shared folder; only its 8-byte hashes are broadcast,
in blocks of at most ``key_bytes`` that are destroyed after their pass, and the hits
they give meet the table in a join on hash and words. No part of the benchmark is left
out, and no task ever holds more than one block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.llm.common import LOWER_BYTES, drop_scratch, fresh, scratch, slices, utf8

#: Bytes that belong to words after lower-casing; all others become spaces.
WORD_BYTES = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in LOWER_BYTES)
#: 0x7F and control characters are spaces, too; bytes of 0x80 and above are parts of UTF-8 letters.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Benchmark text whose hash set is built whole; a word takes some 20 bytes of it and a distinct word some 120.
SET_BYTES = 8 << 20
#: Hashes of a larger benchmark's windows that are broadcast at a time.
KEY_BYTES = 64 << 20
#: Distinct words whose hashes a task remembers.
KNOWN_WORDS = 300_000


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text."""
    return text.translate(WORD_BYTES).split()


def rolled(ids: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows of ``width`` words at ``starts``."""
    keys = np.zeros(len(starts), dtype=np.uint64)
    for k in range(width):
        keys = keys * MULTIPLIER + ids[starts + k].astype(np.uint64)
    return keys


@dataclass
class Windows:
    """Sorted window hashes for each window width, with the words and items behind them."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    #: Word numbers of all items, one after another.
    flat: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    #: width -> (sorted hashes, places in ``flat``, item numbers; -1 for an item without an id)
    by_width: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    items: list[str] = field(default_factory=list)

    @classmethod
    def build(cls, items: list[tuple[int | None, bytes]], n: int) -> Windows:
        own, names, parts, places, at = cls(), {}, [], {}, 0
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            parts.append(np.fromiter((own.vocabulary.setdefault(w, len(own.vocabulary) + 1) for w in words), np.uint32, len(words)))
            owner, width = -1 if item_id is None else names.setdefault(str(item_id), len(names)), min(n, len(words))
            starts = np.arange(at, at + len(words) - width + 1, dtype=np.int64)
            places.setdefault(width, []).append((starts, np.full(len(starts), owner, dtype=np.int32)))
            at += len(words)
        own.items = list(names)
        own.flat = np.concatenate(parts) if parts else own.flat
        for width, found in sorted(places.items()):
            starts, owners = (np.concatenate(x) for x in zip(*found, strict=True))
            keys = rolled(own.flat, starts, width)
            order = np.lexsort((starts, owners, keys))
            keys, starts, owners = keys[order], starts[order], owners[order]
            # the same window of the same item counts once
            same = (keys[1:] == keys[:-1]) & (owners[1:] == owners[:-1])
            for k in range(width):
                same &= own.flat[starts[1:] + k] == own.flat[starts[:-1] + k]
            kept = np.concatenate([[True], ~same])
            own.by_width[width] = keys[kept], starts[kept], owners[kept]
        return own

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """For each word whether it is hit, and the item numbers that occur."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.uint32, count=len(words))
        hit, items = np.zeros(len(ids), dtype=bool), set()
        known = np.concatenate([[0], np.cumsum(ids != 0)])
        for width, (keys, places, owners) in self.by_width.items():
            if len(ids) < width:
                continue
            starts = np.flatnonzero(known[width:] - known[:-width] == width)
            if not len(starts):
                continue
            # only windows of benchmark words can be hits: the rest is never hashed
            hashes = rolled(ids, starts, width)
            left, right = np.searchsorted(keys, hashes, "left"), np.searchsorted(keys, hashes, "right")
            for i in np.flatnonzero(right > left):
                own = ids[starts[i] : starts[i] + width]
                true = (self.flat[places[left[i] : right[i], None] + np.arange(width)] == own).all(axis=1)
                if true.any():
                    hit[starts[i] : starts[i] + width] = True
                    items.update(owners[left[i] : right[i]][true].tolist())
        return hit, items - {-1}


def word_spans(text: bytes) -> list[tuple[int, int]]:
    """Byte offsets of the words of a text."""
    flat, out, at = text.translate(WORD_BYTES), [], 0
    for w in flat.split():
        start = flat.index(w, at)
        at = start + len(w)
        out.append((start, at))
    return out


def cut(text: bytes, hit: np.ndarray) -> bytes:
    """The text without its hit runs of words; what stands between runs stays."""
    spans = word_spans(text)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    keep, at = [], 0
    for first, last in zip(edges[::2], edges[1::2], strict=True):
        keep.append(text[at : spans[first][0]])
        at = spans[last - 1][1]
    return b"".join([*keep, text[at:]])


def small_set(items: DataFrame, n: int, set_bytes: int) -> Windows | None:
    """The hash set of a benchmark of at most ``set_bytes``; None for a larger one."""
    held = items.select("item_id", "text").where("text is not null")
    if (held.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > set_bytes:
        return None
    return Windows.build([(r["item_id"], r["text"].encode()) for r in held.collect()], n)


# larger benchmarks -----------------------------------------------------------------------------
class WordHashes(dict):
    """Hashes of words, kept for the words seen last."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def window_table(items: DataFrame, n: int, rows: int = 8192) -> DataFrame:
    """width, key, words, item_id of all windows of all items, as often as they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, 64):
            for item_id, text in zip(batch.column("item_id").to_pylist(), utf8(batch.column("text")), strict=True):
                words = words_of(text)
                width = min(n, len(words))
                starts = np.arange(len(words) - width + 1 if words else 0)
                keys = rolled(hashes.of(words), starts, width).view(np.int64)
                for at in range(0, len(starts), rows):
                    own = [b" ".join(words[s : s + width]).decode() for s in starts[at : at + rows].tolist()]
                    yield pa.RecordBatch.from_pydict({"width": pa.array([width] * len(own), pa.int32()), "key": pa.array(keys[at : at + rows]), "words": pa.array(own, pa.string()), "item_id": pa.array([item_id] * len(own), batch.schema.field("item_id").type)})

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(run, f"width int, key long, words string, item_id {kind}")


def hits_of(rows: DataFrame, items: DataFrame, row: str, n: int, key_bytes: int) -> DataFrame:
    """``row``, at, item_ids: places of the hit words and occurring items of the rows (``row``, text; a scratch table) that have any."""
    table = scratch(window_table(items, n), "benchmark-windows")
    number = (8 * table.count()) // key_bytes + 1
    while True:
        dealt = table.select("width", "key", F.pmod("key", F.lit(number)).alias("block")).distinct()
        most = dealt.groupBy("block").count().agg(F.max("count")).first()[0] or 0
        # the bound holds for the distinct hashes that are dealt to a block, or there is one hash in each
        if 8 * most <= key_bytes or most <= 1:
            break
        number += number // 2 + 1
    parts = []
    for block in range(number):
        got = dealt.where(F.col("block") == block).toArrow()
        widths, keys = got.column("width").to_numpy(), np.ascontiguousarray(got.column("key").to_numpy()).view(np.uint64)
        shared = rows.sparkSession.sparkContext.broadcast({int(w): np.sort(keys[widths == w]) for w in np.unique(widths)})

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for batch in slices(batches):
                out = {c: [] for c in ("row", "start", "width", "key", "words")}
                for own_row, text in zip(batch.column(row).to_pylist(), utf8(batch.column("text")), strict=True):
                    words = words_of(text)
                    ids = hashes.of(words)
                    for width, own in shared.value.items():
                        found = rolled(ids, np.arange(max(0, len(ids) - width + 1)), width)
                        at = np.searchsorted(own, found)
                        for s in np.flatnonzero((at < len(own)) & (own[np.minimum(at, len(own) - 1)] == found)).tolist():
                            for x, v in zip(out.values(), (own_row, s, width, int(found[s : s + 1].view(np.int64)[0]), b" ".join(words[s : s + width]).decode()), strict=True):
                                x.append(v)
                yield pa.RecordBatch.from_pydict({row: pa.array(out["row"], pa.int64()), "start": pa.array(out["start"], pa.int64()), "width": pa.array(out["width"], pa.int32()), "key": pa.array(out["key"], pa.int64()), "words": pa.array(out["words"], pa.string())})

        parts.append(scratch(rows.select(row, "text").mapInArrow(run, f"`{row}` long, start long, width int, key long, words string"), "benchmark-hits"))
        shared.destroy()
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    # the hash brings them together, the words confirm them
    owners = table.groupBy("width", "key", "words").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    true = found.join(scratch(owners, "benchmark-owners"), ["width", "key", "words"])
    places = F.flatten(F.collect_set(F.sequence("start", F.col("start") + F.col("width") - 1)))
    hits = scratch(true.groupBy(row).agg(F.array_distinct(places).alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("item_ids")), "benchmark-hits")
    drop_scratch(table, *parts)
    return hits


# operators -------------------------------------------------------------------------------------
def scan_documents(docs: DataFrame, items: DataFrame, n: int = 10, set_bytes: int = SET_BYTES, key_bytes: int = KEY_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, item_ids (sorted as strings), n_items, contaminated."""
    windows = small_set(items, n, set_bytes)
    if windows is None:
        return _scan_large(docs, items, n, key_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in slices(batches):
            rows = [[], [], []]
            for text in utf8(batch.column("text")):
                words = words_of(text)
                hit, found = windows.scan(words)
                for x, v in zip(rows, (len(words), int(hit.sum()), sorted(windows.items[i] for i in found)), strict=True):
                    x.append(v)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_words": pa.array(rows[0], pa.int64()), "n_hit": pa.array(rows[1], pa.int64()),
                "item_ids": pa.array(rows[2], pa.list_(pa.string())), "n_items": pa.array([len(x) for x in rows[2]], pa.int64()), "contaminated": pa.array([x > 0 for x in rows[1]], pa.bool_()),
            })

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_hit long, item_ids array<string>, n_items long, contaminated boolean")


def _scan_large(docs: DataFrame, items: DataFrame, n: int, key_bytes: int) -> DataFrame:
    """The same beyond the bound."""
    rows = scratch(docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id()), "decontaminate-rows")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "_row": batch.column("_row"), "n_words": pa.array([len(words_of(t)) for t in utf8(batch.column("text"))], pa.int64())})

    counted = rows.mapInArrow(count, "doc_id long, _row long, n_words long").join(hits_of(rows, items, "_row", n, key_bytes), "_row", "left")
    n_hit, ids = F.coalesce(F.array_size("at").cast("long"), F.lit(0)), F.coalesce("item_ids", F.array().cast("array<string>"))
    return counted.select("doc_id", "n_words", n_hit.alias("n_hit"), ids.alias("item_ids"), F.size(ids).cast("long").alias("n_items"), (n_hit > 0).alias("contaminated"))


def _cut_batch(batch: pa.RecordBatch, hits: list[np.ndarray]) -> pa.RecordBatch:
    """The rows without their hit words; null texts stay null, n_chars follows where a text changes."""
    null = batch.column("text").is_null().to_pylist()
    kept = [None if z else cut(t, h).decode() if h.any() else t.decode() for t, h, z in zip(utf8(batch.column("text")), hits, null, strict=True)]
    fresh_columns = {"text": kept}
    if "n_chars" in batch.schema.names:
        fresh_columns["n_chars"] = [len(t) if h.any() else old for old, h, t in zip(batch.column("n_chars").to_pylist(), hits, kept, strict=True)]
    for name, values in fresh_columns.items():
        at = batch.schema.get_field_index(name)
        batch = batch.set_column(at, batch.schema.field(at), pa.array(values, batch.schema.field(at).type))
    return batch


def remove_contaminated(docs: DataFrame, items: DataFrame, n: int = 10, how: str = "documents", set_bytes: int = SET_BYTES, key_bytes: int = KEY_BYTES) -> DataFrame:
    """Documents without benchmark passages, with their columns as they were.

    ``how='documents'`` drops each document that holds a window; ``how='spans'``
    cuts the hit words out of the text and keeps the rest (n_chars is set anew
    where there is such a column).
    """
    if how not in ("documents", "spans"):
        raise ValueError(f"unknown way {how}")
    columns, windows = docs.schema, small_set(items, n, set_bytes)
    if windows is None:
        return _remove_large(docs, items, n, how, key_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hits = [shared.value.scan(words_of(t))[0] for t in utf8(batch.column("text"))]
            yield _cut_batch(batch, hits) if how == "spans" else batch.filter(pa.array([not h.any() for h in hits], pa.bool_()))

    return docs.mapInArrow(run, columns)


def _remove_large(docs: DataFrame, items: DataFrame, n: int, how: str, key_bytes: int) -> DataFrame:
    """The same beyond the bound: all blocks' hits are known before a document goes or is cut, once."""
    columns, (row, at, ids) = docs.schema, fresh(docs, "_row", "_at", "_ids")
    rows = scratch(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate-rows")
    hits = hits_of(rows, items, row, n, key_bytes).withColumnsRenamed({"at": at, "item_ids": ids})
    if how == "documents":
        return rows.join(hits, row, "left_anti").select(*[f"`{c}`" for c in columns.names])

    def cut_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            marks = []
            for places, text in zip(batch.column(at).to_pylist(), utf8(batch.column("text")), strict=True):
                marks.append(np.zeros(len(words_of(text)), dtype=bool))
                marks[-1][np.array(places or [], dtype=np.int64)] = True
            yield _cut_batch(batch, marks).select(columns.names)

    return rows.join(hits.select(row, at), row, "left").mapInArrow(cut_known, columns)
