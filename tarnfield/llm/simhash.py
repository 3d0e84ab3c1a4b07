"""SimHash near-duplicates with Golay-code fuzzy hashing.

A fingerprint has 64 bits: bit k is set where more than half of the text's shingle
hashes have it set. Two fingerprints link at ``DISTANCE`` (4) or fewer differing bits.

Candidates. A fingerprint is cut into three segments of 22, 21 and 21 bits, each
padded to a word of the perfect (23,12,7) Golay code. Every word lies within three
bits of exactly one codeword, and a segment's fuzzy keys are the codeword numbers of the
word itself and of all words one bit away: one to six of the 4096 numbers. Two segments
within two bits have a fuzzy key in common, since the word between them is one bit from
both. Four errors fall on three segments in one of two ways. Either the least hit segment
has none and the next at most two: the whole first segment with a fuzzy key of another
makes a key of 33 or 34 bits, in six ways. Or two segments have one error each and the
third at most two: half of each of the two is whole, so two halves with a fuzzy key of the
third make a key of 32 to 34 bits, in twelve ways. That is 18 tables of some 2^33 buckets,
and 95 keys for a fingerprint on average; linked fingerprints share a bucket, for certain,
and all candidates are verified.

Volume. Equal fingerprints are one before the keys are made, so exact copies cost
nothing and the rows dealt out are proportional to distinct fingerprints. A bucket
is never turned into pairs: its members are searched breadth-first, each comparing
with those not yet reached only, and a task returns no more than a link per member
to the least of its group. A bucket of more than ``BLOCK`` members (near copies without
end, or texts from one mould) leaves its task as blocks. Their members are dealt anew by
the bucket and one of five interleaved parts of the fingerprint, of which four errors leave
one whole; only what is hot even then meets as pairs of blocks, each pair a row of its own.
Components are found by alternating stars, each step written to the shared folder; nothing
of them comes to the driver but counts. The least neighbours are written, too, before they
meet the edges, so that both sides of the join are plain exchanges and a hub's is split.

Defined cases: a text without words (null, empty) has fingerprint zero and links like
any other; null doc_ids are rows like others and lose against numbers, so a component
of null ids alone has a null component_id; equal rows stay rows; an empty table gives no
rows; very long texts are hashed whole; other columns of the documents are left aside by
near_duplicates and pass through keep_one as they were, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.llm.common import LOWER_BYTES, arrow_map, drop_scratch, fresh, scratch, utf8

SHINGLE, HASH_SEED, DISTANCE = 4, 42, 4
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Generator polynomial of the (23,12) Golay code.
GENERATOR = 0b101011100011
#: Members of a bucket that are compared in one task.
BLOCK = 4096
#: Interleaved parts of a hot bucket's members: one more than the errors.
PARTS = DISTANCE + 1


def fingerprint(text: bytes) -> int:
    """Unsigned fingerprint of a UTF-8 text."""
    words = text.translate(LOWER_BYTES).split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(flat, HASH_SEED)
    ends = list(itertools.accumulate(map(len, words)))
    digest, n = xxhash.xxh64_intdigest, len(words) - SHINGLE + 1
    starts = [0, *[e + k for k, e in enumerate(ends[: n - 1], 1)]]
    stops = [e + k for k, e in enumerate(ends[SHINGLE - 1 :], SHINGLE - 1)]
    hashes = np.fromiter((digest(flat[a:b], HASH_SEED) for a, b in zip(starts, stops, strict=True)), dtype=">u8", count=n)
    set_bits = np.zeros(64, dtype=np.int64)
    for part in np.array_split(hashes, n // 65536 + 1):
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > n).tobytes(), "big")


def _golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Parity bits of the upper 12 bits of a word, and the error of least weight of each syndrome."""
    parity = np.zeros(4096, dtype=np.int64)
    for m in range(4096):
        rest = m << 11
        for k in range(22, 10, -1):
            if rest >> k & 1:
                rest ^= GENERATOR << (k - 11)
        parity[m] = rest
    error = np.zeros(2048, dtype=np.int64)
    for weight in (1, 2, 3):
        for bits in itertools.combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            error[parity[e >> 11] ^ (e & 2047)] = e
    return parity, error


PARITY, ERROR = _golay_tables()


def codeword_number(words: np.ndarray) -> np.ndarray:
    """Number of the nearest codeword of 23-bit words."""
    return (words ^ ERROR[PARITY[words >> 11] ^ (words & 2047)]) >> 11


def segment_keys(words: np.ndarray, bits: int) -> np.ndarray:
    """Keys of each word of ``bits`` bits: rows of codeword numbers, padded by -1."""
    flips = np.concatenate([[0], 1 << np.arange(bits)])
    keys = np.sort(codeword_number(words[:, None] ^ flips[None, :]), axis=1)
    keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = -1
    keys = np.sort(keys, axis=1)[:, ::-1]
    return keys[:, :6]


def bucket_rows(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, position of the fingerprint) for all keys of all fingerprints; the table's number stands above 34 bits of key."""
    words = [((fps >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    fuzzy = [segment_keys(w, bits) for w, (_, bits) in zip(words, SEGMENTS, strict=True)]
    halves = [(w >> (bits // 2), w & ((1 << bits // 2) - 1)) for w, (_, bits) in zip(words, SEGMENTS, strict=True)]
    whole: list[tuple[np.ndarray, int]] = []  # what must be equal, and the segment whose fuzzy key goes with it
    for a, b in itertools.permutations(range(3), 2):
        whole.append((words[a], b))
    for c in range(3):
        a, b = (k for k in range(3) if k != c)
        whole += [((x << 11) | y, c) for x, y in itertools.product(halves[a], halves[b])]
    buckets, owners = [], []
    for table, (own, c) in enumerate(whole):
        some = fuzzy[c] >= 0
        buckets.append(((table << 34) | (own[:, None] << 12) | fuzzy[c])[some])
        owners.append(np.broadcast_to(np.arange(len(fps))[:, None], some.shape)[some])
    return np.concatenate(buckets), np.concatenate(owners)


def part_rows(bucket: int, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The members of a hot bucket under the hash of the bucket and each of their interleaved parts."""
    buckets = []
    for p in range(PARTS):
        mask = np.uint64(sum(1 << k for k in range(p, 64, PARTS)))
        mixed = (members & mask) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64((bucket * 8 + p) * 0xD1B54A32D192ED03 % 2**64)
        buckets.append((mixed ^ (mixed >> np.uint64(29))).view(np.int64))
    return np.concatenate(buckets), np.tile(members, PARTS)


class Groups:
    """Union-find over the fingerprints a task has linked."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while (up := self.parent.get(x, x)) != root and up != x:
            self.parent[x], x = root, up
        return root

    def link(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            a, b = min(a, b), max(a, b)
            self.parent[a], self.parent[b] = self.parent.get(a, a), a

    def links(self) -> tuple[list[int], list[int]]:
        """Each member with the least of its group."""
        pairs = [(x, r) for x in self.parent if (r := self.find(x)) != x]
        return [x for x, _ in pairs], [r for _, r in pairs]


def search(members: np.ndarray, groups: Groups) -> None:
    """Link all members that a chain of steps of DISTANCE or less connects."""
    left = np.ones(len(members), dtype=bool)
    for seed in range(len(members)):
        if not left[seed]:
            continue
        left[seed] = False
        queue, rest = [seed], np.flatnonzero(left)
        while queue and len(rest):
            near = np.bitwise_count(members[rest] ^ members[queue[-1]]) <= DISTANCE
            at = queue.pop()
            if near.any():
                for k in rest[near]:
                    groups.link(int(members[at]), int(members[k]))
                queue.extend(rest[near].tolist())
                left[rest[near]] = False
                rest = rest[~near]


def search_small(keys: np.ndarray, fps: np.ndarray, groups: Groups, most: int) -> None:
    """The same for sorted rows of many buckets, each of ``most`` members at most."""
    for shift in range(1, most):
        if shift >= len(keys):
            break
        at = np.flatnonzero(keys[shift:] == keys[:-shift])
        at = at[np.bitwise_count(fps[at] ^ fps[at + shift]) <= DISTANCE]
        for a, b in zip(fps[at].tolist(), fps[at + shift].tolist(), strict=True):
            groups.link(a, b)


SMALL = 12


def _search_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: links found within buckets; buckets beyond BLOCK members leave as blocks."""
    groups, held_key, held, blocks = Groups(), None, np.zeros(0, dtype=np.uint64), 0

    def as_block() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"u": pa.array([None], pa.int64()), "v": pa.array([None], pa.int64()), "bucket": pa.array([held_key], pa.int64()), "no": pa.array([blocks], pa.int32()), "block": pa.array([held.tobytes()], pa.binary())})

    for batch in batches:
        keys, fps = batch.column("bucket").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
        if not len(keys):
            continue
        edges = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
        if keys[0] == held_key:  # the bucket of the last batch goes on
            held, first = np.concatenate([held, fps[: edges[1]]]), 1
        else:
            first = 0
        while len(held) >= BLOCK:
            rest, held = held[BLOCK:], held[:BLOCK]
            yield as_block()
            held, blocks = rest, blocks + 1
        if first and len(edges) == 2:
            continue
        # the held bucket ends here
        if blocks:
            if len(held):
                yield as_block()
        elif len(held) > 1:
            search(held, groups)
        blocks = 0
        sizes = np.diff(edges)
        whole = np.arange(first, len(sizes) - 1)
        small = whole[(sizes[whole] > 1) & (sizes[whole] <= SMALL)]
        if len(small):
            pick = np.concatenate([np.arange(edges[k], edges[k + 1]) for k in small])
            search_small(keys[pick], fps[pick], groups, int(sizes[small].max()))
        for k in whole[sizes[whole] > SMALL]:
            search(fps[edges[k] : edges[k + 1]], groups)
        held_key, held = keys[-1], fps[edges[-2] :].copy()
        while len(held) >= BLOCK:
            rest, held = held[BLOCK:], held[:BLOCK]
            yield as_block()
            held, blocks = rest, blocks + 1
    if blocks and len(held):
        yield as_block()
    elif len(held) > 1:
        search(held, groups)
    yield _links(groups, True)


def _links(groups: Groups, blocks: bool) -> pa.RecordBatch:
    u, v = (np.array(x, dtype=np.uint64).view(np.int64) for x in groups.links())
    got = {"u": pa.array(u), "v": pa.array(v)}
    if blocks:
        got |= {"bucket": pa.nulls(len(u), pa.int64()), "no": pa.nulls(len(u), pa.int32()), "block": pa.nulls(len(u), pa.binary())}
    return pa.RecordBatch.from_pydict(got)


def _search_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks of one bucket: links within and between them."""
    groups = Groups()
    for batch in batches:
        for a, b in zip(batch.column("block").to_pylist(), batch.column("other").to_pylist(), strict=True):
            search(np.unique(np.concatenate([np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)])), groups)
    yield _links(groups, False)


LINK = "u long, v long, bucket long, no int, block binary"


def find_links(fps: DataFrame) -> DataFrame:
    """Links (u, v) whose components are those of all links, from distinct fingerprints ``fp``; a scratch table."""

    def keys(batch: pa.RecordBatch) -> dict:
        own = batch.column("fp").to_numpy()
        bucket, owner = bucket_rows(own.view(np.uint64))
        return {"bucket": pa.array(bucket), "fp": pa.array(own[owner])}

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, block in zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist(), strict=True):
                dealt, members = part_rows(bucket, np.frombuffer(block, dtype=np.uint64))
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(dealt), "fp": pa.array(members.view(np.int64))})

    def searched(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        found = scratch(rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_search_buckets, LINK), "links")
        blocks = found.where("block is not null").select("bucket", "no", "block")
        return found, None if blocks.isEmpty() else blocks

    found, blocks = searched(arrow_map(fps.select("fp"), keys, "bucket long, fp long", carry=()))
    links, held = found.where("u is not null").select("u", "v"), [found]
    if blocks is not None:
        found, blocks = searched(blocks.mapInArrow(parts, "bucket long, fp long"))
        links = links.unionByName(found.where("u is not null").select("u", "v"))
        held.append(found)
    if blocks is not None:
        # a block meets those of its bucket with its own number and above: one row for each pair, dealt out by the pair
        last = blocks.groupBy("bucket").agg(F.max("no").alias("last"))
        met = blocks.join(last, "bucket").select("bucket", "block", F.explode(F.sequence("no", "last")).alias("no"))
        pairs = met.join(blocks.withColumnRenamed("block", "other"), ["bucket", "no"]).select("block", "other")
        links = links.unionByName(pairs.repartition(F.xxhash64("block", "other")).mapInArrow(_search_blocks, "u long, v long"))
    out = scratch(links, "all-links")
    drop_scratch(*held)
    return out


def connect(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node, a scratch table: alternating large and small stars until nothing changes."""

    # a large star has a row at most for each edge before it, a small star two
    def large(edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame, int]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least", 2 * n)
        return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), least, n

    def small(edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame, int]:
        least = scratch(edges.groupBy("u").agg(F.min("v").alias("m")), "least", n)
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        return out.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), least, 2 * n

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    edges = scratch(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "stars", links.count())
    before, after = None, state(edges)
    while after[0] and after != before:
        before, gone, n = after, [edges], after[0]
        for star in (large, small):
            fresh_edges, least, n = star(edges, n)
            edges = scratch(fresh_edges, "stars", n)
            gone += [least, edges]
        drop_scratch(*gone[:-1])
        after = state(edges)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    out = scratch(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), "linked", 2 * after[0])
    drop_scratch(edges)
    return out


def fingerprints(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns and fp (64 bits as a signed long) of each text."""

    def kernel(batch: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(t) for t in utf8(batch.column("text"))], dtype=np.uint64)
        return {"fp": pa.array(fps.view(np.int64))}

    return arrow_map(docs, kernel, "fp long", carry)


def components(rows: DataFrame) -> DataFrame:
    """Adds root, a fingerprint that names the component, and component_id, the least doc_id reachable, to rows of doc_id and fp (a materialised table).

    Where doc_ids repeat, components may share a component_id, but never a root.
    """
    # a file for each shuffle partition: find_links makes 96 rows of each of these
    distinct = scratch(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    n = distinct.count()
    links = find_links(distinct)
    linked = connect(links)
    named = scratch(distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots", n)
    # written before the join, as in connect: a component may hold any share of the fingerprints, a fingerprint any of the rows
    lowest = scratch(named.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids", n)
    by_fp = scratch(named.join(lowest, "root").select("fp", "root", "component_id"), "components", n)
    drop_scratch(distinct, links, linked, named, lowest)
    return rows.join(by_fp, "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row."""
    rows = scratch(fingerprints(docs.select("doc_id", "text")), "fingerprints")
    return components(rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, that of the least doc_id, with its columns as they were.

    Rows of the same doc_id and component give way to the one of least text hash, and
    equal rows to one of them; of a component of null ids alone one row stays, too. Texts
    cross the network once, to meet the list of those kept.
    """
    columns = docs.columns
    mark, id0, none, times = fresh(docs, "_mark", "_id0", "_none", "_times")
    own_mark = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = scratch(fingerprints(docs.select("doc_id", "text").withColumn(mark, own_mark), ("doc_id", mark)), "fingerprints")
    winners = components(rows).where("doc_id <=> component_id")
    # by root: component_ids are null for null ids alone, and the same for components that share a doc_id; all winners of a root have one doc_id
    kept = winners.groupBy("root", "doc_id").agg(F.min(mark).alias(mark)).select("doc_id", mark).distinct()
    counted = rows.groupBy("doc_id", mark).agg(F.count(F.lit(1)).alias(times))
    keys = [id0, none, mark]

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumns({id0: F.coalesce("doc_id", F.lit(0)), none: F.col("doc_id").isNull()})

    kept = scratch(keyed(kept).drop("doc_id").join(keyed(counted).drop("doc_id"), keys), "kept", rows.count())
    marked = keyed(docs.withColumn(mark, own_mark))
    single = marked.join(kept.where(F.col(times) == 1).drop(times), keys, "left_semi")
    # the second branch is for repeated rows alone; in most corpora its list is empty or small
    several = marked.join(kept.where(F.col(times) > 1).drop(times), keys, "left_semi").dropDuplicates(keys)
    return single.unionByName(several).select(*[f"`{c}`" for c in columns])
