"""URL filter on a sorted digest array.

A rule is a host, a path prefix and a verdict; it fits its host and all
subdomains where the URL's path starts with the rule's, and the longest rule wins.
The rules' strings (host + path) are hashed by 64-bit xxHash; the sorted keys lie
in a memory-mapped anonymous file (in memory, in no folder) beside the strings themselves. A URL's candidates (each
suffix of its host with each prefix of its path of a length that some rule has)
are hashed and probed by vectorised binary search, and each hit is confirmed
against the stored string, so a collision of digests decides nothing.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased.
Path: from there up to ``?``, ``#`` or the end.

Defined cases: a null URL, or one without ``://``, has an empty host and path and
fits no rule; URLs that no rule fits get the default verdict; of rules with the
same string the first counts, and of fitting rules of equal length the one whose string
is the least; very long URLs are split whole; an empty table gives no rows, an empty list
of rules fits nothing; equal rows and repeated or null page_ids stay rows of their own;
other columns of the pages are left aside, whatever their names.
"""

from __future__ import annotations

import mmap
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.llm.common import LOWER, UPPER, scratch

#: (host, path prefix, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
SEED = 0
#: Rules are sent to executors up to so many bytes; a longer list is joined by digest instead.
BROADCAST_BYTES = 64 << 20


def shape_of(rules: list[tuple[str, str, str]]) -> tuple[tuple[int, ...], int]:
    """Lengths of the rules' paths, and the most labels of a rule's host: no other prefix or suffix of a URL can be a rule."""
    return tuple(sorted({len(p) for _, p, _ in rules})), max((h.count(".") + 1 for h, _, _ in rules), default=0)


@dataclass
class DigestArray:
    """Sorted keys with strings and verdicts; ``open`` maps the file form."""

    keys: np.ndarray
    offsets: np.ndarray
    strings: bytes | mmap.mmap
    blocks: np.ndarray
    path_lengths: tuple[int, ...]
    most_labels: int

    @classmethod
    def build(cls, rules: list[tuple[str, str, str]]) -> DigestArray:
        first: dict[str, str] = {}
        for host, path, verdict in rules:
            first.setdefault(f"{host}{path}", verdict)
        texts = [t.encode() for t in first]
        keys = np.array([xxhash.xxh64_intdigest(t, SEED) for t in texts], dtype=np.uint64)
        order = np.argsort(keys, kind="stable")
        texts, verdicts = [texts[i] for i in order], list(first.values())
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        blocks = np.array([verdicts[i] == "block" for i in order], dtype=np.uint8)
        return cls(keys[order], offsets, b"".join(texts), blocks, *shape_of(rules))

    def to_bytes(self) -> bytes:
        head = np.array([len(self.keys), self.most_labels, len(self.path_lengths), *self.path_lengths], dtype=np.int64)
        return head.tobytes() + self.keys.tobytes() + self.offsets.tobytes() + self.blocks.tobytes() + bytes(self.strings)

    @classmethod
    def open(cls, file: str | int) -> DigestArray:
        """Memory-maps a file of ``to_bytes``, given by its path or its descriptor (which is closed)."""
        with open(file, "rb") as f:
            held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n, labels, m = np.frombuffer(held, np.int64, 3)
        lengths = tuple(int(x) for x in np.frombuffer(held, np.int64, m, 24))
        at = 24 + 8 * int(m)
        keys = np.frombuffer(held, np.uint64, n, at)
        offsets = np.frombuffer(held, np.int64, n + 1, at := at + 8 * int(n))
        blocks = np.frombuffer(held, np.uint8, n, at := at + 8 * (int(n) + 1))
        return cls(keys, offsets, memoryview(held)[at + int(n) :], blocks, lengths, int(labels))

    def probe(self, texts: list[bytes]) -> np.ndarray:
        """Position of each string in the array, or -1."""
        keys = np.array([xxhash.xxh64_intdigest(t, SEED) for t in texts], dtype=np.uint64)
        left, right = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        out = np.full(len(texts), -1, dtype=np.int64)
        for i in np.flatnonzero(right > left):
            for k in range(left[i], right[i]):
                if bytes(self.strings[self.offsets[k] : self.offsets[k + 1]]) == texts[i]:
                    out[i] = k
        return out


def host_path(url: str = "url"):
    """Columns for the host and path of a URL column."""
    text = F.coalesce(F.col(url), F.lit(""))
    return F.translate(F.regexp_extract(text, r"(?s)://([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(text, r"(?s)://[^/?#]*([^?#]*)", 1)


def candidates(host: str, path: str, lengths: tuple[int, ...], most_labels: int) -> list[str]:
    """Strings of the rules that could fit, the longest first."""
    labels = host.rsplit(".", most_labels)
    # with more labels than any rule has, the first part is all the rest of the host
    hosts = [".".join(labels[k:]) for k in range(len(labels) > most_labels, len(labels))] if host else []
    found = {h + path[:n] for h in hosts if h for n in lengths if n <= len(path)}
    return sorted(found, key=lambda s: (-len(s), s))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = list(RULES), default: str = "allow", url: str = "url", key: str = "page_id") -> DataFrame:  # noqa: B006
    """key, host, path, rule, verdict for each row."""
    spark = pages.sparkSession
    host, path = host_path(url)
    rows = pages.select(key, host.alias("host"), path.alias("path"))
    if sum(len(h) + len(p) + 17 for h, p, _ in rules) > BROADCAST_BYTES:
        return _join_rules(rows, rules, default, key)
    shared = spark.sparkContext.broadcast(DigestArray.build(rules).to_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # each task maps its own copy; the file is in memory and goes with the mapping
        fd = os.memfd_create("digests")
        with os.fdopen(os.dup(fd), "wb") as f:
            f.write(shared.value)
        own = DigestArray.open(fd)
        for batch in batches:
            flat, owner = [], []
            for k, (h, p) in enumerate(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)):
                for c in candidates(h, p, own.path_lengths, own.most_labels):
                    flat.append(c.encode())
                    owner.append(k)
            found, rule, verdict = own.probe(flat), [None] * batch.num_rows, [default] * batch.num_rows
            for i in np.flatnonzero(found >= 0)[::-1]:  # the longest comes last and stays
                rule[owner[i]], verdict[owner[i]] = flat[i].decode(), "block" if own.blocks[found[i]] else "allow"
            yield pa.RecordBatch.from_pydict({key: batch.column(key), "host": batch.column("host"), "path": batch.column("path"), "rule": pa.array(rule, pa.string()), "verdict": pa.array(verdict, pa.string())})

    return rows.mapInArrow(run, f"`{key}` long, host string, path string, rule string, verdict string")


def _join_rules(rows: DataFrame, rules: list[tuple[str, str, str]], default: str, key: str) -> DataFrame:
    """The same by a join on digest and string, for lists beyond the broadcast bound."""
    spark = rows.sparkSession
    first: dict[str, str] = {}
    for h, p, v in rules:
        first.setdefault(f"{h}{p}", v)
    lengths, most = shape_of(rules)
    listed = spark.createDataFrame(list(first.items()), "rule string, rule_verdict string").withColumn("digest", F.xxhash64("rule"))
    rows = scratch(rows.withColumn("_row", F.monotonically_increasing_id()), "urls")  # written: a row's number must not change
    labels = F.split("host", r"\.")
    hosts = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - most + 1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda p: p.isNotNull())
    tried = rows.select("_row", F.explode(F.array_distinct(F.flatten(F.transform(F.filter(hosts, lambda h: h != ""), lambda h: F.transform(prefixes, lambda p: F.concat(h, p)))))).alias("rule")).withColumn("digest", F.xxhash64("rule"))
    # the longest, then the least string, as in candidates
    best = tried.join(listed.hint("shuffle_merge"), ["digest", "rule"]).groupBy("_row").agg(F.min_by(F.struct("rule", "rule_verdict"), F.struct(-F.length("rule"), "rule")).alias("best"))
    return rows.join(best, "_row", "left").select(key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
