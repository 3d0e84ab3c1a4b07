"""Quality rules: an isolation forest on rule statistics.

Each text yields counts (words, characters in words, symbols, repeated lines, words
in repeated five-word windows). Two plain rules reject at once. For the other
documents forests of random splits over ratios of these counts give mean path
lengths; short paths are anomalies. There is a forest for each ratio and one for all
of them together, each with a threshold calibrated on labelled rows: the ``keep``
quantile of the scores of clean rows, and a margin. A document above any threshold is
rejected. Labelled rows that fail a plain rule don't count.

Each labelled id counts with one text. All labelled ids that pass the plain rules take part:
each tree draws its own ``SUBSAMPLE`` rows among all of them, as isolation trees do, and
a threshold is the exact quantile of the scores of all clean ones. Every count is made over
whole texts of all documents.

Defined cases: a null or empty text has no words and fails the plain rules; without
labelled rows there is no forest and the plain rules decide alone; an id with several
labels counts with the least, and with the text of least hash where it repeats in the
documents; equal rows and rows with a null or repeated doc_id are judged one by one; an
empty table gives no rows; very long texts are counted whole; rows whose scores tie with a
threshold are kept; other columns of the documents are left aside by judge and pass
through keep_good as they were, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.llm.common import drop_scratch, scratch, slices, utf8

SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
SPACE = b" \t\n\r\x0b\x0c"
WINDOW = 5
TREES, SUBSAMPLE, SEED = 60, 256, 11
KEEP = 0.999
MARGIN = 0.01
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Columns of a table of counts: those of STATS, and the lines with a word.
COUNTS = (*STATS, "n_lines")
#: Rows whose distinct scores come to the driver at once; beyond that only those next to the quantile, whose rank is known to RANK_ERROR.
FEW_ROWS, RANK_ERROR = 20000, 0.0005


def repeated_words(ids: np.ndarray) -> int:
    """Words inside five-word windows that occur twice or more, the first occurrence included."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    keys = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    # equal hashes are confirmed by their words; a false one falls back to exact counting
    a, b = order[1:][same], order[:-1][same]
    if any((ids[a + k] != ids[b + k]).any() for k in range(WINDOW)):
        _, inverse, counts = np.unique(np.lib.stride_tricks.sliding_window_view(ids, WINDOW), axis=0, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(counts[inverse.ravel()] > 1)
    else:
        starts = np.unique(np.concatenate([a, b]))
    marks = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + WINDOW, -1)
    return int((np.cumsum(marks)[:-1] > 0).sum())


def stats_of(text: bytes) -> tuple[int, int, int, int, int, int]:
    """The five counts of STATS, and the number of lines with a word."""
    words = text.split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.uint64, count=len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars = len(text.translate(None, SPACE + CONTINUATION))
    return len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(ids), len(lines)


def features_of(stats: np.ndarray) -> np.ndarray:
    """Ratios that don't depend on a text's length: word length, symbols, repeated lines, repeated words."""
    words, chars, symbols, dup, repeat, lines = stats.astype(float).T
    n = np.maximum(words, 1)
    return np.stack([chars / n, symbols / n, dup / np.maximum(lines, 1), repeat / n], axis=1)


def base_failed(stats: np.ndarray) -> np.ndarray:
    return (stats[:, 0] < 10) | (100 * stats[:, 4] > 20 * stats[:, 0])


def _expected(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as flat arrays: feature (-1 at a leaf), cut, the two children, path length at a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    norm: float
    columns: tuple[int, ...] = ()
    threshold: float = 1.0

    @classmethod
    def fit(cls, drawn: list[np.ndarray], seed: int = SEED) -> Forest:
        """One tree for each array of drawn rows, which are equal in number."""
        rng, size = np.random.default_rng(seed), len(drawn[0])
        depth = int(np.ceil(np.log2(max(size, 2))))
        parts = []
        for rows in drawn:
            nodes: list[list[float]] = []

            def grow(sub: np.ndarray, d: int, nodes=nodes) -> int:
                at = len(nodes)
                nodes.append([-1, 0.0, 0, 0, d + float(_expected(len(sub)))])
                low, high = sub.min(axis=0), sub.max(axis=0)
                if d < depth and len(sub) > 1 and len(open_ := np.flatnonzero(high > low)):
                    f = int(rng.choice(open_))
                    cut = rng.uniform(low[f], high[f])
                    side = sub[:, f] <= cut
                    if side.any() and not side.all():
                        nodes[at][:2] = [f, cut]
                        nodes[at][2] = grow(sub[side], d + 1)
                        nodes[at][3] = grow(sub[~side], d + 1)
                return at

            grow(rows, 0)
            parts.append(np.array(nodes))
        most = max(len(p) for p in parts)
        grid = np.stack([np.pad(p, ((0, most - len(p)), (0, 0)), constant_values=-1) for p in parts])
        return cls(grid[:, :, 0].astype(np.int32), grid[:, :, 1], grid[:, :, 2].astype(np.int32), grid[:, :, 3].astype(np.int32), grid[:, :, 4], max(float(_expected(size)), 1e-9))

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly of each row, 0 to 1."""
        total = np.zeros(len(rows))
        everyone = np.arange(len(rows))
        for t in range(len(self.feature)):
            at = np.zeros(len(rows), dtype=np.int32)
            while True:
                f = self.feature[t][at]
                open_ = f >= 0
                if not open_.any():
                    break
                left = rows[everyone, np.maximum(f, 0)] <= self.cut[t][at]
                at = np.where(open_, np.where(left, self.left[t][at], self.right[t][at]), at)
            total += self.length[t][at]
        return 2.0 ** (-total / len(self.feature) / self.norm)


#: Columns of features_of that the forests look at.
VIEWS = ((0,), (1,), (2,), (3,), (0, 1, 2, 3))


def draw_keys(ids: np.ndarray, trees: int) -> np.ndarray:
    """A hash of each id for each tree, different for different ids: a tree draws the rows of least key."""
    x = ids.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def counts_in(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy() for c in COUNTS], axis=1).reshape(-1, len(COUNTS))


def counts_of(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, COUNTS of each document, in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            stats = np.array([stats_of(t) for t in utf8(batch.column("text"))], dtype=np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash")} | {c: pa.array(stats[:, k]) for k, c in enumerate(COUNTS)})

    hashed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    return scratch(hashed.mapInArrow(run, "doc_id long, text_hash long, " + ", ".join(f"{c} long" for c in COUNTS)), "counts")


def drawn_rows(rows: DataFrame, total: int, trees: int, subsample: int = SUBSAMPLE, spare: float = 2.0) -> list[np.ndarray]:
    """For each tree the ratios of its ``subsample`` rows of least key among all ``total`` rows.

    Each task passes on the keys below a bound that about ``spare`` times the wanted rows of
    a tree meet; if any tree gets too few, all are drawn again with a wider bound.
    """
    size = min(subsample, total)
    bound = min(int(2.0**64 * spare * size / total), 2**64 - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys = draw_keys(batch.column("doc_id").to_numpy(), trees)
            row, tree = np.nonzero(keys <= np.uint64(bound))
            features = features_of(counts_in(batch))[row]
            # the sign bit is turned, so that signed order is the order of the keys
            signed = (keys[row, tree] ^ np.uint64(1 << 63)).view(np.int64)
            yield pa.RecordBatch.from_pydict({"tree": pa.array(tree, pa.int64()), "key": pa.array(signed)} | {f"f{k}": pa.array(features[:, k]) for k in range(4)})

    got = rows.mapInArrow(run, "tree long, key long, f0 double, f1 double, f2 double, f3 double").toArrow().sort_by([("tree", "ascending"), ("key", "ascending")])
    ratios = np.stack([got.column(f"f{k}").to_numpy() for k in range(4)], axis=1)
    ends = np.searchsorted(got.column("tree").to_numpy(), np.arange(trees + 1))
    if (np.diff(ends) < size).any():
        return drawn_rows(rows, total, trees, subsample, 4 * spare)
    return [ratios[at : at + size] for at in ends[:-1]]


def exact_quantiles(scores: DataFrame, total: int, q: float) -> list[float]:
    """The quantile of each column over all ``total`` rows, between two scores in proportion.

    Of many rows only the scores near the quantile come to the driver, each once with its
    count; those below them are counted.
    """
    columns, at = scores.columns, q * (total - 1)
    limits = [(-np.inf, np.inf)] * len(columns)
    if total > FEW_ROWS:
        near = scores.approxQuantile(columns, [max(q - 2 * RANK_ERROR, 0.0), min(q + 2 * RANK_ERROR, 1.0)], RANK_ERROR)
        limits = [(low if q > 2 * RANK_ERROR else -np.inf, high if q < 1 - 2 * RANK_ERROR else np.inf) for low, high in near]
    below = scores.agg(*[F.count_if(F.col(c) < low).alias(c) for c, (low, _) in zip(columns, limits, strict=True)]).first()
    out = []
    for c, (low, high) in zip(columns, limits, strict=True):
        got = scores.where(F.col(c).between(low, high)).groupBy(F.col(c).alias("score")).agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by("score")
        ends = below[c] + np.cumsum(got.column("n").to_numpy())
        pair = np.searchsorted(ends, [int(at), min(int(at) + 1, total - 1)], side="right")
        if below[c] > int(at) or pair[1] >= len(ends):
            raise RuntimeError(f"the quantile {q} of {c} lies outside its bounds")
        first, second = got.column("score").to_numpy()[pair]
        out.append(float(first + (second - first) * (at - int(at))))
    return out


def fit_counts(counts: DataFrame, labels: DataFrame, keep: float = KEEP, margin: float = MARGIN) -> list[Forest]:
    """The forests and their thresholds from the counts of all labelled ids that pass the plain rules; none if there is no clean one."""
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    # each task reduces its rows of an id to one before they move, so an id may hold any share of the rows
    texts = counts.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("text_hash", *COUNTS)).alias("least")).select("doc_id", "least.*")
    rows = scratch(texts.join(one, "doc_id").where("n_words >= 10 and 100 * n_repeat_words <= 20 * n_words").select("doc_id", "quality", *COUNTS), "labelled-counts")
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    ratios = (F.col("word_chars") / words, F.col("n_symbols") / words, F.col("n_dup_lines") / lines, F.col("n_repeat_words") / words)
    seen = rows.agg(F.count(F.lit(1)), F.count_if(F.col("quality") == 1), *[F.max(r) > F.min(r) for r in ratios]).first()
    total, clean, differ = seen[0], seen[1], seen[2:]
    views = [k for k, columns in enumerate(VIEWS) if total > 1 and clean and any(differ[c] for c in columns)]
    forests = []
    drawn = drawn_rows(rows, total, TREES * len(VIEWS)) if views else []
    for k in views:
        forest = Forest.fit([d[:, VIEWS[k]] for d in drawn[k * TREES : (k + 1) * TREES]], SEED + k)
        forest.columns = VIEWS[k]
        forests.append(forest)
    if forests:
        shared = counts.sparkSession.sparkContext.broadcast(forests)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                features = features_of(counts_in(batch))
                yield pa.RecordBatch.from_pydict({f"v{k}": pa.array(f.scores(features[:, f.columns])) for k, f in enumerate(shared.value)})

        scores = scratch(rows.where("quality = 1").mapInArrow(run, ", ".join(f"v{k} double" for k in range(len(forests)))), "clean-scores")
        for forest, threshold in zip(forests, exact_quantiles(scores, clean, keep), strict=True):
            forest.threshold = threshold + margin
        drop_scratch(scores)
        shared.unpersist()
    drop_scratch(rows)
    return forests


def fit_forests(docs: DataFrame, labels: DataFrame, keep: float = KEEP, margin: float = MARGIN) -> list[Forest]:
    """The forests and their thresholds from all labelled documents."""
    counts = counts_of(docs)
    forests = fit_counts(counts, labels, keep, margin)
    drop_scratch(counts)
    return forests


def verdicts(stats: np.ndarray, forests: list[Forest]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base_failed, kept, anomaly over threshold) of each row of counts; the last is 0 where nothing is odd."""
    failed, features = base_failed(stats), features_of(stats)
    over = np.zeros(len(stats))
    for f in forests if len(stats) else ():
        over = np.maximum(over, f.scores(features[:, f.columns]) - f.threshold)
    return failed, ~failed & (over <= 0), over


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the five counts, base_failed, kept, anomaly for each document; each text is read once."""
    counts = counts_of(docs)
    shared = docs.sparkSession.sparkContext.broadcast(fit_counts(counts, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            failed, kept, score = verdicts(counts_in(batch), shared.value)
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("doc_id", *STATS)} | {"base_failed": pa.array(failed), "kept": pa.array(kept), "anomaly": pa.array(score)})

    return counts.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in STATS) + ", base_failed boolean, kept boolean, anomaly double")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns as they were; the texts are read a second time for that."""
    shared, columns = docs.sparkSession.sparkContext.broadcast(fit_forests(docs, labels)), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            stats = np.array([stats_of(t) for t in utf8(batch.column("text"))], dtype=np.int64).reshape(-1, len(COUNTS))
            yield batch.filter(pa.array(verdicts(stats, shared.value)[1]))

    return docs.mapInArrow(run, columns)
