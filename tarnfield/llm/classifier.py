"""Quality classifier: random-indexing word vectors, a two-layer network, calibrated probabilities.

Tokens are runs of ASCII letters (lower-cased), digits and non-ASCII characters, and
runs of other visible characters. The ``VOCABULARY`` tokens that most sample texts hold
have rows of their own, every other token, of whatever length, shares one of ``TAIL`` rows
by its hash, so no token is left out. Each row has a sparse ternary index vector; its word
vector is the sum of its neighbours' index vectors over the training sample, centred and
scaled to unit length. A document is the weighted mean of its tokens' vectors, the same
over its distinct rows, the shares of tail and of distinct tokens, and its length. A
two-layer network in numpy scores it; a temperature fitted on a part of the sample that the
network did not see turns scores into probabilities.

Training reads at most ``SAMPLE_ROWS`` labelled ids of least hash, each with one text,
none of them from the held-out fold (crc32 of the id as text, modulo 5, is 0). Inputs are
texts alone. Scoring covers whole texts of all documents.

Defined cases: a null or empty text has the score of an empty vector; an id with
several labels counts with the least, and with the text of least hash where it repeats in
the documents; without labelled rows every score is 0.5; equal texts have equal scores,
and equal rows and rows with a null or repeated doc_id stay rows (a null one is not held
out); an empty table gives no rows; very long texts are pooled whole; other columns of the
documents are left aside, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.llm.common import LOWER_BYTES, crc_mod5, drop_scratch, one_text_each, sample_by_hash, scratch, slices, utf8

TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|[^\x00-\x20\x7f0-9a-z\x80-\xff]+")
#: Sizes of what is learnt: labelled rows, tokens with a row of their own, shared rows, dimensions.
SAMPLE_ROWS, VOCABULARY, TAIL, DIMENSIONS = 8000, 20000, 4096, 48
NONZERO, REACH, HIDDEN, SEED = 6, 2, 24, 7
#: Longer tokens share rows, so that no long one comes to the driver.
OWN_ROW_BYTES = 40
THRESHOLD = 0.3
#: The sample is counted in so many tasks at most, each of which returns one matrix.
TASKS = 8


def tokens_of(text: bytes) -> list[bytes]:
    return TOKEN.findall(text.translate(LOWER_BYTES))


def index_vectors(words: list[bytes], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Sparse ternary vectors, fixed by the words themselves."""
    out = np.zeros((len(words), dimensions), dtype=np.float32)
    for row, w in zip(out, words, strict=True):
        rng = np.random.default_rng(xxhash.xxh64_intdigest(w, SEED))
        row[rng.choice(dimensions, NONZERO, replace=False)] = rng.permutation([1, -1] * (NONZERO // 2))
    return out


def rows_of(tokens: list[bytes], number: dict[bytes, int]) -> np.ndarray:
    """Row of each token: its own, or a shared one after those."""
    own, get = len(number), number.get
    return np.fromiter((k if (k := get(t)) is not None else own + xxhash.xxh64_intdigest(t, SEED) % TAIL for t in tokens), dtype=np.int64, count=len(tokens))


@dataclass
class Model:
    """Word numbers, vectors and weights of all rows; the network's layers, input scaling and temperature."""

    number: dict[bytes, int]
    vectors: np.ndarray
    weight: np.ndarray
    layers: list[np.ndarray] | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    temperature: float = 1.0

    def pooled(self, text: bytes) -> np.ndarray:
        """The document's vector."""
        tokens = tokens_of(text)
        d, own = self.vectors.shape[1], len(self.number)
        ids = rows_of(tokens, self.number)
        out = np.zeros(2 * d + 3, dtype=np.float32)
        if len(ids):
            counts = np.bincount(ids, minlength=len(self.weight))
            types = np.flatnonzero(counts)
            w = self.weight[types]
            by_count = w * counts[types]
            out[:d] = by_count @ self.vectors[types] / by_count.sum()
            out[d : 2 * d] = w @ self.vectors[types] / w.sum()
            out[-3:] = (ids >= own).mean(), len(set(tokens)) / len(tokens), np.log1p(len(tokens)) / 10
        return out

    def logits(self, rows: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        hidden = np.maximum((rows - self.mean) / self.scale @ w1 + b1, 0)
        return (hidden @ w2 + b2)[:, 0]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if self.layers is None or not len(rows):
            return np.full(len(rows), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.logits(rows) / self.temperature, -30, 30)))


def fit_network(model: Model, rows: np.ndarray, labels: np.ndarray, epochs: int = 60, batch: int = 256, rate: float = 3e-3, decay: float = 1e-3) -> None:
    """Trains on four fifths of the rows (Adam, weight decay) and sets the temperature on the rest."""
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(rows))
    held, own = np.split(order, [len(order) // 5])
    model.mean, model.scale = rows[own].mean(axis=0), rows[own].std(axis=0) + 1e-6
    d = rows.shape[1]
    layers = [rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, 1)), np.zeros(1)]
    first, second, step = [np.zeros_like(x) for x in layers], [np.zeros_like(x) for x in layers], 0
    x_all, y_all = (rows - model.mean) / model.scale, labels.astype(float)
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(own), max(1, len(own) // batch)):
            x, y = x_all[at], y_all[at]
            hidden = np.maximum(x @ layers[0] + layers[1], 0)
            p = 1 / (1 + np.exp(-np.clip((hidden @ layers[2] + layers[3])[:, 0], -30, 30)))
            g = ((p - y) / len(y))[:, None]
            back = (g @ layers[2].T) * (hidden > 0)
            grads = [x.T @ back + decay * layers[0], back.sum(axis=0), hidden.T @ g + decay * layers[2], g.sum(axis=0)]
            step += 1
            for k, grad in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                layers[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    model.layers = layers
    if len(held):
        z, y = model.logits(rows[held]), labels[held].astype(float)
        tried = np.exp(np.linspace(np.log(0.25), np.log(8), 80))
        loss = [np.mean(np.logaddexp(0, z / t) - y * z / t) for t in tried]
        model.temperature = float(tried[int(np.argmin(loss))])


def cooccurrence(texts: list[bytes], number: dict[bytes, int], index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the neighbours' index vectors for each row, and the number of texts that hold it."""
    out, held = np.zeros_like(index), np.zeros(len(index), dtype=np.int64)
    for text in texts:
        ids = rows_of(tokens_of(text), number)
        held[np.unique(ids)] += 1
        for k in range(1, REACH + 1):
            a, b = ids[:-k], ids[k:]
            np.add.at(out, a, index[b])
            np.add.at(out, b, index[a])
    return out, held


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, vocabulary: int = VOCABULARY) -> Model:
    """Learns from labelled rows outside the held-out fold."""
    spark = docs.sparkSession
    one = labels.where("doc_id is not null and quality is not null").where(crc_mod5() != 0).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    rows = scratch(one_text_each(docs, sample_by_hash(one, "doc_id", sample_rows)).repartition(TASKS, "doc_id").sortWithinPartitions("doc_id"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in slices(batches):
            for text in utf8(batch.column("text")):
                seen.update({t: 1 for t in tokens_of(text) if len(t) <= OWN_ROW_BYTES})
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

    counted = rows.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = [bytes(r["word"]) for r in counted.where("n > 1").orderBy(F.desc("n"), "word").limit(vocabulary).collect()]
    model = Model({w: k for k, w in enumerate(words)}, np.zeros((0, DIMENSIONS), np.float32), np.ones(0, np.float32))
    index = index_vectors([*words, *(b" tail %d" % k for k in range(TAIL))])
    model.vectors, model.weight = np.zeros_like(index), np.ones(len(index), np.float32)
    if rows.isEmpty():
        return model
    shared = spark.sparkContext.broadcast((model.number, index))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros_like(shared.value[1]), np.zeros(len(shared.value[1]), dtype=np.int64)
        for batch in slices(batches):
            more, texts = cooccurrence(utf8(batch.column("text")), *shared.value)
            total, held = total + more, held + texts
        yield pa.RecordBatch.from_pydict({"m": pa.array([total.astype("<f4").tobytes()], pa.binary()), "n": pa.array([held.astype("<i8").tobytes()], pa.binary())})

    vectors, held = index.copy(), np.zeros(len(index), dtype=np.int64)
    for r in rows.select("text").mapInArrow(add, "m binary, n binary").toLocalIterator():
        vectors += np.frombuffer(r["m"], dtype="<f4").reshape(index.shape)
        held += np.frombuffer(r["n"], dtype="<i8")
    vectors -= vectors.mean(axis=0)
    model.vectors = (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-6)).astype(np.float32)
    model.weight = (1 + np.log(max(held.max(), 1) / np.maximum(held, 1))).astype(np.float32)
    pooled = spark.sparkContext.broadcast(model)

    def vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [pooled.value.pooled(t).astype("<f4").tobytes() for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "quality": batch.column("quality"), "v": pa.array(got, pa.binary())})

    # one row for each chosen id: no more than sample_rows come to the driver
    got = sorted(rows.select("doc_id", "quality", "text").mapInArrow(vector, "doc_id long, quality int, v binary").collect(), key=lambda r: r["doc_id"])
    x, y = np.stack([np.frombuffer(r["v"], dtype="<f4") for r in got]), np.array([r["quality"] for r in got])
    fit_network(model, x.astype(float), y)
    drop_scratch(rows)
    return model


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = np.stack([shared.value.pooled(t) for t in utf8(batch.column("text"))]).astype(float)
            score = shared.value.scores(rows)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32))})

    return docs.select("doc_id", F.coalesce(crc_mod5() == 0, F.lit(False)).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
