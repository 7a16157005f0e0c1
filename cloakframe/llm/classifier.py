"""Document quality: random-indexing word vectors, pooled, in a small calibrated network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.words import LEXICAL, coefficients, mix, word_hashes
from cloakframe.session import materialize

FOLDS = 5


#: Words of a text whose neighbours are counted at a time.
PART = 1 << 17


@dataclass(frozen=True)
class Classifier:
    """Parameters. ``sample`` bounds the labelled rows the network is fitted on; word vectors use all documents.

    Words share ``buckets`` by hash, which bounds the table of word vectors at any corpus size.
    """

    buckets: int = 1 << 14
    dimensions: int = 48
    nonzeros: int = 4
    window: int = 2
    sample: int = 20_000
    hidden: int = 32
    epochs: int = 40
    threshold: float = 0.3


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out of all learning."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _buckets(text: bytes | None, p: Classifier) -> np.ndarray:
    return (word_hashes(text or b"", LEXICAL) % np.uint64(p.buckets)).astype(np.int64)


def _index_vectors(p: Classifier) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the few nonzeros of each bucket's random index vector."""
    bits = mix(coefficients(p.buckets * p.nonzeros, seed=301)).reshape(p.buckets, p.nonzeros)
    return (bits % np.uint64(p.dimensions)).astype(np.int64), np.where(bits >> np.uint64(63), 1, -1).astype(np.int64)


def word_vectors(docs: DataFrame, p: Classifier) -> np.ndarray:
    """Unit vectors of all buckets: sums of the index vectors of the words around, over all documents, damped by log."""
    size = p.buckets * p.dimensions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = _index_vectors(p)
        total, waiting, n = np.zeros(size, dtype=np.int64), [], 0

        def add() -> None:
            cells = np.concatenate([c for c, _ in waiting])
            weights = np.concatenate([s for _, s in waiting])
            total[:] += (np.bincount(cells[weights > 0], minlength=size) - np.bincount(cells[weights < 0], minlength=size))
            waiting.clear()

        for batch in batches:
            for text in batch.column(0):
                words = _buckets(text.as_py(), p)
                for begin in range(0, len(words), PART):
                    for step in range(1, p.window + 1):
                        later = words[begin + step : begin + step + PART]
                        earlier = words[begin : begin + len(later)]
                        for here, there in ((earlier, later), (later, earlier)):
                            waiting.append(((here[:, None] * p.dimensions + places[there]).ravel(), signs[there].ravel()))
                            n += len(here) * p.nonzeros
                    if n > 2_000_000:
                        add()
                        n = 0
        if waiting:
            add()
        table = total.reshape(p.buckets, p.dimensions)
        seen = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.int64()), *(pa.array(np.ascontiguousarray(table[seen, k]), pa.int64()) for k in range(p.dimensions))],
            names=["bucket", *(f"d{k}" for k in range(p.dimensions))])

    names = [f"d{k}" for k in range(p.dimensions)]
    partial = docs.select(F.col("text").cast("binary")).mapInArrow(run, "bucket bigint, " + ", ".join(f"{n} bigint" for n in names))
    summed = partial.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    vectors = np.zeros((p.buckets, p.dimensions), dtype=np.float32)
    if len(summed):
        values = summed[names].to_numpy(dtype=np.float64)
        vectors[summed["bucket"].to_numpy(dtype=np.int64)] = np.sign(values) * np.log1p(np.abs(values))
    vectors -= vectors[vectors.any(axis=1)].mean(axis=0) if len(summed) else 0
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-6)


def pooled(words: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and deviation of a document's word vectors, and how alike neighbours are; zeros without words."""
    d = vectors.shape[1]
    if not len(words):
        return np.zeros(2 * d + 2, dtype=np.float32)
    total, squares, near = np.zeros(d), np.zeros(d), 0.0
    for k in range(0, len(words), 8192):
        part = vectors[words[k : k + 8193]]
        own = part[:8192]
        total += own.sum(axis=0)
        squares += np.einsum("ij,ij->j", own, own)
        near += float(np.einsum("ij,ij->", part[1:], part[:-1]))
    mean = total / len(words)
    spread = np.sqrt(np.maximum(squares / len(words) - mean**2, 0))
    return np.concatenate((mean, spread, [near / max(len(words) - 1, 1), np.linalg.norm(mean)])).astype(np.float32)


class Network:
    """Two layers, fitted by Adam; the temperature is chosen on rows the weights were not fitted on."""

    def __init__(self, x: np.ndarray, y: np.ndarray, p: Classifier):
        rng = np.random.default_rng(11)
        self.prior = (y.sum() + 1) / (len(y) + 2)
        self.temperature = 1.0
        self.mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        self.scale = np.maximum(x.std(axis=0), 1e-6) if len(x) else np.ones(x.shape[1])
        self.layers = None
        if len(np.unique(y)) < 2 or len(y) < 20:
            return
        x = (x - self.mean) / self.scale
        order = rng.permutation(len(y))
        check, fit = order[: len(y) // 5], order[len(y) // 5 :]
        w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], p.hidden)), np.zeros(p.hidden), rng.normal(0, 1 / np.sqrt(p.hidden), p.hidden), np.log(self.prior / (1 - self.prior))]
        first, second = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w]
        step = 0
        for _ in range(p.epochs):
            rng.shuffle(fit)
            for k in range(0, len(fit), 128):
                rows = fit[k : k + 128]
                hidden = np.tanh(x[rows] @ w[0] + w[1])
                error = (1 / (1 + np.exp(-(hidden @ w[2] + w[3]))) - y[rows]) / len(rows)
                back = np.outer(error, w[2]) * (1 - hidden**2)
                grads = [x[rows].T @ back + 1e-4 * w[0], back.sum(axis=0), hidden.T @ error + 1e-4 * w[2], error.sum()]
                step += 1
                for j, g in enumerate(grads):
                    first[j] = 0.9 * first[j] + 0.1 * g
                    second[j] = 0.999 * second[j] + 0.001 * g * g
                    w[j] = w[j] - 0.003 * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.999**step)) + 1e-8)
        self.layers = w
        logits = self.logits(x[check])
        sign = np.where(y[check] > 0, 1, -1)
        self.temperature = min(np.geomspace(0.25, 8, 41), key=lambda t: np.logaddexp(0, -sign * logits / t).mean())

    def logits(self, standardized: np.ndarray) -> np.ndarray:
        w = self.layers
        return np.tanh(standardized @ w[0] + w[1]) @ w[2] + w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability of label 1; the base rate if there was nothing to learn from."""
        if self.layers is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits((x - self.mean) / self.scale) / self.temperature, -40, 40)))


def classify(docs: DataFrame, labels: DataFrame, p: Classifier = Classifier(), label: str = "quality") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs (doc_id, text)``.

    Word vectors are counted over all texts; each document's pooled vector is written to the shared folder. The network
    learns from at most ``sample`` rows of ``labels`` (by order of a hash of the id) outside fold 0, the held-out fold, each
    with one document of its id; ids, labels, language and source are no inputs. NULL and empty texts have the zero vector and a score like any;
    NULL ids are not held out and never learned from; NULL labels are passed over; repeated rows score alike; with
    fewer than 20 labels or one class only every score is the (smoothed) base rate; other columns are ignored.
    """
    spark = docs.sparkSession
    vectors = spark.sparkContext.broadcast(word_vectors(docs, p))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [pooled(_buckets(t.as_py(), p), vectors.value).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "features"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary"))
    known = materialize(rows.mapInArrow(features, "doc_id bigint, features binary"), "features")
    usable = labels.where(F.col(label).isNotNull() & (fold(F.col("doc_id")) != 0)).select(
        F.col("doc_id").cast("bigint"), F.col(label).cast("int").alias("label"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(p.sample)
    # However many documents bear a chosen id, the driver gets one.
    named = known.join(chosen.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("features").alias("features"))
    learned = named.join(chosen, "doc_id").select("doc_id", "features", "label").toPandas().sort_values(["doc_id", "label"])
    width = 2 * p.dimensions + 2
    x = np.frombuffer(b"".join(learned["features"]), dtype=np.float32).reshape(-1, width).astype(np.float64)
    network = spark.sparkContext.broadcast(Network(x, learned["label"].to_numpy(dtype=np.float64), p))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.float32).reshape(-1, width).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(network.value.score(x), pa.float64())], names=["doc_id", "score"])

    return known.mapInArrow(scores, "doc_id bigint, score double").select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= p.threshold).cast("int").alias("predicted"))
