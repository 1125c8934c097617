"""Quality classifier: nearest-neighbour voting over labelled latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import gram_counts, unit_rows

#: Labelled rows of each class that the classifier is fitted on, at most (those with the smallest hashes of their ids).
SAMPLE_PER_CLASS = 1500
#: Hash buckets of shape n-grams (letters and digits become their kind, in any script) and of plain byte n-grams, and their weights.
LOG2_DIMS = 10
SHAPE_GRAMS, SHAPE_WEIGHT = (1, 2, 3, 4), 1.0
BYTE_GRAMS, BYTE_WEIGHT = (3,), 0.4
#: Latent dimensions.
RANK = 48
NEIGHBOURS = 9
#: A neighbour's weight is its cosine to this power.
SHARPNESS = 4
#: Documents whose cosines are computed as one matrix product.
BLOCK = 256


def _shape_of(byte: int) -> int:
    if byte >= 128 or 97 <= byte <= 122:
        return ord("a")
    return ord("A") if 65 <= byte <= 90 else ord("0") if 48 <= byte <= 57 else byte


_SHAPES = bytes(map(_shape_of, range(256)))
DIMS = 2 * (1 << LOG2_DIMS) + 3


def features(text: str | None) -> np.ndarray:
    """A vector of the whole text: dampened counts of its shapes' and bytes' n-grams, and how much its words and lines repeat; zero for null and empty texts."""
    if not text:
        return np.zeros(DIMS, dtype=np.float32)
    data = text.encode("utf-8", "surrogatepass")
    shape, plain = np.sqrt(gram_counts(data.translate(_SHAPES), LOG2_DIMS, SHAPE_GRAMS)), np.sqrt(gram_counts(data, LOG2_DIMS, BYTE_GRAMS))
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    repeats = [sum(map(str.__eq__, words, words[1:])) / n, 0.3 * (1 - len(set(words)) / n), 0.3 * (1 - len(set(lines)) / len(lines))]
    return np.concatenate([SHAPE_WEIGHT * shape / max(np.linalg.norm(shape), 1e-9), BYTE_WEIGHT * plain / max(np.linalg.norm(plain), 1e-9), repeats]).astype(np.float32)


@dataclass
class KnnModel:
    centre: np.ndarray  # of the sample's unit feature vectors
    basis: np.ndarray  # feature dimensions x latent dimensions
    vectors: np.ndarray  # unit latent vectors of the labelled sample
    labels: np.ndarray
    prior: float
    neighbours: int

    def latent(self, x: np.ndarray) -> np.ndarray:
        return unit_rows((unit_rows(x) - self.centre) @ self.basis)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Shares of label 1 among the nearest neighbours, weighted by cosine; without features, the sample's share."""
        if not len(self.labels):
            return np.full(len(x), self.prior)
        cos = self.latent(x) @ self.vectors.T  # exact, against every labelled vector
        k = min(self.neighbours, len(self.labels))
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k] if k < cos.shape[1] else np.tile(np.arange(k), (len(cos), 1))
        w = np.maximum(np.take_along_axis(cos, near, 1), 1e-6) ** SHARPNESS
        vote = (w * self.labels[near]).sum(1) / w.sum(1)
        return np.where(x.any(axis=1), np.clip(vote, 0.0, 1.0), self.prior).astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE_PER_CLASS, rank: int = RANK, neighbours: int = NEIGHBOURS) -> KnnModel:
    """Fit on a bounded sample: of each class, the per_class labelled ids with the smallest hashes, and one text of each.

    An id with several texts gives the one with the smallest hash, and an id with both labels counts for both. The sample's
    feature vectors (2 x per_class, of DIMS numbers each) reach the driver, not its texts. Without labels the model says 0.5.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y")).distinct().withColumn("h", F.xxhash64("doc_id"))
    picked = [(r.doc_id, r.y) for y in (0, 1) for r in known.filter(F.col("y") == y).orderBy("h", "doc_id").limit(per_class).collect()]
    # at most 2 x per_class ids and labels
    sample = F.broadcast(spark.createDataFrame(picked, "doc_id long, y int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t).astype(np.float16).tobytes() for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["y"], pa.array(x, pa.binary())], names=["doc_id", "y", "x"])

    texts = docs.select("doc_id", "text").filter("text IS NOT NULL AND text != ''").join(sample, "doc_id")
    one = texts.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t")).select("doc_id", "y", "t.text")
    rows = sorted((r.doc_id, r.y, bytes(r.x)) for r in one.mapInArrow(run, "doc_id long, y int, x binary").collect())
    if not rows:
        return KnnModel(np.zeros(DIMS, np.float32), np.zeros((DIMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5, neighbours)
    y = np.asarray([r[1] for r in rows], dtype=np.float64)
    x = np.empty((len(rows), DIMS), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i] = np.frombuffer(r[2], dtype=np.float16)
    del rows
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centre = x.mean(0)
    x -= centre
    basis = latent_basis(x, rank)
    return KnnModel(centre, basis, unit_rows(x @ basis), y, float(y.mean()), neighbours)


def latent_basis(x: np.ndarray, rank: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """The first right singular vectors of x, by block power iteration: nothing larger than x times a few columns is held."""
    width = min(rank + 8, *x.shape)
    q = np.random.default_rng(seed).standard_normal((x.shape[1], width)).astype(np.float32)
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    turn = np.linalg.svd(x @ q, full_matrices=False)[2]
    return (q @ turn.T[:, :rank]).astype(np.float32)


def classify(docs: DataFrame, model: KnnModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, score and predicted of every document row; the row's other columns play no part and are left out.

    Each document's whole text becomes a latent vector; the labelled vectors (bounded by the sample) are broadcast and all
    cosines computed block by block. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = b["text"].to_pylist(), []
            for at in range(0, len(texts), BLOCK):
                out.append(shared.value.score(np.stack([features(t) for t in texts[at : at + BLOCK]])))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(np.concatenate(out) if out else [], pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def filter_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, label: str = "quality") -> DataFrame:
    """The documents that the classifier, fitted on the given labels, doesn't reject, with all their columns.

    Scores are appended where the rows are, so no join is needed and repeated rows or null ids do no harm.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label))
    kept_types = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keep = b["text"].to_pylist(), []
            for at in range(0, len(texts), BLOCK):
                keep.append(shared.value.score(np.stack([features(t) for t in texts[at : at + BLOCK]])) >= threshold)
            if keep:
                yield b.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, kept_types)
