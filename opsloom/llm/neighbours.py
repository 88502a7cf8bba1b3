"""Quality classifier by nearest-neighbour voting in a latent-semantic space (operator 8).

A bounded sample of labelled documents is turned into weighted vectors of byte trigrams, trigrams of kinds of bytes and
word repetition, reduced by a truncated singular value decomposition and broadcast. Every document is projected into the
same space and compared with every sample vector in blocks of exact cosine products; the nearest ones vote with their
similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.tables import filter_rows, fold
from opsloom.llm.words import slices, split_words, text_bytes

#: Hashed features of a text, and latent dimensions.
FEATURES, RANK = 2048, 48
#: Documented bound of the labelled sample: so many rows at most, those with the least hash of their id.
SAMPLE = 3000
NEIGHBOURS = 15


#: Steps of the share of words that repeat the word before, one feature each, and the weight of such a feature.
REPEATS = np.array([0.0, 0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
REPEAT_WEIGHT = 12.0
#: Kinds of bytes: capitals, other letters and digits are one each, every other sign is its own.
KIND = np.arange(256, dtype=np.uint32)
KIND[65:91], KIND[97:123], KIND[128:], KIND[48:58] = 65, 97, 97, 48


def _hashed_trigrams(data: np.ndarray, width: int) -> np.ndarray:
    gram = data[:-2] * np.uint32(65536) + data[1:-1] * np.uint32(256) + data[2:]
    return (((gram * np.uint32(2654435761)) >> np.uint32(8)) % np.uint32(width)).astype(np.int64)


def text_features(texts: pa.Array) -> np.ndarray:
    """A row for each text: logarithmic counts of hashed byte trigrams and of trigrams of kinds of bytes, and the step of
    the share of repeated words."""
    data, bounds = text_bytes(texts)
    n, half = len(texts), FEATURES // 2
    found = np.zeros((n, FEATURES), np.float32)
    if len(data) >= 3:
        wide, row = data.astype(np.uint32), np.repeat(np.arange(n), np.diff(bounds))[:-2]
        inside = np.arange(len(row)) + 2 < bounds[1:][row]
        for at, width, values in ((0, half, wide), (half, half - len(REPEATS), KIND[data])):
            bucket = (row * width + _hashed_trigrams(values, width))[inside]
            counts = np.bincount(bucket, minlength=n * width).reshape(n, width)
            found[:, at:at + width] = np.log1p(counts.astype(np.float32))
    words = split_words(texts)
    hashes, counts = words.hashes(), words.counts
    same = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes) > 1:
        again = hashes[1:] == hashes[:-1]
        again[words.first[(words.first > 0) & (words.first < len(hashes))] - 1] = False
        same[2:] = np.cumsum(again)
    share = (same[words.first[1:]] - same[words.first[:-1]]) / np.maximum(counts, 1)
    step = np.searchsorted(REPEATS, share, side="left")
    rows = np.flatnonzero(counts > 0)
    found[rows, FEATURES - len(REPEATS) + np.minimum(step[rows], len(REPEATS) - 1)] = REPEAT_WEIGHT
    return found


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Space:
    """Feature weights, projection, and the labelled vectors; bounded by FEATURES, RANK and the sample."""

    weights: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @staticmethod
    def fit(features: np.ndarray, labels: np.ndarray) -> Space:
        if not len(labels):
            return Space(np.ones(FEATURES, np.float32), np.zeros((FEATURES, RANK), np.float32), np.zeros((0, RANK), np.float32), labels)
        weights = np.log((1 + len(labels)) / (1 + (features > 0).sum(axis=0))).astype(np.float32) + 1
        matrix = _unit(features * weights)
        rng = np.random.default_rng(20)
        base = rng.standard_normal((FEATURES, RANK + 16)).astype(np.float32)
        for _ in range(8):  # subspace iteration
            base, _ = np.linalg.qr(matrix.T @ (matrix @ base))
        _, _, turn = np.linalg.svd(matrix @ base, full_matrices=False)
        projection = (base @ turn.T)[:, :RANK].astype(np.float32)
        return Space(weights, projection, _unit(matrix @ projection), labels)

    def scores(self, features: np.ndarray, neighbours: int) -> np.ndarray:
        """Share of label 1 among the nearest, each weighted by its similarity; for a text without features, or without
        similar neighbours, the share in the sample; 0.5 without a sample."""
        if not len(self.labels):
            return np.full(len(features), 0.5)
        place = _unit(_unit(features * self.weights) @ self.projection)
        similar = place @ self.vectors.T
        k = min(neighbours, len(self.labels))
        nearest = np.argpartition(-similar, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(similar, nearest, axis=1).astype(np.float64), 0) ** 4
        total = vote.sum(axis=1)
        share = (vote * self.labels[nearest]).sum(axis=1) / np.where(total > 0, total, 1)
        return np.where(total > 0, np.clip(share, 0, 1), self.labels.mean())


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    chosen = (labels.select(F.col("doc_id").cast("long").alias("of"), F.col(label).cast("int").alias("label"))
              .filter((fold("of", folds) != 0) & F.col("label").isin(0, 1) & F.col("of").isNotNull())
              .orderBy(F.xxhash64("of"), "of", "label").limit(sample))
    # at most ``sample`` rows are broadcast
    rows = docs.filter("text IS NOT NULL").join(F.broadcast(chosen), F.col("doc_id") == F.col("of")).select("of", "label", "text")

    def features(batches):
        for batch in batches:
            for part in slices(batch):
                weights = text_features(part.column("text")).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column("of"), part.column("label"),
                                                  pa.array([w.tobytes() for w in weights], pa.binary())], ["of", "label", "features"])

    found = rows.mapInArrow(features, "of long, label int, features binary").orderBy("of", "label", "features").limit(sample).collect()
    matrix = np.frombuffer(b"".join(r.features for r in found), np.float16).reshape(-1, FEATURES).astype(np.float32)
    return matrix, np.array([r.label for r in found], np.float64)


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, threshold: float = 0.3,
                   sample: int = SAMPLE, neighbours: int = NEIGHBOURS) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= ``threshold``) of each
    document, from its whole text alone.

    Learns from at most ``sample`` rows of ``labels`` with label 0 or 1 whose crc32(doc_id as text) modulo ``folds`` is not
    0, those with the least hash of doc_id. Null labels and labels without a document are not learnt from. Null, empty and
    very short texts get the share of label 1 in the sample; without any labelled row every score is 0.5. Repeated rows get
    the same score; held_out is null where doc_id is. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    space = docs.sparkSession.sparkContext.broadcast(Space.fit(*labelled_sample(docs, labels, label, folds, sample)))

    def run(batches):
        for part, score in _scored(batches, space.value, neighbours):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    scored = docs.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold("doc_id", folds) == 0).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def _scored(batches, space: Space, neighbours: int):
    for batch in batches:
        for part in slices(batch):
            yield part, np.concatenate([space.scores(text_features(part.slice(a, 256).column("text")), neighbours)
                                        for a in range(0, part.num_rows, 256)])


def keep_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, threshold: float = 0.3,
                 sample: int = SAMPLE, neighbours: int = NEIGHBOURS) -> DataFrame:
    """The rows of ``docs``, unchanged and with all their columns, whose score is at least ``threshold``; scores, nulls and
    empty tables as in quality_scores."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    space = docs.sparkSession.sparkContext.broadcast(Space.fit(*labelled_sample(texts, labels, label, folds, sample)))
    return filter_rows(docs, lambda batches: ((part, score >= threshold) for part, score in _scored(batches, space.value, neighbours)))
