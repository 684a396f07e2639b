"""Document quality by a regularised quadratic discriminant over transformed text statistics.

Each class is a Gaussian over the same statistics. Its covariance is shrunk towards the pooled one and that towards its
diagonal, factored once (Cholesky) and kept with the model; a score is the logistic of the difference of the two
log-densities, each from a Mahalanobis distance by triangular solves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import byte_words, mapped, sliced, text_bytes
from tessella.llm.labelled import fold, labelled, sample

#: Labelled documents of each class that a model is fitted on at most.
SAMPLE_ROWS = 5000
HELD_PARTS, HELD = 4, 2
#: Score from which a document is predicted good.
THRESHOLD = 0.7
#: Shares of the pooled covariance in a class's, and of the diagonal in the pooled one.
TO_POOLED, TO_DIAGONAL = 0.15, 0.1
STATISTICS = (
    "words", "word_bytes", "line_words", "capitals", "symbols", "bars", "shouts", "stops", "digits", "distinct", "stutter", "same_lines", "commonest", "not_ascii",
)
_CAPITALS = bytes(range(65, 91))
_LETTERS = _CAPITALS + bytes(range(97, 123))


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of one whole text: logarithms of sizes, square roots of shares."""
    words = byte_words(text)
    n, size = len(words), len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    letters = size - len(text.translate(None, _LETTERS))
    inside = sum(map(len, words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    shares = (
        (size - len(text.translate(None, _CAPITALS))) / max(1, letters),
        (size - len(text.translate(None, b"#*$%&<>"))) / inside,
        text.count(b"|") / inside,
        text.count(b"!") / inside,
        (text.count(b".") + text.count(b",")) / inside,
        (size - len(text.translate(None, b"0123456789"))) / inside,
        len(counts) / n,
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        max(counts.values()) / n,
        (size - len(text.translate(None, bytes(range(128, 256))))) / inside,
    )
    return [math.log1p(n), math.log(inside / n), math.log1p(n / max(1, len(lines))), *map(math.sqrt, shares)]


def solved(factor: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Each row through the inverse of a lower triangular factor, by forward substitution."""
    out = np.zeros_like(rows)
    for i in range(len(factor)):
        out[:, i] = (rows[:, i] - out[:, :i] @ factor[i, :i]) / factor[i, i]
    return out


class Model:
    """Means, Cholesky factors and log-determinants of the two classes. Without both classes the score is constant."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.constant = None
        if not len(y) or y.min() == y.max():
            self.constant = float(y[0]) if len(y) else 0.5
            return
        self.centre, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = (x - self.centre) / self.scale
        self.means = [z[y == c].mean(axis=0) for c in (0, 1)]
        scatter = [(z[y == c] - self.means[c]).T @ (z[y == c] - self.means[c]) for c in (0, 1)]
        counts = [(y == c).sum() for c in (0, 1)]
        pooled = sum(scatter) / max(1, len(y) - 2)
        pooled = (1 - TO_DIAGONAL) * pooled + TO_DIAGONAL * np.diag(np.diag(pooled) + 1e-3)
        eye = 1e-3 * np.eye(len(pooled))
        shrunk = [(1 - TO_POOLED) * scatter[c] / max(1, counts[c] - 1) + TO_POOLED * pooled + eye for c in (0, 1)]
        self.factors = [np.linalg.cholesky(s) for s in shrunk]
        self.logdets = [2 * np.log(np.diag(f)).sum() for f in self.factors]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None or not len(x):
            return np.full(len(x), self.constant if self.constant is not None else 0.5)
        z = (x - self.centre) / self.scale
        density = [-0.5 * (solved(self.factors[c], z - self.means[c]) ** 2).sum(axis=1) - 0.5 * self.logdets[c] for c in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``most`` labelled documents of each class outside the held-out fold; only their statistics,
    one short row each, reach the driver."""
    rows = labelled(docs, sample(labels, "quality", fold(F.col("doc_id"), HELD_PARTS) != HELD, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [statistics(t) for t in text_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.float64()))], names=["y", "x"])

    got = mapped(rows.select("text", "y"), run, "y int, x array<double>").toArrow()
    x = np.array(got.column(1).to_pylist(), dtype=float).reshape(-1, len(STATISTICS))
    return Model(x, got.column(0).to_numpy())


def classify(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every document, in one pass without a shuffle.

    Null and empty texts have all statistics zero and are scored so. Rows that repeat are scored each; a null doc_id is
    never held out or learnt from. Where only one class is labelled every score is its label; with no label, 0.5.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x = np.array([statistics(t) for t in text_bytes(batch.column(1))], dtype=float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.scores(x))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = mapped(rows, run, "doc_id long, score double")
    held = F.coalesce(fold(F.col("doc_id"), HELD_PARTS) == HELD, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
