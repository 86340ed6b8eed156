"""Quality classifier: a linear hinge-loss model over n-gram indicators scaled by naive Bayes.

Each n-gram's indicator is scaled by its log-count ratio between the two classes, then a
linear support vector machine is fitted on the scaled indicators by dual coordinate descent.
N-grams are words, word pairs, and pairs of word shapes with the share of the text that they
take (in powers of two), all hashed to a fixed number of slots.

Defined results: a null or empty text has no n-gram and gets the model's intercept, a text of any
length is one set of n-grams; a label that is null or not 0 or 1 is not learned from; with labels
of one class only, every score is that class's (0 or 1), and with none it is 0.5. An id with
labels of both classes is learned from as both; of rows of one id, the least text. A score of
exactly 0.5 is predicted 1. An empty table gives no row. Extra columns are ignored. Repeated rows
are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from meridian.llm.common import WordCodes, bounded_sample, fold_of, gathered, mixed, one_each, spare, texts_of

SLOTS = 1 << 18
#: Labelled rows of each class that the model is fitted on, at most.
SAMPLE_PER_CLASS = 2500


def ngrams(text: str, codes: WordCodes) -> np.ndarray:
    """Slots of the distinct n-grams of a whole text, in ascending order."""
    ids = codes.of(text)
    if not len(ids):
        return np.empty(0, dtype=np.int32)
    word, shape = ids & 0xFFFFFFFF, ids >> 32
    found = [mixed(word, 1)]
    if len(ids) > 1:
        found.append(mixed(word[:-1] * 31 + word[1:] * 17, 2))
        same = word[:-1] == word[1:]
        pairs, counts = np.unique((shape[:-1] << 17) | (shape[1:] << 1) | same, return_counts=True)
        share = np.floor(np.log2(counts / len(same))).astype(np.int64) + 64
        found.append(mixed(pairs * 128 + share, 3))
    return np.unique(np.concatenate(found) % np.uint64(SLOTS)).astype(np.int32)


@dataclass
class NBSVM:
    weights: np.ndarray  # weight times ratio, for each slot
    intercept: float
    scale: tuple[float, float]  # of the logistic curve that turns a margin into a score

    def score(self, grams: np.ndarray) -> float:
        margin = self.intercept
        if len(grams):
            margin += float(self.weights[grams].sum()) / np.sqrt(len(grams))
        a, b = self.scale
        return float(1.0 / (1.0 + np.exp(-np.clip(a * margin + b, -30, 30))))


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 12, cost: float = 1.0, smoothing: float = 1.0) -> NBSVM:
    """Log-count ratios, then dual coordinate descent; classes weigh the same in all."""
    y = np.where(labels == 1, 1.0, -1.0)
    if not len(rows) or abs(y.sum()) == len(y):
        sure = 0.0 if not len(rows) else 30.0 * y[0]
        return NBSVM(np.zeros(SLOTS, np.float32), sure, (1.0, 0.0))
    counts = {s: np.full(SLOTS, smoothing) for s in (1.0, -1.0)}
    for r, s in zip(rows, y):
        counts[s][r] += 1
    n = {s: float((y == s).sum()) for s in counts}
    ratio = np.log(counts[1.0] / (n[1.0] + 2 * smoothing)) - np.log(counts[-1.0] / (n[-1.0] + 2 * smoothing))
    ratio[(counts[1.0] + counts[-1.0]) <= 2 * smoothing + 1] = 0.0  # seen once: says nothing
    values = [ratio[r] / np.sqrt(max(1, len(r))) for r in rows]
    norms = np.array([float(v @ v) + 1.0 for v in values])
    limit = {s: cost * len(y) / (2 * n[s]) for s in n}
    w, bias, alpha = np.zeros(SLOTS), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            slope = y[i] * (float(w[rows[i]] @ values[i]) + bias) - 1.0
            new = min(max(alpha[i] - slope / norms[i], 0.0), limit[y[i]])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                alpha[i] = new
                w[rows[i]] += step * values[i]
                bias += step
    margins = np.array([float(w[r] @ v) + bias for r, v in zip(rows, values)])
    return NBSVM((w * ratio).astype(np.float32), bias, _curve(margins, y, n))


def _curve(margins: np.ndarray, y: np.ndarray, n: dict) -> tuple[float, float]:
    """Slope of a logistic curve through the margins, its middle left at margin 0."""
    weight, a = np.array([1.0 / n[s] for s in y]), 1.0
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(a * margins * y, -30, 30)))
        a = float(np.clip(a + 2.0 * np.sum(weight * (1 - p) * y * margins) / 2, 0.1, 20.0))
    return a, 0.0


def collected_grams(rows: DataFrame, label: str) -> tuple[list[np.ndarray], np.ndarray]:
    """The n-grams of a bounded sample, found on the executors, and its labels."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for b, texts in texts_of(batches):
            found = [ngrams(t, codes).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column(label), pa.array(found, pa.binary())], ["doc_id", label, "grams"])

    made = one_each(rows, label).mapInArrow(grams, f"doc_id long, {label} int, grams binary")
    got = gathered(made, label, "grams")
    return [np.frombuffer(g, np.int32) for g in got["grams"]], got[label].to_numpy()


def train(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, held_out: tuple[int, int] | None = (3, 1)) -> NBSVM:
    """Fits on at most ``per_class`` labelled rows of each class, chosen by id hash.

    held_out: (folds, fold) whose documents' labels are never learned from.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1))
    if held_out:
        known = known.where(fold_of(F.col("doc_id"), held_out[0]) != held_out[1])
    known = known.join(documents.select("doc_id"), "doc_id", "left_semi").distinct()
    picked = bounded_sample(known, F.col("quality"), per_class, [0, 1])
    rows = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most 2 * per_class ids
    return fit(*collected_grams(rows, "quality"))


def with_scores(documents: DataFrame, model: NBSVM, column: str = "score") -> DataFrame:
    """``documents`` with a score of each whole text; other columns pass through."""
    shared = documents.sparkSession.sparkContext.broadcast(vars(model))  # SLOTS floats, whatever the input

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, own = WordCodes(), NBSVM(**shared.value)
        for b, texts in texts_of(batches):
            found = pa.array([own.score(ngrams(t, codes)) for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, found], [*b.schema.names, column])

    return documents.mapInArrow(score, StructType([*documents.schema.fields]).add(column, DoubleType()))


def classify(documents: DataFrame, model: NBSVM, folds: tuple[int, int] = (3, 1)) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = with_scores(documents.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        F.coalesce(fold_of(F.col("doc_id"), folds[0]) == folds[1], F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def accepted(documents: DataFrame, model: NBSVM) -> DataFrame:
    """The documents that the model doesn't reject, with their own columns."""
    column = spare(documents.columns, "score")
    return with_scores(documents, model, column).where(F.col(column) >= 0.5).drop(column)
