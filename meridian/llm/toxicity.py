"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j) over the distinct terms of
a text, so that two terms can weigh together what neither weighs alone. Terms are lower-cased
words without marks around them and their first four letters, hashed to a fixed number of slots.

Defined results: a null or empty text has no term and gets the intercept's score, a text of any
length is one set of terms; a label that is null or not 0 or 1 is not learned from; with labels
of one class only, every score is that class's, and with none it is 0.5. An id with labels of
both classes is learned from as both; of rows of one id, the least text. A score of exactly 0.5
is predicted toxic. An empty table gives no row. Extra columns are ignored. Repeated rows are
scored one by one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from meridian.llm.common import bounded_sample, fold_of, gathered, one_each, spare, texts_of

SLOTS = 1 << 22
FACTORS = 4
#: Labelled rows of each class that the model is fitted on, at most.
SAMPLE_PER_CLASS = 2500
#: A slot's value is 1 if its likelihood ratio is so many standard errors from zero, less with less evidence,
#: at least LEAST alone and LEAST_PAIRED in pairs. No slot is left out for it.
STANDARD_ERRORS = 4.0
LEAST = 0.01
LEAST_PAIRED = 0.05
#: How much more a clean text called toxic counts than a toxic one missed.
CLEAN = 3.0
#: Linear weights begin at this share of the log-odds.
START = 0.15
#: Marks that are taken off a word's ends.
EDGES = ".,;:!?\"'()[]{}<>*%&$#@|-_~`/\\"


def slots_of(word: str) -> tuple[int, ...]:
    """Hashed terms of a word: the bare word, and its first four letters if it has more."""
    bare = word.lower().strip(EDGES)
    if not bare:
        return ()
    found = (zlib.crc32(b"w" + bare.encode("utf-8", "surrogatepass")) % SLOTS,)
    if len(bare) > 4:
        found += (zlib.crc32(b"p" + bare[:4].encode("utf-8", "surrogatepass")) % SLOTS,)
    return found


class Terms(dict):
    """word -> its slots (places in ``kept``, if given), remembered up to a size."""

    LIMIT = 150_000

    def __init__(self, kept: np.ndarray | None = None):
        self.places = None if kept is None else {int(s): i for i, s in enumerate(kept)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.LIMIT:
            self.clear()
        found = slots_of(word)
        if self.places is not None:
            found = tuple(self.places[s] for s in found if s in self.places)
        self[word] = found
        return found

    def of(self, text: str) -> np.ndarray:
        """Slots of the distinct terms of a whole text, in ascending order."""
        found = {s for w in set(text.split()) for s in self[w]}
        return np.sort(np.fromiter(found, dtype=np.int32, count=len(found)))


@dataclass
class FactorizationMachine:
    """x_i of a present term grows with its evidence; in pairs it is LEAST_PAIRED at least."""

    kept: np.ndarray  # slots that take part, ascending
    x: np.ndarray  # by place in kept
    w0: float
    w: np.ndarray
    v: np.ndarray  # by place and factor

    def margin(self, places: np.ndarray) -> float:
        if not len(places):
            return self.w0
        vx = self.v[places] * np.maximum(self.x[places, None], LEAST_PAIRED)
        total = vx.sum(axis=0)
        return self.w0 + float(self.w[places] @ self.x[places]) + 0.5 * float(total @ total - (vx * vx).sum())

    def score(self, places: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.margin(places), -30, 30))))


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 15, rate: float = 0.1, decay: float = 1e-4) -> FactorizationMachine:
    """AdaGrad on the logistic loss; linear weights begin at a share of the log-odds.

    Classes weigh the same in all. A term met in one row only never takes part.
    """
    y = np.where(labels == 1, 1.0, -1.0)
    n = {s: float((y == s).sum()) for s in (1.0, -1.0)}
    if not n[1.0] or not n[-1.0]:
        sure = 0.0 if not len(rows) else 30.0 * float(y[0])
        return FactorizationMachine(np.empty(0, np.int32), np.empty(0), sure, np.empty(0), np.empty((0, FACTORS)))
    met, at = np.unique(np.concatenate(rows), return_inverse=True)
    of = np.repeat(y, [len(r) for r in rows])
    counts = {s: np.bincount(at[of == s], minlength=len(met)) for s in n}
    odds = np.log((counts[1.0] + 0.5) / (n[1.0] - counts[1.0] + 0.5)) - np.log((counts[-1.0] + 0.5) / (n[-1.0] - counts[-1.0] + 0.5))
    tells = counts[1.0] + counts[-1.0] > 1
    kept, odds = met[tells].astype(np.int32), odds[tells]
    x = np.clip(_evidence(counts[1.0][tells], counts[-1.0][tells], n) / STANDARD_ERRORS, np.sqrt(LEAST), 1.0) ** 2
    order = np.random.default_rng(11)
    m = FactorizationMachine(kept, x, -1.0, START * np.clip(odds, -4.0, 4.0) * x, order.normal(0, 0.03, (len(kept), FACTORS)))
    places = [places_of(kept, r) for r in rows]
    g0, gw, gv = 1e-2, np.full(len(kept), 1e-2), np.full((len(kept), FACTORS), 1e-2)
    weight = {s: len(y) / (2.0 * n[s]) for s in n}
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            r = places[i]
            x, v = m.x[r], m.v[r]
            paired = np.maximum(x, LEAST_PAIRED)[:, None]
            vx = v * paired
            total = vx.sum(axis=0)
            margin = m.w0 + float(m.w[r] @ x) + 0.5 * float(total @ total - (vx * vx).sum())
            pull = -y[i] * weight[y[i]] / (1.0 + np.exp(np.clip(y[i] * margin, -30, 30)))
            g0 += pull * pull
            m.w0 -= rate * pull / np.sqrt(g0)
            dw = pull * x + decay * m.w[r]
            gw[r] += dw * dw
            m.w[r] -= rate * dw / np.sqrt(gw[r])
            dv = pull * paired * (total - vx) + decay * v
            gv[r] += dv * dv
            m.v[r] = v - 0.5 * rate * dv / np.sqrt(gv[r])
    m.w0 -= min(0.0, _threshold(np.array([m.margin(r) for r in places]), y, n))
    return m


def places_of(kept: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Where a text's slots are among those that take part, each once; both ascend."""
    at = np.searchsorted(kept, slots)
    inside = at < len(kept)
    at, slots = at[inside], slots[inside]
    return at[kept[at] == slots]


def _evidence(toxic: np.ndarray, clean: np.ndarray, n: dict) -> np.ndarray:
    """Roots of the likelihood ratios of the terms' counts in the classes, which hold for rare terms too."""
    share = (toxic + clean) / (n[1.0] + n[-1.0])
    parts = ((toxic, share * n[1.0]), (clean, share * n[-1.0]), (n[1.0] - toxic, (1 - share) * n[1.0]), (n[-1.0] - clean, (1 - share) * n[-1.0]))
    ratio = sum(np.where(k > 0, k * np.log(np.maximum(k, 0.5) / np.maximum(e, 1e-9)), 0.0) for k, e in parts)
    return np.sqrt(np.maximum(2.0 * ratio, 0.0))


def _threshold(margins: np.ndarray, y: np.ndarray, n: dict) -> float:
    """The margin that best parts the classes, in the middle of the gap that it lies in.

    Texts of several strong terms saturate the loss before one strong term alone weighs enough,
    so the middle of the logistic curve may leave such texts out; it is only ever lowered. A share of clean texts wrongly
    called toxic counts as much as ``CLEAN`` times that share of toxic texts missed.
    """
    at = np.argsort(margins, kind="stable")
    below = np.concatenate([[0.0], np.cumsum(np.where(y[at] > 0, -1.0 / n[1.0], CLEAN / n[-1.0]))])
    ordered = margins[at]
    edges = np.concatenate([[ordered[0] - 1.0], (ordered[1:] + ordered[:-1]) / 2, [ordered[-1] + 1.0]])
    splits = np.concatenate([[True], ordered[1:] > ordered[:-1], [True]])
    return float(edges[splits][np.argmax(below[splits])])


def collected_terms(rows: DataFrame, label: str) -> tuple[list[np.ndarray], np.ndarray]:
    """The terms of a bounded sample, found on the executors, and its labels."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms()
        for b, texts in texts_of(batches):
            slots = pa.array([known.of(t).tobytes() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column(label), slots], ["doc_id", label, "slots"])

    made = one_each(rows, label).mapInArrow(found, f"doc_id long, {label} int, slots binary")
    got = gathered(made, label, "slots")
    return [np.frombuffer(s, np.int32) for s in got["slots"]], got[label].to_numpy()


def train(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, held_out: tuple[int, int] | None = (5, 0)) -> FactorizationMachine:
    """Fits on at most ``per_class`` labelled rows of each class, chosen by id hash among those of the documents.

    held_out: (folds, fold) whose documents' labels are never learned from.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1))
    if held_out:
        known = known.where(fold_of(F.col("doc_id"), held_out[0]) != held_out[1])
    known = known.join(documents.select("doc_id"), "doc_id", "left_semi").distinct()
    picked = bounded_sample(known, F.col("toxic"), per_class, [0, 1])
    rows = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most 2 * per_class ids
    return fit(*collected_terms(rows, "toxic"))


def with_scores(documents: DataFrame, model: FactorizationMachine, column: str = "score") -> DataFrame:
    """``documents`` with a score of each whole text; other columns pass through."""
    shared = documents.sparkSession.sparkContext.broadcast(vars(model))  # a few thousand kept slots

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = FactorizationMachine(**shared.value)
        known = Terms(own.kept)
        for b, texts in texts_of(batches):
            found = pa.array([own.score(known.of(t)) for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, found], [*b.schema.names, column])

    return documents.mapInArrow(score, StructType([*documents.schema.fields]).add(column, DoubleType()))


def classify(documents: DataFrame, model: FactorizationMachine, folds: tuple[int, int] = (5, 0)) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = with_scores(documents.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        F.coalesce(fold_of(F.col("doc_id"), folds[0]) == folds[1], F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def accepted(documents: DataFrame, model: FactorizationMachine) -> DataFrame:
    """The documents that the model doesn't reject, with their own columns.

    A model that has learned no term, as without labelled rows of both classes, rejects none.
    """
    if not len(model.kept):
        return documents
    column = spare(documents.columns, "score")
    return with_scores(documents, model, column).where(F.col(column) < 0.5).drop(column)
