"""Mixing sources to target weights with soft domain membership.

A classifier fitted on a table of labelled documents (softmax regression on the square roots of
hashed byte-pair frequencies) gives each document a posterior for every domain. A document's
rate says how often it is to be used. Rates start at 1 and are fitted by projected gradient
steps on the least squares between the expected tokens of each domain, the sum of
rate * tokens * posterior, and its target; after each step negative rates become 0. The
gradient is taken in the metric of the domains' token covariance over the documents that are
not at 0, so a handful of steps is enough; where that doesn't lower the error, in the metric over all
documents, in which a step never raises it. Only sums over domains reach the driver: each
step is one pass over the table, and a document's rate is an expression of its posteriors and
the steps so far.

Defined results: a null or empty text has no tokens, the classifier's prior as its posterior,
and takes part like any other; labels that are null are not learned from; without a labelled
document there is one domain, ``unlabelled``; weights of domains that the classifier doesn't know
are left out and the rest scaled to sum 1; a domain without a weight is left out of the fit, so its
documents' rates only change by their share of domains with one; if no weight is left, all rates
are 1. Equal texts have equal posteriors and rates, repeated rows as many copies each; of rows of
one id and label, the least text is learned from; texts of any length are counted whole. An empty
table gives no row. Extra columns pass through ``mixed``.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from meridian.llm.common import cut, each, hash_sample, one_each, spare, texts_of
from meridian.llm.common import mixed as mixed_bits

SLOTS = 1 << 12
#: Labelled documents of each domain, and in all, that the classifier is fitted on, at most.
SAMPLE_PER_DOMAIN = 500
SAMPLE = 4000
#: Steps at most; the fit ends before at a largest error of TOLERANCE times the target in all, or when
#: a step lowers the squared error by no more than that share of it.
STEPS = 25
TOLERANCE = 1e-9


@dataclass
class SoftDomains:
    domains: list[str]
    weights: np.ndarray  # by byte pair and domain
    bias: np.ndarray

    def posterior(self, raw: bytes) -> np.ndarray:
        logits = self.bias.copy()
        if len(raw) > 1:
            x = features(raw)
            at = np.flatnonzero(x)
            logits += x[at] @ self.weights[at]
        e = np.exp(logits - logits.max())
        return e / e.sum()


_PAIR_SLOT = (mixed_bits(np.arange(1 << 16, dtype=np.uint64), 9) % np.uint64(SLOTS)).astype(np.int64)


def features(raw: bytes) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs in a whole text."""
    b = np.frombuffer(raw, np.uint8).astype(np.int64)
    counts = np.bincount(_PAIR_SLOT[b[:-1] << 8 | b[1:]], minlength=SLOTS)
    return np.sqrt(counts / max(1, len(b) - 1))


def learn(documents: DataFrame, labelled: DataFrame) -> SoftDomains:
    """labelled: doc_id, domain. Fits on a bounded sample of its documents, chosen by id hash."""
    known = labelled.where(F.col("domain").isNotNull()).select("doc_id", F.col("domain").cast("string").alias("domain"))
    ranked = hash_sample(known, "domain", SAMPLE_PER_DOMAIN)
    picked = ranked.orderBy("place", "domain").limit(SAMPLE).select("doc_id", "domain").distinct()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in texts_of(batches):
            x = [features(t).astype(np.float32).tobytes() if len(t) > 1 else b"" for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("domain"), pa.array(x, pa.binary())], ["doc_id", "domain", "x"])

    rows = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most SAMPLE ids
    rows = one_each(rows, "domain").withColumn("text", F.col("text").cast("binary"))
    got = rows.select("doc_id", "domain", "text").mapInArrow(found, "doc_id long, domain string, x binary").toPandas()
    got = got[got["x"].map(len) > 0].drop_duplicates(["doc_id", "domain"]).sort_values(["doc_id", "domain"])
    domains = sorted(got["domain"].unique())
    if not domains:
        return SoftDomains(["unlabelled"], np.zeros((SLOTS, 1)), np.zeros(1))
    x = np.stack([np.frombuffer(r, np.float32) for r in got["x"]])
    return SoftDomains(domains, *_softmax(x, np.array([domains.index(d) for d in got["domain"]]), len(domains)))


def _softmax(x: np.ndarray, y: np.ndarray, k: int, steps: int = 200, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Gradient descent with momentum; domains weigh the same in all."""
    own = np.eye(k, dtype=np.float32)[y]
    share = (1.0 / np.maximum(1, own.sum(axis=0)))[y][:, None].astype(np.float32) / k
    w, b = np.zeros((x.shape[1], k), np.float32), np.zeros(k, np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p = (p / p.sum(axis=1, keepdims=True) - own) * share
        vw = 0.9 * vw - 8.0 * (x.T @ p + decay * w)
        vb = 0.9 * vb - 8.0 * p.sum(axis=0)
        w, b = w + vw, b + vb
    return w.astype(np.float64), b.astype(np.float64)


def with_posteriors(documents: DataFrame, model: SoftDomains, columns: list[str]) -> DataFrame:
    """``columns`` of the documents under the names _c0, _c1, ..., with _tokens (words) and _p0, _p1, ... (posteriors)."""
    names = [f"_p{i}" for i in range(len(model.domains))]
    kept = [f"_c{i}" for i in range(len(columns))]
    shared = documents.sparkSession.sparkContext.broadcast(vars(model))  # SLOTS numbers a domain
    more = [] if "text" in columns else [F.col("text").alias("_raw")]
    rows = documents.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(columns, kept)], *more)
    text = "_raw" if more else kept[columns.index("text")]
    schema = StructType([f for f in rows.schema.fields if f.name != "_raw"]).add("_tokens", LongType())
    for n in names:
        schema = schema.add(n, DoubleType())

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = SoftDomains(**shared.value)
        for b in batches:
            found = [(len(r.split()), own.posterior(r)) for r in each(b.column(text).cast(pa.binary()))]
            p = np.array([f[1] for f in found]).reshape(len(found), len(names))
            tokens = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), tokens, *(pa.array(p[:, i]) for i in range(len(names)))], [*kept, "_tokens", *names])

    return rows.mapInArrow(scored, schema)


def fit_rates(table: DataFrame, model: SoftDomains, weights: dict[str, float], budget: float | None = None) -> tuple[Column, dict]:
    """(the rate as an expression of _p0, _p1, ..., a report of the fit).

    table: _tokens and the posteriors of all documents. budget: tokens in all of the domains with
    a weight; without it, the least at which no domain has to give up tokens and
    rates of all domains' documents are 1 or more (and no rate is under 1, if all weights are positive). The report's
    ``converged`` says whether the fit ended at TOLERANCE; if not, the rates are those of the
    least error met, which is never above that of the first rates, and a warning is given.
    """
    k = len(model.domains)
    p = [F.col(f"_p{i}") for i in range(k)]
    own = np.array([i for i, d in enumerate(model.domains) if d in weights], dtype=int)
    goal = np.array([max(0.0, weights[model.domains[i]]) for i in own])
    rate: Column = F.lit(1.0)
    total, spread = _sums(table, rate, p, 0.0)
    start = total[own]
    if goal.sum() <= 0 or start.sum() <= 0:
        return rate, {"domains": model.domains, "expected": total.tolist(), "target": total.tolist(), "steps": 0, "converged": True}
    goal = goal / goal.sum()
    most = max((s / g for s, g in zip(start, goal) if g > 0), default=0.0)
    safe = np.linalg.pinv(spread[np.ix_(own, own)], rcond=1e-12)
    floor = 1.0 if budget is None and (goal > 0).all() else 0.0
    per, least = safe @ goal, safe @ start  # a first step to targets of T in all adds T * per - least to rates, by domain
    if floor and (per > 0).all():
        most = max(most, (least / per).max())
    target = goal * (budget if budget is not None else max(most, start.sum()))
    size = lambda t: float((t[own] - target) @ safe @ (t[own] - target))
    error, met, steps, done = size(total), False, 0, False
    for steps in range(1, STEPS + 1):
        met = np.abs(total[own] - target).max() <= TOLERANCE * target.sum()
        if met or done:
            break
        for metric in (np.linalg.pinv(spread[np.ix_(own, own)], rcond=1e-12), safe):
            slope = metric @ (total[own] - target)
            down = sum((p[i] * F.lit(float(x)) for i, x in zip(own, slope)), F.lit(0.0))
            tried = F.greatest(F.lit(floor), rate - down)
            found, live = _sums(table, tried, p, floor)
            if size(found) < 0.9 * error:
                break
        done = size(found) >= (1 - TOLERANCE) * error  # the safe step, which always lowers an error that can be lowered
        if size(found) < error:
            rate, total, spread, error = tried, found, live, size(found)
    met = np.abs(total[own] - target).max() <= TOLERANCE * target.sum()
    aim = total.copy()
    aim[own] = target
    if not (met or done):
        warnings.warn(f"the rates' fit did not converge in {STEPS} steps: expected {total.tolist()}, target {aim.tolist()}", stacklevel=2)
    return rate, {"domains": model.domains, "expected": total.tolist(), "target": aim.tolist(), "steps": steps, "converged": bool(met or done)}


def _sums(table: DataFrame, rate: Column, p: list[Column], floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens of each domain, and the domains' covariance over rates above ``floor``."""
    k = len(p)
    rows = table.withColumn("_r", rate)
    live = F.when(F.col("_r") > floor, F.col("_tokens")).otherwise(F.lit(0))
    sums = [F.sum(F.col("_r") * F.col("_tokens") * p[i]) for i in range(k)]
    sums += [F.sum(live * p[i] * p[j]) for i in range(k) for j in range(i, k)]
    got = [float(x or 0.0) for x in rows.agg(*(s.alias(f"s{n}") for n, s in enumerate(sums))).first()]
    spread = np.zeros((k, k))
    spread[np.triu_indices(k)] = got[k:]
    return np.array(got[:k]), spread + np.triu(spread, 1).T


def copies_of(rate: Column, doc_id: Column, seed: int = 17) -> Column:
    """A whole number of copies whose expectation is the rate, fixed by the document's id."""
    chance = F.pmod(F.xxhash64(F.coalesce(doc_id, F.lit(-1)), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("int")).cast("int")


def rates(documents: DataFrame, labelled: DataFrame, weights: dict[str, float], budget: float | None = None) -> tuple[DataFrame, dict]:
    """(doc_id, source if there is one, tokens, a posterior p_<domain> for each, rate, copies; the fit's report).

    Of domains whose names differ in case only, the later ones' columns are called _p_<domain> and so on.
    """
    model = learn(documents, labelled)
    own = [c for c in ("doc_id", "source") if c in documents.columns]
    table = cut(with_posteriors(documents, model, own))
    rate, report = fit_rates(table, model, weights, budget)
    names: list[str] = []
    for d in model.domains:
        names.append(spare([*names, *own, "tokens", "rate", "copies"], f"p_{d}"))
    posteriors = [F.col(f"_p{i}").alias(n) for i, n in enumerate(names)]
    rows = table.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(own)], F.col("_tokens").alias("tokens"), *posteriors, rate.alias("rate"))
    return rows.withColumn("copies", copies_of(F.col("rate"), F.col("doc_id"))), report


def mixed(documents: DataFrame, labelled: DataFrame, weights: dict[str, float], budget: float | None = None) -> DataFrame:
    """The documents as often as their rates say, with their own columns."""
    model = learn(documents, labelled)
    rate, _ = fit_rates(cut(with_posteriors(documents, model, ["doc_id"])), model, weights, budget)
    names = documents.columns
    rows = with_posteriors(documents, model, names)
    many = rows.withColumn("_copies", copies_of(rate, F.col(f"_c{names.index('doc_id')}"))).where("_copies > 0")
    each = many.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return each.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])
