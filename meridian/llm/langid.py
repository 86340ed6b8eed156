"""Language identification by rank-order profiles.

A language's profile is its most frequent letter n-grams (one to three letters, words padded
with a blank) in order of frequency. A document's own most frequent n-grams are ranked the same
way, and its distance to a language is the sum of how far each n-gram is out of place, with a
fixed penalty for n-grams that the profile lacks. The nearest profile's language is predicted.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and so is every
text if nothing could be learned; equal distances go to the smaller language name; rows whose
lang is null are not learned from, of rows of one id and lang only the least text is; equal
frequencies rank by the n-gram's code points; letters are what Unicode calls so, in any plane. A
text of any length is one count of n-grams. An empty table gives no row. Extra columns are
ignored. Repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm.common import fold_of, hash_sample, one_each, texts_of

#: n-grams in a profile, and of a document that are compared with it.
PROFILE = 400
#: Documents of each language that its profile is learned from, at most.
SAMPLE_PER_LANG = 600
BLANK = 0x20
_LETTERS = 0x30000


def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(_LETTERS)), bool, _LETTERS)


def grams(text: str, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the n-grams of a whole text. A code holds up to three code points."""
    cps = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    is_letter = letters[np.minimum(cps, _LETTERS - 1)]
    if len(cps) and cps.max() >= _LETTERS:  # rare
        far = cps >= _LETTERS
        is_letter[far] = [chr(c).isalpha() for c in cps[far].tolist()]
    if not is_letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c = np.concatenate([[BLANK], np.where(is_letter, cps, BLANK), [BLANK]])
    c = c[np.concatenate([[True], (c[1:] != BLANK) | (c[:-1] != BLANK)])]
    pairs = c[:-1] << 21 | c[1:]
    return np.unique(np.concatenate([c[c != BLANK], pairs, pairs[:-1] << 21 | c[2:]]), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most frequent codes first."""
    if len(codes) > 4 * PROFILE:
        floor = np.partition(counts, -PROFILE)[-PROFILE]
        codes, counts = codes[counts >= floor], counts[counts >= floor]
    return codes[np.lexsort((codes, -counts))[:PROFILE]]


@dataclass
class Profiles:
    langs: list[str]  # ascending
    codes: np.ndarray  # all profiles' codes, ascending
    ranks: np.ndarray  # by code and language; PROFILE where a profile lacks the code

    def predict(self, top: np.ndarray) -> tuple[str, float]:
        if not len(top) or not self.langs:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        ranks = np.where((self.codes[at] == top)[:, None], self.ranks[at], PROFILE)
        out = np.where(ranks == PROFILE, PROFILE, np.abs(ranks - np.arange(len(top))[:, None])).sum(axis=0)
        best = int(np.argmin(out))
        return self.langs[best], float(1.0 - out[best] / (PROFILE * len(top)))


def learn(documents: DataFrame, lang: str = "lang", per_lang: int = SAMPLE_PER_LANG, held_out: tuple[int, int] | None = (3, 1)) -> Profiles:
    """Profiles from at most ``per_lang`` documents of each language, chosen by id hash.

    held_out: (folds, fold) whose documents are never learned from.
    """
    known = documents.select("doc_id", "text", F.col(lang).alias("lang")).where(F.col("lang").isNotNull())
    if held_out:
        known = known.where(fold_of(F.col("doc_id"), held_out[0]) != held_out[1])
    picked = hash_sample(known.select("doc_id", "lang"), "lang", per_lang)
    rows = one_each(known.join(F.broadcast(picked.select("doc_id", "lang")), ["doc_id", "lang"]), "lang")  # per_lang rows of each

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for b, texts in texts_of(batches):
            held: dict[str, list] = {}
            for t, name in zip(texts, b.column("lang").to_pylist()):
                held.setdefault(name, []).append(grams(t, letters))
            for name, found in held.items():
                codes, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
                n = np.bincount(at, np.concatenate([f[1] for f in found]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "code", "n"])

    total = rows.mapInArrow(counted, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = total.withColumn("place", F.row_number().over(best) - 1).where(F.col("place") < PROFILE).select("lang", "code", "place").toPandas()
    langs = sorted(top["lang"].unique())
    codes = np.unique(top["code"].to_numpy(np.int64))
    ranks = np.full((len(codes), len(langs)), PROFILE, np.int64)
    if len(codes):
        ranks[np.searchsorted(codes, top["code"].to_numpy(np.int64)), [langs.index(x) for x in top["lang"]]] = top["place"]
    return Profiles(langs, codes, ranks)


def identify(documents: DataFrame, profiles: Profiles, folds: tuple[int, int] = (3, 1)) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document's whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(vars(profiles))  # PROFILE entries a language

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, own = letter_table(), Profiles(**shared.value)
        for b, texts in texts_of(batches):
            found = [own.predict(ranked(*grams(t, letters))) for t in texts]
            names, scores = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), names, scores], ["doc_id", "lang_pred", "score"])

    said = documents.select("doc_id", "text").mapInArrow(predicted, "doc_id long, lang_pred string, score double")
    return said.select("doc_id", _held(folds).alias("held_out"), "lang_pred", "score")


def _held(folds: tuple[int, int]) -> Column:
    return F.coalesce(fold_of(F.col("doc_id"), folds[0]) == folds[1], F.lit(False))
