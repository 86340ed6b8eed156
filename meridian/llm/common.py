"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.operators.frames import cut, shared_dir  # noqa: F401


def spare(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until no column is called so (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


class WordCodes(dict):
    """word -> shape hash (16 bits) << 32 | word hash (32 bits), remembered up to a size.

    The shape keeps what a word looks like: runs of capitals, small letters, digits and each
    other character, so that invented words still show their form.
    """

    LIMIT = 150_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        shape, last = [], ""
        for ch in word:
            kind = "A" if ch.isupper() else "a" if ch.isalpha() else "0" if ch.isdigit() else ch
            if kind != last:
                shape.append(kind)
                last = kind
        code = (zlib.crc32("".join(shape).encode("utf-8", "surrogatepass")) & 0xFFFF) << 32
        code |= zlib.crc32(word.lower().encode("utf-8", "surrogatepass"))
        self[word] = code
        return code

    def of(self, text: str) -> np.ndarray:
        return np.fromiter((self[w] for w in text.split()), dtype=np.int64)


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser, the same on every machine."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def bounded_sample(df: DataFrame, group: Column, per_group: int, groups: list) -> DataFrame:
    """At most ``per_group`` rows of each listed value of ``group``, those of least id hash.

    A top-k by hash needs no shuffle of the rows it leaves out, and the same rows are chosen
    however the table is dealt.
    """
    parts = [
        df.where(group == F.lit(g)).orderBy(F.xxhash64(F.col("doc_id")), F.col("doc_id")).limit(per_group) for g in groups
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def one_each(rows: DataFrame, label: str) -> DataFrame:
    """doc_id, ``label`` and text of a sample: of rows of one id and label, the least text.

    Repeats are summed up before the shuffle, so an id that very many rows have is one row.
    """
    return rows.groupBy("doc_id", label).agg(F.min("text").alias("text"))


#: Bytes of features that a driver is sent to fit a model on, at most.
SAMPLE_BYTES = 128 << 20


def gathered(made: DataFrame, label: str, features: str, most: int = SAMPLE_BYTES) -> pd.DataFrame:
    """A bounded sample's features at the driver, by doc_id and label.

    made: doc_id, label and a binary column, a few thousand rows. Rows are taken in turn from
    each label, by id hash, while their bytes are within ``most``; the first of each is always.
    """
    held = cut(made)
    turn = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64("doc_id"), "doc_id"))
    sizes = held.select("doc_id", label, F.length(features).alias("_bytes")).withColumn("_turn", turn)
    so_far = F.sum("_bytes").over(Window.orderBy("_turn", label).rowsBetween(Window.unboundedPreceding, 0))  # of the sample
    taken = sizes.withColumn("_so_far", so_far).where((F.col("_turn") == 1) | (F.col("_so_far") <= most)).select(F.col("doc_id").alias("_id"), F.col(label).alias("_label"))
    got = held.join(F.broadcast(taken), F.col("doc_id").eqNullSafe(F.col("_id")) & F.col(label).eqNullSafe(F.col("_label"))).drop("_id", "_label")
    return got.toPandas().sort_values(["doc_id", label], kind="stable")


def hash_sample(df: DataFrame, by: str, per_group: int) -> DataFrame:
    """doc_id, ``by`` and place of at most ``per_group`` ids of each group, those of least hash.

    Groups' distinct ids are counted first (summed up before the shuffle), and only ids whose hash is
    likely to be among the least of their group go on to be ranked, so no group, however large,
    meets in one task. df: doc_id and ``by``, in which rows may repeat.
    """
    df = df.select("doc_id", by).distinct()
    counts = df.groupBy(by).agg(F.count("*").alias("_n"))
    if counts.count() <= 10_000:
        counts = F.broadcast(counts)
    chance = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    likely = df.join(counts, by).where(chance * F.col("_n") < 1.5 * per_group + 50)
    first = Window.partitionBy(by).orderBy(chance, "doc_id")
    return likely.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= per_group).select("doc_id", by, F.col("_r").alias("place"))


def texts_of(batches: Iterator[pa.RecordBatch], column: str = "text"):
    """(batch, its texts one by one) with null read as empty.

    Only one text at a time is a Python object, and a batch's buffers are given back after it. So
    is what the worker's last task has freed, of this operator or one before: workers live on.
    """
    give_back()
    for b in batches:
        yield b, each(b.column(column))
        del b
        pa.default_memory_pool().release_unused()
    give_back()


def give_back() -> None:
    """Returns freed memory to the system, where the C library can (glibc)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def each(column: pa.Array):
    """A column's values one by one, null as the empty text."""
    empty = b"" if pa.types.is_binary(column.type) else ""
    return (t.as_py() or empty for t in column)
