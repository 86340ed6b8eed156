"""Interval joins that don't compare every row with every other one."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlapping(a: DataFrame, b: DataFrame, by: Sequence[str], slice_us: int, holds: Callable[..., Column] | None = None, touching: bool = False) -> DataFrame:
    """Pairs of rows of equal keys whose intervals overlap (or touch): a's columns, b's as b_*.

    Both sides are dealt into time slices; a pair is kept only in the first slice both reach, so
    none comes twice. Bounds must be finite. holds: a further predicate of (al, ah, bl, bh).
    """
    more = 0 if touching else 1
    first = lambda lo: F.floor(F.col(lo) / slice_us)
    left = a.withColumn("_slice", F.explode(F.sequence(first("lo"), F.floor((F.col("hi") - more) / slice_us))))
    right = b.select(*[F.col(c).alias(c if c in by else f"b_{c}") for c in b.columns])
    right = right.withColumn("_slice", F.explode(F.sequence(first("b_lo"), F.floor((F.col("b_hi") - more) / slice_us))))
    al, ah, bl, bh = (F.col(c) for c in ("lo", "hi", "b_lo", "b_hi"))
    meet = (al <= bh) & (bl <= ah) if touching else (al < bh) & (bl < ah)
    pairs = left.join(right, [*by, "_slice"]).where(meet & (F.col("_slice") == F.greatest(F.floor(al / slice_us), F.floor(bl / slice_us))))
    if holds is not None:
        pairs = pairs.where(holds(al, ah, bl, bh))
    return pairs.drop("_slice")
