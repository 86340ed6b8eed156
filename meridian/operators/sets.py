"""Algebra of interval sets: frames of key columns, lo and hi.

A set's rows may overlap on input; every operator merges them first, as a set without overlaps
or touching rows is what the algebra is defined on. Rows that don't satisfy lo < hi are empty
and left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions import interval as I
from meridian.functions.moment import NINF, PINF
from meridian.operators.frames import same

KEY = ("key",)


def merge(df: DataFrame, by: Sequence[str] = KEY, slice_us: int | None = None) -> DataFrame:
    """Overlapping and touching intervals made one.

    slice_us: merge within time slices of this width first, so that a key with very many rows
    is spread over tasks and only its islands meet in one.
    """
    rows = df.where(F.col("lo") < F.col("hi")).select(*by, "lo", "hi")
    if slice_us:
        rows = _islands(rows.withColumn("_slice", F.floor(F.col("lo") / slice_us)), [*by, "_slice"]).drop("_slice")
    return _islands(rows, by)


def _islands(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    order = Window.partitionBy(*by).orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("lo") > before), 1).otherwise(0)
    island = F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = rows.withColumn("_opens", opens).withColumn("_island", island)
    return marked.groupBy(*by, "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")


def depth(operands: DataFrame, by: Sequence[str] = KEY, domain: DataFrame | None = None, weight: Column | None = None) -> DataFrame:
    """Segments lo, hi and cnt, the number of operands that cover each.

    operands: key columns, operand, lo, hi. domain: keys that are to have rows even where
    nothing covers them, from the negative to the positive infinite moment.
    """
    merged = merge(operands, [*by, "operand"])
    d = weight if weight is not None else F.lit(1)
    ends = F.array(F.struct(F.col("lo").alias("t"), d.cast("bigint").alias("d")), F.struct(F.col("hi").alias("t"), (-d).cast("bigint").alias("d")))
    points = merged.select(*by, F.explode(ends).alias("e")).select(*by, "e.t", "e.d")
    if domain is not None:
        points = points.unionByName(domain.select(*by).distinct().select(*by, F.lit(NINF).alias("t"), F.lit(0).cast("bigint").alias("d")))
    order = Window.partitionBy(*by).orderBy("t")
    swept = points.groupBy(*by, "t").agg(F.sum("d").alias("d"))
    last = F.lit(PINF) if domain is not None else F.lit(None).cast("bigint")
    segments = swept.select(*by, F.col("t").alias("lo"), F.coalesce(F.lead("t").over(order), last).alias("hi"), F.sum("d").over(order).alias("cnt"))
    return segments.where(F.col("lo") < F.col("hi"))


def where_depth(operands: DataFrame, holds: Column, by: Sequence[str] = KEY, domain: DataFrame | None = None) -> DataFrame:
    """The parts where a predicate of cnt holds, merged."""
    return merge(depth(operands, by, domain).where(holds), by)


def or_(operands: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    return merge(operands, by)


def and_(operands: DataFrame, n: int, by: Sequence[str] = KEY) -> DataFrame:
    """Covered by all of ``n`` operands; an operand without rows for a key makes it empty there."""
    return where_depth(operands, F.col("cnt") == n, by) if n else operands.select(*by, "lo", "hi").where("false")


def exclusive(operands: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """Covered by exactly one operand."""
    return where_depth(operands, F.col("cnt") == 1, by)


def not_(operands: DataFrame, domain: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """Covered by no operand; keys of the domain without rows are free always."""
    merged = merge(operands, by)
    order = Window.partitionBy(*by).orderBy("lo")
    gaps = merged.select(*by, F.col("hi").alias("lo"), F.coalesce(F.lead("lo").over(order), F.lit(PINF)).alias("hi"))
    heads = domain.select(*by).distinct().join(merged.groupBy(*by).agg(F.min("lo").alias("hi")), list(by), "left")
    heads = heads.select(*by, F.lit(NINF).alias("lo"), F.coalesce("hi", F.lit(PINF)).alias("hi"))
    gaps = gaps.join(domain.select(*by).distinct(), list(by), "left_semi")
    return gaps.unionByName(heads).where(F.col("lo") < F.col("hi"))


def exclude(a: DataFrame, b: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """What of ``a`` isn't in ``b``."""
    both = a.select(*by, F.lit(0).alias("operand"), "lo", "hi").unionByName(b.select(*by, F.lit(1).alias("operand"), "lo", "hi"))
    only_a = depth(both, by, weight=F.when(F.col("operand") == 0, 1).otherwise(2)).where(F.col("cnt") == 1)
    return merge(only_a, by)


def window(df: DataFrame, lo: int | Column, hi: int | Column) -> DataFrame:
    """Rows clipped to [lo, hi); those outside go. Rows must be merged already, or are kept apart."""
    a, b = (F.lit(x) if isinstance(x, int) else x for x in (lo, hi))
    clipped = df.where((F.col("lo") < b) & (F.col("hi") > a))
    return clipped.withColumns({"lo": F.greatest("lo", a), "hi": F.least("hi", b)})


def numbered(df: DataFrame, by: Sequence[str] = KEY, backward: bool = False) -> DataFrame:
    """With pos, a row's place (from 0) in its key's order, from the end if backward."""
    order = F.desc("hi") if backward else F.asc("lo")
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1)


def bounds(merged: DataFrame, lo: int, hi: int, by: Sequence[str] = KEY, domain: DataFrame | None = None) -> DataFrame:
    """t, value: where membership changes in [lo, hi], both edges included with what holds there."""
    inside = window(merged, lo, hi)
    ends = F.array(F.struct(F.col("lo").alias("t"), F.lit(True).alias("value")), F.struct(F.col("hi").alias("t"), F.lit(False).alias("value")))
    points = inside.select(*by, F.explode(ends).alias("e")).select(*by, "e.t", "e.value")
    keys = (domain if domain is not None else merged).select(*by).distinct()
    edges = keys.select(*by, F.explode(F.array(F.lit(lo), F.lit(hi))).alias("t"), F.lit(None).cast("boolean").alias("value"))
    at = points.unionByName(edges).groupBy(*by, "t").agg(F.max("value").alias("value"))
    before = F.last("value", ignorenulls=True).over(Window.partitionBy(*by).orderBy("t"))
    closes = (F.col("t") == hi) & F.col("value").isNull()
    return at.select(*by, "t", F.when(closes, F.coalesce(before, F.lit(False))).otherwise(F.coalesce("value", F.lit(False))).alias("value"))


def find(df: DataFrame, length: Column | int, by: Sequence[str] = KEY, backward: bool = False, lo: int = NINF, hi: int = PINF) -> DataFrame:
    """The first place (the last, if backward) in [lo, hi) where a duration fits: lo, hi.

    Intervals without a bound to align with are passed over; a duration of zero finds none.
    """
    n = F.lit(length) if isinstance(length, int) else length
    anchor = F.col("hi") if backward else F.col("lo")
    fits = window(merge(df, by), lo, hi).where(I.fits(F.col("lo"), F.col("hi"), n) & (anchor > NINF) & (anchor < PINF) & (n > 0))
    if backward:
        return fits.groupBy(*by).agg(F.max("hi").alias("hi")).select(*by, (F.col("hi") - n).alias("lo"), "hi")
    return fits.groupBy(*by).agg(F.min("lo").alias("lo")).select(*by, "lo", (F.col("lo") + n).alias("hi"))


def at(merged: DataFrame, moments: DataFrame, by: Sequence[str] = KEY, how: str = "inner") -> DataFrame:
    """The interval that holds each moment t; moments: key columns, t and more (but no lo or hi).

    A merged set's intervals are disjoint, so only the last that begins by then can hold it.
    """
    rows = _begun(merged, moments, F.col("t"), by)
    inside = F.col("_hi") > F.col("_asked.t")
    if how == "inner":
        rows = rows.where(inside)
    return rows.select("_asked.*", F.when(inside, F.col("_lo")).alias("lo"), F.when(inside, F.col("_hi")).alias("hi"))


def enclosing(merged: DataFrame, asked: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """Those of ``asked`` that lie inside one interval of the set."""
    return _begun(merged, asked, F.col("lo"), by).where(F.col("_hi") >= F.col("_asked.hi")).select("_asked.*")


def _begun(merged: DataFrame, asked: DataFrame, at: Column, by: Sequence[str]) -> DataFrame:
    """_asked, _lo, _hi: the asked rows with the last interval of their key that begins at or before ``at``."""
    from meridian.operators import steps

    rows = asked.select(*by, at.alias("t"), F.struct(*asked.columns).alias("_asked"))
    held = merged.select(*by, F.col("lo").alias("t"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    return steps.asof(rows, held, ["_lo", "_hi"], by)


def span(df: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    return df.groupBy(*by).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def total(df: DataFrame, by: Sequence[str] = KEY, lo: int = NINF, hi: int = PINF) -> DataFrame:
    """total: microseconds covered within [lo, hi); raises if that is unbounded."""
    inside = window(merge(df, by), lo, hi)
    length = F.when(F.assert_true(I.is_bounded(F.col("lo"), F.col("hi")), "an unbounded set has no total").isNull(), F.col("hi") - F.col("lo"))
    return inside.groupBy(*by).agg(F.sum(length).alias("total"))


def ratio(a: DataFrame, b: DataFrame, by: Sequence[str] = KEY, lo: int = NINF, hi: int = PINF) -> DataFrame:
    """total(a) / total(b) in whole milliseconds; 0 where a has none, null where b has none."""
    ms = lambda df, name: total(df, by, lo, hi).select(*by, F.floor(F.col("total") / 1000).alias(name))
    both = ms(a, "_a").join(ms(b, "_b"), list(by), "full")
    return both.select(*by, F.when(F.coalesce("_a", F.lit(0)) == 0, 0.0).when(F.col("_b") > 0, F.col("_a") / F.col("_b")).alias("ratio"))


def classify(df: DataFrame, domain: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """is_never, is_always of each key of the domain."""
    seen = merge(df, by).groupBy(*by).agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    rows = domain.select(*by).distinct().join(seen, list(by), "left")
    return rows.select(*by, F.col("n").isNull().alias("is_never"), F.coalesce((F.col("n") == 1) & (F.col("lo") <= NINF) & (F.col("hi") >= PINF), F.lit(False)).alias("is_always"))


def equal(a: DataFrame, b: DataFrame, by: Sequence[str] = KEY) -> bool:
    """Whether two sets hold the same moments for every key."""
    x, y = merge(a, by), merge(b, by)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()
