"""Step functions: change points that hold until the next one, and range maps with edit logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.operators.sets import KEY

# --- change points: key columns, t, value ------------------------------------------------------


def latest(log: DataFrame, by: Sequence[str] = KEY, at: str = "t", seq: str = "seq") -> DataFrame:
    """One row for each key and instant: the last written one."""
    rest = [c for c in log.columns if c not in (*by, at)]
    picked = F.max_by(F.struct(*rest), seq)
    return log.groupBy(*by, at).agg(picked.alias("_row")).select(*by, at, "_row.*")


def compact(points: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """Without points that repeat the value before them."""
    before = F.lag("value").over(Window.partitionBy(*by).orderBy("t"))
    first = F.lag("t").over(Window.partitionBy(*by).orderBy("t")).isNull()
    return points.withColumn("_same", ~first & before.eqNullSafe(F.col("value"))).where(~F.col("_same")).drop("_same")


def remove(points: DataFrame, lo: int, hi: int, lower_inclusive: bool = True, upper_inclusive: bool = False) -> DataFrame:
    low = F.col("t") >= lo if lower_inclusive else F.col("t") > lo
    high = F.col("t") <= hi if upper_inclusive else F.col("t") < hi
    return points.where(~(low & high))


def asof(queries: DataFrame, facts: DataFrame, payload: Sequence[str], by: Sequence[str] = KEY, how: str = "floor", slice_us: int | None = None) -> DataFrame:
    """Each query row (key columns, t, more) with ``found_t`` and the payload of the fact next to it.

    how: floor (at or before t), lower (before), ceiling (at or after), higher (after). One union,
    one shuffle, one sort; facts have one row for each key and t.

    slice_us: look within time slices of this width first, so that a key with very many rows is
    spread over tasks; where a slice has no such fact, the nearest slice's outermost one is it.
    """
    if slice_us:
        return _asof_sliced(queries, facts, payload, by, how, slice_us)
    back, ties_first = how in ("floor", "lower"), how in ("floor", "ceiling")
    rest = [c for c in queries.columns if c not in (*by, "t")]
    packed = F.struct(F.col("t").alias("found_t"), *payload)
    asked = queries.select(*by, "t", F.lit(1).alias("_ask"), F.struct(F.lit(0).alias("_"), *rest).alias("_q"), F.lit(None).cast(_type(facts, payload)).alias("_f"))
    known = facts.select(*by, "t", F.lit(0).alias("_ask"), F.lit(None).cast(asked.schema["_q"].dataType).alias("_q"), packed.alias("_f"))
    order = [F.asc("t") if back else F.desc("t"), F.asc("_ask") if ties_first else F.desc("_ask")]
    near = F.last("_f", ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = asked.unionByName(known).withColumn("_near", near).where(F.col("_ask") == 1)
    return rows.select(*by, "t", *[F.col(f"_q.{c}").alias(c) for c in rest], "_near.found_t", *[F.col(f"_near.{c}").alias(c) for c in payload])


def _asof_sliced(queries: DataFrame, facts: DataFrame, payload: Sequence[str], by: Sequence[str], how: str, slice_us: int) -> DataFrame:
    back, within = how in ("floor", "lower"), [*by, "_slice"]
    of = F.floor(F.col("t") / slice_us)
    near = asof(queries.withColumn("_slice", of), facts.withColumn("_slice", of), payload, within, how)
    outer = (F.max_by if back else F.min_by)(F.struct(F.col("t").alias("found_t"), *payload), "t")
    edges = facts.groupBy(*by, of.alias("t")).agg(outer.alias("_edge"))
    asked = near.where("found_t is null").select(*by, F.col("_slice").alias("t")).distinct()
    carried = asof(asked, edges, ["_edge"], by, "lower" if back else "higher").select(*by, F.col("t").alias("_slice"), "_edge")
    rest = [c for c in near.columns if c not in ("_slice", "found_t", *payload)]
    rows = near.join(carried, within, "left")
    return rows.select(*rest, *[F.coalesce(F.when(F.col("found_t").isNotNull(), F.col(c)), F.when(F.col("found_t").isNull(), F.col(f"_edge.{c}"))).alias(c) for c in ("found_t", *payload)])


def _type(facts: DataFrame, payload: Sequence[str]):
    return facts.select(F.struct(F.col("t").alias("found_t"), *payload).alias("f")).schema["f"].dataType


def navigate(points: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """With previous and next key and value, and whether a point is its series' first or last."""
    order = Window.partitionBy(*by).orderBy("t")
    return points.withColumns(
        {
            "prev_t": F.lag("t").over(order),
            "prev_value": F.lag("value").over(order),
            "next_t": F.lead("t").over(order),
            "next_value": F.lead("value").over(order),
        }
    )


def scan(points: DataFrame, lo: int, hi: int, default: Column, by: Sequence[str] = KEY, backward: bool = False) -> DataFrame:
    """Points strictly between lo and hi, and both edges with the value in force there.

    Backward, a point carries the value that holds below it, as seen when walking down.
    """
    inner = points.where((F.col("t") > lo) & (F.col("t") < hi)).select(*by, "t", "value")
    floor = points.where(F.col("t") <= lo).groupBy(*by).agg(F.max_by("value", "t").alias("low"))
    last = points.where(F.col("t") <= hi).groupBy(*by).agg(F.max_by("value", "t").alias("high"))
    keys = points.select(*by).distinct().join(floor, list(by), "left").join(last, list(by), "left")
    edges = keys.select(*by, F.explode(F.array(F.struct(F.lit(lo).alias("t"), F.coalesce("low", default).alias("value")), F.struct(F.lit(hi).alias("t"), F.coalesce("high", default).alias("value")))).alias("e")).select(*by, "e.t", "e.value")
    rows = inner.unionByName(edges)
    if not backward:
        return rows
    below = F.lag("value").over(Window.partitionBy(*by).orderBy("t"))
    return rows.withColumn("value", F.coalesce(below, F.when(F.col("t") == lo, F.col("value"))))


def expand(points: DataFrame, moments: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """The points, and at each asked moment one more with the value in force (none before the first)."""
    asked = moments.select(*by, "t", F.lit(None).cast(points.schema["value"].dataType).alias("value"))
    both = points.select(*by, "t", "value").unionByName(asked).groupBy(*by, "t").agg(F.max("value").alias("value"))
    held = F.last("value", ignorenulls=True).over(Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("value", held)


def ranges(points: DataFrame, by: Sequence[str] = KEY, end: Column | None = None) -> DataFrame:
    """lo, hi, value: each point's value until the next point (until ``end`` for the last)."""
    hi = F.lead("t").over(Window.partitionBy(*by).orderBy("t"))
    rows = points.select(*by, F.col("t").alias("lo"), (F.coalesce(hi, end) if end is not None else hi).alias("hi"), "value")
    return rows.where(F.col("hi").isNotNull() & (F.col("lo") < F.col("hi")))


# --- range maps: edit log with key columns, seq, lo, hi, value ----------------------------------


def winners(log: DataFrame, by: Sequence[str] = KEY, slice_us: int | None = None) -> DataFrame:
    """lo, hi, value, seq: for each part of time, the last written range that covers it.

    Time is cut at every bound of the key; a part's winner is the covering row of greatest seq.
    slice_us: cut at multiples of this width too and look for winners within a slice, so the
    work grows with what overlaps, not with the square of a key's rows; bounds must be finite.
    """
    rows = log.where(F.col("lo") < F.col("hi")).select(*by, "seq", "lo", "hi", "value")
    within = list(by)
    if slice_us:
        n = F.sequence(F.floor(F.col("lo") / slice_us), F.floor((F.col("hi") - 1) / slice_us))
        cut = rows.withColumn("_slice", F.explode(n))
        rows = cut.withColumns({"lo": F.greatest(F.col("lo"), F.col("_slice") * slice_us), "hi": F.least(F.col("hi"), (F.col("_slice") + 1) * slice_us)})
        within.append("_slice")
    points = rows.select(*within, F.explode(F.array("lo", "hi")).alias("lo")).distinct()
    parts = points.withColumn("hi", F.lead("lo").over(Window.partitionBy(*within).orderBy("lo"))).where("hi is not null")
    covering = rows.select(*within, F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "seq", "value")
    pairs = parts.join(covering, within).where((F.col("_lo") <= F.col("lo")) & (F.col("_hi") >= F.col("hi")))
    best = pairs.groupBy(*within, "lo", "hi").agg(F.max_by(F.struct("value", "seq"), "seq").alias("w"))
    return best.select(*by, "lo", "hi", "w.value", "w.seq")


def joined(parts: DataFrame, same: Sequence[str], by: Sequence[str] = KEY) -> DataFrame:
    """Touching parts whose ``same`` columns are equal made one."""
    order = Window.partitionBy(*by).orderBy("lo")
    alike = F.lag("hi").over(order).eqNullSafe(F.col("lo"))
    for c in same:
        alike = alike & F.lag(c).over(order).eqNullSafe(F.col(c))
    marked = parts.withColumn("_opens", F.when(alike, 0).otherwise(1)).withColumn("_run", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rest = [F.first(c).alias(c) for c in parts.columns if c not in (*by, "lo", "hi")]
    return marked.groupBy(*by, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), *rest).drop("_run")


def put_disjoint(log: DataFrame, by: Sequence[str] = KEY, slice_us: int | None = None) -> DataFrame:
    """lo, hi, value after all writes, equal neighbours made one. A null value writes the default, which has no row."""
    return joined(winners(log, by, slice_us).drop("seq"), ["value"], by).where("value is not null")


def put_nonoverlapping(log: DataFrame, by: Sequence[str] = KEY, slice_us: int | None = None) -> DataFrame:
    """lo, hi, value after all writes; bounds stay where two writes meet, even of equal value."""
    return joined(winners(log, by, slice_us), ["seq"], by).drop("seq")


def with_default(parts: DataFrame, domain: DataFrame, lo: int, hi: int, default: Column, by: Sequence[str] = KEY) -> DataFrame:
    """Parts clipped to [lo, hi), and the default's rows between them, touching ones of it made one."""
    inside = parts.where((F.col("lo") < hi) & (F.col("hi") > lo)).select(*by, F.greatest("lo", F.lit(lo)).alias("lo"), F.least("hi", F.lit(hi)).alias("hi"), "value")
    order = Window.partitionBy(*by).orderBy("lo")
    gaps = inside.select(*by, F.col("hi").alias("lo"), F.coalesce(F.lead("lo").over(order), F.lit(hi)).alias("hi"), default.alias("value"))
    heads = domain.select(*by).distinct().join(inside.groupBy(*by).agg(F.min("lo").alias("hi")), list(by), "left")
    heads = heads.select(*by, F.lit(lo).alias("lo"), F.coalesce("hi", F.lit(hi)).alias("hi"), default.alias("value"))
    return inside.unionByName(gaps).unionByName(heads).where("lo < hi")
