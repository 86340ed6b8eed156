"""First-fit scheduling of several steps, for all queries at once.

steps: query_id, step (from 0), dur, step_lo, step_hi, locked, center, win_lo, win_hi.
availability: query_id, step, lo, hi; overlaps are merged.

Steps are placed one after another: each in the first place within the query's window, the
step's window and its availability, after the end of the step before, that its duration fits.
A locked step takes its whole window if that lies after what is placed. A failed step fails all
that follow. If a step is centered, the steps before it are then moved as late as they can be,
within their own windows and availability, but not within the query's window. A duration of zero
succeeds without a place. A step that can't be moved fails the query.

The number of steps is small and known to the driver. A query is one row with its availability
for each step as an array, so all steps are placed after one shuffle by query_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.functions.moment import NINF, PINF
from meridian.operators import sets

FIELDS = ("dur", "step_lo", "step_hi", "locked", "center")


def validate(steps: DataFrame) -> DataFrame:
    """query_id, problem of each query that can't be asked: there should be none."""
    flagged = F.sum((F.col("locked") | F.col("center")).cast("int"))
    tight = F.max(F.col("locked") & (F.col("step_lo") > NINF) & (F.col("step_hi") < PINF) & (F.col("step_hi") - F.col("step_lo") < F.col("dur")))
    found = steps.groupBy("query_id").agg(flagged.alias("n"), tight.alias("tight"))
    problem = F.when(F.col("n") > 1, "more than one locked or centered step").when(F.col("tight"), "a locked step's window is shorter than its duration")
    return found.select("query_id", problem.alias("problem")).where("problem is not null")


def place(steps: DataFrame, availability: DataFrame, count: int) -> DataFrame:
    """query_id, step, success, lo, hi of every step; lo and hi are null for an empty place.

    count: the number of steps of the longest query.
    """
    state = _centered(_forward(_wide(steps, count).join(_offered(availability, count), "query_id", "left"), count), count)
    each = F.array(*(F.struct(F.lit(k).alias("step"), F.col(f"has_{k}").alias("has"), F.col(f"ok_{k}").alias("ok"), F.col(f"lo_{k}").alias("lo"), F.col(f"hi_{k}").alias("hi")) for k in range(count)))
    rows = state.select("query_id", F.col("broken").alias("broken"), F.explode(each).alias("s")).where("s.has")
    ok = F.col("s.ok") & ~F.col("broken")
    return rows.select("query_id", "s.step", ok.alias("success"), F.when(ok, F.col("s.lo")).alias("lo"), F.when(ok, F.col("s.hi")).alias("hi"))


def results(placed: DataFrame) -> DataFrame:
    """query_id, success, and its places in order if all steps succeeded (else none)."""
    rows = placed.groupBy("query_id").agg(F.min("success").alias("success"), F.sort_array(F.collect_list(F.struct("step", "lo", "hi"))).alias("places"))
    return rows.select("query_id", "success", F.when(F.col("success"), F.col("places")).otherwise(F.slice("places", 1, 0)).alias("places"))


def _offered(availability: DataFrame, count: int) -> DataFrame:
    """A row for each query with its steps' merged availability side by side, as arrays."""
    spot = F.struct("lo", "hi")
    each = [F.collect_list(F.when(F.col("step") == k, spot)).alias(f"av_{k}") for k in range(count)]
    return sets.merge(availability, ["query_id", "step"]).groupBy("query_id").agg(*each)


def _wide(steps: DataFrame, count: int) -> DataFrame:
    """A row for each query with its steps' fields side by side."""
    wide = [F.max(F.when(F.col("step") == k, F.struct(*FIELDS))).alias(f"s_{k}") for k in range(count)]
    rows = steps.groupBy("query_id").agg(F.max("win_lo").alias("win_lo"), F.max("win_hi").alias("win_hi"), *wide)
    return rows.withColumns({"ptr": F.col("win_lo"), "failed": F.lit(False)})


def _fitting(state: DataFrame, k: int, lo: Column, hi: Column, backward: bool) -> DataFrame:
    """state with _at: the first start (the last end) of step k's availability in [lo, hi) that fits."""
    dur = F.col(f"s_{k}.dur")
    bounded = state.withColumns({"_from": lo, "_to": hi})
    clipped = F.transform(f"av_{k}", lambda a: F.struct(F.greatest(F.col("_from"), a["lo"]).alias("lo"), F.least(F.col("_to"), a["hi"]).alias("hi")))

    def fits(a: Column) -> Column:
        anchor = a["hi"] if backward else a["lo"]
        return (a["lo"] < a["hi"]) & ((a["lo"] <= NINF) | (a["hi"] >= PINF) | (a["hi"] - a["lo"] >= dur)) & (anchor > NINF) & (anchor < PINF)

    spots = F.transform(F.filter(clipped, fits), lambda a: a["hi"] if backward else a["lo"])
    return bounded.withColumn("_at", (F.array_max if backward else F.array_min)(spots)).drop("_from", "_to")


def _forward(state: DataFrame, count: int) -> DataFrame:
    for k in range(count):
        s = F.col(f"s_{k}")
        lo, hi = F.greatest("win_lo", "ptr", s["step_lo"]), F.least(F.col("win_hi"), s["step_hi"])
        state = _fitting(state, k, lo, hi, False)
        has, at = s.isNotNull(), F.col("_at")
        free = s["locked"] & ((F.col("ptr") <= s["step_lo"]) | (F.col("ptr") <= NINF))
        ok = has & ~F.col("failed") & F.when(s["locked"], free).otherwise((s["dur"] == 0) | at.isNotNull())
        placed_lo = F.when(s["locked"], s["step_lo"]).when(s["dur"] > 0, at)
        placed_hi = F.when(s["locked"], s["step_hi"]).when(s["dur"] > 0, at + s["dur"])
        state = state.withColumns({f"has_{k}": has, f"ok_{k}": ok}).withColumns({f"lo_{k}": F.when(F.col(f"ok_{k}"), placed_lo), f"hi_{k}": F.when(F.col(f"ok_{k}"), placed_hi)})
        bounded = F.col(f"lo_{k}").isNotNull() & (F.col(f"lo_{k}") > NINF) & (F.col(f"hi_{k}") < PINF)
        state = state.withColumns({"ptr": F.when(bounded, F.col(f"hi_{k}")).otherwise(F.col("ptr")), "failed": F.col("failed") | (has & ~F.col(f"ok_{k}"))}).drop("_at")
    return state


def _centered(state: DataFrame, count: int) -> DataFrame:
    state = state.withColumns({"limit": F.lit(None).cast("bigint"), "broken": F.lit(False)})
    for k in range(count - 1, -1, -1):
        s, limit = F.col(f"s_{k}"), F.col("limit")
        hi = F.when(limit >= s["step_hi"], s["step_hi"]).otherwise(limit)
        state = _fitting(state, k, s["step_lo"], hi, True)
        there = F.col(f"has_{k}") & ~F.col("failed") & F.col(f"lo_{k}").isNotNull()
        moves = there & ~s["center"] & limit.isNotNull() & (s["dur"] > 0)
        reachable = (limit >= s["step_hi"]) | (limit > s["step_lo"])
        lost = moves & ~(F.coalesce(reachable, F.lit(False)) & F.col("_at").isNotNull())
        to_lo, to_hi = F.col("_at") - s["dur"], F.col("_at")
        state = state.withColumns({"_moves": F.coalesce(moves & ~lost, F.lit(False)), "broken": F.col("broken") | F.coalesce(lost, F.lit(False)), "_there": F.coalesce(there, F.lit(False))})
        state = state.withColumns({f"lo_{k}": F.when(F.col("_moves"), to_lo).otherwise(F.col(f"lo_{k}")), f"hi_{k}": F.when(F.col("_moves"), to_hi).otherwise(F.col(f"hi_{k}"))})
        starts = F.col("_there") & (s["center"] | limit.isNotNull())
        state = state.withColumn("limit", F.when(starts, F.col(f"lo_{k}")).otherwise(limit)).drop("_at", "_moves", "_there")
    return state
