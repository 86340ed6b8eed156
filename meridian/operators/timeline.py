"""Timelines: layers of intervals, presences and events, as edit logs.

An event layer's log has timeline, layer, seq, op (put or remove), lo, hi, tags. Reads apply the
whole log; nothing depends on the order of rows but on seq.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from meridian.functions.moment import DAY
from meridian.operators import joins, sets, steps

LAYER = ("timeline", "layer")
INTERVAL, PRESENCE, STRICT, OVERLAP, MERGE = "INTERVAL", "PRESENCE", "EVENT_STRICT", "EVENT_OVERLAP", "EVENT_MERGE"
#: What may be done with a layer of each kind.
ALLOWED = {INTERVAL: {"interval"}, PRESENCE: {"presence"}, STRICT: {"event"}, OVERLAP: {"event"}, MERGE: {"event"}}


def require(kind: str, what: str) -> None:
    if what not in ALLOWED[kind]:
        raise ValueError(f"a layer of kind {kind} holds no {what}")


def intervals(log: DataFrame, by: Sequence[str] = LAYER) -> DataFrame:
    """lo, hi of an interval layer after all puts and removes."""
    written = log.withColumn("value", F.col("op") == "put")
    return sets.merge(steps.winners(written, by).where("value"), by)


def conflicts(log: DataFrame, by: Sequence[str] = LAYER, slice_us: int = DAY) -> DataFrame:
    """seq, with_seq: puts of a strict layer that fall on an earlier event. There should be none.

    Only events of one time slice are compared; the bounds of events must be finite.
    """
    puts = log.where((F.col("op") == "put") & (F.col("lo") < F.col("hi"))).select(*by, "seq", "lo", "hi")
    met = joins.overlapping(puts, puts, by, slice_us).where(F.col("b_seq") < F.col("seq"))
    return met.select(*by, "seq", F.col("b_seq").alias("with_seq"))


def merge_layer(log: DataFrame, by: Sequence[str] = LAYER, slice_us: int | None = None) -> DataFrame:
    """lo, hi, tags: a later event overwrites what it covers; touching ones of equal tags are one."""
    written = log.withColumn("value", F.when(F.col("op") == "put", F.col("tags")))
    return steps.put_disjoint(written, by, slice_us).withColumnRenamed("value", "tags")


def lanes(log: DataFrame, by: Sequence[str] = LAYER) -> DataFrame:
    """lane, lo, hi, tag: an overlap layer's puts in the first lane that is free, in order of seq.

    First fit depends on the order of writing, so a layer's log is folded in one task. tag: the
    event's tags as text; touching events of equal tags in a lane are one.
    """
    schema = log.select(*by, F.lit(0).alias("lane"), "lo", "hi", F.col("tag")).schema

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        key = [group[c].iloc[0] for c in by]
        rows = [(*key, n, lo, hi, tag) for n, lane in enumerate(first_fit(group.sort_values("seq"))) for lo, hi, tag in lane]
        return pd.DataFrame(rows, columns=[*by, "lane", "lo", "hi", "tag"])

    return log.select(*by, "seq", "op", "lo", "hi", "tag").groupBy(*by).applyInPandas(fold, schema)


def first_fit(log: pd.DataFrame) -> list[list[tuple]]:
    """Lanes of (lo, hi, tag) after a log in order."""
    placed: list[list[tuple]] = []
    for op, lo, hi, tag in zip(log["op"], log["lo"], log["hi"], log["tag"]):
        if op == "remove":
            placed = [left for lane in placed if (left := [p for e in lane for p in ((e[0], min(e[1], lo), e[2]), (max(e[0], hi), e[1], e[2])) if p[0] < p[1]])]
            continue
        lane = next((x for x in placed if not any(a < hi and lo < b for a, b, _ in x)), None)
        if lane is None:
            lane = []
            placed.append(lane)
        lane.append((lo, hi, tag))
        lane.sort()
        fused: list[tuple] = []
        for e in lane:
            if fused and fused[-1][1] == e[0] and fused[-1][2] == e[2]:
                fused[-1] = (fused[-1][0], e[1], e[2])
            else:
                fused.append(e)
        lane[:] = fused
    return placed


def strict_clashes(log: DataFrame, by: Sequence[str] = LAYER, slice_us: int = DAY) -> DataFrame:
    """``conflicts`` as of the time of writing: a put on time that was removed from the earlier event is none."""
    puts = log.where((F.col("op") == "put") & (F.col("lo") < F.col("hi"))).select(*by, "seq", "lo", "hi")
    pair = [*by, "seq", "with_seq"]
    shared = joins.overlapping(puts, puts, by, slice_us).where(F.col("b_seq") < F.col("seq"))
    shared = shared.select(*by, "seq", F.col("b_seq").alias("with_seq"), F.greatest("lo", "b_lo").alias("lo"), F.least("hi", "b_hi").alias("hi"))
    removes = log.where((F.col("op") == "remove") & (F.col("lo") < F.col("hi"))).select(*by, "seq", "lo", "hi")
    cleared = joins.overlapping(shared, removes, by, slice_us).where((F.col("b_seq") > F.col("with_seq")) & (F.col("b_seq") < F.col("seq")))
    cleared = cleared.select(*pair, F.greatest("lo", "b_lo").alias("lo"), F.least("hi", "b_hi").alias("hi"))
    length = sets.merge(cleared, pair).groupBy(*pair).agg(F.sum(F.col("hi") - F.col("lo")).alias("_cleared"))
    left = shared.join(length, pair, "left").where(F.coalesce("_cleared", F.lit(0)) < F.col("hi") - F.col("lo"))
    return left.select(*pair)


def presences(log: DataFrame, by: Sequence[str] = LAYER, slice_us: int = DAY) -> DataFrame:
    """lo (the moment), lat, lon, tags of a presence layer: the last put at each moment that no later remove covers."""
    puts = steps.latest(log.where("op = 'put'").select(*by, F.col("lo").alias("t"), "seq", "lat", "lon", "tags"), by)
    at = puts.select(*by, "seq", F.col("t").alias("lo"), (F.col("t") + 1).alias("hi"))
    removes = log.where((F.col("op") == "remove") & (F.col("lo") < F.col("hi"))).select(*by, "seq", "lo", "hi")
    gone = joins.overlapping(at, removes, by, slice_us).where(F.col("b_seq") > F.col("seq")).select(*by, "seq").distinct()
    return puts.join(gone, [*by, "seq"], "left_anti").withColumnRenamed("t", "lo").drop("seq")


def build(layers: DataFrame, log: DataFrame, slice_us: int = DAY) -> DataFrame:
    """What each layer of each timeline holds after all that was written to it, by the layer's kind.

    layers: timeline, layer, kind (one row each). log: timeline, layer, seq, op, what (interval,
    presence or event), lo, hi (finite; a put presence's moment is lo), lat, lon, tags. Returns
    timeline, layer, kind, lane (of overlap layers), lo, hi (null for presences), lat, lon, tags.

    Raises as the plan runs: at a layer defined twice, a write to one that is not defined or of a
    kind that holds no such thing, and an event put on another of a strict layer.
    """
    defined = layers.groupBy(*LAYER).agg(F.first("kind").alias("kind"), F.count("*").alias("_n"))
    written = log.join(defined, [*LAYER], "left")
    holds = F.coalesce(*(F.when(F.col("kind") == k, F.col("what").isin(*what)) for k, what in ALLOWED.items()), F.lit(False))
    of = lambda kind: written.where(F.col("kind") == kind).drop("kind", "what", "_n")
    tags = log.schema["tags"].dataType
    none = lambda rows, why: rows.groupBy().count().select(F.assert_true(F.col("count") == 0, F.lit(why)).alias("_ok"))
    checks = [
        none(defined.where("_n > 1"), "a layer is defined twice"),
        none(written.where(~holds), "a layer that is not defined, or holds no such thing"),
        none(strict_clashes(of(STRICT), slice_us=slice_us), "an event on another of a strict layer"),
    ]
    said = of(OVERLAP).withColumn("tag", F.to_json(F.struct("tags")))
    read = F.from_json("tag", StructType([StructField("tags", tags)]))["tags"]
    parts = {
        INTERVAL: intervals(of(INTERVAL)),
        PRESENCE: presences(of(PRESENCE), slice_us=slice_us),
        STRICT: merge_layer(of(STRICT), LAYER, slice_us),
        OVERLAP: lanes(said).withColumn("tags", read),
        MERGE: merge_layer(of(MERGE), LAYER, slice_us),
    }
    types = {"lane": "int", "lo": "bigint", "hi": "bigint", "lat": "double", "lon": "double", "tags": tags}
    out = None
    for kind, rows in parts.items():
        shaped = rows.select(*LAYER, F.lit(kind).alias("kind"), *((F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()))
        out = shaped if out is None else out.unionByName(shaped)
    for check in checks:  # one row each
        out = out.crossJoin(F.broadcast(check)).where("_ok IS NULL").drop("_ok")
    return out


def removed(events: DataFrame, lo: int, hi: int) -> DataFrame:
    """Events without what lies in [lo, hi); one that reaches over it is split."""
    pieces = F.array(
        F.struct(F.col("lo").alias("lo"), F.least("hi", F.lit(lo)).alias("hi")),
        F.struct(F.greatest("lo", F.lit(hi)).alias("lo"), F.col("hi").alias("hi")),
    )
    rest = [c for c in events.columns if c not in ("lo", "hi")]
    kept = F.filter(pieces, lambda p: p["lo"] < p["hi"])
    return events.select(*rest, F.explode(kept).alias("p")).select(*rest, "p.lo", "p.hi")


def select_events(events: DataFrame, lo: int, hi: int, by: Sequence[str] = LAYER, backward: bool = False, tie: str = "seq") -> DataFrame:
    """Events clipped to [lo, hi) with pos: by start, or from the last end back."""
    clipped = sets.window(events, lo, hi)
    order = [F.desc("hi"), F.desc("lo")] if backward else [F.asc("lo"), F.asc("hi")]
    return clipped.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(*order, tie)) - 1)


def busy(events: DataFrame, by: Sequence[str] = LAYER) -> DataFrame:
    """When a layer has any event."""
    return sets.merge(events, by)


def free(windows: DataFrame, events: DataFrame, by: Sequence[str] = LAYER, slice_us: int = DAY) -> DataFrame:
    """Those windows (key columns, lo, hi) in which a layer has no event.

    Only windows and events of one time slice are compared; bounds must be finite.
    """
    own = [*by, "lo", "hi"]
    rows = events.where(F.col("lo") < F.col("hi")).select(*own)
    met = joins.overlapping(windows.where(F.col("lo") < F.col("hi")).select(*own).distinct(), rows, by, slice_us)
    return windows.join(met.select(*own).distinct(), own, "left_anti")


def add_layer(layers: DataFrame, timeline: str, layer: str, kind: str, tags=None) -> DataFrame:
    """layers (timeline, layer, kind, tags) with one more; raises as the plan runs if the id is taken."""
    from meridian.functions import tags as T

    if kind not in ALLOWED:
        raise ValueError(f"there is no kind of layer {kind}")
    new = layers.sparkSession.range(1).select(F.lit(timeline).alias("timeline"), F.lit(layer).alias("layer"), F.lit(kind).alias("kind"), (tags if tags is not None else F.array()).cast(T.TAGS).alias("tags"))
    both = layers.unionByName(new)
    n = F.count("*").over(Window.partitionBy("timeline", "layer"))
    return both.withColumn("_n", n).where(F.assert_true(F.col("_n") == 1, "the layer's id is taken").isNull()).drop("_n")


def remove_layer(rows: DataFrame, timeline: str, layer: str) -> DataFrame:
    """Layers, or a log, without those of one layer."""
    return rows.where(~((F.col("timeline") == timeline) & (F.col("layer") == layer)))


def duplicate_layer(rows: DataFrame, timeline: str, layer: str, as_layer: str) -> DataFrame:
    """Layers, or a log, with those of one layer once more under another id."""
    own = rows.where((F.col("timeline") == timeline) & (F.col("layer") == layer))
    return rows.unionByName(own.withColumn("layer", F.lit(as_layer)))


def find_layers(layers: DataFrame, *wanted: tuple[str, str | None]) -> DataFrame:
    """Layers that have exactly all of the wanted tags. layers: timeline, layer, kind, tags."""
    from meridian.functions import tags as T

    for name, value in wanted:
        layers = layers.where(T.has(F.col("tags"), name, value))
    return layers
