"""Presences: where a track was at an instant; key columns, t, lat, lon (both null: anywhere)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions import geo
from meridian.operators.steps import latest

TRACK = ("track",)


def load(log: DataFrame, by: Sequence[str] = TRACK, seq: str = "seq") -> DataFrame:
    """One presence for each track and instant, the last written one."""
    return latest(log, by, "t", seq)


def window(presences: DataFrame, lo: int, hi: int, domain: DataFrame, by: Sequence[str] = TRACK) -> DataFrame:
    """Presences strictly inside (lo, hi), and one at each edge.

    At the lower edge the track is where it last was at or before it, at the upper edge where it
    will next be at or after it; anywhere if that is unknown.
    """
    inner = presences.where((F.col("t") > lo) & (F.col("t") < hi)).select(*by, "t", "lat", "lon")
    place = F.struct("lat", "lon")
    floor = presences.where(F.col("t") <= lo).groupBy(*by).agg(F.max_by(place, "t").alias("low"))
    ceiling = presences.where(F.col("t") >= hi).groupBy(*by).agg(F.min_by(place, "t").alias("high"))
    keys = domain.select(*by).distinct().join(floor, list(by), "left").join(ceiling, list(by), "left")
    edge = lambda t, p: F.struct(F.lit(t).alias("t"), F.col(f"{p}.lat").alias("lat"), F.col(f"{p}.lon").alias("lon"))
    edges = keys.select(*by, F.explode(F.array(edge(lo, "low"), edge(hi, "high"))).alias("e")).select(*by, "e.*")
    return inner.unionByName(edges)


def movements(presences: DataFrame, by: Sequence[str] = TRACK) -> DataFrame:
    """Each presence and the next one of its track: from_t, from_lat, from_lon, to_t, to_lat, to_lon."""
    order = Window.partitionBy(*by).orderBy("t")
    ends = {f"to_{c}": F.lead(c).over(order) for c in ("t", "lat", "lon")}
    rows = presences.select(*by, "t", "lat", "lon").withColumns(ends).where("to_t is not null")
    return rows.select(*by, F.col("t").alias("from_t"), F.col("lat").alias("from_lat"), F.col("lon").alias("from_lon"), "to_t", "to_lat", "to_lon")


def metres(moves: DataFrame) -> Column:
    """Great-circle metres of each movement; 0 if either end is anywhere."""
    return F.coalesce(geo.haversine(F.col("from_lat"), F.col("from_lon"), F.col("to_lat"), F.col("to_lon")), F.lit(0).cast("bigint"))


def tracks(moves: DataFrame) -> DataFrame:
    """Movements with their distance and duration."""
    return moves.withColumn("distance_m", metres(moves)).withColumn("duration_us", F.col("to_t") - F.col("from_t"))
