"""Text forms of whole sets and of presences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.functions import geo
from meridian.functions import interval as I
from meridian.functions import moment as M
from meridian.functions import tags as T


def format_set(merged: DataFrame, by: Sequence[str] = ("key",), domain: DataFrame | None = None) -> DataFrame:
    """text: a key's intervals in order, ``∅`` for a key of the domain without any."""
    each = F.sort_array(F.collect_list(F.struct("lo", F.struct(I.format_interval(F.col("lo"), F.col("hi")).alias("x")).alias("s"))))
    said = merged.groupBy(*by).agg(F.array_join(F.transform(each, lambda e: e["s"]["x"]), ",").alias("text"))
    if domain is None:
        return said
    return domain.select(*by).distinct().join(said, list(by), "left").withColumn("text", F.coalesce("text", F.lit("∅")))


def format_presence(t: Column, lat: Column, lon: Column, tags: Column | None = None) -> Column:
    """``lat,lon@moment`` or ``anywhere@moment``, then the tags if there are any."""
    place = F.when(lat.isNull(), F.lit("anywhere")).otherwise(geo.code(lat, lon))
    text = F.concat(place, F.lit("@"), M.format_moment(t))
    return text if tags is None else F.when(F.size(tags) > 0, F.concat(text, F.lit(" "), T.format_tags(tags))).otherwise(text)


def parse_presence(text: Column) -> Column:
    """struct<t, lat, lon, tags>; null if the text isn't a presence."""
    halves = F.split(text, "@", 2)
    place, rest = F.get(halves, F.lit(0)), F.get(halves, F.lit(1))
    t = M.parse(F.substring_index(rest, " ", 1))
    at = geo.parse(place)
    known = (at.isNotNull() | (place == "anywhere")) & t.isNotNull()
    return F.when(known, F.struct(t.alias("t"), at["lat"].alias("lat"), at["lon"].alias("lon"), T.parse(F.regexp_extract(rest, r" (\[.*\])$", 1)).alias("tags")))
