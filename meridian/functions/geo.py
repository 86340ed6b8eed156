"""Locations as latitude and longitude in degrees; distances in whole metres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000
#: Metres in each unit.
METRES = {"centimeter": 0.01, "meter": 1.0, "kilometer": 1000.0, "mile": 1609.34}


def haversine(alat: Column, alon: Column, blat: Column, blon: Column) -> Column:
    """Great-circle distance in whole metres, cut off; null if a coordinate is."""
    return _by_arc_sine(_half_chord(alat, alon, cosine(alat), blat, blon, cosine(blat)))


def cosine(lat: Column) -> Column:
    """What ``great_circle`` needs to know of each latitude."""
    return F.cos(F.radians(lat))


def great_circle(alat: Column, alon: Column, acos: Column, blat: Column, blon: Column, bcos: Column) -> Column:
    """``haversine`` for projections of very many pairs, whose latitudes' cosines are known.

    Java's arc sine takes most of the time of a pair. The arc tangent takes a sixth and differs by
    less than 1e-7 m, so the arc sine is only asked within 1e-6 m of a whole metre.
    """
    s = _half_chord(alat, alon, acos, blat, blon, bcos)
    near = F.lit(2.0 * EARTH_RADIUS_M) * F.atan(s / (F.sqrt((F.lit(1.0) - s) * (F.lit(1.0) + s)) + F.lit(1e-300)))  # never over 0
    return F.when(F.abs(near - F.floor(near) - F.lit(0.5)) < F.lit(0.5 - 1e-6), near.cast("bigint")).otherwise(_by_arc_sine(s))


def _half_chord(alat: Column, alon: Column, acos: Column, blat: Column, blon: Column, bcos: Column) -> Column:
    dlat, dlon = F.radians(blat - alat), F.radians(blon - alon)
    return F.sqrt(F.pow(F.sin(dlat / 2), 2.0) + acos * bcos * F.pow(F.sin(dlon / 2), 2.0))


def _by_arc_sine(half_chord: Column) -> Column:
    angle = F.nanvl(F.asin(half_chord), F.lit(math.pi / 2))  # rounding may bring it over 1; it is named once, so it is worked out once
    return (F.lit(2.0 * EARTH_RADIUS_M) * angle).cast("bigint")


def pythagorean(alat: Column, alon: Column, blat: Column, blon: Column) -> Column:
    """Plane distance in degrees."""
    return F.sqrt((alat - blat) * (alat - blat) + (alon - blon) * (alon - blon))


def travel_seconds(metres: Column, km_per_hour: float) -> Column:
    """Whole seconds that a distance takes at a speed, cut off."""
    return (F.lit(3600.0) * metres / F.lit(km_per_hour * 1000.0)).cast("bigint")


def to_unit(metres: Column, unit: str) -> Column:
    """Metres in another unit, cut off."""
    return (metres / F.lit(METRES[unit])).cast("bigint") if unit != "centimeter" else (metres * 100).cast("bigint")


def from_unit(n: Column, unit: str) -> Column:
    return (n * F.lit(METRES[unit])).cast("bigint")


def code(lat: Column, lon: Column) -> Column:
    return F.concat_ws(",", lat.cast("string"), lon.cast("string"))


def parse(text: Column) -> Column:
    """struct<lat, lon> from ``lat,lon``; null for ``anywhere`` and for other text."""
    parts = F.split(text, ",")
    lat, lon = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))
