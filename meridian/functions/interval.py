"""Half-open intervals [lo, hi) of moments, as pairs of Columns or as struct<lo, hi>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meridian.functions import moment as M
from meridian.functions.moment import NINF, PINF

BEFORE, STARTS, ENDS, AFTER = "ALIGN_BEFORE", "ALIGN_STARTS", "ALIGN_ENDS", "ALIGN_AFTER"


def interval(lo: Column, hi: Column) -> Column:
    """struct<lo, hi>; raises unless lo < hi."""
    return F.when(F.assert_true(lo < hi, "lower must be before upper").isNull(), _pair(lo, hi))


def try_interval(lo: Column, hi: Column) -> Column:
    """struct<lo, hi>, null unless lo < hi."""
    return F.when(lo < hi, _pair(lo, hi))


def _pair(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"))


def always() -> Column:
    return _pair(M.ninf(), M.pinf())


def half(at: Column, forward: Column) -> Column:
    """[at, inf) if forward, else (-inf, at)."""
    return F.when(forward, _pair(at, M.pinf())).otherwise(_pair(M.ninf(), at))


def with_length(at: Column, duration: Column) -> Column:
    """From ``at`` for a duration; a negative one ends there. Null for none."""
    end = M.shift(at, duration)
    return try_interval(F.least(at, end), F.greatest(at, end))


def bounds(lo: Column, hi: Column) -> Column:
    return F.array(lo, hi)


def in_zone(lo: Column, hi: Column, zone: str) -> Column:
    """Both bounds as local times of a zone, for reading."""
    return F.struct(M.in_zone(lo, zone).alias("lo"), M.in_zone(hi, zone).alias("hi"))


def is_bounded(lo: Column, hi: Column) -> Column:
    return (lo > NINF) & (hi < PINF)


def duration(lo: Column, hi: Column) -> Column:
    """hi - lo, null for unbounded ones."""
    return F.when(is_bounded(lo, hi), hi - lo)


def kind(lo: Column, hi: Column) -> Column:
    return (
        F.when((lo <= NINF) & (hi >= PINF), "always")
        .when(lo <= NINF, "to")
        .when(hi >= PINF, "from")
        .otherwise("bounded")
    )


def contains(lo: Column, hi: Column, t: Column) -> Column:
    """Whether t is inside; one without an upper bound holds the infinite end too, unless it is always."""
    return (lo <= t) & ((t < hi) | ((hi >= PINF) & (lo > NINF) & (t >= PINF)))


def position(lo: Column, hi: Column, t: Column, before: Column, inside: Column, after: Column) -> Column:
    """One of three values by where the interval lies relative to a moment."""
    return F.when(lo > t, after).when(contains(lo, hi, t), inside).otherwise(before)


def encloses(alo: Column, ahi: Column, blo: Column, bhi: Column) -> Column:
    return (alo <= blo) & (ahi >= bhi)


def fits(lo: Column, hi: Column, length: Column) -> Column:
    """Whether a duration fits; always if unbounded."""
    return F.when(is_bounded(lo, hi), hi - lo >= length).otherwise(True)


def span(alo: Column, ahi: Column, blo: Column, bhi: Column) -> Column:
    return _pair(F.least(alo, blo), F.greatest(ahi, bhi))


def intersect(alo: Column, ahi: Column, blo: Column, bhi: Column) -> Column:
    return try_interval(F.greatest(alo, blo), F.least(ahi, bhi))


def union(alo: Column, ahi: Column, blo: Column, bhi: Column) -> Column:
    """One interval if the two meet or overlap, else both in order."""
    joined = F.array(_pair(F.least(alo, blo), F.greatest(ahi, bhi)))
    return F.when((alo <= bhi) & (blo <= ahi), joined).otherwise(F.sort_array(F.array(_pair(alo, ahi), _pair(blo, bhi))))


def complement(lo: Column, hi: Column) -> Column:
    """Up to two intervals."""
    return F.filter(F.array(_pair(M.ninf(), lo), _pair(hi, M.pinf())), lambda x: x["lo"] < x["hi"])


def shift(lo: Column, hi: Column, by: Column) -> Column:
    return _pair(M.shift(lo, by), M.shift(hi, by))


def with_lower(lo: Column, hi: Column, to: Column) -> Column:
    return interval(to, hi)


def with_upper(lo: Column, hi: Column, to: Column) -> Column:
    return interval(lo, to)


def try_align(lo: Column, hi: Column, length: Column, alignment: Column) -> Column:
    """An interval of a length placed at a bound; null if that bound is infinite."""
    anchor = F.when(alignment.isin(BEFORE, STARTS), lo).otherwise(hi)
    start = F.when(alignment.isin(BEFORE, ENDS), anchor - length).otherwise(anchor)
    return F.when(M.is_finite(anchor), try_interval(start, start + length))


def align(lo: Column, hi: Column, length: Column, alignment: Column) -> Column:
    made = try_align(lo, hi, length, alignment)
    return F.when(F.assert_true(made.isNotNull(), "the bound to align with is infinite").isNull(), made)


def steps(lo: Column, hi: Column, step: Column) -> Column:
    """Array of the moments lo, lo + step, ... before hi."""
    return F.sequence(lo, hi - 1, step)


# --- text -----------------------------------------------------------------------------------


def format_interval(lo: Column, hi: Column) -> Column:
    return F.concat(F.lit("["), M.format_moment(lo), F.lit(".."), M.format_moment(hi), F.lit(")"))


def parse(text: Column) -> Column:
    """struct<lo, hi> from ``[lower..upper)``; null if it isn't one."""
    inner = F.regexp_extract(text, r"(?s)^[\[(](.{3,})\)$", 1)
    halves = F.split(inner, r"\.\.")
    lo, hi = M.parse(F.get(halves, F.lit(0))), M.parse(F.get(halves, F.lit(1)))
    made = try_interval(lo, hi)
    return F.when(text.isin("always", "[-∞..∞)"), always()).when(F.size(halves) == 2, made)


# --- calendars ------------------------------------------------------------------------------


def _local(t: Column, zone: str) -> Column:
    return F.from_utc_timestamp(F.timestamp_micros(t), zone)


def _utc(local: Column, zone: str) -> Column:
    return F.unix_micros(F.to_utc_timestamp(local, zone))


def day(t: Column, zone: str) -> Column:
    """The zone's calendar day that holds a moment, with its true length on days of clock changes."""
    midnight = F.date_trunc("day", _local(t, zone))
    return _pair(_utc(midnight, zone), _utc(midnight + F.expr("interval 1 day"), zone))


def day_by_offset(t: Column, zone: str) -> Column:
    """The day by the offset in force at the moment itself, end by that of a day later.

    Differs from ``day`` just before and after a clock change; both bounds fall on the same local
    date only then, and the end moves a day on.
    """
    at, later = _local(t, zone), _local(t + M.DAY, zone)
    lo = t - (F.unix_micros(at) - F.unix_micros(F.date_trunc("day", at)))
    end = t + M.DAY - (F.unix_micros(later) - F.unix_micros(F.date_trunc("day", later)))
    return _pair(lo, F.when(F.to_date(at) == F.to_date(later), end + M.DAY).otherwise(end))


def days(lo: Column, hi: Column, zone: str, crop: bool = False) -> Column:
    """Array of the zone's days from that of lo to that of hi (its end), cut to [lo, hi) if asked."""
    first, last = F.to_date(_local(lo, zone)), F.to_date(_local(hi, zone))
    starts = F.sequence(first, last, F.expr("interval 1 day"))
    each = F.transform(starts, lambda d: _pair(_utc(d.cast("timestamp"), zone), _utc(F.date_add(d, 1).cast("timestamp"), zone)))
    return _cropped(each, lo, hi) if crop else each


def daily(lo: Column, hi: Column, start: int, end: int, zone: str, crop: bool = False) -> Column:
    """Each day's slot from ``start`` to ``end`` (elapsed since local midnight); over midnight if end < start."""
    stop = end if end > start else end + M.DAY
    if start == end:
        return days(lo, hi, zone, crop)
    each = F.transform(days(lo, hi, zone), lambda d: _pair(d["lo"] + start, d["lo"] + stop))
    return _cropped(each, lo, hi) if crop else each


def _cropped(each: Column, lo: Column, hi: Column) -> Column:
    cut = F.transform(each, lambda d: _pair(F.greatest(d["lo"], lo), F.least(d["hi"], hi)))
    return F.filter(cut, lambda d: d["lo"] < d["hi"])
