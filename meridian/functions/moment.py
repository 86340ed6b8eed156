"""Moments as whole microseconds since the epoch, with two infinite ones.

Every function takes and returns Columns. Bounds are BIGINT; NINF and PINF stand for the
infinite moments, lie outside of any timestamp, and absorb shifts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NINF = -(1 << 62)
PINF = 1 << 62
SECOND = 1_000_000
MINUTE, HOUR, DAY = 60 * SECOND, 3600 * SECOND, 86400 * SECOND

#: Texts of the infinite moments.
INFINITE_TEXTS = ["inf", "infinite", "+inf", "+infinite", "∞", "+∞"]
NEGATIVE_INFINITE_TEXTS = ["ninf", "-infinite", "-inf", "-∞"]


def ninf() -> Column:
    return F.lit(NINF)


def pinf() -> Column:
    return F.lit(PINF)


def now() -> Column:
    """The moment at which the query runs, one for all rows."""
    return F.unix_micros(F.current_timestamp())


def strict(parsed: Column, text: Column) -> Column:
    """A parsed value; raises where a text that isn't null could not be parsed."""
    bad = F.concat(F.lit("unable to parse: "), F.coalesce(text, F.lit("")))
    return F.when(parsed.isNotNull() | text.isNull(), parsed).otherwise(F.raise_error(bad))


def from_timestamp(ts: Column) -> Column:
    """A timestamp, with or without zone (then UTC), as a moment."""
    return F.unix_micros(ts.cast("timestamp"))


def to_timestamp(t: Column) -> Column:
    """A finite moment as a timestamp, null for infinite ones."""
    return F.when(is_finite(t), F.timestamp_micros(t))


def is_finite(t: Column) -> Column:
    return (t > NINF) & (t < PINF)


def is_infinite(t: Column) -> Column:
    return ~is_finite(t)


def shift(t: Column, by: Column) -> Column:
    return F.when(is_finite(t), t + by).otherwise(t)


def clamp(t: Column, lower: Column, upper: Column) -> Column:
    """``t`` pulled into [lower, upper]; raises unless lower < upper."""
    return F.when(F.assert_true(lower < upper, "lower must be before upper").isNull(), F.greatest(lower, F.least(upper, t)))


def negate(t: Column) -> Column:
    """The opposite infinite moment."""
    return F.when(is_infinite(t), -t)


def between(t: Column, start: Column, start_inclusive: bool, end: Column, end_inclusive: bool) -> Column:
    low = t >= start if start_inclusive else t > start
    high = t <= end if end_inclusive else t < end
    return F.when(F.assert_true(start < end, "start must be before end").isNull(), low & high)


def kind(t: Column) -> Column:
    return F.when(t <= NINF, "negative infinite").when(t >= PINF, "positive infinite").otherwise("finite")


def in_zone(t: Column, zone: str) -> Column:
    """The local time in a zone, as text; infinite moments as their signs."""
    local = F.date_format(F.from_utc_timestamp(F.timestamp_micros(F.when(is_finite(t), t)), zone), "yyyy-MM-dd HH:mm:ss")
    return F.when(t >= PINF, "∞").when(t <= NINF, "-∞").otherwise(local)


def format_moment(t: Column) -> Column:
    text = F.date_format(F.timestamp_micros(F.when(is_finite(t), t)), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(t >= PINF, "∞").when(t <= NINF, "-∞").otherwise(F.concat(text, F.lit("Z")))


def parse(text: Column) -> Column:
    """A moment from text: an infinite sign or an ISO date and time with offset; null if neither."""
    token = F.trim(text)
    iso = token.rlike(r"^[+-]?\d{4,}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2}(:?\d{2})?)$")
    seconds = F.regexp_replace(token, r"T(\d{2}:\d{2})(?=Z|[+-])", "T$1:00")  # may be left out
    finite = F.unix_micros(F.try_to_timestamp(F.when(iso, seconds)))
    return F.when(token.isin(INFINITE_TEXTS), PINF).when(token.isin(NEGATIVE_INFINITE_TEXTS), NINF).otherwise(finite)
