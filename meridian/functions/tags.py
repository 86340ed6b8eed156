"""Tags: ARRAY<STRUCT<name, value>>, value null for a bare name. Several values of a name are legal.

A null array counts as one without tags.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAGS = "array<struct<name:string,value:string>>"
_QUOTED = r'"((?:[^"\\]|\\.)*)"(:"((?:[^"\\]|\\.)*)")?'


def tag(name: Column | str, value: Column | str | None = None) -> Column:
    as_col = lambda x: F.lit(x) if x is None or isinstance(x, str) else x
    return F.struct(as_col(name).cast("string").alias("name"), as_col(value).cast("string").alias("value"))


def build(*tags: Column) -> Column:
    """A holder of the tags, in order, without repeated ones."""
    return F.array_distinct(F.array(*tags)).cast(TAGS)


def merge(a: Column, b: Column) -> Column:
    return F.array_distinct(F.concat(_of(a), _of(b)))


def _of(tags: Column) -> Column:
    return F.coalesce(tags, F.array().cast(TAGS))


def matches(t: Column, name: str, value: str | None = None) -> Column:
    """A tag against a query: a query without a value asks for the name only."""
    named = t["name"] == name
    return named if value is None else named & t["value"].eqNullSafe(F.lit(value))


def has(tags: Column, name: str, value: str | None = None) -> Column:
    """Whether exactly this tag is there."""
    return F.exists(_of(tags), lambda t: (t["name"] == name) & t["value"].eqNullSafe(F.lit(value)))


def any_of(tags: Column, *queries: tuple[str, str | None]) -> Column:
    if not queries:
        raise ValueError("at least one tag is needed")
    return F.exists(_of(tags), lambda t: _either([matches(t, *q) for q in queries]))


def all_of(tags: Column, *queries: tuple[str, str | None]) -> Column:
    if not queries:
        raise ValueError("at least one tag is needed")
    out = None
    for q in queries:
        one = any_of(tags, q)
        out = one if out is None else out & one
    return out


def none_of(tags: Column, *queries: tuple[str, str | None]) -> Column:
    return ~any_of(tags, *queries)


def _either(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def is_multiple(tags: Column, name: str) -> Column:
    return F.size(F.filter(_of(tags), lambda t: t["name"] == name)) > 1


def values(tags: Column, name: str) -> Column:
    found = F.filter(_of(tags), lambda t: (t["name"] == name) & t["value"].isNotNull())
    return F.transform(found, lambda t: t["value"])


def value(tags: Column, name: str, default: str | None = None) -> Column:
    return F.coalesce(F.get(values(tags, name), F.lit(0)), F.lit(default).cast("string"))


def quote(text: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(text, r'([\\"])', r"\\$1"), F.lit('"'))


def unquote(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(.)", "$1")


def format_tags(tags: Column) -> Column:
    each = F.transform(_of(tags), lambda t: F.concat(quote(t["name"]), F.coalesce(F.concat(F.lit(":"), quote(t["value"])), F.lit(""))))
    return F.concat(F.lit("["), F.array_join(each, ","), F.lit("]"))


def parse(text: Column) -> Column:
    """Tags from ``["name","name":"value"]``, repeated ones once."""
    found = F.regexp_extract_all(text, F.lit(_QUOTED), F.lit(0))
    name = lambda x: unquote(F.regexp_extract(x, _QUOTED, 1))
    val = lambda x: F.when(F.regexp_extract(x, _QUOTED, 2) != "", unquote(F.regexp_extract(x, _QUOTED, 3)))
    return F.array_distinct(F.transform(found, lambda x: F.struct(name(x).alias("name"), val(x).alias("value"))))
