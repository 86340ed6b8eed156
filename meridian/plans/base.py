"""Registration of queries, and SQL texts that the oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NINF, PINF = -(1 << 62), 1 << 62
#: 2024-01-10 and 2024-01-20, midnight UTC.
JAN10, JAN20 = 1704844800000000, 1705708800000000
HOUR, DAY = 3_600_000_000, 86_400_000_000


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


EV = """ev AS (SELECT user_id AS key, event_id AS seq, event_type AS type, value AS v, props, epoch_us(ts) AS t, epoch_us(ts) AS lo,
  epoch_us(ts) + (CAST(floor(value * 60) AS BIGINT) + 1) * 1000000 AS hi FROM events)"""
SHIP = """ship AS (SELECT o_custkey AS key, l_orderkey AS "order", l_linenumber AS line, epoch_us(o_orderdate) AS lo, epoch_us(l_shipdate) AS hi
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate < l_shipdate)"""
PRES = """pres AS (SELECT user_id AS track, event_id AS seq, epoch_us(ts) AS t, (event_id * 37 % 1700) / 10.0::DOUBLE - 85.0::DOUBLE AS lat,
  (event_id * 91 % 3600) / 10.0::DOUBLE - 180.0::DOUBLE AS lon FROM events)"""
LOC = """loc AS (SELECT s_suppkey AS id, s_nationkey AS nation, (s_suppkey * 37 % 1700) / 10.0::DOUBLE - 85.0::DOUBLE AS lat,
  (s_suppkey * 91 % 3600) / 10.0::DOUBLE - 180.0::DOUBLE AS lon FROM supplier)"""


def merged(name: str, source: str, by: str = "key") -> str:
    """CTEs that end in ``name``: the source's intervals merged."""
    return f"""{name}_a AS (SELECT {by}, lo, hi, max(hi) OVER (PARTITION BY {by} ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM {source} q),
{name}_b AS (SELECT *, sum(CASE WHEN p IS NULL OR lo > p THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM {name}_a),
{name} AS (SELECT {by}, min(lo) AS lo, max(hi) AS hi FROM {name}_b GROUP BY {by}, g)"""


def covered(name: str, source: str) -> str:
    """CTEs that end in ``name``: elementary segments with cnt, the operands that cover each."""
    return f"""{name}_p AS (SELECT key, lo AS t FROM {source} UNION SELECT key, hi FROM {source}),
{name}_s AS (SELECT key, t AS lo, lead(t) OVER (PARTITION BY key ORDER BY t) AS hi FROM {name}_p),
{name} AS (SELECT s.key, s.lo, s.hi, count(DISTINCT x.operand) AS cnt FROM {name}_s s LEFT JOIN {source} x ON x.key = s.key AND x.lo <= s.lo AND x.hi >= s.hi
  WHERE s.hi IS NOT NULL GROUP BY s.key, s.lo, s.hi)"""


def winning(name: str, source: str, by: str = "key") -> str:
    """CTEs that end in ``name``: elementary segments with value and seq of the last write that covers each."""
    on = " AND ".join(f"x.{c} = s.{c}" for c in by.split(", "))
    return f"""{name}_p AS (SELECT {by}, lo AS t FROM {source} UNION SELECT {by}, hi FROM {source}),
{name}_s AS (SELECT {by}, t AS lo, lead(t) OVER (PARTITION BY {by} ORDER BY t) AS hi FROM {name}_p),
{name} AS (SELECT {", ".join("s." + c for c in by.split(", "))}, s.lo, s.hi, arg_max(struct_pack(v := x.value), x.seq).v AS value, max(x.seq) AS seq FROM {name}_s s JOIN {source} x ON {on} AND x.lo <= s.lo AND x.hi >= s.hi
  GROUP BY ALL)"""


def coalesced(name: str, source: str, same: str, by: str = "key") -> str:
    """CTEs that end in ``name``: touching segments of equal ``same`` made one (with value)."""
    return f"""{name}_a AS (SELECT *, CASE WHEN lag(hi) OVER w = lo AND lag({same}) OVER w IS NOT DISTINCT FROM {same} THEN 0 ELSE 1 END AS o FROM {source} WINDOW w AS (PARTITION BY {by} ORDER BY lo)),
{name}_b AS (SELECT *, sum(o) OVER (PARTITION BY {by} ORDER BY lo ROWS UNBOUNDED PRECEDING) AS g FROM {name}_a),
{name} AS (SELECT {by}, min(lo) AS lo, max(hi) AS hi, any_value(value) AS value FROM {name}_b GROUP BY {by}, g)"""
