"""Queries of step functions, range maps and interval maps, and of the row-level dataflow."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridian.functions import moment as M
from meridian.operators import flow, sets, steps
from meridian.plans.base import DAY, EV, JAN10, JAN20, coalesced, query, winning
from meridian.plans.q_sets import PT, _SCAN, ev, points
from meridian.sources import tables

C = F.col
#: Writes at whole hours, so that several fall on one instant.
LOGH = "lg AS (SELECT key, t - t % 3600000000 AS t, seq, type AS value FROM ev)"
LASTH = "la AS (SELECT key, t, arg_max(value, seq) AS value FROM lg GROUP BY key, t)"
DEFAULT = "none"


def hourly(s, d):
    return ev(s, d).select("key", (C("t") - C("t") % M.HOUR).alias("t"), "seq", C("type").alias("value"))


@query(f"WITH {EV}, {LOGH}, {LASTH} SELECT key, t, value FROM la")
def signal_put(s, d):
    return steps.latest(hourly(s, d)).drop("seq")


@query(f"WITH {EV}, {LOGH}, {LASTH} SELECT key, t, value FROM la WHERE t BETWEEN {JAN10} AND {JAN20}")
def signal_load(s, d):
    return steps.latest(hourly(s, d).where(C("t").between(JAN10, JAN20))).drop("seq")


@query(f"WITH {EV}, {PT} SELECT key, t, value FROM pt WHERE NOT (t >= {JAN10} AND t < {JAN20})")
def signal_remove(s, d):
    return steps.remove(points(s, d), JAN10, JAN20)


_ASK = "ask AS (SELECT key, seq, t + 7200000000 AS t FROM ev WHERE type = 'click')"


def asks(s, d):
    return ev(s, d, "click").select("key", "seq", (C("t") + 2 * M.HOUR).alias("t"))


@query(f"WITH {EV}, {PT}, {_ASK} SELECT a.key, a.seq, a.t, p.value FROM ask a ASOF LEFT JOIN pt p ON a.key = p.key AND a.t >= p.t")
def signal_asof(s, d):
    return steps.asof(asks(s, d), points(s, d), ["value"]).select("key", "seq", "t", "value")


@query(f"""WITH {EV}, {PT} SELECT key, t, value, lag(t) OVER w AS prev_t, lag(value) OVER w AS prev_value, lead(t) OVER w AS next_t, lead(value) OVER w AS next_value
 FROM pt WINDOW w AS (PARTITION BY key ORDER BY t)""")
def signal_nav(s, d):
    return steps.navigate(points(s, d))


@query(f"WITH {EV}, {PT}, {_SCAN} SELECT key, t, value, CAST(row_number() OVER (PARTITION BY key ORDER BY t) - 1 AS INTEGER) AS pos FROM sc")
def signal_range_scan(s, d):
    from pyspark.sql import Window

    rows = steps.scan(points(s, d), JAN10, JAN20, F.lit(DEFAULT))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy("t")) - 1)


@query(f"WITH {EV}, {PT}, {_SCAN} SELECT key, t, coalesce(lag(value) OVER (PARTITION BY key ORDER BY t), value) AS value FROM sc")
def signal_range_backward(s, d):
    return steps.scan(points(s, d), JAN10, JAN20, F.lit(DEFAULT), backward=True)


@query(f"WITH {EV}, {PT}, r AS (SELECT key, t AS lo, coalesce(lead(t) OVER (PARTITION BY key ORDER BY t), 1706745600000000) AS hi, value FROM pt) SELECT key, lo, hi, value FROM r")
def signal_ranges(s, d):
    return steps.ranges(points(s, d), end=F.lit(1706745600000000))


LOG = "lg AS (SELECT key, seq, lo, hi, CASE WHEN type <> 'error' THEN type END AS value FROM ev)"


def log(s, d):
    return ev(s, d).select("key", "seq", "lo", "hi", F.when(C("type") != "error", C("type")).alias("value"))


_DISJOINT = f"WITH {EV}, {LOG}, {winning('w', 'lg')}, {coalesced('c', 'w', 'value')}, r AS (SELECT key, lo, hi, value FROM c WHERE value IS NOT NULL)"


@query(f"{_DISJOINT} SELECT key, lo, hi, value FROM r")
def range_put_disjoint(s, d):
    return steps.put_disjoint(log(s, d), slice_us=DAY)


@query(f"WITH {EV}, {LOG}, {winning('w', 'lg')}, {coalesced('c', 'w', 'seq')} SELECT key, lo, hi, value FROM c")
def range_put_nonoverlap(s, d):
    return steps.put_nonoverlapping(log(s, d), slice_us=DAY)


@query(f"{_DISJOINT}, q AS (SELECT key, seq, t + 60000000 AS t FROM ev) SELECT q.key, q.seq, q.t, coalesce(r.value, 'none') AS value FROM q LEFT JOIN r ON r.key = q.key AND r.lo <= q.t AND q.t < r.hi")
def range_get(s, d):
    parts = steps.put_disjoint(log(s, d), slice_us=DAY)
    asked = ev(s, d).select("key", "seq", (C("t") + 60_000_000).alias("t"))
    found = steps.asof(asked, parts.select("key", C("lo").alias("t"), "hi", "value"), ["hi", "value"])
    return found.select("key", "seq", "t", F.when(C("hi") > C("t"), C("value")).otherwise(DEFAULT).alias("value"))


_WITH_DEFAULT = f"""k AS (SELECT DISTINCT key FROM ev), cl AS (SELECT key, greatest(lo, {JAN10}) AS lo, least(hi, {JAN20}) AS hi, value FROM r WHERE lo < {JAN20} AND hi > {JAN10}),
 al AS (SELECT key, lo, hi, value FROM cl UNION ALL SELECT key, hi, coalesce(lead(lo) OVER (PARTITION BY key ORDER BY lo), {JAN20}), 'none' FROM cl
 UNION ALL SELECT k.key, {JAN10}, coalesce((SELECT min(lo) FROM cl WHERE cl.key = k.key), {JAN20}), 'none' FROM k)"""


@query(f"{_DISJOINT}, {_WITH_DEFAULT} SELECT key, lo, hi, value FROM al WHERE lo < hi")
def range_scan(s, d):
    return steps.with_default(steps.put_disjoint(log(s, d), slice_us=DAY), ev(s, d), JAN10, JAN20, F.lit(DEFAULT))


@query(f"{_DISJOINT} SELECT key, lo, CASE WHEN hi <= {JAN10} THEN 'below' WHEN lo > {JAN10} THEN 'above' ELSE 'inside' END AS place FROM r")
def range_map_relation(s, d):
    place = F.when(C("hi") <= JAN10, "below").when(C("lo") > JAN10, "above").otherwise("inside")
    return steps.put_disjoint(log(s, d), slice_us=DAY).select("key", "lo", place.alias("place"))


@query(f"""WITH {EV}, {PT}, n AS (SELECT *, lag(value) OVER w AS p, lead(value) OVER w AS x FROM pt WINDOW w AS (PARTITION BY key ORDER BY t))
 SELECT key, t, value FROM n WHERE t >= {JAN10} AND t < {JAN20} AND p IS NOT NULL AND x = 'click' AND value <> 'error'""")
def signal_predicates(s, d):
    rows = steps.navigate(points(s, d))
    return rows.where((C("t") >= JAN10) & (C("t") < JAN20) & C("prev_t").isNotNull() & (C("next_value") == "click") & (C("value") != "error")).select("key", "t", "value")


@query(f"{_DISJOINT} SELECT key, lo, hi, value FROM r")
def imap_put(s, d):
    return steps.put_disjoint(log(s, d), slice_us=DAY)


@query(f"{_DISJOINT}, k AS (SELECT DISTINCT key FROM ev) SELECT k.key, r.lo, r.hi, coalesce(r.value, 'none') AS value FROM k LEFT JOIN r ON r.key = k.key AND r.lo <= {JAN10} AND r.hi > {JAN10}")
def imap_get(s, d):
    at = steps.put_disjoint(log(s, d), slice_us=DAY).where((C("lo") <= JAN10) & (C("hi") > JAN10))
    return ev(s, d).select("key").distinct().join(at, "key", "left").withColumn("value", F.coalesce("value", F.lit(DEFAULT)))


@query(f"{_DISJOINT}, {_WITH_DEFAULT} SELECT key, lo, hi, value FROM al WHERE lo < hi")
def imap_entries_window(s, d):
    return steps.with_default(steps.put_disjoint(log(s, d), slice_us=DAY), ev(s, d), JAN10, JAN20, F.lit(DEFAULT))


@query(f"""{_DISJOINT}, h AS (SELECT key, lo, hi, value FROM r WHERE value IN ('view', 'click')), h2 AS (SELECT key, lo, hi, 1 AS value FROM h),
 {coalesced('f', 'h2', 'value')} SELECT key, lo, hi FROM f""")
def imap_intervals(s, d):
    return sets.merge(steps.put_disjoint(log(s, d), slice_us=DAY).where(C("value").isin("view", "click")))


# --- dataflow -----------------------------------------------------------------------------------


@query(f"WITH {EV} SELECT seq, v FROM ev WHERE v > 50")
def flow_filter(s, d):
    return ev(s, d).where("v > 50").select("seq", "v")


@query(f"WITH {EV} SELECT seq, v * 2 AS doubled FROM ev")
def flow_map(s, d):
    return ev(s, d).select("seq", (C("v") * 2).alias("doubled"))


@query(f"WITH {EV} SELECT seq, unnest([lo, hi]) AS bound FROM ev")
def flow_flatmap(s, d):
    return ev(s, d).select("seq", F.explode(F.array("lo", "hi")).alias("bound"))


@query(f"WITH {EV}, n AS (SELECT key, t, lead(t) OVER (PARTITION BY key ORDER BY t) AS next_t FROM ev) SELECT key, t, next_t, next_t - t AS gap FROM n WHERE next_t IS NOT NULL")
def flow_pairwise(s, d):
    return flow.pairwise(ev(s, d).select("key", "t"), ["t"], ["t"]).withColumn("gap", C("next_t") - C("t"))


_RN = f"WITH {EV}, n AS (SELECT key, seq, row_number() OVER (PARTITION BY key ORDER BY t) AS n FROM ev)"


@query(f"{_RN} SELECT key, seq FROM n WHERE n <= 5")
def flow_limit(s, d):
    return flow.limit(ev(s, d), 5, ["t"]).select("key", "seq")


@query(f"{_RN} SELECT key, seq FROM n WHERE n > 5")
def flow_skip(s, d):
    return flow.skip(ev(s, d), 5, ["t"]).select("key", "seq")


_WHILE = f"WITH {EV}, n AS (SELECT key, seq, min(CASE WHEN v < 40 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY t ROWS UNBOUNDED PRECEDING) AS p FROM ev)"


@query(f"{_WHILE} SELECT key, seq FROM n WHERE p = 1")
def flow_takewhile(s, d):
    return flow.take_while(ev(s, d), C("v") < 40, ["t"]).select("key", "seq")


@query(f"{_WHILE} SELECT key, seq FROM n WHERE p = 0")
def flow_dropwhile(s, d):
    return flow.drop_while(ev(s, d), C("v") < 40, ["t"]).select("key", "seq")


@query(f"WITH {EV} SELECT key, min(t) AS t, arg_min(seq, t) AS seq FROM ev GROUP BY key")
def flow_first(s, d):
    return flow.first(ev(s, d).select("key", "t", "seq"), "t")


@query(f"WITH {EV} SELECT DISTINCT key, type FROM ev")
def flow_distinct(s, d):
    return ev(s, d).select("key", "type").distinct()


@query(f"WITH {EV} SELECT key, t, 'view' AS source FROM ev WHERE type = 'view' UNION ALL SELECT key, hi, 'click' FROM ev WHERE type = 'click'")
def flow_concat(s, d):
    views = ev(s, d, "view").select("key", "t", F.lit("view").alias("source"))
    return flow.concat(views, ev(s, d, "click").select("key", C("hi").alias("t"), F.lit("click").alias("source")))


@query(f"""WITH {EV}, h AS (SELECT key, t - t % 3600000000 AS t, CASE type WHEN 'view' THEN 0 ELSE 1 END AS n, seq FROM ev WHERE type IN ('view', 'click'))
 SELECT key, t, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY n, seq) AS said FROM h GROUP BY key, t""")
def flow_multiplex(s, d):
    hour = lambda kind: ev(s, d, kind).select("key", (C("t") - C("t") % M.HOUR).alias("t"), "seq")
    met = flow.multiplex("t", "seq", hour("view"), hour("click"))
    return met.select("key", "t", F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("said"))


@query("SELECT s_suppkey AS id, CAST(dense_rank() OVER (ORDER BY s_nationkey) - 1 AS INTEGER) AS index FROM supplier")
def flow_index(s, d):
    return flow.index(tables.locations(s, d).select("id", "nation"), "nation").select("id", C("index").cast("int").alias("index"))
