"""Queries of scheduling, containers, tags, timelines and JSON forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meridian.functions import tags as T
from meridian.operators import container, schedule, sets, steps, timeline
from meridian.plans.base import DAY, EV, HOUR, JAN10, JAN20, LOC, NINF, PINF, PRES, coalesced, covered, merged, query, winning
from meridian.plans.q_presence import HAVERSINE
from meridian.plans.q_sets import ev
from meridian.sources import json_forms as J
from meridian.sources import tables

C = F.col
JAN15 = 1705276800000000
HALF = HOUR // 2

# --- scheduling ---------------------------------------------------------------------------------

_FREE = f"""{merged('m', 'ev')}, u AS (SELECT DISTINCT key FROM ev),
 fr AS (SELECT key, {NINF} AS lo, min(lo) AS hi FROM m GROUP BY key UNION ALL SELECT key, hi, coalesce(lead(lo) OVER (PARTITION BY key ORDER BY lo), {PINF}) FROM m)"""


def _step(n, before, dur, lo=JAN10, hi=JAN20):
    """A CTE f<n>: the first fit after the CTE ``before`` (its hi), as key, lo, hi."""
    start = f"greatest(fr.lo, {lo}, b.hi)" if before else f"greatest(fr.lo, {lo})"
    join = f"JOIN {before} b ON b.key = fr.key" if before else ""
    return f"f{n} AS (SELECT fr.key, min({start}) AS lo, min({start}) + {dur} AS hi FROM fr {join} WHERE least(fr.hi, {hi}) - {start} >= {dur} GROUP BY fr.key)"


def _late(n, after, dur):
    """A CTE g<n>: the last fit before the CTE ``after`` (its lo)."""
    return f"g{n} AS (SELECT fr.key, max(least(fr.hi, a.lo)) - {dur} AS lo, max(least(fr.hi, a.lo)) AS hi FROM fr JOIN {after} a ON a.key = fr.key WHERE least(fr.hi, a.lo) - fr.lo >= {dur} GROUP BY fr.key)"


def _rows(*ctes):
    parts = [f"SELECT u.key AS query_id, {k} AS step, x.lo IS NOT NULL AS success, x.lo, x.hi FROM u LEFT JOIN {c} x ON x.key = u.key" for k, c in enumerate(ctes)]
    return " UNION ALL ".join(parts)


def plan(s, d, *asked):
    """A query for each user; asked: (dur, lo, hi, locked, center) of each step. Users are free when no event lasts."""
    users = ev(s, d).select(C("key").alias("query_id")).distinct()
    each = F.array(*(F.struct(F.lit(k).alias("step"), F.lit(dur).cast("bigint").alias("dur"), F.lit(lo).cast("bigint").alias("step_lo"), F.lit(hi).cast("bigint").alias("step_hi"), F.lit(lock).alias("locked"), F.lit(mid).alias("center")) for k, (dur, lo, hi, lock, mid) in enumerate(asked)))
    wanted = users.select("query_id", F.explode(each).alias("s")).select("query_id", "s.*", F.lit(JAN10).alias("win_lo"), F.lit(JAN20).alias("win_hi"))
    free = sets.not_(ev(s, d), ev(s, d)).withColumnRenamed("key", "query_id")
    offered = free.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(len(asked) - 1))))
    return schedule.place(wanted, offered, len(asked))


def free(dur, lo=NINF, hi=PINF, locked=False, center=False):
    return dur, lo, hi, locked, center


@query(f"WITH {EV}, {_FREE}, {_step(0, '', HALF)}, {_step(1, 'f0', HOUR)}, {_step(2, 'f1', HALF)} {_rows('f0', 'f1', 'f2')}")
def sched_sequence(s, d):
    return plan(s, d, free(HALF), free(HOUR), free(HALF))


@query(f"""WITH {EV}, {_FREE}, {_step(0, '', HALF)}, f1 AS (SELECT key, {JAN15} AS lo, {JAN15 + HOUR} AS hi FROM f0 WHERE hi <= {JAN15}), {_step(2, 'f1', HALF)} {_rows('f0', 'f1', 'f2')}""")
def sched_locked(s, d):
    return plan(s, d, free(HALF), free(HOUR, JAN15, JAN15 + HOUR, locked=True), free(HALF))


@query(f"""WITH {EV}, {_FREE}, {_step(0, '', HALF)}, {_step(1, 'f0', HOUR)}, {_step(2, 'f1', HALF, lo=JAN15)}, {_late(1, 'f2', HOUR)}, {_late(0, 'g1', HALF)} {_rows('g0', 'g1', 'f2')}""")
def sched_center(s, d):
    """The flagship: each user's three appointments around a fixed week, the first two as late as can be."""
    return plan(s, d, free(HALF), free(HOUR), free(HALF, JAN15, PINF, center=True))


@query(f"""WITH {EV}, {_FREE}, {_step(0, '', HALF)}, {_step(1, 'f0', 30 * HOUR)}, {_step(2, 'f1', 40 * HOUR)}
 SELECT u.key AS query_id, f2.lo IS NOT NULL AS success, CAST(CASE WHEN f2.lo IS NOT NULL THEN 3 ELSE 0 END AS INTEGER) AS n, f2.hi AS ends FROM u LEFT JOIN f2 USING (key)""")
def sched_results(s, d):
    found = schedule.results(plan(s, d, free(HALF), free(30 * HOUR), free(40 * HOUR)))
    return found.select("query_id", "success", F.size("places").alias("n"), F.get("places", F.lit(2))["hi"].alias("ends"))


# --- containers ---------------------------------------------------------------------------------


def container_rows(s, d):
    tags = (
        F.when(C("type").isin("view", "click"), T.build(T.tag("availability")))
        .when(C("type") == "purchase", T.build(T.tag("window")))
        .when(C("type") == "error", T.build(T.tag("global", "absence")))
        .otherwise(F.array().cast(T.TAGS))
    )
    return ev(s, d).select(C("key").alias("container"), C("type").alias("id"), tags.alias("tags"), "lo", "hi")


def tagged(*q):
    return container.collections(T.any_of(C("tags"), *q))


_OP = "op AS (SELECT key, type AS operand, lo, hi FROM ev WHERE type IN ('view', 'click'))"
_SEG = f"{_OP}, {covered('cv', 'op')}"


def _out(cte):
    return f"SELECT key AS container, lo, hi FROM {cte}"


_VIEWS = "(SELECT key, lo, hi FROM ev WHERE type = 'view')"


@query(f"WITH {EV}, {merged('r', _VIEWS)} {_out('r')}")
def container_get(s, d):
    return container.get(container_rows(s, d), "view")


@query(f"""WITH {EV}, {_SEG}, n AS (SELECT key, count(DISTINCT operand) AS n FROM op GROUP BY key), {merged('r', '(SELECT cv.key, lo, hi FROM cv JOIN n USING (key) WHERE cnt = n)')} {_out('r')}""")
def container_and(s, d):
    return container.combine(container_rows(s, d), container.and_(tagged(("availability", None)).else_empty()))


@query(f"WITH {EV}, {_OP}, {merged('r', 'op')} {_out('r')}")
def container_or(s, d):
    return container.combine(container_rows(s, d), container.or_(tagged(("availability", None)).else_empty()))


_NOT = """k AS (SELECT DISTINCT key FROM ev), nt AS (SELECT k.key, {ninf} AS lo, coalesce(min(m.lo), {pinf}) AS hi FROM k LEFT JOIN m ON m.key = k.key GROUP BY k.key
 UNION ALL SELECT key, hi, coalesce(lead(lo) OVER (PARTITION BY key ORDER BY lo), {pinf}) FROM m)""".format(ninf=NINF, pinf=PINF)


@query(f"WITH {EV}, {_OP}, {merged('m', 'op')}, {_NOT} SELECT key AS container, lo, hi FROM nt WHERE lo < hi")
def container_not(s, d):
    return container.combine(container_rows(s, d), container.not_(tagged(("availability", None)).else_empty()))


_CONTAINER = f"""{merged('av', "(SELECT key, lo, hi FROM ev WHERE type IN ('view', 'click'))")}, {merged('wi', "(SELECT key, lo, hi FROM ev WHERE type = 'purchase')")},
 {merged('ab', "(SELECT key, lo, hi FROM ev WHERE type = 'error')")}, p AS (SELECT key, lo AS t FROM av UNION SELECT key, hi FROM av UNION SELECT key, lo FROM wi UNION SELECT key, hi FROM wi UNION SELECT key, lo FROM ab UNION SELECT key, hi FROM ab),
 sg AS (SELECT key, t AS lo, lead(t) OVER (PARTITION BY key ORDER BY t) AS hi FROM p), ok AS (SELECT key, lo, hi FROM sg WHERE hi IS NOT NULL
  AND EXISTS (SELECT 1 FROM av x WHERE x.key = sg.key AND x.lo <= sg.lo AND x.hi >= sg.hi) AND EXISTS (SELECT 1 FROM wi x WHERE x.key = sg.key AND x.lo <= sg.lo AND x.hi >= sg.hi)
  AND NOT EXISTS (SELECT 1 FROM ab x WHERE x.key = sg.key AND x.lo <= sg.lo AND x.hi >= sg.hi)), {merged('r', 'ok')}"""


@query(f"WITH {EV}, {_CONTAINER} {_out('r')}")
def container_combine(s, d):
    free_time = container.and_(container.or_(tagged(("availability", None)).else_empty()), tagged(("window", None)).else_empty())
    return container.combine(container_rows(s, d), free_time, container.not_(tagged(("global", None), ("absence", None)).else_empty()))


@query(f"WITH {EV}, {merged('r', _VIEWS)} {_out('r')}")
def container_fallback(s, d):
    wanted = container.and_(container.collections(container.by_id("view")).else_empty(), tagged(("holiday", None)).else_always())
    return container.combine(container_rows(s, d), wanted)


# --- tags ---------------------------------------------------------------------------------------


def orders(s, d):
    return tables.tagged_orders(s, d)


_TG = "tg AS (SELECT o_orderkey AS id, o_orderpriority AS p, o_orderstatus AS st, CASE WHEN o_totalprice > 250000 THEN 'large' ELSE o_orderstatus END AS st2 FROM orders)"


def _tag_query(name, sql, make):
    @query(f"WITH {_TG} SELECT id, {sql} FROM tg", name=name)
    def run(s, d):
        return orders(s, d).select("id", *make(C("tags")))


_tag_query("tag_match", "true AS named, st = 'F' OR st2 = 'F' AS valued, false AS other", lambda t: [T.any_of(t, ("status", None)).alias("named"), T.any_of(t, ("status", "F")).alias("valued"), T.any_of(t, ("1-URGENT", "x")).alias("other")])
_tag_query("tag_has", "p = '1-URGENT' AS urgent, st = 'F' OR st2 = 'F' AS done, false AS bare", lambda t: [T.has(t, "1-URGENT").alias("urgent"), T.has(t, "status", "F").alias("done"), T.has(t, "status").alias("bare")])
_tag_query("tag_any", "p = '1-URGENT' OR st = 'O' OR st2 = 'O' AS hit", lambda t: [T.any_of(t, ("1-URGENT", None), ("status", "O")).alias("hit")])
_tag_query("tag_all", "p = '1-URGENT' AND (st = 'O' OR st2 = 'O') AS hit", lambda t: [T.all_of(t, ("1-URGENT", None), ("status", "O")).alias("hit")])
_tag_query("tag_none", "NOT (p = '1-URGENT' OR st = 'O' OR st2 = 'O') AS hit", lambda t: [T.none_of(t, ("1-URGENT", None), ("status", "O")).alias("hit")])
_tag_query("tag_multiple", "st <> st2 AS multiple", lambda t: [T.is_multiple(t, "status").alias("multiple")])
_tag_query("tag_value", "st AS status, 'none' AS missing", lambda t: [T.value(t, "status").alias("status"), T.value(t, "colour", "none").alias("missing")])
_tag_query("tag_values", "CASE WHEN st = st2 THEN st ELSE st || ',' || st2 END AS listed", lambda t: [F.array_join(T.values(t, "status"), ",").alias("listed")])
_tag_query("tag_predicate", "(p = '1-URGENT' OR p = '2-HIGH') AND NOT (st = 'F' OR st2 = 'F') AS hit", lambda t: [(T.any_of(t, ("1-URGENT", None), ("2-HIGH", None)) & T.none_of(t, ("status", "F"))).alias("hit")])
_tag_query("tag_build", "CAST(CASE WHEN st = st2 THEN 2 ELSE 3 END AS INTEGER) AS n", lambda t: [F.size(t).alias("n")])
_tag_query("parse_tags", "CAST(CASE WHEN st = st2 THEN 2 ELSE 3 END AS INTEGER) AS n, p AS first", lambda t: [F.size(T.parse(T.format_tags(t))).alias("n"), F.get(T.parse(T.format_tags(t)), F.lit(0))["name"].alias("first")])

# --- timelines ----------------------------------------------------------------------------------

_TL = "tl AS (SELECT key, type AS layer, seq, CASE WHEN v > 60 THEN 'remove' ELSE 'put' END AS op, lo, hi, CASE WHEN v > 20 THEN 'long' ELSE 'short' END AS tag FROM ev)"


def log(s, d):
    op, tag = F.when(C("v") > 60, "remove").otherwise("put"), F.when(C("v") > 20, "long").otherwise("short")
    return ev(s, d).select(C("key").alias("timeline"), C("type").alias("layer"), "seq", op.alias("op"), "lo", "hi", tag.alias("tag"))


def events_of(s, d):
    return log(s, d).where("op = 'put'")


_BY = "key, layer"


@query(f"""WITH {EV}, {_TL}, lg AS (SELECT key, layer, seq, lo, hi, op AS value FROM tl), {winning('w', 'lg', _BY)},
 {merged('r', "(SELECT key, layer, lo, hi FROM w WHERE value = 'put')", _BY)} SELECT key AS timeline, layer, lo, hi FROM r""")
def tl_interval(s, d):
    return timeline.intervals(log(s, d))


@query(f"WITH {PRES}, h AS (SELECT track, t - t % {HOUR} AS t, arg_max(seq, seq) AS seq, arg_max(lat, seq) AS lat, arg_max(lon, seq) AS lon FROM pres GROUP BY 1, 2) SELECT track AS timeline, t, lat, lon FROM h WHERE NOT (t >= {JAN10} AND t < {JAN20})")
def tl_presence(s, d):
    rows = tables.presences(s, d).select(C("track").alias("timeline"), (C("t") - C("t") % HOUR).alias("t"), "seq", "lat", "lon")
    return steps.remove(steps.latest(rows, ["timeline"]).drop("seq"), JAN10, JAN20)


@query(f"WITH {EV}, {_TL} SELECT a.key AS timeline, a.layer, a.seq, b.seq AS with_seq FROM tl a JOIN tl b ON a.key = b.key AND a.layer = b.layer AND b.seq < a.seq AND b.lo < a.hi AND a.lo < b.hi WHERE a.op = 'put' AND b.op = 'put'")
def tl_strict_conflicts(s, d):
    return timeline.conflicts(log(s, d))


_MERGE = f"lg AS (SELECT key, seq, lo, hi, CASE WHEN op = 'put' THEN tag END AS value FROM tl), {winning('w', 'lg')}, {coalesced('c', 'w', 'value')}"


@query(f"WITH {EV}, {_TL}, {_MERGE} SELECT key AS timeline, lo, hi, value AS tags FROM c WHERE value IS NOT NULL")
def tl_merge(s, d):
    return timeline.merge_layer(log(s, d).withColumnRenamed("tag", "tags"), ["timeline"], DAY)


#: The kind of each type's layer in a built timeline.
_KINDS = {"view": timeline.INTERVAL, "click": timeline.MERGE, "purchase": timeline.OVERLAP, "error": timeline.PRESENCE}
_KIND = "CASE layer " + " ".join(f"WHEN '{t}' THEN '{k}'" for t, k in _KINDS.items()) + f" ELSE '{timeline.STRICT}' END"
#: A strict layer's events are made disjoint: the last of each day, for twelve hours from midnight.
_HALF = DAY // 2


@query(f"""WITH {EV}, {_TL}, dl AS (SELECT key, layer, {_KIND} AS kind, seq, op, lo, hi, tag FROM tl),
 lg AS (SELECT key, layer, seq, lo, hi, op || CASE WHEN kind = '{timeline.MERGE}' THEN tag ELSE '' END AS value FROM dl WHERE kind IN ('{timeline.INTERVAL}', '{timeline.MERGE}')), {winning('w', 'lg', _BY)}, {coalesced('c', 'w', 'value', _BY)},
 p AS (SELECT key, layer, lo AS t FROM dl WHERE kind = '{timeline.OVERLAP}' UNION SELECT key, layer, hi FROM dl WHERE kind = '{timeline.OVERLAP}'),
 sg AS (SELECT key, layer, t AS lo, lead(t) OVER (PARTITION BY key, layer ORDER BY t) AS hi FROM p),
 o AS (SELECT x.key, x.layer, s.lo, s.hi FROM dl x JOIN sg s ON s.key = x.key AND s.layer = x.layer AND x.lo <= s.lo AND s.hi <= x.hi WHERE x.op = 'put'
  AND NOT EXISTS (SELECT 1 FROM dl r WHERE r.op = 'remove' AND r.key = x.key AND r.layer = x.layer AND r.seq > x.seq AND r.lo <= s.lo AND s.hi <= r.hi)),
 pr AS (SELECT DISTINCT key, layer, lo, NULL::BIGINT AS hi FROM dl x WHERE kind = '{timeline.PRESENCE}' AND op = 'put'
  AND NOT EXISTS (SELECT 1 FROM dl r WHERE r.op = 'remove' AND r.key = x.key AND r.layer = x.layer AND r.seq > x.seq AND r.lo <= x.lo AND x.lo < r.hi)),
 st AS (SELECT key, layer, lo - lo % {DAY} AS lo, lo - lo % {DAY} + {_HALF} AS hi, arg_max(op, seq) AS op FROM dl WHERE kind = '{timeline.STRICT}' GROUP BY ALL),
 every AS (SELECT key, layer, lo, hi FROM c WHERE value LIKE 'put%' UNION ALL SELECT key, layer, lo, hi FROM o UNION ALL SELECT key, layer, lo, hi FROM pr UNION ALL SELECT key, layer, lo, hi FROM st WHERE op = 'put')
 SELECT key AS timeline, layer, {_KIND} AS kind, min(lo) AS first, max(hi) AS until, CAST(sum(hi - lo) AS BIGINT) AS total,
  CASE WHEN {_KIND} <> '{timeline.OVERLAP}' THEN count(*) END AS held FROM every GROUP BY key, layer""")
def timeline_build(s, d):
    """What layers of all five kinds hold, from definitions and one log: first, until, total, and how many (of overlap layers the time only)."""
    kind = F.coalesce(*(F.when(C("layer") == t, F.lit(k)) for t, k in _KINDS.items()), F.lit(timeline.STRICT))
    rows = log(s, d).withColumn("kind", kind)
    day = C("lo") - C("lo") % DAY
    strict = rows.where(C("kind") == timeline.STRICT).withColumn("lo", day).withColumn("hi", C("lo") + _HALF)
    last = strict.groupBy("timeline", "layer", "kind", "lo", "hi").agg(F.max_by(F.struct("seq", "op", "tag"), "seq").alias("x")).select("timeline", "layer", "kind", "lo", "hi", "x.*")
    rows = rows.where(C("kind") != timeline.STRICT).unionByName(last)
    what = F.when(C("kind") == timeline.INTERVAL, "interval").when(C("kind") == timeline.PRESENCE, "presence").otherwise("event")
    written = rows.select("timeline", "layer", "seq", "op", what.alias("what"), "lo", "hi", F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), C("tag").alias("tags"))
    built = timeline.build(rows.select("timeline", "layer", "kind").distinct(), written)
    held = F.when(C("kind") != timeline.OVERLAP, F.count("*"))
    return built.groupBy("timeline", "layer", "kind").agg(F.min("lo").alias("first"), F.max("hi").alias("until"), F.sum(C("hi") - C("lo")).alias("total"), held.alias("held"))


@query()
def tl_overlap_lanes(s, d):
    return timeline.lanes(log(s, d))


@query(f"""WITH {EV}, {_TL}, p AS (SELECT key, layer, lo AS t FROM tl UNION SELECT key, layer, hi FROM tl),
 sg AS (SELECT key, layer, t AS lo, lead(t) OVER (PARTITION BY key, layer ORDER BY t) AS hi FROM p),
 rest AS (SELECT x.key, x.layer, s.hi - s.lo AS n FROM tl x JOIN sg s ON s.key = x.key AND s.layer = x.layer AND x.lo <= s.lo AND s.hi <= x.hi WHERE x.op = 'put'
  AND NOT EXISTS (SELECT 1 FROM tl r WHERE r.op = 'remove' AND r.key = x.key AND r.layer = x.layer AND r.seq > x.seq AND r.lo <= s.lo AND s.hi <= r.hi))
 SELECT key AS timeline, layer, CAST(sum(n) AS BIGINT) AS total, 0::BIGINT AS clashes FROM rest GROUP BY key, layer""")
def tl_overlap_totals(s, d):
    """What an overlap layer's lanes hold in all (each put less the removes after it), and the events that overlap another of their lane."""
    before = F.lag("hi").over(Window.partitionBy("timeline", "layer", "lane").orderBy("lo"))
    rows = timeline.lanes(log(s, d)).withColumn("clash", F.coalesce((before > C("lo")).cast("bigint"), F.lit(0).cast("bigint")))
    return rows.groupBy("timeline", "layer").agg(F.sum(C("hi") - C("lo")).alias("total"), F.sum("clash").alias("clashes"))


@query(f"""WITH {EV}, {_TL}, e AS (SELECT * FROM tl WHERE op = 'put') SELECT key AS timeline, layer, seq, lo, least(hi, {JAN10}) AS hi FROM e WHERE lo < {JAN10}
 UNION ALL SELECT key, layer, seq, greatest(lo, {JAN20}), hi FROM e WHERE hi > {JAN20}""")
def tl_remove(s, d):
    return timeline.removed(events_of(s, d).select("timeline", "layer", "seq", "lo", "hi"), JAN10, JAN20)


@query(f"""WITH {EV}, {_TL}, c AS (SELECT key AS timeline, layer, seq, greatest(lo, {JAN10}) AS lo, least(hi, {JAN20}) AS hi FROM tl WHERE op = 'put' AND lo < {JAN20} AND hi > {JAN10})
 SELECT *, CAST(row_number() OVER (PARTITION BY timeline, layer ORDER BY lo, hi, seq) - 1 AS INTEGER) AS pos,
 CAST(row_number() OVER (PARTITION BY timeline, layer ORDER BY hi DESC, lo DESC, seq) - 1 AS INTEGER) AS back FROM c""")
def tl_select_events(s, d):
    rows = events_of(s, d).select("timeline", "layer", "seq", "lo", "hi")
    forward = timeline.select_events(rows, JAN10, JAN20)
    return timeline.select_events(forward, JAN10, JAN20, backward=True).withColumnRenamed("pos", "back").join(forward.select("timeline", "layer", "seq", "pos"), ["timeline", "layer", "seq"])


@query(f"""WITH {EV}, {_TL}, {merged('r', "(SELECT key, layer, lo, hi FROM tl WHERE op = 'put')", _BY)} SELECT key AS timeline, layer, lo, hi FROM r""")
def tl_busy(s, d):
    return timeline.busy(events_of(s, d))


@query(f"""WITH {EV}, {_TL}, w AS (SELECT DISTINCT key, layer, unnest(range({JAN10}, {JAN20}, {DAY})) AS lo FROM tl)
 SELECT key AS timeline, layer, lo, lo + {DAY} AS hi FROM w WHERE NOT EXISTS (SELECT 1 FROM tl e WHERE op = 'put' AND e.key = w.key AND e.layer = w.layer AND e.lo < w.lo + {DAY} AND w.lo < e.hi)""")
def tl_free_windows(s, d):
    days = F.explode(F.sequence(F.lit(JAN10), F.lit(JAN20 - DAY), F.lit(DAY)))
    windows = log(s, d).select("timeline", "layer").distinct().withColumn("lo", days).withColumn("hi", C("lo") + DAY)
    return timeline.free(windows, events_of(s, d), ["timeline", "layer"])


@query("SELECT o_orderkey AS layer FROM orders WHERE o_orderpriority = '1-URGENT' AND (o_orderstatus = 'F' OR (o_totalprice <= 250000 AND o_orderstatus = 'F'))")
def tl_find_layers(s, d):
    layers = orders(s, d).withColumnRenamed("id", "layer")
    return timeline.find_layers(layers, ("1-URGENT", None), ("status", "F")).select("layer")


# --- JSON: written, read back, taken apart --------------------------------------------------------


def _sets(s, d):
    each = F.sort_array(F.collect_list(F.struct("lo", "hi")))
    return sets.merge(ev(s, d)).groupBy("key").agg(each.alias("i"))


@query(f"WITH {EV}, {merged('m', 'ev')} SELECT key, lo, hi FROM m")
def json_roundtrip_intervals(s, d):
    return _sets(s, d).select("key", F.explode(J.read_intervals(J.write_intervals(C("i")))).alias("x")).select("key", "x.lo", "x.hi")


@query(f"WITH {EV}, {merged('m', 'ev')} SELECT 'u' || key AS id, 2 AS n_tags, lo, hi FROM m")
def json_roundtrip_tagged(s, d):
    tags = T.build(T.tag("a"), T.tag("b", "1"))
    x = J.read_tagged(J.write_tagged(F.concat(F.lit("u"), C("key").cast("string")), tags, C("i")))
    return _sets(s, d).select(x.alias("x")).select("x.id", F.size("x.tags").alias("n_tags"), F.explode("x.collection").alias("c")).select("id", "n_tags", "c.lo", "c.hi")


@query(f"WITH {EV} SELECT key, type AS id, CAST(CASE WHEN type IN ('view', 'click', 'purchase', 'error') THEN 1 ELSE 0 END AS INTEGER) AS n_tags, lo, hi FROM ev")
def json_roundtrip_container(s, d):
    each = container_rows(s, d).groupBy("container", "id", "tags").agg(F.collect_list(F.struct("lo", "hi")).alias("collection"))
    rows = each.groupBy("container").agg(F.collect_list(F.struct("id", "tags", "collection")).alias("r"))
    read = rows.select(C("container").alias("key"), F.explode(J.read_container(J.write_container(C("r")))).alias("x"))
    return read.select("key", "x.id", F.size("x.tags").alias("n_tags"), F.explode("x.collection").alias("c")).select("key", "id", "n_tags", "c.lo", "c.hi")


_DISJOINT = f"lg AS (SELECT key, seq, lo, hi, type AS value FROM ev), {winning('w', 'lg')}, {coalesced('c', 'w', 'value')}"


@query(f"WITH {EV}, {_DISJOINT} SELECT key, 'none' AS def, lo, hi, value FROM c")
def json_roundtrip_interval_map(s, d):
    parts = steps.put_disjoint(ev(s, d).select("key", "seq", "lo", "hi", C("type").alias("value")), slice_us=DAY)
    packed = parts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "value"))).alias("e"))
    x = J.read_interval_map(J.write_interval_map(F.lit("none"), C("e")))
    return packed.select("key", x.alias("x")).select("key", C("x.default").alias("def"), F.explode("x.entries").alias("e")).select("key", "def", "e.lo", "e.hi", "e.value")


@query(f"WITH {EV} SELECT key, t, type AS value FROM ev")
def json_roundtrip_signal_map(s, d):
    packed = ev(s, d).groupBy("key").agg(F.collect_list(F.struct("t", C("type").alias("value"))).alias("e"))
    x = J.read_signal_map(J.write_signal_map(F.lit("none"), C("e")))
    return packed.select("key", F.explode(x["signals"]).alias("e")).select("key", "e.t", "e.value")


def _traces(s, d):
    """presences of each track, tagged with their seq."""
    tags = T.build(T.tag("seq", C("seq")))
    return tables.presences(s, d).groupBy("track").agg(F.collect_list(F.struct("t", "lat", "lon", tags.alias("tags"))).alias("presences"))


def _untraced(read):
    return read.select("track", "p.t", "p.lat", "p.lon", F.get("p.tags", F.lit(0))["value"].alias("tag"))


@query(f"WITH {PRES} SELECT track, t, lat, lon, CAST(seq AS VARCHAR) AS tag FROM pres")
def json_roundtrip_presences(s, d):
    said = J.write_presences(C("presences"), tagged=True)
    return _untraced(_traces(s, d).select("track", F.explode(J.read_presences(said)).alias("p")))


@query(f"WITH {PRES} SELECT track, t, lat, lon, CAST(seq AS VARCHAR) AS tag FROM pres")
def json_roundtrip_presence_layer(s, d):
    """A timeline of one presence layer each."""
    none = F.array().cast(f"array<struct<lo:bigint,hi:bigint,tags:{T.TAGS}>>")
    layer = F.struct(F.lit("PRESENCE").alias("type"), F.lit("trace").alias("id"), F.array().cast(T.TAGS).alias("tags"), none.alias("rows"), C("presences"))
    read = _traces(s, d).select("track", F.explode(J.read_timeline(J.write_timeline(F.array(layer), presences=True))).alias("x"))
    return _untraced(read.where("x.type = 'PRESENCE' and x.rows is null").select("track", F.explode("x.presences").alias("p")))


@query(f"WITH {_TG} SELECT id, CAST(CASE WHEN st = st2 THEN 2 ELSE 3 END AS INTEGER) AS n, p AS first FROM tg")
def json_roundtrip_tags(s, d):
    return orders(s, d).select("id", J.read_tags(J.write_tags(C("tags"))).alias("t")).select("id", F.size("t").alias("n"), F.get("t", F.lit(0))["name"].alias("first"))


_MV = """mv AS (SELECT track, t AS from_t, lat AS from_lat, lon AS from_lon, lead(t) OVER w AS to_t, lead(lat) OVER w AS to_lat, lead(lon) OVER w AS to_lon FROM pres WINDOW w AS (PARTITION BY track ORDER BY t))"""


@query(f"WITH {PRES}, {_MV} SELECT track, from_t, from_lat, from_lon, to_t, to_lat, to_lon, {HAVERSINE.format(a='from_', b='to_')} AS distance_m FROM mv WHERE to_t IS NOT NULL")
def json_roundtrip_track(s, d):
    from meridian.operators import presence
    from meridian.sources import text as X

    moves = presence.tracks(presence.movements(tables.presences(s, d)))
    said = J.write_track(X.format_presence(C("from_t"), C("from_lat"), C("from_lon")), X.format_presence(C("to_t"), C("to_lat"), C("to_lon")), C("distance_m"))
    read = moves.select("track", J.read_track(said).alias("x"))
    ends = [C(f"x.{end}.{c}").alias(f"{name}_{c}") for end, name in (("origin", "from"), ("destination", "to")) for c in ("t", "lat", "lon")]
    return read.select("track", *ends, "x.distance_m")


@query(f"WITH {LOC} SELECT a.nation, a.id AS o, b.id AS d, a.id * 1000 + b.id AS distance_m, a.id * 7 + b.id AS duration_s FROM loc a JOIN loc b USING (nation)")
def json_roundtrip_matrix(s, d):
    ids = tables.locations(s, d).groupBy("nation").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    cells = lambda n: F.transform("ids", lambda o: F.transform("ids", lambda x: o * n + x))
    said = J.write_matrix(cells(1000), cells(7), F.transform("ids", lambda x: x.cast("string")))
    read = ids.select("nation", F.explode(J.read_matrix(said)).alias("c"))
    return read.select("nation", C("c.o").cast("bigint").alias("o"), C("c.d").cast("bigint").alias("d"), "c.distance_m", "c.duration_s")


@query(f"WITH {EV}, {_TL} SELECT key AS timeline, layer, lo, hi, tag FROM tl WHERE op = 'put'")
def json_roundtrip_timeline(s, d):
    rows = events_of(s, d).withColumn("tags", T.build(T.tag(C("tag"))))
    layers = rows.groupBy("timeline", "layer").agg(F.collect_list(F.struct("lo", "hi", "tags")).alias("rows"))
    packed = layers.groupBy("timeline").agg(F.collect_list(F.struct(F.lit("EVENT_OVERLAP").alias("type"), C("layer").alias("id"), F.array().cast(T.TAGS).alias("tags"), "rows")).alias("l"))
    read = packed.select("timeline", F.explode(J.read_timeline(J.write_timeline(C("l")))).alias("x"))
    return read.select("timeline", C("x.id").alias("layer"), F.explode("x.rows").alias("e")).select("timeline", "layer", "e.lo", "e.hi", F.get("e.tags", F.lit(0))["name"].alias("tag"))
