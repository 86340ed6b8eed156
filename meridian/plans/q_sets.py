"""Queries of interval-set algebra and of boolean signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridian.operators import sets, steps
from meridian.plans.base import DAY, EV, HOUR, JAN10, JAN20, NINF, PINF, SHIP, covered, merged, query
from meridian.sources import tables

C = F.col
OP = "op AS (SELECT key, type AS operand, lo, hi FROM ev WHERE type IN ({types}))"
AB, ABC = OP.format(types="'view', 'click'"), OP.format(types="'view', 'click', 'purchase'")
A, B = "(SELECT key, lo, hi FROM ev WHERE type = 'view')", "(SELECT key, lo, hi FROM ev WHERE type = 'click')"
DOM = "dom AS (SELECT c_custkey AS key FROM customer)"
CLIP = f"greatest(lo, {JAN10}) AS lo, least(hi, {JAN20}) AS hi"
INSIDE = f"lo < {JAN20} AND hi > {JAN10}"


def ev(s, d, *types):
    rows = tables.events(s, d)
    return rows.where(C("type").isin(*types)) if types else rows


def customers(s, d):
    return tables.table(s, d, "customer").select(C("c_custkey").alias("key"))


@query(f"WITH {EV}, {merged('m', 'ev')} SELECT key, lo, hi FROM m")
def iset_merge(s, d):
    return sets.merge(ev(s, d), slice_us=DAY)


@query(f"WITH {EV}, {merged('m', 'ev')} SELECT key, lo, hi FROM m")
def iset_from_rows(s, d):
    return sets.merge(ev(s, d).select("key", "lo", "hi"))


@query(f"WITH {SHIP}, {merged('m', 'ship')} SELECT key, lo, hi FROM m")
def iset_from_columns(s, d):
    return sets.merge(tables.shipments(s, d), slice_us=30 * DAY)


_GAPS = f"""{merged('m', A)}, {merged('n', B)}, sides AS (SELECT key, 'a' AS operand, lo, hi FROM m UNION ALL SELECT key, 'b', lo, hi FROM n),
 ps AS (SELECT key, lo AS t FROM sides UNION SELECT key, hi FROM sides), ss AS (SELECT key, t AS lo, lead(t) OVER (PARTITION BY key ORDER BY t) AS hi FROM ps),
 only_a AS (SELECT key, lo, hi FROM ss WHERE EXISTS (SELECT 1 FROM m WHERE m.key = ss.key AND m.lo <= ss.lo AND m.hi >= ss.hi)
   AND NOT EXISTS (SELECT 1 FROM n WHERE n.key = ss.key AND n.lo <= ss.lo AND n.hi >= ss.hi)), {merged('r', 'only_a')}"""


@query(f"WITH {EV}, {_GAPS} SELECT key, lo, hi FROM r")
def iset_subtract(s, d):
    return sets.exclude(ev(s, d, "view"), ev(s, d, "click"))


@query(f"WITH {EV}, {_GAPS} SELECT key, lo, hi FROM r")
def iset_exclude(s, d):
    free = sets.not_(ev(s, d, "click"), ev(s, d))
    both = ev(s, d, "view").select("key", F.lit(0).alias("operand"), "lo", "hi").unionByName(free.withColumn("operand", F.lit(1)))
    return sets.and_(both, 2)


@query(f"""WITH {EV}, lg AS (SELECT key, seq, lo, hi, CASE WHEN type IN ('error', 'signup') THEN 'exclude' ELSE 'include' END AS value FROM ev),
 p AS (SELECT key, lo AS t FROM lg UNION SELECT key, hi FROM lg), sg AS (SELECT key, t AS lo, lead(t) OVER (PARTITION BY key ORDER BY t) AS hi FROM p),
 w AS (SELECT s.key, s.lo, s.hi, arg_max(x.value, x.seq) AS value FROM sg s JOIN lg x ON x.key = s.key AND x.lo <= s.lo AND x.hi >= s.hi GROUP BY ALL),
 {merged('r', "(SELECT key, lo, hi FROM w WHERE value = 'include')")} SELECT key, lo, hi FROM r""")
def iset_edit_log(s, d):
    log = ev(s, d).select("key", "seq", "lo", "hi", F.when(C("type").isin("error", "signup"), "exclude").otherwise("include").alias("value"))
    return sets.merge(steps.winners(log, slice_us=DAY).where(C("value") == "include"))


@query(f"WITH {EV}, {AB}, {merged('r', 'op')} SELECT key, lo, hi FROM r")
def iset_or(s, d):
    return sets.or_(tables.operands(s, d, "view", "click"))


def _sql(op, cnt):
    return f"WITH {EV}, {op}, {covered('cv', 'op')}, {merged('r', f'(SELECT key, lo, hi FROM cv WHERE cnt = {cnt})')} SELECT key, lo, hi FROM r"


@query(_sql(AB, 2))
def iset_and(s, d):
    return sets.and_(tables.operands(s, d, "view", "click"), 2)


@query(_sql(ABC, 3))
def iset_and_nary(s, d):
    return sets.and_(tables.operands(s, d, "view", "click", "purchase"), 3)


@query(_sql(AB, 1))
def iset_exclusive(s, d):
    return sets.exclusive(tables.operands(s, d, "view", "click"))


@query(_sql(ABC, 1))
def iset_exclusive3(s, d):
    return sets.exclusive(tables.operands(s, d, "view", "click", "purchase"))


_NOT = f"""{merged('m', A)}, fr AS (SELECT d.key, {NINF} AS lo, coalesce(min(m.lo), {PINF}) AS hi FROM dom d LEFT JOIN m ON m.key = d.key GROUP BY d.key
 UNION ALL SELECT m.key, m.hi, coalesce(lead(m.lo) OVER (PARTITION BY m.key ORDER BY m.lo), {PINF}) FROM m JOIN dom USING (key))"""


@query(f"WITH {EV}, {DOM}, {_NOT} SELECT key, lo, hi FROM fr")
def iset_not(s, d):
    return sets.not_(ev(s, d, "view"), customers(s, d))


@query(f"WITH {EV}, {ABC}, {merged('mo', 'op', 'key, operand')}, {covered('cv', 'mo')} SELECT key, lo, hi, cnt FROM cv")
def iset_depth(s, d):
    return sets.depth(tables.operands(s, d, "view", "click", "purchase"))


_M = f"WITH {EV}, {merged('m', 'ev')}"


@query(f"{_M} SELECT key, lo AS t, true AS value FROM m UNION ALL SELECT key, hi, false FROM m")
def iset_to_signals(s, d):
    ends = F.array(F.struct(C("lo").alias("t"), F.lit(True).alias("value")), F.struct(C("hi").alias("t"), F.lit(False).alias("value")))
    return sets.merge(ev(s, d)).select("key", F.explode(ends).alias("e")).select("key", "e.t", "e.value")


@query(f"{_M} SELECT key, lo AS t, false AS value FROM m UNION ALL SELECT key, hi, true FROM m")
def signals_not(s, d):
    return iset_to_signals(s, d).withColumn("value", ~C("value"))


@query(f"""WITH {EV}, o AS (SELECT key, t, type, lag(type) OVER (PARTITION BY key ORDER BY t) AS p, lag(t) OVER (PARTITION BY key ORDER BY t) AS q FROM ev)
 SELECT key, t, type AS value FROM o WHERE q IS NULL OR p <> type""")
def signals_compact(s, d):
    log = ev(s, d).select("key", "t", "seq", C("type").alias("value"))
    return steps.compact(steps.latest(log).drop("seq"))


_SCAN = f"""k AS (SELECT DISTINCT key FROM pt), sc AS (SELECT key, t, value FROM pt WHERE t > {JAN10} AND t < {JAN20}
 UNION ALL SELECT key, {JAN10}, coalesce((SELECT arg_max(value, t) FROM pt WHERE pt.key = k.key AND t <= {JAN10}), 'none') FROM k
 UNION ALL SELECT key, {JAN20}, coalesce((SELECT arg_max(value, t) FROM pt WHERE pt.key = k.key AND t <= {JAN20}), 'none') FROM k)"""
PT = "pt AS (SELECT key, t, type AS value FROM ev)"


def points(s, d):
    return ev(s, d).select("key", "t", C("type").alias("value"))


@query(f"WITH {EV}, {PT}, {_SCAN} SELECT key, t, value FROM sc")
def signals_window(s, d):
    return steps.scan(points(s, d), JAN10, JAN20, F.lit("none"))


@query(f"""WITH {EV}, {PT}, q AS (SELECT DISTINCT key, unnest([{JAN10}, {JAN20}]) AS t FROM pt)
 SELECT key, t, value FROM pt UNION ALL SELECT key, t, (SELECT arg_max(value, t) FROM pt WHERE pt.key = q.key AND pt.t <= q.t) AS value FROM q""")
def signals_expand(s, d):
    asked = points(s, d).select("key").distinct().select("key", F.explode(F.array(F.lit(JAN10), F.lit(JAN20))).alias("t"))
    return steps.expand(points(s, d), asked)


@query(f"{_M} SELECT key, {CLIP}, CAST(row_number() OVER (PARTITION BY key ORDER BY lo) - 1 AS INTEGER) AS pos FROM m WHERE {INSIDE}")
def iset_window(s, d):
    return sets.numbered(sets.window(sets.merge(ev(s, d)), JAN10, JAN20))


@query(f"{_M} SELECT key, {CLIP}, CAST(row_number() OVER (PARTITION BY key ORDER BY hi DESC) - 1 AS INTEGER) AS pos FROM m WHERE {INSIDE}")
def iset_window_backward(s, d):
    return sets.numbered(sets.window(sets.merge(ev(s, d)), JAN10, JAN20), backward=True)


@query(f"""{_M}, b AS (SELECT key, lo AS t, true AS value FROM m WHERE lo > {JAN10} AND lo < {JAN20} UNION ALL SELECT key, hi, false FROM m WHERE hi > {JAN10} AND hi < {JAN20}),
 k AS (SELECT DISTINCT key FROM m) SELECT key, t, value FROM b
 UNION ALL SELECT key, {JAN10}, EXISTS (SELECT 1 FROM m WHERE m.key = k.key AND lo <= {JAN10} AND hi > {JAN10}) FROM k
 UNION ALL SELECT key, {JAN20}, false FROM k""")
def iset_bounds(s, d):
    return sets.bounds(sets.merge(ev(s, d)), JAN10, JAN20)


_FIT = f"f AS (SELECT key, {CLIP} FROM m WHERE {INSIDE})"


@query(f"{_M}, {_FIT} SELECT key, min(lo) AS lo, min(lo) + {HOUR} AS hi FROM f WHERE hi - lo >= {HOUR} GROUP BY key")
def iset_find_first(s, d):
    return sets.find(ev(s, d), HOUR, lo=JAN10, hi=JAN20)


@query(f"{_M}, {_FIT} SELECT key, max(hi) - {HOUR} AS lo, max(hi) AS hi FROM f WHERE hi - lo >= {HOUR} GROUP BY key")
def iset_find_last(s, d):
    return sets.find(ev(s, d), HOUR, backward=True, lo=JAN10, hi=JAN20)


@query(f"{_M} SELECT key, min(greatest(lo, {JAN10})) AS lo, min(greatest(lo, {JAN10})) + {HOUR} AS hi FROM m WHERE hi - greatest(lo, {JAN10}) >= {HOUR} GROUP BY key")
def iset_find_from(s, d):
    return sets.find(ev(s, d), HOUR, lo=JAN10)


@query(f"{_M} SELECT q.key, q.seq, q.t + 60000000 AS t, m.lo, m.hi FROM ev q JOIN m ON m.key = q.key AND m.lo <= q.t + 60000000 AND q.t + 60000000 < m.hi")
def iset_get(s, d):
    asked = ev(s, d).select("key", "seq", (C("t") + 60_000_000).alias("t"))
    return sets.at(sets.merge(ev(s, d)), asked)


@query(f"{_M} SELECT k.key, EXISTS (SELECT 1 FROM m WHERE m.key = k.key AND lo <= {JAN10} AND {JAN10} < hi) AS inside FROM (SELECT DISTINCT key FROM ev) k")
def iset_contains(s, d):
    asked = ev(s, d).select("key").distinct().withColumn("t", F.lit(JAN10))
    return sets.at(sets.merge(ev(s, d)), asked, how="left").select("key", C("lo").isNotNull().alias("inside"))


@query(f"{_M} SELECT q.key, q.seq FROM ev q WHERE EXISTS (SELECT 1 FROM m WHERE m.key = q.key AND m.lo <= q.lo - 60000000 AND m.hi >= q.hi)")
def iset_encloses(s, d):
    asked = ev(s, d).select("key", "seq", (C("lo") - 60_000_000).alias("lo"), "hi")
    return sets.enclosing(sets.merge(ev(s, d)), asked).select("key", "seq")


@query(f"""WITH {EV}, {DOM} SELECT d.key, NOT EXISTS (SELECT 1 FROM ev WHERE ev.key = d.key) AS is_never, EXISTS (SELECT 1 FROM ev WHERE ev.key = d.key AND v > 300) AS is_always FROM dom d""")
def iset_class(s, d):
    wide = ev(s, d).select("key", F.when(C("v") > 300, NINF).otherwise(C("lo")).alias("lo"), F.when(C("v") > 300, PINF).otherwise(C("hi")).alias("hi"))
    return sets.classify(wide, customers(s, d))


@query(f"WITH {EV} SELECT key, min(lo) AS lo, max(hi) AS hi FROM ev GROUP BY key")
def iset_span(s, d):
    return sets.span(ev(s, d))


@query(f"{_M}, {_FIT} SELECT key, CAST(sum(hi - lo) AS BIGINT) AS total FROM f GROUP BY key")
def iset_total(s, d):
    return sets.total(ev(s, d), lo=JAN10, hi=JAN20)


@query(f"""WITH {EV}, {merged('m', A)}, {merged('n', B)}, x AS (SELECT key, floor(sum(least(hi, {JAN20}) - greatest(lo, {JAN10})) / 1000) AS a FROM m WHERE {INSIDE} GROUP BY key),
 y AS (SELECT key, floor(sum(least(hi, {JAN20}) - greatest(lo, {JAN10})) / 1000) AS b FROM n WHERE {INSIDE} GROUP BY key)
 SELECT key, CASE WHEN coalesce(a, 0) = 0 THEN 0.0::DOUBLE WHEN b > 0 THEN a / b END AS ratio FROM x FULL JOIN y USING (key)""")
def iset_ratio(s, d):
    return sets.ratio(ev(s, d, "view"), ev(s, d, "click"), lo=JAN10, hi=JAN20)


@query(f"""{_M} SELECT key, string_agg('[' || strftime(make_timestamp(lo), '%Y-%m-%dT%H:%M:%S.%f') || 'Z..' || strftime(make_timestamp(hi), '%Y-%m-%dT%H:%M:%S.%f') || 'Z)', ',' ORDER BY lo) AS text FROM m GROUP BY key""")
def format_iset(s, d):
    from meridian.sources import text

    return text.format_set(sets.merge(ev(s, d)))
