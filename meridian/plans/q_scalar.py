"""Queries of moments, intervals, calendars and relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridian.functions import interval as I
from meridian.functions import moment as M
from meridian.functions import relations as R
from meridian.operators import joins
from meridian.plans.base import DAY, EV, HOUR, JAN10, JAN20, NINF, PINF, SHIP, query
from meridian.sources import tables

C = F.col
Z = "Europe/Budapest"
MO = f"""mo AS (SELECT seq, CASE type WHEN 'error' THEN {NINF} WHEN 'signup' THEN {PINF} ELSE t END AS m, t AS other FROM ev)"""
#: Intervals of all four kinds.
IV = f"""iv AS (SELECT seq, key, CASE WHEN type IN ('error', 'view') THEN {NINF} ELSE lo END AS lo, CASE WHEN type IN ('signup', 'view') THEN {PINF} ELSE hi END AS hi, t, hi - lo AS len FROM ev)"""


def mo(s, d):
    m = F.when(C("type") == "error", NINF).when(C("type") == "signup", PINF).otherwise(C("t"))
    return tables.events(s, d).select("seq", m.alias("m"), C("t").alias("other"))


def iv(s, d):
    lo, hi = F.when(C("type").isin("error", "view"), NINF).otherwise(C("lo")), F.when(C("type").isin("signup", "view"), PINF).otherwise(C("hi"))
    return tables.events(s, d).select("seq", "key", lo.alias("lo"), hi.alias("hi"), "t", (C("hi") - C("lo")).alias("len"))


def fields(x, keep=("seq",), lo="lo", hi="hi"):
    return [*keep, x["lo"].alias(lo), x["hi"].alias(hi)]


# --- moments ------------------------------------------------------------------------------------


@query(f"WITH {EV}, {MO} SELECT seq, m = other AS eq, m <> other AS ne, m < {JAN10} AS lt, m <= {JAN10} AS le, m > {JAN10} AS gt, m >= {JAN10} AS ge FROM mo")
def moment_cmp(s, d):
    m, x = C("m"), F.lit(JAN10)
    return mo(s, d).select("seq", (m == C("other")).alias("eq"), (m != C("other")).alias("ne"), (m < x).alias("lt"), (m <= x).alias("le"), (m > x).alias("gt"), (m >= x).alias("ge"))


@query(f"WITH {EV}, {MO} SELECT seq, least(m, {JAN10}) AS least_m, greatest(m, {JAN10}) AS greatest_m FROM mo")
def moment_minmax(s, d):
    return mo(s, d).select("seq", F.least("m", F.lit(JAN10)).alias("least_m"), F.greatest("m", F.lit(JAN10)).alias("greatest_m"))


@query(f"WITH {EV}, {MO} SELECT seq, CASE WHEN abs(m) = {PINF} THEN m ELSE m + {HOUR} END AS shifted FROM mo")
def moment_shift(s, d):
    return mo(s, d).select("seq", M.shift(C("m"), F.lit(HOUR)).alias("shifted"))


@query(f"WITH {EV}, {MO} SELECT seq, greatest({JAN10}, least({JAN20}, m)) AS pulled FROM mo")
def moment_clamp(s, d):
    return mo(s, d).select("seq", M.clamp(C("m"), F.lit(JAN10), F.lit(JAN20)).alias("pulled"))


@query(f"""WITH {EV}, {MO} SELECT seq, abs(m) <> {PINF} AS finite, abs(m) = {PINF} AS infinite,
  CASE m WHEN {NINF} THEN 'negative infinite' WHEN {PINF} THEN 'positive infinite' ELSE 'finite' END AS kind FROM mo""")
def moment_class(s, d):
    return mo(s, d).select("seq", M.is_finite(C("m")).alias("finite"), M.is_infinite(C("m")).alias("infinite"), M.kind(C("m")).alias("kind"))


@query(f"WITH {EV}, {MO} SELECT seq, CAST(sign(m) AS INTEGER) AS sig, abs(m) AS absolute, -m AS negated FROM mo WHERE abs(m) = {PINF}")
def moment_inf_algebra(s, d):
    m = C("m")
    return mo(s, d).where(M.is_infinite(m)).select("seq", F.signum(m).cast("int").alias("sig"), F.abs(m).alias("absolute"), M.negate(m).alias("negated"))


@query(f"""WITH {EV}, {MO} SELECT seq, CASE m WHEN {NINF} THEN '-∞' WHEN {PINF} THEN '∞'
  ELSE strftime(make_timestamp(m) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') END AS local FROM mo""")
def moment_zone(s, d):
    return mo(s, d).select("seq", M.in_zone(C("m"), Z).alias("local"))  # January: an hour ahead of UTC


@query(f"WITH {EV}, {MO} SELECT seq, m >= {JAN10} AND m < {JAN20} AS inside, m > {JAN10} AND m <= {JAN20} AS inside_right FROM mo")
def moment_between(s, d):
    a, b = F.lit(JAN10), F.lit(JAN20)
    return mo(s, d).select("seq", M.between(C("m"), a, True, b, False).alias("inside"), M.between(C("m"), a, False, b, True).alias("inside_right"))


# --- intervals ----------------------------------------------------------------------------------


@query(f"WITH {EV}, {IV} SELECT seq, lo, hi FROM iv")
def interval_make(s, d):
    return iv(s, d).select("seq", I.interval(C("lo"), C("hi")).alias("i")).select("seq", "i.lo", "i.hi")


@query(f"WITH {EV} SELECT seq, CASE WHEN v < 20 THEN {NINF} ELSE t END AS lo, CASE WHEN v < 20 THEN t ELSE {PINF} END AS hi FROM ev")
def interval_half(s, d):
    return tables.events(s, d).select("seq", I.half(C("t"), C("v") >= 20).alias("i")).select("seq", "i.lo", "i.hi")


@query(f"WITH {EV}, n AS (SELECT seq, t, (CAST(floor(v) AS BIGINT) - 20) * 60000000 AS d FROM ev) SELECT seq, least(t, t + d) AS lo, greatest(t, t + d) AS hi FROM n WHERE d <> 0")
def interval_from_duration(s, d):
    length = (F.floor(C("v")) - 20) * M.MINUTE
    made = tables.events(s, d).select("seq", I.with_length(C("t"), length).alias("i"))
    return made.where("i is not null").select("seq", "i.lo", "i.hi")


@query(f"WITH {EV} SELECT seq, CASE WHEN t < {JAN10} THEN t END AS lo, CASE WHEN t < {JAN10} THEN {JAN10} END AS hi FROM ev")
def interval_try(s, d):
    return tables.events(s, d).select("seq", I.try_interval(C("t"), F.lit(JAN10)).alias("i")).select("seq", "i.lo", "i.hi")


@query(f"WITH {EV} SELECT seq, unnest(range(lo, hi, 1800000000)) AS t FROM ev")
def interval_step(s, d):
    return tables.events(s, d).select("seq", F.explode(I.steps(C("lo"), C("hi"), F.lit(30 * M.MINUTE))).alias("t"))


_OFF = """CASE WHEN {x} >= make_timestamp(2024, 3, 31, 1, 0, 0.0) AND {x} < make_timestamp(2024, 10, 27, 1, 0, 0.0) THEN 2 ELSE 1 END"""
_DST = f"""sp AS (SELECT seq, t, t + (seq % 300) * {DAY} AS moment FROM ev), lc AS (SELECT seq, make_timestamp(moment) AS u FROM sp),
 l2 AS (SELECT seq, date_trunc('day', u + {_OFF.format(x="u")} * INTERVAL 1 HOUR) AS dd FROM lc),
 mid AS (SELECT seq, dd AS a, dd + INTERVAL 1 DAY AS b FROM l2)"""
#: A local midnight in UTC: the clock changes fall at 01:00 UTC, after any midnight of their day.
_UTC = """epoch_us({x}) - (CASE WHEN {x} > make_timestamp(2024, 3, 31, 0, 0, 0.0) AND {x} <= make_timestamp(2024, 10, 27, 0, 0, 0.0) THEN 2 ELSE 1 END) * 3600000000"""


@query(f"WITH {EV}, {_DST} SELECT seq, {_UTC.format(x='a')} AS lo, {_UTC.format(x='b')} AS hi FROM mid")
def interval_day(s, d):
    at = C("t") + (C("seq") % 300) * DAY
    return tables.events(s, d).select("seq", I.day(at, Z).alias("i")).select("seq", "i.lo", "i.hi")


_DAYS = f"""dy AS (SELECT seq, lo, hi, unnest(range(lo - (lo + {HOUR}) % {DAY}, hi + {HOUR} - (hi + {HOUR}) % {DAY} + 1, {DAY})) AS a FROM ev)"""


@query(f"WITH {EV}, {_DAYS} SELECT seq, a AS lo, a + {DAY} AS hi FROM dy WHERE a <= hi")
def interval_days(s, d):
    return tables.events(s, d).select("seq", F.explode(I.days(C("lo"), C("hi"), Z)).alias("i")).select("seq", "i.lo", "i.hi")


@query(f"WITH {EV}, {_DAYS}, c AS (SELECT seq, greatest(a, lo) AS lo, least(a + {DAY}, hi) AS hi FROM dy) SELECT seq, lo, hi FROM c WHERE lo < hi")
def interval_days_crop(s, d):
    return tables.events(s, d).select("seq", F.explode(I.days(C("lo"), C("hi"), Z, True)).alias("i")).select("seq", "i.lo", "i.hi")


@query(f"WITH {EV}, {_DAYS}, c AS (SELECT seq, greatest(a + 22 * {HOUR}, lo) AS lo, least(a + 30 * {HOUR}, hi) AS hi FROM dy WHERE a <= hi) SELECT seq, lo, hi FROM c WHERE lo < hi")
def interval_daily(s, d):
    slots = I.daily(C("lo"), C("hi"), 22 * HOUR, 6 * HOUR, Z, True)
    return tables.events(s, d).select("seq", F.explode(slots).alias("i")).select("seq", "i.lo", "i.hi")


@query(f"WITH {EV}, {IV} SELECT seq, CASE WHEN lo <> {NINF} AND hi <> {PINF} THEN hi - lo END AS length FROM iv")
def interval_duration(s, d):
    return iv(s, d).select("seq", I.duration(C("lo"), C("hi")).alias("length"))


@query(f"""WITH {EV}, {IV} SELECT seq, CASE WHEN lo = {NINF} AND hi = {PINF} THEN 'always' WHEN lo = {NINF} THEN 'to' WHEN hi = {PINF} THEN 'from' ELSE 'bounded' END AS kind,
  lo <> {NINF} AND hi <> {PINF} AS bounded FROM iv""")
def interval_class(s, d):
    return iv(s, d).select("seq", I.kind(C("lo"), C("hi")).alias("kind"), I.is_bounded(C("lo"), C("hi")).alias("bounded"))


@query(f"WITH {EV}, {IV} SELECT seq, lo <= {JAN10} AND {JAN10} < hi AS at_tenth, hi = {PINF} AND lo <> {NINF} AS at_end FROM iv")
def interval_contains(s, d):
    lo, hi = C("lo"), C("hi")
    return iv(s, d).select("seq", I.contains(lo, hi, F.lit(JAN10)).alias("at_tenth"), I.contains(lo, hi, F.lit(PINF)).alias("at_end"))


@query(f"WITH {EV}, {IV} SELECT seq, CASE WHEN lo > {JAN10} THEN 'after' WHEN {JAN10} < hi THEN 'inside' ELSE 'before' END AS place FROM iv")
def interval_map_relative(s, d):
    return iv(s, d).select("seq", I.position(C("lo"), C("hi"), F.lit(JAN10), F.lit("before"), F.lit("inside"), F.lit("after")).alias("place"))


@query(f"WITH {EV}, {IV} SELECT seq, lo <= {JAN10} AND hi >= {JAN20} AS holds, {JAN10} <= lo AND {JAN20} >= hi AS held FROM iv")
def interval_encloses(s, d):
    a, b = F.lit(JAN10), F.lit(JAN20)
    return iv(s, d).select("seq", I.encloses(C("lo"), C("hi"), a, b).alias("holds"), I.encloses(a, b, C("lo"), C("hi")).alias("held"))


@query(f"WITH {EV}, {IV} SELECT seq, CASE WHEN lo = {NINF} OR hi = {PINF} THEN true ELSE hi - lo >= {HOUR} END AS fits FROM iv")
def interval_fits(s, d):
    return iv(s, d).select("seq", I.fits(C("lo"), C("hi"), F.lit(HOUR)).alias("fits"))


@query(f"WITH {EV}, {IV} SELECT seq, least(lo, {JAN10}) AS lo, greatest(hi, {JAN20}) AS hi FROM iv")
def interval_span(s, d):
    return iv(s, d).select("seq", I.span(C("lo"), C("hi"), F.lit(JAN10), F.lit(JAN20)).alias("i")).select("seq", "i.lo", "i.hi")


@query(f"""WITH {EV}, {IV} SELECT seq, least(lo, {JAN10}) AS lo, greatest(hi, {JAN20}) AS hi FROM iv WHERE lo <= {JAN20} AND {JAN10} <= hi
  UNION ALL SELECT seq, lo, hi FROM iv WHERE NOT (lo <= {JAN20} AND {JAN10} <= hi) UNION ALL SELECT seq, {JAN10}, {JAN20} FROM iv WHERE NOT (lo <= {JAN20} AND {JAN10} <= hi)""")
def interval_union(s, d):
    both = I.union(C("lo"), C("hi"), F.lit(JAN10), F.lit(JAN20))
    return iv(s, d).select("seq", F.explode(both).alias("i")).select("seq", "i.lo", "i.hi")


@query(f"WITH {EV}, {IV} SELECT seq, greatest(lo, {JAN10}) AS lo, least(hi, {JAN20}) AS hi FROM iv WHERE greatest(lo, {JAN10}) < least(hi, {JAN20})")
def interval_intersect(s, d):
    made = iv(s, d).select("seq", I.intersect(C("lo"), C("hi"), F.lit(JAN10), F.lit(JAN20)).alias("i"))
    return made.where("i is not null").select("seq", "i.lo", "i.hi")


@query(f"WITH {EV}, {IV} SELECT seq, {NINF} AS lo, lo AS hi FROM iv WHERE lo > {NINF} UNION ALL SELECT seq, hi, {PINF} FROM iv WHERE hi < {PINF}")
def interval_complement(s, d):
    return iv(s, d).select("seq", F.explode(I.complement(C("lo"), C("hi"))).alias("i")).select("seq", "i.lo", "i.hi")


@query(f"WITH {EV}, {IV} SELECT seq, CASE WHEN lo = {NINF} THEN lo ELSE lo - {DAY} END AS lo, CASE WHEN hi = {PINF} THEN hi ELSE hi - {DAY} END AS hi FROM iv")
def interval_shift(s, d):
    return iv(s, d).select("seq", I.shift(C("lo"), C("hi"), F.lit(-DAY)).alias("i")).select("seq", "i.lo", "i.hi")


@query(f"WITH {EV} SELECT seq, lo - {HOUR} AS lower_lo, hi AS lower_hi, lo AS upper_lo, hi + {HOUR} AS upper_hi FROM ev")
def interval_with_bound(s, d):
    rows = tables.events(s, d).select("seq", I.with_lower(C("lo"), C("hi"), C("lo") - HOUR).alias("a"), I.with_upper(C("lo"), C("hi"), C("hi") + HOUR).alias("b"))
    return rows.select("seq", C("a.lo").alias("lower_lo"), C("a.hi").alias("lower_hi"), C("b.lo").alias("upper_lo"), C("b.hi").alias("upper_hi"))


_KINDS = f"(SELECT unnest(['{I.BEFORE}', '{I.STARTS}', '{I.ENDS}', '{I.AFTER}']) AS how)"
_ALIGN = f"""al AS (SELECT seq, how, CASE WHEN how IN ('{I.BEFORE}', '{I.STARTS}') THEN lo ELSE hi END AS a, CASE WHEN how IN ('{I.BEFORE}', '{I.ENDS}') THEN {HOUR} ELSE 0 END AS back FROM SRC, {_KINDS})"""


@query(f"WITH {EV}, {_ALIGN.replace('SRC', 'ev')} SELECT seq, how, a - back AS lo, a - back + {HOUR} AS hi FROM al")
def interval_align(s, d):
    rows = tables.events(s, d).withColumn("how", F.explode(F.array(*map(F.lit, (I.BEFORE, I.STARTS, I.ENDS, I.AFTER)))))
    return rows.select("seq", "how", I.align(C("lo"), C("hi"), F.lit(HOUR), C("how")).alias("i")).select("seq", "how", "i.lo", "i.hi")


@query(f"""WITH {EV}, {IV}, {_ALIGN.replace('SRC', 'iv')} SELECT seq, how, CASE WHEN abs(a) <> {PINF} THEN a - back END AS lo, CASE WHEN abs(a) <> {PINF} THEN a - back + {HOUR} END AS hi FROM al""")
def interval_align_try(s, d):
    rows = iv(s, d).withColumn("how", F.explode(F.array(*map(F.lit, (I.BEFORE, I.STARTS, I.ENDS, I.AFTER)))))
    return rows.select("seq", "how", I.try_align(C("lo"), C("hi"), F.lit(HOUR), C("how")).alias("i")).select("seq", "how", "i.lo", "i.hi")


# --- text ---------------------------------------------------------------------------------------

_TXT = "strftime(make_timestamp({x}), '%Y-%m-%dT%H:%M:%S.%f') || 'Z'"


@query(f"""WITH {EV}, {IV} SELECT seq, '[' || CASE WHEN lo = {NINF} THEN '-∞' ELSE {_TXT.format(x='lo')} END || '..' || CASE WHEN hi = {PINF} THEN '∞' ELSE {_TXT.format(x='hi')} END || ')' AS text FROM iv""")
def format_interval(s, d):
    return iv(s, d).select("seq", I.format_interval(C("lo"), C("hi")).alias("text"))


@query(f"""WITH {EV}, {MO} SELECT seq, CASE WHEN seq % 7 = 0 THEN NULL ELSE m END AS m FROM mo""")
def parse_moment(s, d):
    text = F.when(C("seq") % 7 == 0, "noon").when(C("m") == PINF, " +∞ ").when(C("m") == NINF, "ninf").otherwise(M.format_moment(C("m")))
    return mo(s, d).select("seq", M.parse(text).alias("m"))


@query(f"WITH {EV}, {IV} SELECT seq, CASE WHEN seq % 7 <> 0 THEN lo END AS lo, CASE WHEN seq % 7 <> 0 THEN hi END AS hi FROM iv")
def parse_interval(s, d):
    text = F.when(C("seq") % 7 == 0, F.lit("[1..2]")).otherwise(I.format_interval(C("lo"), C("hi")))
    return iv(s, d).select("seq", I.parse(text).alias("i")).select("seq", "i.lo", "i.hi")


# --- relations ----------------------------------------------------------------------------------

_REL_SQL = {
    "before": "ah < bl", "meets": "ah = bl", "overlaps": "al < bl AND bl < ah AND ah < bh", "starts": "al = bl AND ah < bh", "during": "al > bl AND ah < bh",
    "finishes": "al > bl AND ah = bh", "equals": "al = bl AND ah = bh", "finished_by": "al < bl AND ah = bh", "contains": "al < bl AND ah > bh",
    "started_by": "al = bl AND ah > bh", "overlapped_by": "al > bl AND al < bh AND ah > bh", "met_by": "al = bh", "after": "al > bh",
    "intersects": "al < bh AND bl < ah", "distinct": "NOT (al < bh AND bl < ah)", "adjacent": "ah = bl OR al = bh", "connects": "al <= bh AND bl <= ah", "encloses": "al <= bl AND ah >= bh",
}
#: Days of order and shipping on a coarse grid, so that all thirteen relations occur.
_GRID = f"""g AS (SELECT key, "order" * 100 + line AS id, lo - lo % (30 * {DAY}) AS lo, hi + 30 * {DAY} - hi % (30 * {DAY}) AS hi FROM ship)"""
_PAIRS = f"""WITH {SHIP}, {_GRID}, pr AS (SELECT a.id AS a, b.id AS b, a.lo AS al, a.hi AS ah, b.lo AS bl, b.hi AS bh FROM g a JOIN g b ON a.key = b.key AND a.id <> b.id)"""


def grid(s, d):
    month = 30 * DAY
    return tables.shipments(s, d).select("key", (C("order") * 100 + C("line")).alias("id"), (C("lo") - C("lo") % month).alias("lo"), (C("hi") + month - C("hi") % month).alias("hi"))


def _pairs(s, d, holds):
    a, b = grid(s, d).alias("a"), grid(s, d).alias("b")
    return a.join(b, (C("a.key") == C("b.key")) & (C("a.id") != C("b.id")) & holds(C("a.lo"), C("a.hi"), C("b.lo"), C("b.hi")))


def _relation(name):
    meeting = name in ("intersects", "connects", "adjacent", "meets", "met_by", "overlaps", "starts", "during", "finishes", "equals", "finished_by", "contains", "started_by", "overlapped_by", "encloses")

    @query(f"{_PAIRS} SELECT a, count(*) AS n, CAST(sum(b) AS BIGINT) AS of FROM pr WHERE {_REL_SQL[name]} GROUP BY a", name=f"rel_{name}")
    def run(s, d):
        if meeting:  # related pairs meet in time: no need to compare all of a customer's
            found = joins.overlapping(grid(s, d), grid(s, d), ["key"], 180 * DAY, R.PREDICATES[name], touching=True).where("id <> b_id").select(C("id").alias("a"), C("b_id").alias("b"))
        else:
            found = _pairs(s, d, R.PREDICATES[name]).select(C("a.id").alias("a"), C("b.id").alias("b"))
        return found.groupBy("a").agg(F.count("*").alias("n"), F.sum("b").alias("of"))


for _name in R.PREDICATES:
    _relation(_name)

_CASE = " ".join(f"WHEN {_REL_SQL[n]} THEN '{text}'" for n, _, text in R.BASIC)
_BITS = " ".join(f"WHEN {_REL_SQL[n]} THEN {1 << i}" for i, (n, _, _t) in enumerate(R.BASIC))


@query(f"{_PAIRS} SELECT a, CASE {_BITS} END AS flag, CASE {_CASE} END AS relation, count(*) AS n FROM pr GROUP BY ALL")
def rel_classify(s, d):
    bounds = (C("a.lo"), C("a.hi"), C("b.lo"), C("b.hi"))
    rows = _pairs(s, d, lambda *_: F.lit(True)).select(C("a.id").alias("a"), R.flags(*bounds).alias("flag"), R.name(*bounds).alias("relation"))
    return rows.groupBy("a", "flag", "relation").agg(F.count("*").alias("n"))
