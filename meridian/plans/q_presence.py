"""Queries of presences, as-of lookups, movements and tracks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meridian.functions import moment as M
from meridian.functions import tags as T
from meridian.operators import presence, steps
from meridian.plans.base import HOUR, JAN10, JAN20, NINF, PRES, query
from meridian.sources import tables, text

C = F.col
BY = ["track"]
#: Writes at whole hours, so that several fall on one instant.
_H = "h AS (SELECT track, t - t % 3600000000 AS t, seq, lat, lon FROM pres), la AS (SELECT track, t, arg_max(lat, seq) AS lat, arg_max(lon, seq) AS lon FROM h GROUP BY track, t)"


def pres(s, d):
    return tables.presences(s, d)


@query(f"WITH {PRES}, {_H} SELECT track, t, lat, lon FROM la")
def presence_put(s, d):
    return presence.load(pres(s, d).withColumn("t", C("t") - C("t") % HOUR)).drop("seq")


@query(f"WITH {PRES} SELECT track, t, lat, lon FROM pres")
def presence_load(s, d):
    return presence.load(pres(s, d)).drop("seq")


@query(f"WITH {PRES} SELECT track, t, lat, lon FROM pres WHERE NOT (t > {JAN10} AND t <= {JAN20})")
def presence_remove(s, d):
    return steps.remove(pres(s, d).drop("seq"), JAN10, JAN20, False, True)


@query(f"WITH {PRES} SELECT track, count(*) AS n FROM pres GROUP BY track")
def presence_size(s, d):
    return pres(s, d).groupBy("track").agg(F.count("*").alias("n"))


#: Asked at an instant of the trace itself and a minute after it.
_Q = "q AS (SELECT track, seq, unnest([t, t + 60000000]) AS t FROM pres)"


def _asof(how, op):
    @query(f"""WITH {PRES}, {_Q} SELECT q.track, q.seq, q.t, p.t AS found_t, p.lat, p.lon FROM q ASOF LEFT JOIN pres p ON q.track = p.track AND q.t {op} p.t""", name=f"asof_{how}")
    def run(s, d):
        asked = pres(s, d).select("track", "seq", F.explode(F.array("t", C("t") + 60_000_000)).alias("t"))
        return steps.asof(asked, pres(s, d), ["lat", "lon"], BY, how)


for _how, _op in (("floor", ">="), ("lower", ">"), ("ceiling", "<="), ("higher", "<")):
    _asof(_how, _op)

_WIN = f"""k AS (SELECT DISTINCT track FROM pres), wn AS (SELECT track, t, lat, lon FROM pres WHERE t > {JAN10} AND t < {JAN20}
 UNION ALL SELECT k.track, {JAN10}, f.lat, f.lon FROM k LEFT JOIN (SELECT track, arg_max(lat, t) AS lat, arg_max(lon, t) AS lon FROM pres WHERE t <= {JAN10} GROUP BY track) f USING (track)
 UNION ALL SELECT k.track, {JAN20}, c.lat, c.lon FROM k LEFT JOIN (SELECT track, arg_min(lat, t) AS lat, arg_min(lon, t) AS lon FROM pres WHERE t >= {JAN20} GROUP BY track) c USING (track))"""


@query(f"WITH {PRES}, {_WIN} SELECT track, t, lat, lon, CAST(row_number() OVER (PARTITION BY track ORDER BY t) - 1 AS INTEGER) AS pos FROM wn")
def presence_window(s, d):
    rows = presence.window(pres(s, d), JAN10, JAN20, pres(s, d))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("track").orderBy("t")) - 1)


@query(f"WITH {PRES}, {_WIN} SELECT track, t, lat, lon, CAST(row_number() OVER (PARTITION BY track ORDER BY t DESC) - 1 AS INTEGER) AS pos FROM wn")
def presence_window_backward(s, d):
    rows = presence.window(pres(s, d), JAN10, JAN20, pres(s, d))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("track").orderBy(F.desc("t"))) - 1)


def _moves(source):
    return f"""mv AS (SELECT track, t AS from_t, lat AS from_lat, lon AS from_lon, lead(t) OVER w AS to_t, lead(lat) OVER w AS to_lat, lead(lon) OVER w AS to_lon
 FROM {source} WINDOW w AS (PARTITION BY track ORDER BY t))"""


@query(f"WITH {PRES}, {_moves('pres')} SELECT * FROM mv WHERE to_t IS NOT NULL")
def movements(s, d):
    return presence.movements(pres(s, d))


@query(f"WITH {PRES}, {_WIN}, {_moves('wn')} SELECT * FROM mv WHERE to_t IS NOT NULL")
def movements_window(s, d):
    return presence.movements(presence.window(pres(s, d), JAN10, JAN20, pres(s, d)))


@query(f"WITH {PRES} SELECT track, seq, t + {HOUR} AS t, lat, lon, 2 AS n_tags FROM pres")
def presence_shift(s, d):
    tags = T.merge(T.build(T.tag("a")), T.build(T.tag("a"), T.tag("b", "1")))
    return pres(s, d).select("track", "seq", M.shift(C("t"), F.lit(HOUR)).alias("t"), "lat", "lon", F.size(tags).alias("n_tags"))


@query(f"WITH {PRES}, {_moves('pres')} SELECT track, from_t AS lo, to_t AS hi, to_t - from_t AS length FROM mv WHERE to_t IS NOT NULL")
def movement_interval(s, d):
    return presence.movements(pres(s, d)).select("track", C("from_t").alias("lo"), C("to_t").alias("hi"), (C("to_t") - C("from_t")).alias("length"))


HAVERSINE = """CAST(trunc(2.0 * 6371000 * asin(sqrt(least(1.0, pow(sin(radians({b}lat - {a}lat) / 2), 2.0) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2.0))))) AS BIGINT)"""
_M = HAVERSINE.format(a="from_", b="to_")


@query(f"WITH {PRES}, {_moves('pres')} SELECT track, from_t AS lo, from_t + CAST(trunc(3600.0 * {_M} / 50000.0) AS BIGINT) * 1000000 AS hi, {_M} AS distance_m FROM mv WHERE to_t IS NOT NULL")
def track_make(s, d):
    from meridian.functions import geo

    moves = presence.tracks(presence.movements(pres(s, d)))
    return moves.select("track", C("from_t").alias("lo"), (C("from_t") + geo.travel_seconds(C("distance_m"), 50.0) * 1_000_000).alias("hi"), "distance_m")


@query(f"WITH {PRES}, {_moves('pres')} SELECT track, from_t, to_t, to_t - from_t AS duration_us, {_M} AS distance_m FROM mv WHERE to_t IS NOT NULL")
def track_props(s, d):
    return presence.tracks(presence.movements(pres(s, d))).select("track", "from_t", "to_t", "duration_us", "distance_m")


_TR = f"tr AS (SELECT track, from_t AS lo, from_t + CAST(trunc(3600.0 * {_M} / 500000.0) AS BIGINT) * 1000000 AS hi FROM mv WHERE to_t IS NOT NULL)"


@query(f"WITH {PRES}, {_moves('pres')}, {_TR}, n AS (SELECT track, lo, hi, lead(lo) OVER w AS nlo, lead(hi) OVER w AS nhi FROM tr WINDOW w AS (PARTITION BY track ORDER BY lo)) SELECT track, lo, lo <= nhi AND nlo <= hi AS connected FROM n WHERE nlo IS NOT NULL")
def track_connected(s, d):
    from meridian.functions import geo

    moves = presence.tracks(presence.movements(pres(s, d))).select("track", C("from_t").alias("lo"), (C("from_t") + geo.travel_seconds(C("distance_m"), 500.0) * 1_000_000).alias("hi"))
    w = Window.partitionBy("track").orderBy("lo")
    rows = moves.withColumns({"nlo": F.lead("lo").over(w), "nhi": F.lead("hi").over(w)}).where("nlo is not null")
    return rows.select("track", "lo", ((C("lo") <= C("nhi")) & (C("nlo") <= C("hi"))).alias("connected"))


@query(f"WITH {PRES} SELECT track, seq, CASE WHEN seq % 5 = 0 THEN {NINF} ELSE t END AS t, CASE WHEN seq % 3 <> 0 THEN lat END AS lat, CASE WHEN seq % 3 <> 0 THEN lon END AS lon, CAST(CASE WHEN seq % 2 = 0 THEN 2 ELSE 0 END AS INTEGER) AS n_tags FROM pres")
def parse_presence(s, d):
    place = C("seq") % 3 != 0
    t = F.when(C("seq") % 5 == 0, NINF).otherwise(C("t"))
    tags = F.when(C("seq") % 2 == 0, T.build(T.tag("home"), T.tag("by", 'a "b"'))).otherwise(F.array().cast(T.TAGS))
    said = text.format_presence(t, F.when(place, C("lat")), F.when(place, C("lon")), tags)
    return pres(s, d).select("track", "seq", text.parse_presence(said).alias("p")).select("track", "seq", "p.t", "p.lat", "p.lon", F.size("p.tags").alias("n_tags"))
