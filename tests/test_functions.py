import pytest
from pyspark.sql import functions as F

from meridian.functions import geo, interval as I, moment as M, relations as R, tags as T
from meridian.functions.moment import DAY, HOUR, NINF, PINF
from meridian.plans import sql
from meridian.sources import json_forms as J
from meridian.sources import text as X
from tests.helpers import H0, h


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def us(y, *rest):
    import datetime as dt

    return int(dt.datetime(y, *rest, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000


@pytest.mark.parametrize(
    ("text", "value"),
    [("inf", PINF), (" +∞ ", PINF), ("ninf", NINF), ("-∞", NINF), ("-ninf", None), ("2024-01-01T00:00:00Z", H0), ("2024-01-01T02:00:00.5+02:00", H0 + 500_000), ("2024-01-01T00:00Z", H0), ("2024-01-01", None), ("", None), (None, None)],
)
def test_parse_moment(spark, text, value):
    assert one(spark, M.parse(F.lit(text))) == value


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("always", (NINF, PINF)), ("[-∞..∞)", (NINF, PINF)), ("(2024-01-01T00:00:00Z..inf)", (H0, PINF)), ("[ninf..2024-01-01T00:00:00Z)", (NINF, H0)),
        ("[2024-01-01T00:00:00Z..2024-01-01T01:00:00Z]", None), ("[2024-01-01T01:00:00Z..2024-01-01T00:00:00Z)", None), ("[a..b)", None), ("[1)", None), (None, None),
    ],
)
def test_parse_interval(spark, text, value):
    found = one(spark, I.parse(F.lit(text)))
    assert (found and tuple(found)) == value


ALLEN = [
    ((0, 1), (2, 3), "is before"), ((0, 2), (2, 3), "meets"), ((0, 2), (1, 3), "overlaps"), ((0, 1), (0, 3), "starts"), ((1, 2), (0, 3), "during"), ((1, 3), (0, 3), "finishes"), ((0, 3), (0, 3), "equals to"),
    ((0, 3), (1, 3), "is finished by"), ((0, 3), (1, 2), "contains"), ((0, 3), (0, 1), "is started by"), ((1, 3), (0, 2), "is overlapped by"), ((2, 3), (0, 2), "is met by"), ((2, 3), (0, 1), "is after"),
]


def test_relations(spark):
    df = spark.createDataFrame([(a, b, c, d, name, n) for n, ((a, b), (c, d), name) in enumerate(ALLEN)], "al long, ah long, bl long, bh long, name string, n int")
    four = [F.col(c) for c in ("al", "ah", "bl", "bh")]
    each = [p(*four).cast("int") for p in (x[1] for x in R.BASIC)]
    rows = df.select("*", R.name(*four).alias("said"), R.flags(*four).alias("flag"), sum(each[1:], each[0]).alias("total"), *[p(*four).alias(f"c_{n}") for n, p in R.COMBINED.items()]).collect()
    for r in rows:
        assert r["said"] == r["name"] and r["flag"] == 1 << r["n"] and r["total"] == 1
        assert r["c_distinct"] != r["c_intersects"] and r["c_adjacent"] == (r["n"] in (1, 11)) and r["c_connects"] == (r["c_intersects"] or r["c_adjacent"])
        assert r["c_encloses"] == (r["n"] in (6, 7, 8, 9))
    names = sql.register(spark)
    df.createOrReplaceTempView("allen")
    for n in names:
        if n.startswith("rel_"):
            assert spark.sql(f"select count(*) from allen where {n}(al, ah, bl, bh)").first()[0] == df.where(R.PREDICATES[n[4:]](*four)).count()
    assert spark.sql(f"select moment_shift({PINF}, 5) as a, interval_intersect(0, 5, 3, 9).lo as b, interval_duration({NINF}, 3) as c").first()[:] == (PINF, 3, None)


def test_days_of_clock_changes(spark):
    year = I.days(F.lit(us(2024, 1, 1)), F.lit(us(2025, 1, 1)), "Europe/Tirane")
    days = [(d["lo"], d["hi"]) for d in one(spark, year)]
    lengths = {lo: (hi - lo) // HOUR for lo, hi in days}
    assert lengths[us(2024, 3, 30, 23)] == 23 and lengths[us(2024, 10, 26, 22)] == 25
    assert all(a[1] == b[0] for a, b in zip(days, days[1:]))
    eve = us(2024, 3, 30, 12)
    assert tuple(one(spark, I.day_by_offset(F.lit(eve), "Europe/Budapest"))) == (us(2024, 3, 29, 23), us(2024, 3, 30, 22))
    assert tuple(one(spark, I.day(F.lit(eve), "Europe/Budapest"))) == (us(2024, 3, 29, 23), us(2024, 3, 30, 23))
    midnight = us(2024, 3, 30, 23)
    assert tuple(one(spark, I.day_by_offset(F.lit(midnight), "Europe/Budapest"))) == (midnight, midnight + 23 * HOUR)


def test_daily_and_steps(spark):
    night = I.daily(F.lit(H0), F.lit(H0 + 2 * DAY), 22 * HOUR, 6 * HOUR, "UTC", True)
    assert [(x["lo"], x["hi"]) for x in one(spark, night)] == [(h(22), h(30)), (h(46), h(48))]
    assert one(spark, I.steps(F.lit(h(0)), F.lit(h(5)), F.lit(HOUR // 2))) == [h(n / 2) for n in range(10)]


def test_errors(spark):
    for bad in (I.interval(F.lit(2), F.lit(1)), M.clamp(F.lit(0), F.lit(2), F.lit(2)), I.align(F.col("id") + NINF, F.col("id"), F.lit(1), F.lit(I.STARTS)), M.strict(M.parse(F.lit("x")), F.lit("x"))):
        with pytest.raises(Exception, match="before|infinite|parse"):
            one(spark, bad)


def test_distances(spark):
    paris = geo.haversine(F.lit(52.52), F.lit(13.405), F.lit(48.8566), F.lit(2.3522))
    assert abs(one(spark, paris) / 1000 - 876) <= 5
    assert abs(one(spark, geo.travel_seconds(paris, 50.0)) / 3600 - 17.5) < 0.5
    assert one(spark, geo.haversine(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(0.0))) is None
    assert one(spark, geo.to_unit(F.lit(3219), "mile")) == 2 and one(spark, geo.parse(F.lit("anywhere"))) is None


def some_tags():
    return T.build(T.tag("tag1"), T.tag("tag2", "2.1"), T.tag("tag2", "2.2"), T.tag("tag2", "2.2"), T.tag("tag3", "v"))


def test_tags(spark):
    tags = some_tags()
    assert one(spark, F.size(tags)) == 4
    assert one(spark, T.is_multiple(tags, "tag2")) and not one(spark, T.is_multiple(tags, "tag1"))
    assert one(spark, T.any_of(tags, ("tag2", None))) and not one(spark, T.any_of(tags, ("tag1", "x")))
    assert one(spark, T.has(tags, "tag1")) and not one(spark, T.has(tags, "tag2"))
    assert one(spark, T.values(tags, "tag2")) == ["2.1", "2.2"] and one(spark, T.value(tags, "none", "d")) == "d"
    nothing = F.lit(None).cast(T.TAGS)
    assert not one(spark, T.any_of(nothing, ("a", None))) and one(spark, T.none_of(nothing, ("a", None)))
    odd = T.build(T.tag('a"b\\', 'c:"d"'), T.tag("e"))
    assert one(spark, T.parse(T.format_tags(odd))) == one(spark, odd)
    for wrong in (T.any_of, T.all_of, T.none_of):
        with pytest.raises(ValueError):
            wrong(tags)


def test_texts_and_json(spark):
    tags = some_tags()
    said = X.format_presence(F.lit(H0), F.lit(1.5), F.lit(-2.25), tags)
    p = one(spark, X.parse_presence(said))
    assert (p["t"], p["lat"], p["lon"], len(p["tags"])) == (H0, 1.5, -2.25, 4)
    assert one(spark, X.parse_presence(F.lit("nowhere"))) is None and one(spark, X.parse_presence(F.lit("anywhere@inf")))["t"] == PINF
    assert [tuple(x) for x in one(spark, J.read_intervals(F.lit('"always"')))] == [(NINF, PINF)]
    assert one(spark, J.read_intervals(F.lit("[]"))) == []
    assert one(spark, J.read_distance(F.lit("123m"))) == 123 and one(spark, J.read_distance(F.lit("1km"))) is None
    assert one(spark, J.write_tags(tags)) == '[["tag1"],["tag2","2.1"],["tag2","2.2"],["tag3","v"]]'
    d = one(spark, J.read_direction(F.lit('{"origin":"1.0,2.0","destination":"3.0,4.0","distance":"5m","duration":6}')))
    assert (d["origin"]["lat"], d["destination"]["lon"], d["distance_m"], d["duration_s"]) == (1.0, 4.0, 5, 6)
    rows = one(spark, J.read_timeline(F.lit('{"layers":[{"type":"INTERVAL","id":"a","tags":[["x","y"]],"intervals":["always"]}]}')))
    assert rows[0]["rows"][0]["lo"] == NINF and rows[0]["tags"][0]["value"] == "y"
