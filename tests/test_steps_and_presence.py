import random

from meridian.functions.moment import HOUR
from meridian.operators import presence, steps
from tests.helpers import HI, LO, back, h


def log_frame(spark, cases):
    rows = [(k, n, h(a), h(b), v) for k, c in cases.items() for n, (a, b, v) in enumerate(c)]
    return spark.createDataFrame(rows, "key string, seq long, lo long, hi long, value string")


def parts(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["key"], []).append((back(r["lo"]), back(r["hi"]), r["value"]))
    return {k: sorted(v, key=lambda x: x[0]) for k, v in out.items()}


def test_interval_map_window(spark):
    log = log_frame(spark, {"x": [(0, 5, "e1"), (10, 15, "e2"), (20, 25, "e2")]})
    rows = steps.with_default(steps.put_disjoint(log), log, h(-10), h(22), __import__("pyspark").sql.functions.lit("d"))
    assert parts(rows) == {"x": [(-10, 0, "d"), (0, 5, "e1"), (5, 10, "d"), (10, 15, "e2"), (15, 20, "d"), (20, 22, "e2")]}


def test_range_maps(spark):
    cases = {"touch": [(0, 10, "a"), (10, 20, "a")], "over": [(0, 10, "a"), (2, 5, "b"), (1, 8, "a")], "inf": [(LO, HI, "a"), (0, 1, "b")]}
    log = log_frame(spark, cases)
    assert parts(steps.put_disjoint(log)) == {"touch": [(0, 20, "a")], "over": [(0, 10, "a")], "inf": [(LO, 0, "a"), (0, 1, "b"), (1, HI, "a")]}
    kept = parts(steps.put_nonoverlapping(log))
    assert kept["touch"] == [(0, 10, "a"), (10, 20, "a")] and kept["over"] == [(0, 1, "a"), (1, 8, "a"), (8, 10, "a")]


def test_edit_logs_against_a_fold(spark):
    r = random.Random(4)
    cases = {str(k): [(a, a + r.randrange(1, 10), r.choice(["a", "b", None])) for _ in range(r.randrange(1, 12)) for a in [r.randrange(0, 30)]] for k in range(40)}
    want = {}
    for k, c in cases.items():
        cell = {}
        for a, b, v in c:
            cell |= dict.fromkeys(range(a, b), v)
        want[k] = {t: v for t, v in cell.items() if v is not None}
    for sliced in (None, 4 * HOUR):
        found = parts(steps.put_disjoint(log_frame(spark, cases), slice_us=sliced))
        assert {k: {t: v for a, b, v in found.get(k, []) for t in range(int(a), int(b))} for k in cases} == want
        assert all(x[1] < y[0] or x[2] != y[2] for rows in found.values() for x, y in zip(rows, rows[1:]))


def points_frame(spark, cases):
    return spark.createDataFrame([(k, h(t), v) for k, c in cases.items() for t, v in c], "key string, t long, value string")


def test_asof_against_plain_python(spark):
    r = random.Random(2)
    facts = {str(k): [(t, f"{k}-{t}") for t in sorted(r.sample(range(30), 8))] for k in range(5)}
    asked = [(str(k), h(t), k * 100 + t) for k in range(6) for t in range(-1, 31)]
    queries = spark.createDataFrame(asked, "key string, t long, id int")
    for how, holds, best in (("floor", lambda f, t: f <= t, max), ("lower", lambda f, t: f < t, max), ("ceiling", lambda f, t: f >= t, min), ("higher", lambda f, t: f > t, min)):
        for sliced in (None, 7 * HOUR):
            found = {r["id"]: r["value"] for r in steps.asof(queries, points_frame(spark, facts), ["value"], how=how, slice_us=sliced).collect()}
            for k, t, i in asked:
                near = [x for x in facts.get(k, []) if holds(h(x[0]), t)]
                assert found[i] == (best(near)[1] if near else None)


def test_compact_and_remove(spark):
    p = points_frame(spark, {"x": [(0, "a"), (1, "a"), (2, None), (3, None), (4, "a")]})
    assert sorted((back(r["t"]), r["value"]) for r in steps.compact(p).collect()) == [(0, "a"), (2, None), (4, "a")]
    assert steps.remove(p, h(1), h(3)).count() == 3 and steps.remove(p, h(1), h(3), False, True).count() == 3


def pres(spark, rows):
    return spark.createDataFrame([(k, h(t), lat, lon) for k, t, lat, lon in rows], "track string, t long, lat double, lon double")


def test_presence_window_edges(spark):
    df = pres(spark, [("a", 0, 0.0, 0.0), ("a", 5, 5.0, 5.0), ("a", 10, 9.0, 9.0)])
    domain = spark.createDataFrame([("a",), ("b",)], "track string")

    def seen(lo, hi):
        out = {}
        for r in presence.window(df, h(lo), h(hi), domain).collect():
            out.setdefault(r["track"], []).append((back(r["t"]), r["lat"]))
        return {k: sorted(v) for k, v in out.items()}

    assert seen(LO, 2) == {"a": [(LO, None), (0, 0.0), (2, 5.0)], "b": [(LO, None), (2, None)]}
    assert seen(0, 5)["a"] == [(0, 0.0), (5, 5.0)]
    assert seen(6, 20)["a"] == [(6, 5.0), (10, 9.0), (20, None)]
    moves = presence.tracks(presence.movements(presence.window(df, h(6), h(20), domain))).collect()
    assert sorted((r["track"], back(r["from_t"]), r["distance_m"] > 0) for r in moves) == [("a", 6, True), ("a", 10, False), ("b", 6, False)]


def test_last_write_wins(spark):
    log = spark.createDataFrame([("a", h(0), 1, 1.0, 1.0), ("a", h(0), 3, 3.0, 3.0), ("a", h(0), 2, 2.0, None)], "track string, t long, seq long, lat double, lon double")
    assert [(r["lat"], r["seq"]) for r in presence.load(log).collect()] == [(3.0, 3)]
