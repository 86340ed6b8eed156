import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from meridian.functions import tags as T
from meridian.functions.moment import HOUR
from meridian.operators import container as K
from meridian.operators import flow, matrix_cache, schedule, space, timeline
from tests.helpers import HI, LO, back, got, h

FREE = [(LO, HI)]


def plan(spark, cases):
    """cases: {id: (window, availability, steps)}; a step: (hours, window, flags)."""
    steps, free = [], []
    for q, (win, avail, asked) in cases.items():
        for n, s in enumerate(asked):
            dur, (a, b), flags = (*s, FREE[0], "")[:3] if len(s) == 1 else (*s, "")[:3]
            steps.append((q, n, int(dur * HOUR), h(a), h(b), "L" in flags, "C" in flags, h(win[0]), h(win[1])))
            free += [(q, n, h(x), h(y)) for x, y in avail]
    schema = "query_id string, step int, dur long, step_lo long, step_hi long, locked boolean, center boolean, win_lo long, win_hi long"
    wanted = spark.createDataFrame(steps, schema)
    placed = schedule.place(wanted, spark.createDataFrame(free, "query_id string, step int, lo long, hi long"), max(len(c[2]) for c in cases.values()))
    out = {}
    for r in placed.collect():
        out.setdefault(r["query_id"], []).append((r["step"], r["success"], None if r["lo"] is None else (back(r["lo"]), back(r["hi"]))))
    return wanted, {q: [x[1:] for x in sorted(v)] for q, v in out.items()}


def test_schedule(spark):
    gaps = [(0, 2), (3, 5), (6, 8), (9, 13)]
    _, found = plan(
        spark,
        {
            "center": ((5, 24), [(0, 24)], [(1,), (2, (5, 8), "C"), (3,)]),
            "late": (FREE[0], gaps, [(2,), (1,), (2, (4, 13), "C"), (1, (10, 24))]),
            "locked": (FREE[0], gaps, [(1,), (1,), (1, (5, 6), "L"), (1, (10, 11))]),
            "breach": (FREE[0], gaps, [(2,), (1, (1, 2), "L"), (1,)]),
            "none": (FREE[0], gaps, [(5,), (1,)]),
            "zero": ((1, 9), gaps, [(0,), (1,)]),
        },
    )
    ok = lambda *x: [(True, p) for p in x]
    assert found["center"] == ok((5, 6), (6, 8), (8, 11))
    assert found["late"] == ok((0, 2), (4, 5), (6, 8), (10, 11))
    assert found["locked"] == ok((0, 1), (1, 2), (5, 6), (10, 11))
    assert found["breach"] == [(True, (0, 2)), (False, None), (False, None)]
    assert found["none"] == [(False, None), (False, None)]
    assert found["zero"] == ok(None, (1, 2))


def plain_plan(win, avail, asked):
    """One query by hand, in whole hours."""
    out, ptr = [], win[0]
    for dur, (a, b), flags in asked:
        if "L" in flags:
            place = (a, b) if ptr <= a else None
        else:
            place = next(((s, s + dur) for s in range(-1, 60) if any(x <= s and s + dur <= y for x, y in avail) and s >= max(win[0], ptr, a) and s + dur <= min(win[1], b)), None)
        if place is None:
            return None
        out.append(place)
        ptr = place[1]
    mid = next((n for n, s in enumerate(asked) if "C" in s[2]), None)
    if mid is not None:
        limit = out[mid][0]
        for n in range(mid - 1, -1, -1):
            dur, (a, b), _ = asked[n]
            out[n] = next((s, s + dur) for s in range(60, -2, -1) if any(x <= s and s + dur <= y for x, y in avail) and s >= a and s + dur <= min(b, limit))
            limit = out[n][0]
    return out


def test_schedules_against_plain_python(spark):
    r = random.Random(8)
    cases = {}
    for q in range(120):
        avail, at = [], 0
        for _ in range(r.randrange(1, 7)):
            a = at + r.randrange(1, 5)
            at = a + r.randrange(1, 7)
            avail.append((a, at))
        flags = r.choice(["", "C", "L", ""])
        special = r.randrange(3)
        asked = []
        for n in range(3):
            a = r.randrange(0, 12)
            window = (a, a + r.randrange(3, 30)) if r.random() < 0.4 or n == special and flags == "L" else (0, 60)
            asked.append((r.randrange(1, 4), window, flags if n == special else ""))
        cases[str(q)] = ((r.randrange(0, 4), r.randrange(12, 50)), avail, asked)
    wanted, found = plan(spark, cases)
    assert schedule.validate(wanted).count() == 0
    for q, case in cases.items():
        want = plain_plan(*case)
        success = all(s for s, _ in found[q])
        assert success == (want is not None), (q, case)
        if want:
            assert [p for _, p in found[q]] == want, (q, case)


# --- containers -----------------------------------------------------------------------------------


def container_rows(spark):
    sets_ = {"a": ([(0, 5), (10, 15)], [("availability", None)]), "b": ([(3, 8)], [("availability", None)]), "c": ([(2, 30)], [("window", None)]), "d": ([(12, 14), (20, 40)], [("global", "absence")])}
    rows = [("x", i, tags, h(a), h(b)) for i, (ivs, tags) in sets_.items() for a, b in ivs]
    return spark.createDataFrame(rows, f"container string, id string, tags {T.TAGS}, lo long, hi long")


def tagged(name):
    return K.collections(T.any_of(F.col("tags"), (name, None)))


def test_container_expression(spark):
    rows = container_rows(spark)
    wanted = K.and_(K.and_(K.or_(tagged("availability")), tagged("window")), K.not_(K.collections(T.any_of(F.col("tags"), ("global", None), ("absence", None)))))
    assert got(K.combine(rows, wanted), "container") == {"x": [(2, 8), (10, 12), (14, 15)]}
    assert got(K.combine(rows, K.not_(K.not_(tagged("window")))), "container") == {"x": [(2, 30)]}
    assert got(K.combine(rows, tagged("availability")), "container") == {"x": [(3, 5)]}
    assert got(K.combine(rows, K.and_(tagged("none").else_always(), tagged("window"))), "container") == {"x": [(2, 30)]}
    assert K.combine(rows, K.and_(tagged("none").else_empty(), tagged("window"))).count() == 0
    with pytest.raises(Exception, match="no collection"):
        K.combine(rows, K.and_(tagged("none"), tagged("window"))).collect()
    assert got(K.get(rows, "a"), "container") == {"x": [(0, 5), (10, 15)]} and K.get(rows, "q").count() == 0
    twice = rows.select("container", "id", "tags").distinct()
    assert K.unique_ids(twice).count() == 0 and K.unique_ids(twice.unionByName(twice)).count() == 4
    assert K.simplified(K.or_(K.or_(tagged("a"), tagged("b")), tagged("c"))).operator == "or"
    assert len(K.simplified(K.or_(K.or_(tagged("a"), tagged("b")), tagged("c"))).operands) == 3


# --- timelines ------------------------------------------------------------------------------------


def layer_log(spark, ops):
    return spark.createDataFrame([("t", "l", n, op, h(a), h(b), tag) for n, (op, a, b, tag) in enumerate(ops)], "timeline string, layer string, seq long, op string, lo long, hi long, tag string")


def test_merge_layer(spark):
    def read(ops):
        rows = timeline.merge_layer(layer_log(spark, ops).withColumnRenamed("tag", "tags")).collect()
        return sorted((back(r["lo"]), back(r["hi"]), r["tags"]) for r in rows)

    assert read([("put", 0, 15, "t1"), ("put", 10, 20, "t2"), ("put", 20, 30, "t2")]) == [(0, 10, "t1"), (10, 30, "t2")]
    assert read([("put", 0, 10, "t1"), ("put", 20, 30, "t2"), ("remove", 5, 25, None)]) == [(0, 5, "t1"), (25, 30, "t2")]


def test_lanes(spark):
    ops = [("put", 0, 15, "t1"), ("put", 10, 30, "t2"), ("put", 15, 20, "t1"), ("put", 12, 13, "t3"), ("remove", 12, 13, None), ("put", 12, 13, "t4")]
    rows = timeline.lanes(layer_log(spark, ops)).collect()
    assert sorted((r["lane"], back(r["lo"]), back(r["hi"]), r["tag"]) for r in rows) == [(0, 0, 12, "t1"), (0, 12, 13, "t4"), (0, 13, 20, "t1"), (1, 10, 12, "t2"), (1, 13, 30, "t2")]
    events = layer_log(spark, ops[:2])
    seen = timeline.select_events(events, h(5), h(25)).orderBy("pos").collect()
    assert [(back(r["lo"]), back(r["hi"]), r["tag"]) for r in seen] == [(5, 15, "t1"), (10, 25, "t2")]
    assert timeline.conflicts(events).count() == 1
    assert got(timeline.busy(events, ["timeline"]), "timeline") == {"t": [(0, 30)]}
    with pytest.raises(ValueError):
        timeline.require(timeline.PRESENCE, "event")


def test_layers(spark):
    layers = spark.createDataFrame([("t", "a", timeline.INTERVAL, [("x", None)])], f"timeline string, layer string, kind string, tags {T.TAGS}")
    more = timeline.duplicate_layer(timeline.add_layer(layers, "t", "b", timeline.MERGE), "t", "a", "c")
    assert sorted(r["layer"] for r in more.collect()) == ["a", "b", "c"]
    assert sorted(r["layer"] for r in timeline.find_layers(timeline.remove_layer(more, "t", "c"), ("x", None)).collect()) == ["a"]
    with pytest.raises(Exception, match="taken"):
        timeline.add_layer(layers, "t", "a", timeline.MERGE).collect()


def test_lanes_never_overlap():
    r = random.Random(3)
    log = pd.DataFrame([("put" if r.random() < 0.8 else "remove", a, a + r.randrange(1, 9), r.choice("ab")) for _ in range(200) for a in [r.randrange(0, 90)]], columns=["op", "lo", "hi", "tag"])
    for lane in timeline.first_fit(log):
        assert lane and all(x[1] < y[0] or x[1] == y[0] and x[2] != y[2] for x, y in zip(lane, lane[1:]))


# --- space ----------------------------------------------------------------------------------------


def plain_metres(a, b):
    import math

    (la, lo), (lb, lp) = a, b
    x = math.sin(math.radians(lb - la) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(lb)) * math.sin(math.radians(lp - lo) / 2) ** 2
    return int(2 * 6371000 * math.asin(math.sqrt(min(1, x))))


@pytest.mark.parametrize("radius", [0, 3000, 400_000, 3_000_000, 25_000_000])
def test_radius_links_against_all_pairs(spark, radius):
    r = random.Random(radius)
    spots = [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(150)] + [(89.9, x) for x in (-170, 0, 90)] + [(10.0, 179.99), (10.0, -179.99), (10.0, 180.0), (90.0, 5.0), (-90.0, 7.0), (10.0, 179.99)]
    spots += [(52.52, 13.405), (52.5096, 13.3739), (52.5219, 13.4132), (48.1351, 11.582)]
    df = spark.createDataFrame([(i, *map(float, s)) for i, s in enumerate(spots)], "id long, lat double, lon double")
    found = sorted((x["a"], x["b"]) for x in space.within(df, radius).collect())
    same = lambda i, j: spots[i] == spots[j] if radius == 0 else plain_metres(spots[i], spots[j]) <= radius
    assert found == [(i, j) for i in range(len(spots)) for j in range(i + 1, len(spots)) if same(i, j)]


def test_clusters(spark):
    spots = [(52.52, 13.405), (52.5096, 13.3739), (52.5219, 13.4132), (48.1351, 11.582)]
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(spots)], "id long, lat double, lon double")
    assert sorted((r["id"], r["cluster"]) for r in space.clusters(df, 3000).collect()) == [(0, 0), (1, 0), (2, 0), (3, 1)]


def test_matrices(spark):
    df = spark.createDataFrame([(i, 0.0, float(i)) for i in range(5)], "id long, lat double, lon double")
    from meridian.functions import geo

    od = space.matrix(space.pairs(df, df), space.metric(geo.pythagorean), 3600.0, 1000.0)
    assert all(r["distance_m"] == 1000 * abs(r["o"] - r["d"]) and r["duration_s"] == 3600 * abs(r["o"] - r["d"]) for r in od.collect())
    assert space.complete(od) and not space.complete(od.where("o <> 1 or d <> 2"))
    asked = spark.createDataFrame([(None, 1), (2, 2), (0, 3)], "o long, d long")
    assert sorted((r["d"], r["distance_m"]) for r in space.resolve(asked, od).collect()) == [(1, 0), (2, 0), (3, 3000)]
    with pytest.raises(Exception, match="unknown location"):
        space.resolve(spark.createDataFrame([(9, 1)], "o long, d long"), od).collect()


def test_matrix_cache(spark):
    calls, now = [], [0.0]

    def fetch(o, d):
        calls.append((len(o), len(d)))
        return spark.createDataFrame([(a, b, a * b, a + b) for a in o for b in d], "o long, d long, distance_m long, duration_s long")

    cache = matrix_cache.MatrixCache(fetch, max_size=2, expire_s=10, clock=lambda: now[0])
    assert cache.get([1, 2, 3]).count() == 9 and cache.get([3, 2, 1]).count() == 9 and calls == [(3, 3)]
    assert cache.get([1, 2]).count() == 9  # covered: the stored superset
    extended = cache.get([1, 2, 3, 4])
    assert extended.count() == 16 and extended.select("o", "d").distinct().count() == 16 and calls[1:] == [(1, 3), (3, 1), (1, 1)]
    s = cache.statistics
    assert (s.requests, s.quick_hits, s.covered, s.partial, s.full, s.fetched_cells) == (4, 1, 1, 1, 1, 16)
    cache.get([7, 8, 9])
    assert s.full == 2 and s.evicted == 1 and len(cache.entries) == 2
    now[0] = 60.0
    cache.get([7, 8, 9])
    assert s.expired == 2 and s.full == 3
    assert matrix_cache.plan(2, 1, 2) == ("FULL", 4) and matrix_cache.plan(4, 1, 3) == ("PARTIAL", 9)


# --- dataflow -------------------------------------------------------------------------------------


def test_flow(spark):
    df = spark.createDataFrame([("a", t, v) for t, v in enumerate([1, 2, 9, 1, None, 3])] + [("b", 0, 9)], "key string, t int, v int")
    seen = lambda d: sorted((r["key"], r["t"]) for r in d.collect())
    assert seen(flow.take_while(df, F.col("v") < 5, ["t"])) == [("a", 0), ("a", 1)]
    assert seen(flow.drop_while(df, F.col("v") < 5, ["t"])) == [("a", 2), ("a", 3), ("a", 4), ("a", 5), ("b", 0)]
    assert seen(flow.limit(df, 2, ["t"], skip=1)) == [("a", 1), ("a", 2)]
    assert flow.pairwise(df, ["v"], ["t"]).count() == 5 and flow.first(df, "t").count() == 2
    assert seen(flow.pipeline(lambda d: d.where("t > 0"), lambda d: flow.skip(d, 3, ["t"]))(df)) == [("a", 4), ("a", 5)]
    assert flow.unfold(df.where("key = 'b'"), F.lit(1), F.lit(2), F.lit(7)).count() == 4
    met = flow.multiplex("t", "v", df, df).where("key = 'a' and t = 2").first()
    assert met["values"] == [9, 9]
