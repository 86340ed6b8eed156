"""Look-ups, checks that raise, plans of the cache, relations by their SQL names."""

import itertools

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from meridian.functions import relations
from meridian.operators import joins, matrix_cache, sets, space, timeline
from meridian.plans import sql


def test_at_and_enclosing_with_nulls_and_ties(spark):
    merged = spark.createDataFrame([("x", 0, 5), ("x", 7, 9), (None, 1, 3), ("y", 2, 4)], "key string, lo long, hi long")
    asked = [("x", -1), ("x", 0), ("x", 4), ("x", 5), ("x", 6), ("x", 8), (None, 2), ("z", 2), ("x", 8)]
    got = sets.at(merged, spark.createDataFrame(asked, "key string, t long"), how="left").collect()
    held = {("x", 0): (0, 5), ("x", 4): (0, 5), ("x", 8): (7, 9), (None, 2): (1, 3)}
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((*a, *held.get(a, (None, None)))) for a in asked)
    inner = sets.at(merged, spark.createDataFrame(asked, "key string, t long"))
    assert inner.count() == 5
    parts = spark.createDataFrame([("x", 0, 5, "a"), ("x", 1, 6, "b"), ("x", 7, 8, "c"), (None, 0, 2, "d"), (None, 1, 2, "e")], "key string, lo long, hi long, name string")
    assert {r["name"] for r in sets.enclosing(merged, parts).collect()} == {"a", "c", "e"}


def test_conflicts_and_free_by_slices(spark):
    rows = [("t", "l", n, "put", n * 7 % 50, n * 7 % 50 + 1 + n % 9) for n in range(40)] + [("t", "l", 90, "remove", 0, 99), ("u", "l", 91, "put", 5, 5)]
    log = spark.createDataFrame(rows, "timeline string, layer string, seq long, op string, lo long, hi long")
    puts = [r for r in rows if r[3] == "put" and r[4] < r[5]]
    want = {(a[2], b[2]) for a in puts for b in puts if a[0] == b[0] and b[2] < a[2] and a[4] < b[5] and b[4] < a[5]}
    for width in (3, 1000):
        got = timeline.conflicts(log, slice_us=width).collect()
        assert len(got) == len(want) and {(r["seq"], r["with_seq"]) for r in got} == want
        windows = spark.createDataFrame([("t", "l", i, i + 2) for i in range(-5, 70)] + [("u", "l", 5, 6)], "timeline string, layer string, lo long, hi long")
        free = {(r["timeline"], r["lo"]) for r in timeline.free(windows, log.where("op = 'put'"), slice_us=width).collect()}
        assert free == {("t", i) for i in range(-5, 70) if not any(p[4] < i + 2 and i < p[5] for p in puts)} | {("u", 5)}
    assert joins.overlapping(windows.limit(0), windows, ["timeline", "layer"], 5).count() == 0


def test_checks_raise(spark):
    od = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2)], "o long, d long")
    assert space.built(od).count() == 4
    with pytest.raises(ValueError, match="one cell"):
        space.built(od.where("not (o = 2 and d = 1)"))
    with pytest.raises(ValueError, match="one cell"):
        space.built(od.unionByName(od.limit(1)))
    good = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id long, cluster int")
    assert sorted(map(tuple, space.validated(good).collect())) == [(1, 0), (2, 0), (3, 1)]
    with pytest.raises(PySparkException, match="two clusters"):
        space.validated(good.unionByName(spark.createDataFrame([(2, 1)], "id long, cluster int"))).collect()


def test_asked_pairs_only(spark):
    loc = spark.createDataFrame([(i, float(i), float(-i)) for i in range(5)], "id long, lat double, lon double")
    asked = spark.createDataFrame([(0, 1), (0, 1), (3, 2), (4, 9), (None, 1)], "o long, d long")
    assert sorted(map(tuple, space.asked_pairs(asked, loc, loc).select("o", "d", "olat", "dlon").collect())) == [(0, 1, 0.0, -1.0), (3, 2, 3.0, -2.0)]


def test_cache_extends_where_costs_are_equal(spark):
    fetched = []

    def fetch(origins, destinations):
        fetched.append((len(origins), len(destinations)))
        return spark.createDataFrame([(o, d, 1, 1) for o in origins for d in destinations], "o long, d long, distance_m long, duration_s long")

    cache = matrix_cache.MatrixCache(fetch)
    cache.get([100, 101, 102, 103])  # lacks all of what is asked below, so would be fetched in full
    cache.get([1, 2, 3])
    fetched.clear()
    assert matrix_cache.plan(3, 1, 3)[0] == "PARTIAL"
    cache.get([2, 3, 4])
    assert cache.statistics.partial == 1 and sum(a * b for a, b in fetched) == 7


def test_relations_by_sql_names(spark):
    names = sql.register(spark)
    assert {f"rel_{n}" for n in relations.PREDICATES} <= set(names)
    spots = list(itertools.combinations(range(4), 2))
    table = spark.createDataFrame([(*a, *b) for a in spots for b in spots], "al long, ah long, bl long, bh long")
    four = [F.col(c) for c in ("al", "ah", "bl", "bh")]
    for name, holds in relations.PREDICATES.items():
        assert table.where(F.expr(f"rel_{name}(al, ah, bl, bh)") != holds(*four)).count() == 0, name
