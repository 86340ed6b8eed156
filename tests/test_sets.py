import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from meridian.functions.moment import HOUR, NINF, PINF
from meridian.operators import joins, sets
from meridian.functions import relations as R
from tests.helpers import HI, LO, frame, got, h, operands

S1, S2, S3 = [(0, 5), (10, 15), (20, 25)], [(1, 4), (11, 14), (21, 24)], [(2, 3), (12, 13), (22, 23)]


def test_and(spark):
    ops = operands(spark, {"three": [S1, S2, S3], "empty": [S1, S2, []]})
    assert got(sets.and_(ops, 3)) == {"three": [(2, 3), (12, 13), (22, 23)]}
    assert sets.and_(ops, 0).count() == 0


def test_or_merges_touching(spark):
    assert got(sets.or_(operands(spark, {"a": [[(0, 1), (4, 5)], [(0, 2), (5, 6)]]}))) == {"a": [(0, 2), (4, 6)]}


def test_not_has_a_domain(spark):
    domain = spark.createDataFrame([("a",), ("b",)], "key string")
    free = sets.not_(operands(spark, {"a": [S1, S2, S3], "c": [S1]}), domain)
    assert got(free) == {"a": [(LO, 0), (5, 10), (15, 20), (25, HI)], "b": [(LO, HI)]}


def test_exclusive_is_not_parity(spark):
    cases = {"two": [[(0, 5)], [(3, 8)]], "three": [[(0, 3)], [(1, 4)], [(2, 5)]], "same": [[(0, 5), (10, 15)]] * 2}
    assert got(sets.exclusive(operands(spark, cases))) == {"two": [(0, 3), (5, 8)], "three": [(0, 1), (4, 5)]}


def test_exclude(spark):
    a, b = frame(spark, {"x": [(0, 10)], "y": [(0, 1)], "z": [(LO, HI)]}), frame(spark, {"x": [(2, 3), (9, 12)], "y": [(0, 1)], "z": [(4, 5)]})
    assert got(sets.exclude(a, b)) == {"x": [(0, 2), (3, 9)], "z": [(LO, 4), (5, HI)]}


def test_empty_rows_and_empty_sets(spark):
    assert sets.merge(frame(spark, {"x": [(3, 3), (5, 4)]})).count() == 0
    nothing = frame(spark, {})
    assert sets.merge(nothing).count() == sets.exclusive(operands(spark, {})).count() == 0
    assert sets.equal(frame(spark, {"x": [(0, 1), (1, 2)]}), frame(spark, {"x": [(0, 2)]}))
    assert not sets.equal(frame(spark, {"x": [(0, 1)]}), frame(spark, {"y": [(0, 1)]}))


#: Thirteen places of one interval [10, 20) against a window, a duration of 2, and where it is found.
PLACES = [
    ((5, 8), None, None), ((5, 10), None, None), ((5, 15), (10, 12), (13, 15)), ((10, 15), (10, 12), (13, 15)), ((12, 18), (12, 14), (16, 18)), ((11, 13), (11, 13), (11, 13)),
    ((11, 20), (11, 13), (18, 20)), ((10, 20), (10, 12), (18, 20)), ((5, 20), (10, 12), (18, 20)), ((5, 25), (10, 12), (18, 20)), ((10, 25), (10, 12), (18, 20)),
    ((15, 25), (15, 17), (18, 20)), ((19, 25), None, None), ((20, 25), None, None), ((22, 25), None, None), ((LO, HI), (10, 12), (18, 20)),
]


@pytest.mark.parametrize(("window", "first", "last"), PLACES)
def test_find(spark, window, first, last):
    rows = frame(spark, {"x": [(10, 20)]})
    lo, hi = h(window[0]), h(window[1])
    assert got(sets.find(rows, 2 * HOUR, lo=lo, hi=hi)) == ({"x": [first]} if first else {})
    assert got(sets.find(rows, 2 * HOUR, backward=True, lo=lo, hi=hi)) == ({"x": [last]} if last else {})


def test_find_passes_over_open_ends(spark):
    rows = frame(spark, {"x": [(LO, 3), (5, HI)]})
    assert got(sets.find(rows, HOUR)) == {"x": [(5, 6)]}
    assert got(sets.find(rows, HOUR, backward=True)) == {"x": [(2, 3)]}
    assert sets.find(rows, 0).count() == 0


def test_window_bounds_and_points(spark):
    merged = sets.merge(frame(spark, {"x": [(0, 5), (10, 15)]}))
    assert got(sets.window(merged, h(3), h(12))) == {"x": [(3, 5), (10, 12)]}
    seen = sorted((r["t"], r["value"]) for r in sets.bounds(merged, h(3), h(12)).collect())
    assert seen == [(h(3), True), (h(5), False), (h(10), True), (h(12), False)]
    asked = spark.createDataFrame([("x", h(4)), ("x", h(5))], "key string, t long")
    assert got(sets.at(merged, asked)) == {"x": [(0, 5)]}


def test_total_and_ratio(spark):
    a, b = frame(spark, {"x": [(0, 5), (3, 6)], "y": [(0, 1)]}), frame(spark, {"x": [(0, 12)]})
    assert {r["key"]: r["total"] for r in sets.total(a, lo=h(1), hi=h(20)).collect()} == {"x": 5 * HOUR}
    assert {r["key"]: r["ratio"] for r in sets.ratio(a, b).collect()} == {"x": 0.5, "y": None}
    with pytest.raises(Exception, match="unbounded"):
        sets.total(frame(spark, {"x": [(0, HI)]})).collect()


interval = st.tuples(st.integers(0, 30), st.integers(1, 12)).map(lambda x: (x[0], x[0] + x[1]))
some = st.lists(interval, max_size=6)


def cells(ivs):
    return {c for a, b in ivs for c in range(a, b)}


def runs(found):
    return {k: {c for a, b in v for c in range(int(a), int(b))} for k, v in found.items()}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(some, some, some), min_size=12, max_size=12))
def test_algebra_against_cells(spark, cases):
    named = {str(n): list(c) for n, c in enumerate(cases)}
    ops = operands(spark, named).cache()
    want = {k: [cells(x) for x in c] for k, c in named.items()}
    keep = lambda m: {k: v for k, v in m.items() if v}
    assert runs(got(sets.or_(ops))) == keep({k: a | b | c for k, (a, b, c) in want.items()})
    assert runs(got(sets.and_(ops, 3))) == keep({k: a & b & c for k, (a, b, c) in want.items()})
    one = lambda a, b, c: {x for x in a | b | c if (x in a) + (x in b) + (x in c) == 1}
    assert runs(got(sets.exclusive(ops))) == keep({k: one(*v) for k, v in want.items()})
    first, second = ops.where("operand = 0"), ops.where("operand = 1")
    assert runs(got(sets.exclude(first, second))) == keep({k: a - b for k, (a, b, _) in want.items()})
    merged = got(sets.merge(ops))
    assert all(b < c for v in merged.values() for (_, b), (c, _) in zip(v, v[1:]))
    assert got(sets.merge(ops, slice_us=3 * HOUR)) == merged
    domain = ops.select("key").distinct()
    free = sets.not_(ops, domain)
    both = free.selectExpr("key", "0 as operand", "lo", "hi").unionByName(sets.or_(ops).selectExpr("key", "1 as operand", "lo", "hi"))
    assert sets.and_(both, 2).count() == 0  # a and not a
    assert all(v == [(NINF, PINF)] for v in got(sets.or_(both)).values())


def test_sliced_join_finds_each_pair_once(spark):
    r = random.Random(1)
    rows = [(str(n % 3), n, a, a + r.randrange(1, 9)) for n in range(60) for a in [r.randrange(0, 40)]]
    df = spark.createDataFrame([(k, n, h(a), h(b)) for k, n, a, b in rows], "key string, id int, lo long, hi long")
    for name, touching in (("intersects", False), ("connects", True), ("meets", True), ("during", True)):
        found = joins.overlapping(df, df, ["key"], 5 * HOUR, R.PREDICATES[name], touching).select("id", "b_id").collect()
        holds = {"intersects": lambda a, b, c, d: a < d and c < b, "connects": lambda a, b, c, d: a <= d and c <= b, "meets": lambda a, b, c, d: b == c, "during": lambda a, b, c, d: a > c and b < d}[name]
        want = sorted((x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and holds(x[2], x[3], y[2], y[3]))
        assert sorted((x["id"], x["b_id"]) for x in found) == want
