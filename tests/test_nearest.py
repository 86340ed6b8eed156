"""The nearest and farthest locations, by cells and by broadcast, against all pairs in plain Python."""

import math
import random

import pytest

from meridian.functions import geo
from meridian.operators import nearest, space

R = geo.EARTH_RADIUS_M


def great_circle(a, b):
    dlat, dlon = math.radians(b[0] - a[0]), math.radians(b[1] - a[1])
    h = math.sin(dlat / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(dlon / 2) ** 2
    return int(2.0 * R * math.asin(math.sqrt(min(1.0, h))))


def plane(a, b):
    return math.hypot(a[0] - b[0], a[1] - b[1])


def places(n, seed):
    """A town, copies of one place, places around the poles and the 180th meridian, and a few anywhere."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        kind = i % 5
        if kind == 0:
            out.append((i, 52.5 + r.gauss(0, 0.05), 13.4 + r.gauss(0, 0.05)))
        elif kind == 1:
            out.append((i, 48.0, 11.0))
        elif kind == 2:
            out.append((i, r.choice((89.0, -89.0)) + r.random(), r.uniform(-180, 180)))
        elif kind == 3:
            out.append((i, r.uniform(-1, 1), r.choice((179.5, -180.0)) + r.random() / 2))
        else:
            out.append((i, r.uniform(-90, 90), r.uniform(-180, 180)))
    return out


def plain(origins, locations, k, far, itself, measure):
    out = set()
    for o, *a in origins:
        rows = sorted(((-1 if far else 1) * measure(a, b), d) for d, *b in locations if itself or d != o)[:k]
        out |= {(o, d, i + 1) for i, (_, d) in enumerate(rows)}
    return out


@pytest.mark.parametrize("way", ["cells", "broadcast"])
@pytest.mark.parametrize("far, itself, planar", [(False, False, False), (True, False, False), (False, True, True), (True, False, True)])
def test_as_all_pairs(spark, monkeypatch, way, far, itself, planar):
    if way == "cells":
        monkeypatch.setattr(nearest, "FEW", 0)
        monkeypatch.setattr(nearest, "LEAF", 4)
    rows = places(150, 7)
    df = spark.createDataFrame(rows, "id BIGINT, lat DOUBLE, lon DOUBLE")
    fn, measure = (geo.pythagorean, plane) if planar else (geo.haversine, great_circle)
    got = nearest.nearest(df, df, 4, space.metric(fn), slack=1e-9 if planar else 1.0, planar=planar, farthest=far, itself=itself)
    assert {(x["o"], x["d"], x["rank"]) for x in got.collect()} == plain(rows, rows, 4, far, itself, measure)


def test_other_origins_few_and_none(spark, monkeypatch):
    """Fewer locations than k, origins elsewhere, a place without coordinates, an empty table."""
    monkeypatch.setattr(nearest, "FEW", 0)
    schema = "id BIGINT, lat DOUBLE, lon DOUBLE"
    origins, ends = [(1, -35.0, 150.0), (2, 0.0, 0.0)], [(1, 10.0, 10.0), (3, 20.0, 20.0)]
    o, d = spark.createDataFrame([*origins, (9, None, 1.0)], schema), spark.createDataFrame([*ends, (8, 1.0, None)], schema)
    got = nearest.nearest(o, d, 5, space.metric(geo.haversine))
    assert {(x["o"], x["d"], x["rank"]) for x in got.collect()} == plain(origins, ends, 5, False, False, great_circle)
    assert nearest.nearest(o, d.limit(0), 5, space.metric(geo.haversine)).count() == 0


def test_pairs_of_cells_grow_with_locations(spark, monkeypatch):
    """Of four times the locations, no more than about four times the pairs of places are measured."""
    monkeypatch.setattr(nearest, "FEW", 0)
    seen = []
    reached = nearest._reached

    def counted(*args):
        out = reached(*args)
        seen[-1].append(out.count())
        return out

    monkeypatch.setattr(nearest, "_reached", counted)
    r = random.Random(3)
    for n in (400, 1600):
        seen.append([])
        df = spark.createDataFrame([(i, r.uniform(40, 50), r.uniform(0, 10)) for i in range(n)], "id BIGINT, lat DOUBLE, lon DOUBLE")
        assert nearest.nearest(df, df, 3, space.metric(geo.haversine)).count() == 3 * n
    few, many = (n[-1] for n in seen)
    assert many < 8 * few and many < 1600 * 1600 / 8, seen
