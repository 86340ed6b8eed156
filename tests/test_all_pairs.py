"""Matrices of all pairs: over all cores, without a shuffle of pairs, with the right rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from meridian.functions import geo
from meridian.operators import space
from meridian.plans import registry
from meridian.sources import tables

SCHEMA = "id long, nation int, lat double, lon double"
#: Queries whose pairs are to be dealt over all cores.
DEALT = ["od_travel_time", "od_pythagorean", "od_pyth_resolve", "track_from_od", "od_extend"]
#: Queries whose pairs are not to be shuffled.
STILL = ["od_uncovered", "od_build", "od_clustered", "od_merge", "od_pivot", "od_split"]


@pytest.fixture
def unsent(spark):
    """Nothing is broadcast but what an operator says, as with large tables."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield spark
    spark.conf.set(key, before)


@pytest.mark.parametrize("name", DEALT)
def test_pairs_over_all_cores(spark, medium, name):
    assert registry.QUERIES[name](spark, medium).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", STILL)
def test_pairs_are_not_shuffled(unsent, small, name, monkeypatch):
    if name == "od_build":  # what it looks at before must not be the cells
        monkeypatch.setattr(space, "complete", lambda od: pytest.fail("a check over all cells"))
    plan = registry.QUERIES[name](unsent, small)._jdf.queryExecution().sparkPlan().toString()
    above, _, _ = plan.partition("Generate" if name == "od_uncovered" else "CartesianProduct" if "CartesianProduct" in plan else "NestedLoopJoin")
    assert above != plan and not re.search("SortMergeJoin|ShuffledHashJoin|Aggregate|Window", above)


def places(spark, rows):
    return spark.createDataFrame([(i, 0, float(i % 7), float(i % 5)) for i in rows], SCHEMA)


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_uncovered_against_plain_python(spark, block):
    cells = [(1, 1), (1, 2), (2, 9), (5, 3), (5, 3), (77, 1), (None, 2)]
    got = space.uncovered(spark.createDataFrame(cells, "o long, d long"), places(spark, [1, 2, 5, 5]), places(spark, range(10)), block)
    assert sorted(map(tuple, got.collect())) == sorted({(o, d) for o in (1, 2, 5) for d in range(10)} - set(cells))


def test_pivot_with_repeated_ids(spark):
    rows = [(1, 0, 0.0, 0.0), (1, 0, 5.0, 5.0), (2, 0, 1.0, 1.0), (3, 0, -1.0, 2.0), (3, 0, 0.5, 0.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    cells = space.matrix(space.pairs(df, df), space.metric(geo.haversine), 0.5).collect()
    want = {o: ",".join(str(m) for _, m in sorted((c["d"], c["distance_m"]) for c in cells if c["o"] == o)) for o in (1, 2, 3)}
    assert dict(map(tuple, space.pivoted(df, df, geo.haversine).collect())) == want
    once = df.where("lat <> 5 and lat <> 0.5")
    assert dict(map(tuple, space.pivoted(once, once, geo.haversine).collect()))[2] == ",".join(str(r["distance_m"]) for r in space.matrix(space.pairs(once, once), space.metric(geo.haversine), 0.5).where("o = 2").orderBy("d").collect())


@pytest.mark.parametrize("few", [0, 100])
def test_overlaid_takes_the_last(spark, few, monkeypatch):
    monkeypatch.setattr(space, "FEW", few)
    df = places(spark, range(3))
    whole = space.matrix(space.pairs(df, df), space.metric(geo.pythagorean), 1.0)
    cells = spark.createDataFrame([(0, 1, 7, 8, 1), (0, 1, None, 9, 2), (9, 9, 1, 1, 1)], "o long, d long, distance_m long, duration_s long, seq int")
    got = {(r["o"], r["d"]): (r["distance_m"], r["duration_s"]) for r in space.overlaid(whole, cells).collect()}
    assert got == {(r["o"], r["d"]): (r["distance_m"], r["duration_s"]) for r in whole.collect()} | {(0, 1): (None, 9)}


def test_tiled_pairs_are_tiles(spark):
    df = places(spark, [5, 1, 9, 30, 7])
    want = space.tiles(space.pairs(df, df).select("o", "d"), 2, 3).select("o", "d", "tile_o", "tile_d")
    assert sorted(space.tiled_pairs(df, df, 2, 3).collect()) == sorted(want.collect())


def test_built_pairs_need_distinct_ids(spark):
    df = places(spark, range(3))
    assert space.complete(space.built_pairs(df, df))
    for bad in (df.unionByName(df.limit(1)), df.unionByName(df.limit(1).withColumn("id", F.lit(None).cast("long")))):
        with pytest.raises(ValueError):
            space.built_pairs(df, bad)


def test_great_circle_of_opposite_and_of_unknown_places(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 0.0, 180.0), (float("nan"), 0.0, 0.0, 0.0), (None, 0.0, 0.0, 0.0), (3.0, 4.0, 3.0, 4.0)], "a double, b double, c double, d double")
    half = 20015086
    assert [r[0] for r in rows.select(geo.haversine(*map(F.col, "abcd"))).collect()] == [half, half, None, 0]


def test_pairs_with_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(space, "PAIRED", 2)
    ends = [(i, 0, float(n), -float(n)) for n, i in enumerate([1, 1, None, 2, 9, 9, 9])]
    df = spark.createDataFrame(ends, SCHEMA)
    got = space.pairs(df, df.where("lat <> 3")).collect()
    want = [(a, x, y, b, v, w) for a, _, x, y in ends for b, _, v, w in ends if v != 3]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert space.pairs(df, df.where("false")).count() == 0


@pytest.mark.parametrize("name", ["od_pythagorean", "od_pyth_resolve", "track_from_od"])
def test_origins_meet_blocks_of_destinations(spark, medium, name):
    """What generated code makes of one row, it holds: that must not be all cells of an origin."""
    rows = registry.QUERIES[name](spark, medium)
    plan = rows._jdf.queryExecution().sparkPlan().toString()
    above, _, below = plan.partition("CartesianProduct")
    assert "Generate inline" in above and "NestedLoopJoin" not in plan and "collect_list" in below


def test_track_asks_the_arc_sine_only_near_whole_metres(spark, medium):
    """It takes most of a pair's time in Java."""
    plan = registry.QUERIES["track_from_od"](spark, medium)._jdf.queryExecution().optimizedPlan().toString()
    assert "ATAN(" in plan and "COS(" not in plan.partition("Generate inline")[0]


def test_great_circle_of_pairs_is_the_haversine(spark):
    """Also where a number of metres is close to a whole one, and where nothing is known."""
    near = [(i, 0, 50.0 + i * 1e-6, 8.0 + i % 7 * 1e-5) for i in range(150)]
    opposite = [(1000 + i, 0, -50.0 - i * 1e-6, -172.0 + i * 1e-6) for i in range(50)]
    odd = [(2000, 0, float("nan"), 0.0), (2001, 0, None, 0.0), (2002, 0, 90.0, 0.0), (2003, 0, -90.0, 50.0), (2004, 0, 410.0, 8.0), (2005, 0, 130.0, -172.0), (2006, 0, 0.0, 0.0), (2007, 0, 0.0, 180.0)]
    met = space.arcs(spark.createDataFrame(near + opposite + odd, SCHEMA))
    plain = space.metric(geo.haversine)
    same = met.select(space.great_circle().eqNullSafe(plain).alias("same"), space.apart(plain).eqNullSafe(plain > 0).alias("apart"))
    assert [tuple(r) for r in same.distinct().collect()] == [(True, True)]


#: Queries whose cells are written in the order that makes files small.
ORDERED = ["od_build", "od_pythagorean", "track_from_od", "od_clustered", "od_travel_time"]


@pytest.mark.parametrize("name", ORDERED)
def test_cells_come_in_the_order_of_places(spark, medium, name, monkeypatch):
    """Neighbouring origins follow each other, and a destination comes back after few cells: files of cells stay small."""
    monkeypatch.setattr(space, "PAIRED", 8, raising=False)
    monkeypatch.setattr(space, "BESIDE", 16, raising=False)
    at = {r["id"]: (r["lat"], r["lon"]) for r in tables.locations(spark, medium).collect()}
    rows = registry.QUERIES[name](spark, medium).withColumn("_in", F.spark_partition_id()).select("_in", "o", "d").collect()
    seen, back, origins = {}, [], []
    for n, r in enumerate(rows):
        if (r["_in"], r["d"]) in seen:
            back.append(n - seen[r["_in"], r["d"]] <= 8)
        seen[r["_in"], r["d"]] = n
        if not origins or origins[-1] != (r["_in"], r["o"]):
            origins.append((r["_in"], r["o"]))
    assert sum(back) > 0.8 * len(back)
    onward = [at[a[1]] < at[b[1]] for a, b in zip(origins, origins[1:]) if a[0] == b[0]]
    assert sum(onward) > 0.8 * len(onward)


def test_cells_of_a_grid_are_written_small(spark, tmp_path):
    ids = random.Random(5).sample(range(2160), 2160)
    grid = spark.createDataFrame([(n, 0, float(i // 36), float(i % 36 * 10 - 180)) for i, n in enumerate(ids)], SCHEMA)
    space.matrix(space.arcs(grid), space.great_circle(), 0.5).write.parquet(str(tmp_path / "od"))
    assert sum(f.stat().st_size for f in (tmp_path / "od").glob("*.parquet")) < 3 * 2160**2


def test_turned_pairs_with_repeated_and_unknown_ends(spark, monkeypatch):
    """Every pair once, whatever lines and tiles the ends fall into."""
    nan = float("nan")
    ends = [(1, 0, 1.0, 2.0), (1, 0, 1.0, 2.0), (None, 0, 1.0, None), (2, 0, None, None), (3, 0, None, 7.0), (4, 0, nan, nan), (5, 0, nan, 1.0), (6, 0, 0.0, -0.0), (7, 0, -0.0, 0.0), (7, 0, 9.0, 9.0)]
    ends += [(100 + i, 0, 3.0, float(i * i)) for i in range(11)] + [(200 + i, 0, float(i), 5.0) for i in range(23)]
    df = spark.createDataFrame(ends, SCHEMA)
    few = df.where("id <> 3 or id is null")
    want = sorted(str((a, x, y, m, b, v, w, n)) for a, m, x, y in ends for b, n, v, w in ends if b != 3)
    for paired, along, tiled in ((256, 32, 2048), (3, 2, 5), (1, 1, 1)):
        for name, value in (("PAIRED", paired), ("ALONG", along), ("TILED", tiled)):
            monkeypatch.setattr(space, name, value)
        got = space.turned_pairs(df, few, ["nation"]).select("o", "olat", "olon", "onation", "d", "dlat", "dlon", "dnation").collect()
        assert sorted(str(tuple(r)) for r in got) == want
    assert space.turned_pairs(df, df.where("false")).count() == space.turned_pairs(df.where("false"), df).count() == 0


#: Queries whose origins take turns, and the most bytes that a cell of places on lines with gaps may take.
TURNED = {"od_pythagorean": 1.0, "track_from_od": 1.1}


@pytest.mark.parametrize("name", TURNED)
def test_cells_of_lines_with_gaps_are_written_small(spark, tmp_path, name):
    keys = [k for k in range(60_000) if k * 37 % 1700 < 64]
    random.Random(7).shuffle(keys)
    spark.createDataFrame([(k, 0) for k in keys], "s_suppkey long, s_nationkey int").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    rows = registry.QUERIES[name](spark, str(tmp_path))
    rows.write.parquet(str(tmp_path / "od"))
    assert spark.read.parquet(str(tmp_path / "od")).count() == len(keys) ** 2 - (name == "track_from_od") * len(keys)
    taken = sum(f.stat().st_size for f in (tmp_path / "od").glob("*.parquet")) / len(keys) ** 2
    assert taken < TURNED[name], taken
