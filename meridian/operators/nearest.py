"""The nearest or farthest locations of each origin, without measuring all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions import geo
from meridian.operators import space
from meridian.operators.frames import cut, kept, written

#: So many locations at most are broadcast and measured from every origin.
FEW = 4096
#: Cells are halved until none holds more places than this, or DEPTH times.
LEAF = 16
DEPTH = 30
_AXES = ("x", "y", "z")


def nearest(origins: DataFrame, locations: DataFrame, k: int, distance: Column, slack: float = 1.0, planar: bool = False, farthest: bool = False, itself: bool = False) -> DataFrame:
    """o, d, distance, rank: the ``k`` nearest locations of each origin, or farthest; ties to the smaller d.

    origins, locations: id, lat, lon; ids are distinct in each. Rows without a coordinate take no
    part. distance: over olat, olon, dlat, dlon, in line with the great circle, or with the plane of
    degrees if ``planar``; slack: by how many metres (degrees) two places may differ that it takes
    for equally far. itself: whether a location of the origin's id counts.

    Up to ``FEW`` locations are broadcast. More are searched by cells: space is halved along each
    axis level by level, for origins' cells and locations' cells together. Each level knows how
    near and how far two cells' places can be, so a pair of cells goes on only if it can hold one of
    the first k. Both ways give the same rows. The work grows with the cells, not with pairs of
    locations; where very many places lie equally far from an origin all of them are looked at.
    Places that coincide are one place, which stands for its k + 1 smallest ids: others can't be
    among the first k of any origin.
    """
    known = [df.select("id", "lat", "lon").where("lat IS NOT NULL AND lon IS NOT NULL") for df in (origins, locations)]
    if known[1].limit(FEW + 1).count() <= FEW:
        all_pairs = space.pairs(known[0], F.broadcast(known[1]))
        rows = space.ranked(all_pairs if itself else all_pairs.where("o <> d"), distance, "o", "d", farthest)
        return rows.where(F.col("rank") <= k).select("o", "d", "distance", "rank")
    return by_cells(*known, k, distance, slack, planar, farthest, itself)


def by_cells(origins: DataFrame, locations: DataFrame, k: int, distance: Column, slack: float, planar: bool, farthest: bool, itself: bool) -> DataFrame:
    """``nearest`` by cells, whatever the number of locations."""
    spot = ["lat", "lon"]
    with written(origins.sparkSession):
        place = Window.partitionBy(*spot).orderBy("id")
        first = locations.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= k + 1)
        ends = first.groupBy(*spot).agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("w", F.size("ids"))
        starts = origins.select(*spot).distinct()
        low, width = _extent(origins.select(*spot).unionByName(locations.select(*spot))) if planar else ((-1.0,) * 3, 2.0)
        axes = [F.col("lat"), F.col("lon")] if planar else _on_sphere()
        ends, starts = (cut(df.select("*", *_cell(axes, low, width))) for df in (ends, starts))
        names = _AXES[: len(axes)]
        depth = _depth(ends, names)
        at = cut(starts.groupBy(*names).agg(F.lit(1).alias("w")))
        to = cut(ends.groupBy(*names).agg(F.sum("w").alias("w")))
        allowed = slack if planar else slack / geo.EARTH_RADIUS_M
        pairs = None
        for level in range(depth + 1):
            a, b = (_cells(df, names, level, p) for df, p in ((at, "a"), (to, "b")))
            if pairs is None:
                pairs = a.drop("aw").crossJoin(b)  # one cell and one cell
            else:
                pairs = _halved(_halved(pairs.drop("bw"), a.drop("aw"), "a", names), b, "b", names)
            pairs = cut(_reached(pairs, names, k, width / 2.0**level, allowed + 1e-9 * width, farthest))
        fine = DEPTH - depth
        leaf = lambda df, p: df.select(*(F.shiftright(c, fine).alias(f"{p}{c}") for c in names), *(c for c in df.columns if c not in _AXES))
        met = pairs.join(leaf(starts, "a").withColumnsRenamed({"lat": "olat", "lon": "olon"}), [f"a{c}" for c in names])
        met = met.join(leaf(ends, "b").drop("w").withColumnsRenamed({"lat": "dlat", "lon": "dlon"}), [f"b{c}" for c in names])
        met = met.withColumn("distance", distance).select("olat", "olon", F.explode("ids").alias("d"), "distance")
        order = [F.desc("distance") if farthest else F.asc("distance"), F.asc("d")]
        found = met.withColumn("_n", F.row_number().over(Window.partitionBy("olat", "olon").orderBy(*order))).where(F.col("_n") <= k + 1)
        rows = origins.select(F.col("id").alias("o"), F.col("lat").alias("olat"), F.col("lon").alias("olon")).join(found, ["olat", "olon"])
        rows = (rows if itself else rows.where("o <> d")).withColumn("rank", F.row_number().over(Window.partitionBy("o").orderBy(*order)))
        return kept(rows.where(F.col("rank") <= k).select("o", "d", "distance", "rank"))


def _on_sphere() -> list[Column]:
    lat, lon = F.radians("lat"), F.radians("lon")
    return [F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)]


def _extent(places: DataFrame) -> tuple[tuple[float, float], float]:
    """The least corner and the larger side of the box around some places."""
    box = places.agg(F.min("lat"), F.min("lon"), F.max("lat"), F.max("lon")).first()
    if box[0] is None:
        return (0.0, 0.0), 1.0
    return (box[0], box[1]), max(box[2] - box[0], box[3] - box[1]) or 1.0


def _cell(axes: list[Column], low: tuple[float, ...], width: float) -> list[Column]:
    """The numbers of a place's finest cell."""
    last = (1 << DEPTH) - 1
    return [F.greatest(F.lit(0), F.least(F.lit(last), F.floor((c - lo) / width * float(1 << DEPTH)))).cast("bigint").alias(n) for n, c, lo in zip(_AXES, axes, low)]


def _cells(finest: DataFrame, names: tuple[str, ...], level: int, p: str) -> DataFrame:
    """The cells of a level that hold places, with what they hold; columns start with ``p``."""
    shifted = [F.shiftright(c, DEPTH - level).alias(f"{p}{c}") for c in names]
    return finest.groupBy(*shifted).agg(F.sum("w").alias(f"{p}w"))


def _halved(pairs: DataFrame, cells: DataFrame, p: str, names: tuple[str, ...]) -> DataFrame:
    """Pairs of cells with the cells of one side replaced by those of the next level in them."""
    own = [f"{p}{c}" for c in names]
    up = pairs.withColumnsRenamed({c: f"_{c}" for c in own})
    return up.join(cells.withColumns({f"_{c}": F.shiftright(c, 1) for c in own}), [f"_{c}" for c in own]).drop(*(f"_{c}" for c in own))


def _depth(places: DataFrame, names: tuple[str, ...]) -> int:
    """The first level, by twos, whose cells hold ``LEAF`` places at most."""
    for level in range(0, DEPTH, 2):
        most = places.groupBy(*(F.shiftright(c, DEPTH - level) for c in names)).count().agg(F.max("count")).first()[0]
        if most is None or most <= LEAF:
            return level
    return DEPTH


def _reached(pairs: DataFrame, names: tuple[str, ...], k: int, side: float, slack: float, farthest: bool) -> DataFrame:
    """Pairs of cells that can hold one of the first k of an origin.

    k + 1 places of the cells that are surely near bound how far the first k can be (one may be
    the origin itself); cells that begin beyond that hold none.
    """
    gap = [F.abs(F.col(f"a{c}") - F.col(f"b{c}")).cast("double") for c in names]
    least = F.sqrt(sum((F.greatest(F.lit(0.0), g - 1.0) * F.greatest(F.lit(0.0), g - 1.0) for g in gap), F.lit(0.0))) * side
    most = F.sqrt(sum(((g + 1.0) * (g + 1.0) for g in gap), F.lit(0.0))) * side
    sure, open_ = (-least, -most) if farthest else (most, least)
    own = [f"a{c}" for c in names]
    rows = pairs.withColumn("_sure", sure).withColumn("_open", open_)
    held = rows.withColumn("_held", F.sum("bw").over(Window.partitionBy(*own).orderBy("_sure").rangeBetween(Window.unboundedPreceding, 0)))
    bound = F.min(F.when(F.col("_held") >= k + 1, F.col("_sure"))).over(Window.partitionBy(*own))
    near = held.withColumn("_bound", bound).where(F.col("_bound").isNull() | (F.col("_open") <= F.col("_bound") + slack))
    return near.drop("_sure", "_open", "_held", "_bound")
