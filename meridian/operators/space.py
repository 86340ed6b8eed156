"""Locations: proximity ranks, radius clusters, and origin-destination frames in long form."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridian.functions import geo
from meridian.operators.frames import placed
from meridian.operators.graph import components

Metric = Callable[[Column, Column, Column, Column], Column]


def ranked(pairs: DataFrame, distance: Column, by: str, tie: str, farthest: bool = False) -> DataFrame:
    """With distance, and rank (from 1) of each row of ``by`` from the nearest on, or the farthest."""
    d = pairs.withColumn("distance", distance)
    order = F.desc("distance") if farthest else F.asc("distance")
    return d.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(order, tie)))


#: Destinations that an origin is paired with at a time.
PAIRED = 256
#: Origins that stay side by side when they are dealt.
BESIDE = 64


def dealt(df: DataFrame) -> DataFrame:
    """Rows over all cores. A table of locations may be one file and so one task, with all that it is crossed with."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def _blocks(ends: DataFrame, c: str, keep: Sequence[str], most: int, name: str) -> DataFrame:
    """Locations in the order of latitude, longitude and id, as arrays of at most ``most``, one row each.

    They are numbered in one task: all pairs of more than that can order are too many to write.
    """
    rows = ends.select(F.col("lat").alias(c + "lat"), F.col("lon").alias(c + "lon"), F.col("id").alias(c), *(F.col(x).alias(c + x) for x in keep))
    place = F.row_number().over(Window.orderBy(*rows.columns)) - 1
    return rows.withColumn("_at", F.floor(place / most)).groupBy("_at").agg(F.sort_array(F.collect_list(F.struct(*rows.columns))).alias(name)).select(name)


def pairs(origins: DataFrame, destinations: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Every origin with every destination: o, olat, olon, d, dlat, dlon.

    keep: more columns of both, named like ``olat`` and ``dlat``. What is known of a location is
    joined to it before, so that pairs are never shuffled. Origins meet blocks of destinations, one
    row each: generated code holds all pairs of one row before it hands them on, and all of an
    origin's, tens of thousands, would outlive the youngest generation.

    A task goes through its origins for each block, both in the order of their places. So a file
    that cells are written to repeats a block's ids every few kilobytes and, where places lie on
    lines of latitude at equal steps, the distances too, which compression finds.
    """
    starts = dealt(_blocks(origins, "o", keep, BESIDE, "_from")).select(F.inline("_from"))
    blocks = _blocks(destinations, "d", keep, PAIRED, "_to").repartition(1)
    met = blocks.hint("shuffle_replicate_nl").crossJoin(starts)
    ends = [c + x for c in "od" for x in ("", "lat", "lon", *keep)]
    return met.select(*starts.columns, F.inline("_to")).select(*ends)


#: Origins that take turns in ``turned_pairs``: eight values take whole bytes, however many bits each has.
TURNS = 8
#: Destinations of a block there, if their latitude has no more.
ALONG = 32
#: Origins, and destinations, whose cells are one task.
TILED = 2048


def _in_lines(ends: DataFrame, c: str, keep: Sequence[str]) -> DataFrame:
    """Locations with the number of their latitude (_line) and their place on it (_along), both from 0.

    Latitudes whose places lie at the same steps follow each other. They are numbered in one task, as in ``_blocks``.
    """
    names = [c, c + "lat", c + "lon", *(c + x for x in keep)]
    rows = ends.select(F.col("lat").alias("_lat"), F.struct(F.col("lon").alias(c + "lon"), F.col("id").alias(c), F.col("lat").alias(c + "lat"), *(F.col(x).alias(c + x) for x in keep)).alias("_end"))
    lines = rows.groupBy("_lat").agg(F.sort_array(F.collect_list("_end")).alias("_ends"))
    steps = F.transform("_ends", lambda x: F.round(x[c + "lon"] - F.col("_ends")[0][c + "lon"], 6))
    lines = lines.withColumn("_steps", steps).withColumn("_line", F.row_number().over(Window.orderBy("_steps", "_lat")) - 1)
    return lines.select("_line", F.posexplode("_ends").alias("_along", "_end")).select("_line", "_along", *(F.col("_end")[x].alias(x) for x in names))


def _tiles(ends: DataFrame, by: Sequence[str], at: Column, size: int, n: int, name: str) -> DataFrame:
    """Numbered locations as arrays, one row for each ``at`` (of ``_place``, their place in the order of ``by``), ``size`` places a partition and ``n`` in all."""
    names = [x for x in ends.columns if not x.startswith("_")]
    rows = ends.withColumn("_place", F.row_number().over(Window.orderBy(*by)) - 1).withColumn("_at", at)
    lines = rows.groupBy("_at").agg(F.sort_array(F.collect_list(F.struct("_place", F.struct(*names).alias("_end")))).alias("_ends"))
    tile = F.floor(F.col("_ends")[0]["_place"] / size).cast("int")
    return lines.repartitionById(max(1, -(-n // size)), tile).select(F.transform("_ends", lambda x: x["_end"]).alias(name))


def turned_pairs(origins: DataFrame, destinations: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``pairs`` in another order, for files that are smaller still; tasks have the cells of some origins and some destinations.

    At each destination origins of eight latitudes take turns, then the next eight along these. Where
    places lie at equal steps, their distances are those of the eight before, moved on by one
    destination: by eight values, so by whole bytes, and compression finds them. A task has so few
    ids and distances that files keep them in dictionaries.
    """
    n, m = origins.count(), destinations.count()
    share = -(-n // origins.sparkSession.sparkContext.defaultParallelism)
    turn = _in_lines(origins, "o", keep).withColumn("_turn", F.floor(F.col("_line") / TURNS))
    starts = _tiles(turn, ["_turn", "_along", "_line"], F.floor(F.col("_place") / TURNS), max(1, min(TILED, share)), n, "_from")
    line = F.floor((F.col("_place") - F.col("_along") % PAIRED) / ALONG)
    blocks = _tiles(_in_lines(destinations, "d", keep), ["_line", "_along"], line, TILED, m, "_to")
    met = blocks.hint("shuffle_replicate_nl").crossJoin(starts).select("_from", F.inline("_to")).select("*", F.inline("_from"))
    return met.select(*(c + x for c in "od" for x in ("", "lat", "lon", *keep)))


def asked_pairs(asked: DataFrame, origins: DataFrame, destinations: DataFrame) -> DataFrame:
    """The asked pairs (o, d) of known locations, in the form of ``pairs``: no more cells than are asked for."""
    o = origins.select(F.col("id").alias("o"), F.col("lat").alias("olat"), F.col("lon").alias("olon"))
    d = destinations.select(F.col("id").alias("d"), F.col("lat").alias("dlat"), F.col("lon").alias("dlon"))
    return asked.select("o", "d").distinct().join(o, "o").join(d, "d").select(*o.columns, *d.columns)


def built(od: DataFrame) -> DataFrame:
    """A matrix in long form, once it is sure that every origin has one cell to every destination; else raises."""
    if not complete(od):
        raise ValueError("a matrix needs exactly one cell for each origin and destination")
    return od


def built_pairs(origins: DataFrame, destinations: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``pairs`` for a matrix, once it is sure that every origin has one cell to every destination; else raises.

    Ids that differ, crossed, make each cell once: it is enough to look at the ids.
    """
    for df in (origins, destinations):
        got = df.agg(F.count("*").alias("n"), F.count_distinct("id").alias("u")).first()
        if got["n"] != got["u"]:
            raise ValueError("a matrix needs exactly one cell for each origin and destination")
    return pairs(origins, destinations, keep)


def validated(clusters: DataFrame) -> DataFrame:
    """id, cluster of clusters given as rows; raises, as the plan runs, at a location that is in two."""
    held = clusters.groupBy("id").agg(F.min("cluster").alias("cluster"), F.max("cluster").alias("_last"))
    return held.where(F.assert_true(F.col("cluster") == F.col("_last"), "a location is in two clusters").isNull()).drop("_last")


OD = ("olat", "olon", "dlat", "dlon")


def metric(fn: Metric) -> Column:
    return fn(*(F.col(c) for c in OD))


def arcs(locations: DataFrame, keep: Sequence[str] = (), among: Callable[..., DataFrame] = pairs) -> DataFrame:
    """``pairs`` (or ``built_pairs``) of all locations for ``great_circle``."""
    known = locations.withColumn("cos", geo.cosine(F.col("lat")))
    return among(known, known, ["cos", *keep])


def great_circle() -> Column:
    return geo.great_circle(*(F.col(c) for c in ("olat", "olon", "ocos", "dlat", "dlon", "dcos")))


def apart(metres: Column) -> Column:
    """Whether great-circle ``metres`` are over 0; they aren't worked out where latitudes are ten metres apart."""
    on_earth = F.greatest(F.abs("olat"), F.abs("dlat")) <= 90.0
    return (on_earth & (F.abs(F.col("olat") - F.col("dlat")) >= 1e-4)) | (metres > 0)


def matrix(all_pairs: DataFrame, distance: Column, seconds_per_unit: float, metres_per_unit: float = 1.0) -> DataFrame:
    """o, d, distance_m, duration_s of a measured distance, both cut off to whole numbers."""
    return all_pairs.select("o", "d", (distance * F.lit(metres_per_unit)).cast("bigint").alias("distance_m"), (distance * F.lit(seconds_per_unit)).cast("bigint").alias("duration_s"))


def tiles(od: DataFrame, max_origins: int, max_destinations: int) -> DataFrame:
    """With tile_o and tile_d: the cut of the matrix into tiles of at most so many rows and columns.

    Places are numbered once for each distinct location, so only locations are put in order.
    """
    number = lambda c, most: placed(od.select(c).distinct(), [c]).select(c, F.floor(F.col("place") / most).cast("int").alias(f"tile_{c}"))
    return od.join(number("o", max_origins), "o").join(number("d", max_destinations), "d")


def tiled_pairs(origins: DataFrame, destinations: DataFrame, max_origins: int, max_destinations: int) -> DataFrame:
    """o, d, tile_o, tile_d: ``tiles`` of all pairs, whose locations get their tile before they are crossed."""
    def numbered(df: DataFrame, most: int) -> DataFrame:
        places = placed(df.select("id").distinct(), ["id"])
        return df.join(places.select("id", F.floor(F.col("place") / most).cast("int").alias("tile")), "id")

    all_pairs = pairs(numbered(origins, max_origins), numbered(destinations, max_destinations), ["tile"])
    return all_pairs.select("o", "d", F.col("otile").alias("tile_o"), F.col("dtile").alias("tile_d"))


def within(locations: DataFrame, radius_m: int) -> DataFrame:
    """Links (a, b), a < b, of locations at most ``radius_m`` metres apart by great circle.

    Locations are dealt into cells of the radius' size; a cell meets its neighbours only. Cells
    get as many columns as the circle of latitude at their outer edge allows, so none is
    narrower than the radius; they wrap around at 180 degrees.
    """
    if radius_m <= 0:  # only places that coincide
        spots = locations.select(F.col("id").alias("a"), "lat", "lon")
        return spots.join(spots.withColumnRenamed("a", "b"), ["lat", "lon"]).where("a < b").select("a", "b")
    degrees = radius_m / geo.EARTH_RADIUS_M * 180.0 / math.pi * 1.000001 + 1e-9
    rows = max(1, int(180.0 / degrees))
    height = 180.0 / rows

    def columns(row: Column) -> Column:
        """Columns of a row of cells; one near the poles."""
        edge = F.greatest(F.abs(row * height - 90.0), F.abs((row + 1) * height - 90.0))
        reach = F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(degrees))) / F.greatest(F.lit(1e-12), F.cos(F.radians(F.least(F.lit(90.0), edge))))))
        whole = F.floor(F.lit(360.0) / F.degrees(reach))
        return F.when(edge + degrees >= 90.0, F.lit(1)).otherwise(F.greatest(F.lit(1), whole))

    row = F.least(F.lit(rows - 1), F.greatest(F.lit(0), F.floor((F.col("lat") + 90.0) / height)))
    east = F.pmod(F.col("lon") + 180.0, F.lit(360.0))
    at = locations.select("id", "lat", "lon", row.alias("row"), east.alias("east"))
    column = lambda r: F.least(columns(r) - 1, F.floor(F.col("east") / 360.0 * columns(r)))
    home = at.select(F.col("id").alias("a"), F.col("lat").alias("alat"), F.col("lon").alias("alon"), "row", column(F.col("row")).alias("col"))
    near_rows = F.filter(F.sequence(F.col("row") - 1, F.col("row") + 1), lambda r: (r >= 0) & (r < rows))
    reach = at.withColumn("row", F.explode(near_rows)).withColumn("n", columns(F.col("row"))).withColumn("c", column(F.col("row")))
    around = F.array_distinct(F.transform(F.sequence(F.col("c") - 1, F.col("c") + 1), lambda c: F.pmod(c, F.col("n"))))
    reach = reach.select(F.col("id").alias("b"), F.col("lat").alias("blat"), F.col("lon").alias("blon"), "row", F.explode(around).alias("col"))
    met = home.join(reach, ["row", "col"]).where("a < b")
    return met.where(geo.haversine(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon")) <= radius_m).select("a", "b")


def clusters(locations: DataFrame, radius_m: int, similar: DataFrame | None = None) -> DataFrame:
    """id, cluster: locations linked within a radius, directly or through others.

    similar: id and kind; only locations of equal kind are linked. Clusters are numbered from 0
    in the order of their smallest members.
    """
    links = within(locations, radius_m)
    if similar is not None:
        kind = lambda c: similar.select(F.col("id").alias(c), F.col("kind").alias(f"{c}_kind"))
        links = links.join(kind("a"), "a").join(kind("b"), "b").where("a_kind <=> b_kind").select("a", "b")
    rooted = locations.select("id").distinct().join(components(links).withColumnRenamed("node", "id"), "id", "left")
    rooted = rooted.select("id", F.coalesce("root", "id").alias("root"))
    numbers = placed(rooted.select("root").distinct(), ["root"]).select("root", F.col("place").cast("int").alias("cluster"))
    return rooted.join(numbers, "root").select("id", "cluster")


def merged(cells: DataFrame) -> DataFrame:
    """One cell for each (o, d): the one of greatest seq. cells: o, d, distance_m, duration_s, seq."""
    best = F.max_by(F.struct("distance_m", "duration_s"), "seq")
    return cells.groupBy("o", "d").agg(best.alias("c")).select("o", "d", "c.distance_m", "c.duration_s")


#: Cells up to this number are sent to all tasks, and so are destinations' ids.
FEW = 1 << 20
#: Destinations of a block.
BLOCK = 4096


def overlaid(whole: DataFrame, cells: DataFrame) -> DataFrame:
    """A matrix with later cells in place of its own: what ``merged`` makes of both, of the matrix's pairs.

    whole: o, d, distance_m, duration_s. cells: the same, and seq; those of pairs that ``whole``
    lacks are left out. Up to ``FEW`` of them are broadcast, so that the matrix isn't shuffled.
    """
    last = merged(cells).select("o", "d", F.struct("distance_m", "duration_s").alias("_c"))
    if last.limit(FEW + 1).count() <= FEW:
        last = F.broadcast(last)
    pick = lambda c: F.when(F.col("_c").isNotNull(), F.col(f"_c.{c}")).otherwise(F.col(c)).alias(c)
    return whole.join(last, ["o", "d"], "left").select("o", "d", pick("distance_m"), pick("duration_s"))


def uncovered(cells: DataFrame, origins: DataFrame, destinations: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs (o, d) that have no cell.

    Destinations are dealt into blocks by hash, and each origin's cells are gathered by block. So
    what is shuffled are the cells, and origins with numbers of blocks; a block's ids are made
    pairs, less those that have a cell, after that.
    """
    ends = destinations.select("id").distinct()
    n = ends.count()
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(max(1, -(-n // block))))
    unnamed = F.when(F.count("*") > F.count("id"), F.array(F.lit(None).cast(ends.schema["id"].dataType))).otherwise(F.array().cast(T.ArrayType(ends.schema["id"].dataType)))
    blocks = ends.groupBy(at("id").alias("_at")).agg(F.concat(F.collect_list("id"), unnamed).alias("_ids"))
    had = cells.select("o", "d").groupBy("o", at("d").alias("_at")).agg(F.collect_set("d").alias("_had"))
    starts = dealt(origins.select(F.col("id").alias("o")).distinct())
    rows = starts.crossJoin(blocks.select("_at")).join(had, ["o", "_at"], "left").join(F.broadcast(blocks) if n <= FEW else blocks, "_at")
    left = F.when(F.col("_had").isNull(), F.col("_ids")).otherwise(F.array_except("_ids", "_had"))
    return rows.select("o", F.explode(left).alias("d"))


def pivoted(origins: DataFrame, destinations: DataFrame, distance: Metric) -> DataFrame:
    """o, distances: an origin's distances to all destinations in the order of their ids, with commas between.

    A row of the result holds a number for each destination, so all destinations are one array that
    each origin is measured against: no cell is a row, none is shuffled.
    """
    where = F.struct("lat", "lon")
    starts = dealt(origins.groupBy(F.col("id").alias("o")).agg(F.collect_list(where).alias("_from")))
    to = destinations.agg(F.sort_array(F.collect_list(F.struct("id", "lat", "lon"))).alias("_to"))
    to = to.withColumn("_once", F.size("_to") == F.size(F.array_distinct(F.transform("_to", lambda p: p["id"]))))
    measure = lambda a, b: distance(a["lat"], a["lon"], b["lat"], b["lon"])
    plain = F.transform("_to", lambda b: measure(F.col("_from")[0], b).cast("string"))
    # where ids repeat, equal ones are in the order of distances
    cells = F.flatten(F.transform("_from", lambda a: F.transform("_to", lambda b: F.struct(b["id"].alias("d"), measure(a, b).alias("m")))))
    several = F.transform(F.sort_array(cells), lambda c: c["m"].cast("string"))
    said = F.when((F.size("_from") == 1) & F.col("_once"), F.array_join(plain, ",")).otherwise(F.array_join(several, ","))
    return starts.crossJoin(F.broadcast(to)).select("o", said.alias("distances"))


def extension(known: DataFrame, asked: DataFrame) -> DataFrame:
    """Pairs (o, d, part) to fetch so that a square matrix over ``known`` covers ``asked`` too."""
    old, new = known.select("id").distinct(), asked.select("id").distinct().join(known.select("id"), "id", "left_anti")
    pair = lambda a, b, part: dealt(a.select(F.col("id").alias("o"))).crossJoin(dealt(b.select(F.col("id").alias("d")))).withColumn("part", F.lit(part))
    return pair(new, old, "new to old").unionByName(pair(old, new, "old to new")).unionByName(pair(new, new, "new to new"))


def resolve(directions: DataFrame, od: DataFrame) -> DataFrame:
    """directions with distance_m and duration_s; 0 where either end is anywhere (null).

    Raises at a location that the matrix doesn't know. A duration of 2**31 - 1 reads as 80 days.
    """
    known = od.select("o", "d", F.col("distance_m").alias("_m"), F.col("duration_s").alias("_s"))
    rows = directions.join(known, ["o", "d"], "left")
    anywhere = F.col("o").isNull() | F.col("d").isNull()
    found = F.when(anywhere, F.lit(0).cast("bigint")).when(F.assert_true(F.col("_m").isNotNull() | anywhere, "unknown location").isNull(), F.col("_m"))
    seconds = F.when(anywhere, F.lit(0).cast("bigint")).when(F.col("_s") == (1 << 31) - 1, F.lit(80 * 86400)).otherwise(F.col("_s"))
    return rows.withColumn("distance_m", found).withColumn("duration_s", seconds).drop("_m", "_s")


def location_hash(codes: DataFrame, by: str) -> DataFrame:
    """hash: SHA-256 of a request's sorted locations, as origins and as destinations."""
    said = F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("lat", "lon"))), lambda p: geo.code(p["lat"], p["lon"])), ", "), F.lit("]"))
    return codes.groupBy(by).agg(said.alias("s")).select(by, F.sha2(F.concat("s", F.lit("->"), "s"), 256).alias("hash"))


def complete(od: DataFrame) -> bool:
    """Whether every origin has a cell to every destination, once."""
    got = od.agg(F.count("*").alias("n"), F.count_distinct("o", "d").alias("u"), F.count_distinct("o").alias("o"), F.count_distinct("d").alias("d")).first()
    return got["n"] == got["u"] == got["o"] * got["d"]
