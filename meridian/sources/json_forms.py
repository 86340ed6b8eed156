"""JSON forms: writers make a text column, readers take one apart. Bad text reads as null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meridian.functions import geo
from meridian.functions import interval as I
from meridian.functions import moment as M
from meridian.functions import tags as T
from meridian.sources import text as X

INTERVALS = "array<struct<lo:bigint,hi:bigint>>"


def _strings(values: Column) -> Column:
    return F.to_json(values)


def write_intervals(intervals: Column) -> Column:
    """An array of interval texts from array<struct<lo, hi>>."""
    return _strings(_interval_texts(intervals))


def _interval_texts(intervals: Column) -> Column:
    return F.transform(intervals, lambda i: I.format_interval(i["lo"], i["hi"]))


def read_intervals(text: Column) -> Column:
    """array<struct<lo, hi>>; a bare string is one interval."""
    bare = F.trim(text).startswith('"')
    many = F.from_json(F.when(bare, F.concat(F.lit("["), text, F.lit("]"))).otherwise(text), "array<string>")
    return F.transform(many, I.parse)


def write_tagged(id_: Column, tags: Column, intervals: Column) -> Column:
    """{id, tags, collection}."""
    return F.to_json(F.struct(id_.alias("id"), _tag_lists(tags).alias("tags"), _interval_texts(intervals).alias("collection")))


def read_tagged(text: Column) -> Column:
    """struct<id, tags, collection>."""
    x = F.from_json(text, "id string, tags array<array<string>>, collection array<string>")
    return F.struct(x["id"].alias("id"), _tags(x["tags"]).alias("tags"), F.transform(x["collection"], I.parse).alias("collection"))


def write_container(rows: Column) -> Column:
    """An array of {id, tags, collection} from array<struct<id, tags, collection>>."""
    return F.to_json(F.transform(rows, lambda r: F.struct(r["id"].alias("id"), _tag_lists(r["tags"]).alias("tags"), _interval_texts(r["collection"]).alias("collection"))))


def read_container(text: Column) -> Column:
    rows = F.from_json(text, "array<struct<id:string,tags:array<array<string>>,collection:array<string>>>")
    return F.transform(rows, lambda x: F.struct(x["id"].alias("id"), _tags(x["tags"]).alias("tags"), F.transform(x["collection"], I.parse).alias("collection")))


def _tag_lists(tags: Column) -> Column:
    return F.transform(tags, lambda t: F.when(t["value"].isNull(), F.array(t["name"])).otherwise(F.array(t["name"], t["value"])))


def _tags(lists: Column) -> Column:
    return F.transform(lists, lambda x: F.struct(F.get(x, F.lit(0)).alias("name"), F.get(x, F.lit(1)).alias("value")))


def write_tags(tags: Column) -> Column:
    """An array of [name] and [key, value]."""
    return F.to_json(_tag_lists(tags))


def read_tags(text: Column) -> Column:
    return _tags(F.from_json(text, "array<array<string>>")).cast(T.TAGS)


def write_interval_map(default: Column, entries: Column) -> Column:
    """{default, entries: [{interval, value}]} from array<struct<lo, hi, value>>."""
    each = F.transform(entries, lambda e: F.struct(I.format_interval(e["lo"], e["hi"]).alias("interval"), e["value"].alias("value")))
    return F.to_json(F.struct(default.alias("default"), each.alias("entries")))


def read_interval_map(text: Column) -> Column:
    x = F.from_json(text, "default string, entries array<struct<interval:string,value:string>>")
    each = F.transform(x["entries"], lambda e: F.struct(I.parse(e["interval"])["lo"].alias("lo"), I.parse(e["interval"])["hi"].alias("hi"), e["value"].alias("value")))
    return F.struct(x["default"].alias("default"), each.alias("entries"))


def write_signal_map(default: Column, signals: Column) -> Column:
    """{default, signals: [{key, value}]} from array<struct<t, value>>."""
    each = F.transform(signals, lambda e: F.struct(M.format_moment(e["t"]).alias("key"), e["value"].alias("value")))
    return F.to_json(F.struct(default.alias("default"), each.alias("signals")))


def read_signal_map(text: Column) -> Column:
    x = F.from_json(text, "default string, signals array<struct<key:string,value:string>>")
    each = F.transform(x["signals"], lambda e: F.struct(M.parse(e["key"]).alias("t"), e["value"].alias("value")))
    return F.struct(x["default"].alias("default"), each.alias("signals"))


def write_presences(presences: Column, tagged: bool = False) -> Column:
    """An array of presence texts from array<struct<t, lat, lon>>, with tags too if ``tagged``."""
    return F.to_json(_presence_texts(presences, tagged))


def _presence_texts(presences: Column, tagged: bool) -> Column:
    return F.transform(presences, lambda p: X.format_presence(p["t"], p["lat"], p["lon"], p["tags"] if tagged else None))


def read_presences(text: Column) -> Column:
    return F.transform(F.from_json(text, "array<string>"), X.parse_presence)


def write_distance(metres: Column) -> Column:
    return F.concat(metres.cast("string"), F.lit("m"))


def read_distance(text: Column) -> Column:
    """Whole metres from ``123m``; null for any other text."""
    return F.when(text.rlike(r"^\d+m$"), F.rtrim(text, F.lit("m")).try_cast("bigint"))


def write_track(origin: Column, destination: Column, metres: Column) -> Column:
    """{origin, destination, distance}: presence texts and a distance."""
    return F.to_json(F.struct(origin.alias("origin"), destination.alias("destination"), write_distance(metres).alias("distance")))


def read_track(text: Column) -> Column:
    x = F.from_json(text, "origin string, destination string, distance string")
    return F.struct(X.parse_presence(x["origin"]).alias("origin"), X.parse_presence(x["destination"]).alias("destination"), read_distance(x["distance"]).alias("distance_m"))


def read_direction(text: Column) -> Column:
    """{origin, destination[, distance, duration]}: locations, metres and seconds."""
    x = F.from_json(text, "origin string, destination string, distance string, duration bigint")
    return F.struct(geo.parse(x["origin"]).alias("origin"), geo.parse(x["destination"]).alias("destination"), read_distance(x["distance"]).alias("distance_m"), x["duration"].alias("duration_s"))


def write_matrix(metres: Column, seconds: Column, locations: Column) -> Column:
    """{distancesInMeter, durationsInSeconds, locations} from nested arrays and location texts."""
    return F.to_json(F.struct(metres.alias("distancesInMeter"), seconds.alias("durationsInSeconds"), locations.alias("locations")))


def read_matrix(text: Column) -> Column:
    """array<struct<o, d, distance_m, duration_s>>: the matrix in long form, by place in locations."""
    x = F.from_json(text, "distancesInMeter array<array<bigint>>, durationsInSeconds array<array<bigint>>, locations array<string>")
    n = F.sequence(F.lit(0), F.size(x["locations"]) - 1)

    def cell(o: Column, d: Column) -> Column:
        at = lambda m: F.get(F.get(x[m], o), d)
        return F.struct(F.get(x["locations"], o).alias("o"), F.get(x["locations"], d).alias("d"), at("distancesInMeter").alias("distance_m"), at("durationsInSeconds").alias("duration_s"))

    return F.flatten(F.transform(n, lambda o: F.transform(n, lambda d: cell(o, d))))


def write_timeline(layers: Column, presences: bool = False) -> Column:
    """{layers: [{type, id, tags, events | intervals | presences}]} from array<struct<type, id, tags, rows>>.

    rows: array<struct<lo, hi, tags>>; an event is {interval, tags}. presences: whether layers
    have a field of that name, array<struct<t, lat, lon, tags>>, for those of type PRESENCE.
    """
    kind = lambda x, *types: x["type"].isin(*types)
    traced = [lambda x: F.when(kind(x, "PRESENCE"), _presence_texts(x["presences"], True)).alias("presences")] if presences else []
    event = lambda e: F.struct(I.format_interval(e["lo"], e["hi"]).alias("interval"), _tag_lists(e["tags"]).alias("tags"))
    plain = lambda e: I.format_interval(e["lo"], e["hi"])
    each = F.transform(
        layers,
        lambda x: F.struct(
            x["type"].alias("type"),
            x["id"].alias("id"),
            _tag_lists(x["tags"]).alias("tags"),
            F.when(~kind(x, "INTERVAL", "PRESENCE"), F.transform(x["rows"], event)).alias("events"),
            F.when(kind(x, "INTERVAL"), F.transform(x["rows"], plain)).alias("intervals"),
            *(t(x) for t in traced),
        ),
    )
    return F.to_json(F.struct(each.alias("layers")))


def read_timeline(text: Column) -> Column:
    """array<struct<type, id, tags, rows, presences>>; rows is null for a presence layer, presences for any other."""
    form = "layers array<struct<type:string,id:string,tags:array<array<string>>,events:array<struct<interval:string,tags:array<array<string>>>>,intervals:array<string>,presences:array<string>>>"
    x = F.from_json(text, form)
    event = lambda e: F.struct(I.parse(e["interval"])["lo"].alias("lo"), I.parse(e["interval"])["hi"].alias("hi"), _tags(e["tags"]).cast(T.TAGS).alias("tags"))
    plain = lambda e: F.struct(I.parse(e)["lo"].alias("lo"), I.parse(e)["hi"].alias("hi"), F.array().cast(T.TAGS).alias("tags"))
    return F.transform(
        x["layers"],
        lambda y: F.struct(
            y["type"].alias("type"),
            y["id"].alias("id"),
            _tags(y["tags"]).alias("tags"),
            F.coalesce(F.transform(y["events"], event), F.transform(y["intervals"], plain)).alias("rows"),
            F.transform(y["presences"], X.parse_presence).alias("presences"),
        ),
    )
