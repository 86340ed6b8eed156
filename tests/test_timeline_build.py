"""Timelines built from definitions: each kind of layer, and what may not be written."""

import pytest
from pyspark.errors import PySparkException

from meridian.operators import timeline

KINDS = {"i": timeline.INTERVAL, "p": timeline.PRESENCE, "s": timeline.STRICT, "o": timeline.OVERLAP, "m": timeline.MERGE}
LOG = "timeline STRING, layer STRING, seq BIGINT, op STRING, what STRING, lo BIGINT, hi BIGINT, lat DOUBLE, lon DOUBLE, tags ARRAY<STRUCT<name STRING, value STRING>>"


def build(spark, rows, kinds=KINDS):
    """rows: (layer, op, what, lo, hi, tag), in order of writing."""
    layers = spark.createDataFrame([("t", n, k) for n, k in kinds.items()], "timeline STRING, layer STRING, kind STRING")
    log = [("t", layer, n, op, what, lo, hi, 1.0, 2.0, [(tag, None)] if tag else []) for n, (layer, op, what, lo, hi, tag) in enumerate(rows)]
    got = timeline.build(layers, spark.createDataFrame(log, LOG), slice_us=10).collect()
    return [(r["layer"], r["lane"], r["lo"], r["hi"], *(t["name"] for t in r["tags"] or [])) for r in got], got


def test_all_kinds(spark):
    rows = [
        ("i", "put", "interval", 0, 10, ""), ("i", "put", "interval", 8, 12, ""), ("i", "remove", "interval", 2, 4, ""),
        ("p", "put", "presence", 5, None, "a"), ("p", "put", "presence", 5, None, "b"), ("p", "put", "presence", 25, None, "c"),
        ("p", "remove", "presence", 20, 30, ""), ("p", "put", "presence", 28, None, "d"),
        ("s", "put", "event", 0, 15, "a"), ("s", "remove", "event", 5, 8, ""), ("s", "remove", "event", 8, 12, ""), ("s", "put", "event", 6, 12, "b"),
        ("o", "put", "event", 0, 15, "a"), ("o", "put", "event", 10, 30, "b"),
        ("m", "put", "event", 0, 15, "a"), ("m", "put", "event", 10, 20, "b"), ("m", "put", "event", 20, 30, "b"),
    ]
    got, raw = build(spark, rows)
    assert set(got) == {
        ("i", None, 0, 2), ("i", None, 4, 12), ("p", None, 5, None, "b"), ("p", None, 28, None, "d"),
        ("s", None, 0, 5, "a"), ("s", None, 6, 12, "b"), ("s", None, 12, 15, "a"),
        ("o", 0, 0, 15, "a"), ("o", 1, 10, 30, "b"), ("m", None, 0, 10, "a"), ("m", None, 10, 30, "b"),
    }
    assert len(got) == 11 and {(r["layer"], r["kind"]) for r in raw} == set(KINDS.items())
    assert {(r["lat"], r["lon"]) for r in raw if r["layer"] == "p"} == {(1.0, 2.0)}


@pytest.mark.parametrize("rows", [
    [("x", "put", "event", 0, 1, "a")],
    [("i", "put", "event", 0, 1, "a")],
    [("s", "put", "event", 0, 10, "a"), ("s", "remove", "event", 0, 5, ""), ("s", "put", "event", 4, 6, "b")],
])
def test_raises(spark, rows):
    with pytest.raises(PySparkException):
        build(spark, rows)
