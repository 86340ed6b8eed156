"""The star-schema tables read as frames of the domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.functions import moment as M
from meridian.functions import tags as T
from meridian.functions.moment import SECOND


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key (user), seq, type, v, props, t, and an interval [lo, hi) from the event for ``v`` minutes."""
    t = M.from_timestamp(F.col("ts"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("type"),
        F.col("value").alias("v"),
        "props",
        t.alias("t"),
        t.alias("lo"),
        (t + (F.floor(F.col("value") * 60) + 1) * SECOND).alias("hi"),
    )


def operands(spark: SparkSession, sf_dir: str, *types: str) -> DataFrame:
    """key, operand (the event type), lo, hi."""
    rows = events(spark, sf_dir)
    return rows.where(F.col("type").isin(*types)).select("key", F.col("type").alias("operand"), "lo", "hi")


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key (customer), order, line, lo (ordered), hi (shipped), where it was ordered first."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", M.from_timestamp(F.col("o_orderdate")).alias("lo"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", M.from_timestamp(F.col("l_shipdate")).alias("hi"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).where("lo < hi")
    return rows.select(F.col("o_custkey").alias("key"), F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line"), "lo", "hi")


def _lat(n):
    return F.pmod(n * 37, F.lit(1700)) / F.lit(10.0) - F.lit(85.0)


def _lon(n):
    return F.pmod(n * 91, F.lit(3600)) / F.lit(10.0) - F.lit(180.0)


def presences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track (user), seq, t, lat, lon."""
    rows = events(spark, sf_dir)
    return rows.select(F.col("key").alias("track"), "seq", "t", _lat(F.col("seq")).alias("lat"), _lon(F.col("seq")).alias("lon"))


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id (supplier), nation, lat, lon."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), _lat(F.col("s_suppkey")).alias("lat"), _lon(F.col("s_suppkey")).alias("lon")
    )


def tagged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id (order), tags: the priority as a name, status as a key with a value."""
    tags = T.build(T.tag(F.col("o_orderpriority")), T.tag("status", F.col("o_orderstatus")), T.tag("status", F.when(F.col("o_totalprice") > 250000, "large").otherwise(F.col("o_orderstatus"))))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), tags.alias("tags"))
