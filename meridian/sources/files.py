"""Reading and writing interval frames in Spark's file formats."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.functions import moment as M


def read(spark: SparkSession, path: str, lower: Column, upper: Column, keys: Mapping[str, Column], fmt: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """A frame of key columns, lo and hi from timestamp columns; a null bound is infinite.

    Only the columns that the expressions name are read, and a filter on them reaches the scan.
    """
    reader = spark.read.format(fmt).options(**options)
    rows = (reader.schema(schema) if schema else reader).load(path)
    lo = F.coalesce(M.from_timestamp(lower), M.ninf()).alias("lo")
    hi = F.coalesce(M.from_timestamp(upper), M.pinf()).alias("hi")
    return rows.select(*[c.alias(n) for n, c in keys.items()], lo, hi)


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = (), **options) -> None:
    """Bounds as timestamps, infinite ones as nulls."""
    rows = df.withColumns({"lo": M.to_timestamp(F.col("lo")), "hi": M.to_timestamp(F.col("hi"))})
    rows.write.format(fmt).options(**options).mode(mode).partitionBy(*partition_by).save(path)
