"""Written intermediate tables and small helpers for frames."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where none is set, one of this machine's own if the driver is the only process, as in tests;
    on a cluster that would lose rows, so it raises.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_dir:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        set_dir = tempfile.mkdtemp(prefix="meridian-")
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back.

    What follows reads files that outlive any executor, sees only the columns it asks for,
    and carries no lineage. Tables stay until ``clear``, or until the end of a ``written`` block
    around the call.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _open:
        _open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def written(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the tables that were cut inside it. For steps whose result is written too."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            _remove(spark, path)


def kept(df: DataFrame) -> DataFrame:
    """``cut`` whose table outlives the ``written`` block that it is called in (not one around that)."""
    out = cut(df)
    if _open:
        path = _open[-1].pop()
        if len(_open) > 1:
            _open[-2].append(path)
    return out


def clear(spark: SparkSession) -> None:
    """Removes all tables that this application has cut. Frames that read them must be done with."""
    _remove(spark, _folder(spark))


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/meridian-{spark.sparkContext.applicationId}"


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def same(left: DataFrame, right: DataFrame, by: list[str]) -> Column:
    """Equality of the key columns of two frames."""
    out = F.lit(True)
    for c in by:
        out = out & left[c].eqNullSafe(right[c])
    return out


def placed(df: DataFrame, order: Sequence[str], name: str = "place") -> DataFrame:
    """``df`` with each row's place (from 0) in the order of some columns, over all tasks.

    Rows are dealt by ranges and sorted in each; only the number of rows of each range meets in
    one task. The order must tell all rows apart for the places to be the same every time.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    held = cut(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part, at = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))  # a row for each task
    rows = held.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return rows.withColumn(name, at + F.col("_start")).drop("_at", "_part", "_start")
