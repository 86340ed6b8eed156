"""Row-level dataflow: what a lazy iterator does, for each key in the order of its rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.operators.frames import placed
from meridian.operators.sets import KEY


def _order(by: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*by).orderBy(*order)


def pairwise(df: DataFrame, columns: Sequence[str], order: Sequence[str], by: Sequence[str] = KEY) -> DataFrame:
    """Each row with the ``columns`` of the one after it, as next_*; the last row goes."""
    w = _order(by, order)
    rows = df.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}).withColumn("_n", F.lead(F.lit(1)).over(w))
    return rows.where("_n is not null").drop("_n")


def limit(df: DataFrame, n: int, order: Sequence[str], by: Sequence[str] = KEY, skip: int = 0) -> DataFrame:
    """At most n rows of each key, after the first ``skip``."""
    place = F.row_number().over(_order(by, order))
    return df.withColumn("_n", place).where((F.col("_n") > skip) & (F.col("_n") <= skip + n)).drop("_n")


def skip(df: DataFrame, n: int, order: Sequence[str], by: Sequence[str] = KEY) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(_order(by, order))).where(F.col("_n") > n).drop("_n")


def take_while(df: DataFrame, holds: Column, order: Sequence[str], by: Sequence[str] = KEY) -> DataFrame:
    """Rows of each key up to the first one for which ``holds`` isn't true."""
    so_far = F.min(F.coalesce(holds, F.lit(False))).over(_order(by, order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_on", so_far).where("_on").drop("_on")


def drop_while(df: DataFrame, holds: Column, order: Sequence[str], by: Sequence[str] = KEY) -> DataFrame:
    """Rows of each key from the first one on for which ``holds`` isn't true."""
    begun = F.max(~F.coalesce(holds, F.lit(False))).over(_order(by, order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_on", begun).where("_on").drop("_on")


def first(df: DataFrame, order: str, by: Sequence[str] = KEY) -> DataFrame:
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*by, "r.*")


def unfold(df: DataFrame, start: Column, step: Column, until: Column, name: str = "value") -> DataFrame:
    """Each row as often as start, start + step, ... goes, up to ``until``."""
    return df.withColumn(name, F.explode(F.sequence(start, until, step)))


def concat(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def multiplex(at: str, value: str, *frames: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """Rows of several ordered frames with equal keys and instants met in one: ``values``, by frame."""
    tagged = [f.select(*by, at, F.struct(F.lit(n).alias("n"), F.col(value).alias("v")).alias("e")) for n, f in enumerate(frames)]
    met = concat(*tagged).groupBy(*by, at).agg(F.sort_array(F.collect_list("e")).alias("es"))
    return met.select(*by, at, F.transform("es", lambda e: e["v"]).alias("values"))


def index(df: DataFrame, column: str) -> DataFrame:
    """With ``index``, the place (from 0) of a row's value among the distinct values in order."""
    return df.join(placed(df.select(column).distinct(), [column], "index"), column)


def pipeline(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """A reusable chain of transformations."""

    def run(df: DataFrame) -> DataFrame:
        for s in steps:
            df = df.transform(s)
        return df

    return run
