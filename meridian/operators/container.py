"""Containers: named, tagged interval sets, and expressions that combine them.

A container frame has container, id, tags, lo, hi. An expression is built from selectors and
the operators and, or, not; it becomes one DataFrame plan. Collections of one frame row set may
belong to many containers; everything is worked out for each of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.functions.moment import NINF, PINF
from meridian.operators import sets

BY = ("container",)
ERROR, ALWAYS, EMPTY = "error", "always", "empty"


@dataclass(frozen=True)
class Select:
    """Collections that all filters (predicates over id and tags) let through; all without any."""

    filters: tuple[Column, ...] = ()
    fallback: str = ERROR

    def else_always(self) -> Select:
        return Select(self.filters, ALWAYS)

    def else_empty(self) -> Select:
        return Select(self.filters, EMPTY)


@dataclass(frozen=True)
class Combine:
    """and, or, not over what the operands give; a selector gives each of its collections."""

    operator: str
    operands: tuple = field(default_factory=tuple)
    fallback: str = ERROR

    def else_always(self) -> Combine:
        return Combine(self.operator, self.operands, ALWAYS)

    def else_empty(self) -> Combine:
        return Combine(self.operator, self.operands, EMPTY)


def collections(*filters: Column) -> Select:
    return Select(tuple(filters))


def by_id(*ids: str) -> Column:
    return F.col("id").isin(list(ids))


def and_(*operands) -> Combine:
    return Combine("and", operands)


def or_(*operands) -> Combine:
    return Combine("or", operands)


def not_(*operands) -> Combine:
    return Combine("not", operands)


def simplified(node):
    """The same expression with nested and, or of one kind flattened and double negation undone.

    A node with a fallback of its own stays as it is.
    """
    if isinstance(node, Select):
        return node
    operands = [simplified(x) for x in node.operands]
    if node.operator in ("and", "or"):
        flat = []
        for x in operands:
            nested = isinstance(x, Combine) and x.operator == node.operator and x.operands and x.fallback == ERROR
            flat += x.operands if nested else [x]
        operands = flat
    only = operands[0] if len(operands) == 1 else None
    if node.operator == "not" and isinstance(only, Combine) and only.operator == "not" and only.operands:
        return simplified(Combine("or", only.operands, node.fallback))
    return Combine(node.operator, tuple(operands), node.fallback)


def unique_ids(rows: DataFrame) -> DataFrame:
    """container, id of ids that two collections share: there should be none. rows: container, id, tags."""
    return rows.groupBy(*BY, "id").agg(F.count("*").alias("n")).where("n > 1")


def get(rows: DataFrame, id_: str) -> DataFrame:
    """The collection of an id, without rows where there is none."""
    return sets.merge(rows.where(F.col("id") == id_), BY)


def combine(rows: DataFrame, *expression, domain: DataFrame | None = None) -> DataFrame:
    """container, lo, hi of an expression; several roots are and-ed.

    domain: the containers there are (those with rows, if not given). A selection that is empty
    in a container follows its fallback there; ERROR raises as the plan runs.
    """
    keys = (domain if domain is not None else rows).select(*BY).distinct()
    return sets.merge(_evaluate(rows, simplified(and_(*expression)), keys), BY)


def _operands(rows: DataFrame, node, keys: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(operand, lo, hi of what the node gives; container, count of its operands)."""
    if isinstance(node, Select):
        picked = reduce(lambda df, f: df.where(f), node.filters, rows)
        operands = picked.select(*BY, F.concat(F.lit(f"{n}/"), F.col("id")).alias("operand"), "lo", "hi")
        counts = keys.join(picked.groupBy(*BY).agg(F.count_distinct("id").alias("c")), list(BY), "left")
        counts = counts.select(*BY, F.coalesce("c", F.lit(0)).alias("c"))
        if node.fallback == ERROR:
            counts = counts.withColumn("c", F.when(F.assert_true(F.col("c") > 0, "no collection was selected").isNull(), F.col("c")))
        missing = counts.where("c = 0").select(*BY)
        if node.fallback == ALWAYS:
            operands = operands.unionByName(missing.select(*BY, F.lit(f"{n}/").alias("operand"), F.lit(NINF).alias("lo"), F.lit(PINF).alias("hi")))
        return operands, counts.select(*BY, F.greatest("c", F.lit(1)).alias("c"))
    made = _evaluate(rows, node, keys)
    return made.select(*BY, F.lit(f"{n}/").alias("operand"), "lo", "hi"), keys.withColumn("c", F.lit(1).cast("bigint"))


def _evaluate(rows: DataFrame, node, keys: DataFrame) -> DataFrame:
    if isinstance(node, Select):
        node = Combine("and", (node,))
    if not node.operands:
        made = keys.select(*BY, F.lit(NINF).alias("lo"), F.lit(PINF).alias("hi"))
        return made if node.operator == "not" or node.fallback == ALWAYS else made.where("false")
    parts = [_operands(rows, x, keys, n) for n, x in enumerate(node.operands)]
    operands = reduce(DataFrame.unionByName, (p[0] for p in parts))
    if node.operator == "or":
        return sets.merge(operands, BY)
    if node.operator == "not":
        return sets.not_(operands, keys, BY)
    counts = reduce(DataFrame.unionByName, (p[1] for p in parts)).groupBy(*BY).agg(F.sum("c").alias("n"))
    deep = sets.depth(operands, BY).join(counts, list(BY)).where("cnt = n")
    return sets.merge(deep, BY)
