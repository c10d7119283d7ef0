"""Neighbours and running totals along an order, in two levels.

A window keyed by a handful of missions would give each of them to one task. Here rows are dealt by
(keys, block), a block being a stretch of the order (a day, say): windows work inside blocks, and
what goes across comes from a table of one row per block, the only one whose windows are keyed by
``keys`` alone. Blocks have to follow the order: a row of a later block never comes earlier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _on(keys: list[str], names: list[str]) -> Column:
    out = F.col("_block") == F.col("_block2")
    for k, n in zip(keys, names, strict=True):
        out = out & F.col(k).eqNullSafe(F.col(n))
    return out


def _joined(rows: DataFrame, ends: DataFrame, keys: list[str]) -> DataFrame:
    """``ends`` (one row per block) beside the rows of their block."""
    names = [f"_key{k}" for k in range(len(keys))]
    renamed = ends.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("_block").alias("_block2"), *[c for c in ends.columns if c not in (*keys, "_block")])
    return rows.join(renamed, _on(keys, names), "left").drop(*names, "_block2")


def beside(rows: DataFrame, keys: list[str], block: Column, order: list[str], columns: list[str]) -> DataFrame:
    """Adds _prev and _next: structs of ``columns`` of the rows before and after, null at the ends."""
    own, here = W.partitionBy(*keys, "_block").orderBy(*order), F.struct(*columns)
    marked = rows.withColumn("_block", block)
    at = F.struct(*order)
    ends = marked.groupBy(*keys, "_block").agg(F.min_by(here, at).alias("_first"), F.max_by(here, at).alias("_last"))
    across = W.partitionBy(*keys).orderBy("_block")
    ends = ends.select(*keys, "_block", F.lag("_last").over(across).alias("_before"), F.lead("_first").over(across).alias("_after"))
    inside = marked.withColumn("_prev", F.lag(here).over(own)).withColumn("_next", F.lead(here).over(own))
    found = _joined(inside, ends, keys)
    return found.withColumn("_prev", F.coalesce("_prev", "_before")).withColumn("_next", F.coalesce("_next", "_after")).drop("_before", "_after", "_block")


def running(rows: DataFrame, keys: list[str], block: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows up to and with each one, and _all, that of all rows of its keys."""
    marked = rows.withColumn("_block", block).withColumn("_value", value)
    across = W.partitionBy(*keys)
    sums = marked.groupBy(*keys, "_block").agg(F.sum("_value").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(across.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*keys, "_block", before.alias("_before"), F.sum("_sum").over(across).alias("_all"))
    own = W.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = _joined(marked.withColumn(name, F.sum("_value").over(own)), sums, keys)
    return found.withColumn(name, F.col(name) + F.col("_before")).drop("_before", "_block", "_value")
