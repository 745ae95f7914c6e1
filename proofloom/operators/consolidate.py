"""Reconciling several sources of one fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def consolidate(evidence: DataFrame, keys: list[str], value: str, source: str, order: str, priority: Column) -> DataFrame:
    """One row for each fact: n_sources, conflict, value (null in conflict: it is never chosen), best_source (lowest priority, then order).

    One aggregation: distinctness is told by min and max, the choice by min_by.
    """
    best = F.min_by(F.col(source), F.struct(priority, F.col(order)))
    conflict = F.min(value) < F.max(value)
    return evidence.groupBy(*keys).agg(
        F.count("*").alias("n_sources"), F.coalesce(conflict, F.lit(False)).alias("conflict"), F.when(~conflict, F.min(value)).alias("value"), best.alias("best_source")
    )


def suffixed_sources(evidence: DataFrame, keys: list[str], source: str, value: str, out: str) -> DataFrame:
    """The source's name, with #2, #3 ... for its further values."""
    rank = F.dense_rank().over(Window.partitionBy(*keys, source).orderBy(value))
    return evidence.withColumn(out, F.when(rank > 1, F.concat(F.col(source), F.lit("#"), rank.cast("string"))).otherwise(F.col(source)))


def resolve_secondary(links: DataFrame, secondary: str, primary: str) -> DataFrame:
    """(secondary, primary or null if there isn't exactly one, resolved)."""
    one = F.min(primary) == F.max(primary)
    return links.groupBy(secondary).agg(F.when(one, F.min(primary)).alias(primary), F.coalesce(one, F.lit(False)).alias("resolved"))
