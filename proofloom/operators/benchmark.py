"""Obtained against expected results, set against set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compared(want: DataFrame, got: DataFrame, key: str, equal: list[str], subset: list[str]) -> DataFrame:
    """(key, <column>_ok…, passed) of every expected case: columns in equal must be the same (nulls too), lists in subset must be contained."""
    mine = got.select(F.col(key).alias("__key"), *[F.col(x).alias(f"__{x}") for x in (*equal, *subset)])
    rows = want.join(mine, F.col(key) == F.col("__key"), "left")
    none = F.array().cast("array<string>")
    ok = {x: F.col(x).eqNullSafe(F.col(f"__{x}")) for x in equal}
    ok |= {x: F.size(F.array_except(F.coalesce(F.col(x), none), F.coalesce(F.col(f"__{x}"), none))) == 0 for x in subset}
    passed = F.lit(True)
    for x in ok.values():
        passed = passed & x
    return rows.select(key, *[v.alias(f"{k}_ok") for k, v in ok.items()], passed.alias("passed"))


def summary(rows: DataFrame, named: dict[str, str]) -> DataFrame:
    """(cases, passed, …): how many cases there are and how many pass, on the whole and by column."""
    return rows.agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"), *[F.count_if(F.col(c)).alias(k) for k, c in named.items()])


def coverage(facts: DataFrame, key: str, has_evidence: Column, item: str, expected: int) -> DataFrame:
    """(key, facts, with_evidence, extracted, expected, coverage): distinct items against how many are expected."""
    per = facts.groupBy(key, item).agg(F.count("*").alias("n"), F.count_if(has_evidence).alias("e"))
    rows = per.groupBy(key).agg(F.sum("n").alias("facts"), F.sum("e").alias("with_evidence"), F.count(item).alias("extracted"))
    return rows.withColumn("expected", F.lit(expected)).withColumn("coverage", F.round(F.col("with_evidence") / F.col("facts"), 6))
