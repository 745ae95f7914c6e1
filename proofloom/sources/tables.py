"""Reference tables from CSV: the header is held against what is declared, values are typed, keys and values checked when they are loaded."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.operators import lookup as U


class TableError(ValueError):
    """A reference table isn't what its declaration says."""


@dataclass(frozen=True)
class TableSpec:
    name: str
    key: str
    value: str
    #: Column -> Spark type, in the order of the header.
    columns: dict[str, str]
    #: Whether a value that falls where keys rise is told.
    monotone: bool = True


def read_table(spark: SparkSession, path: str, spec: TableSpec) -> tuple[DataFrame, list[str]]:
    """The table and warnings about it. A wrong header, a value that doesn't fit its type, a missing key or value, a key twice or a value of 0 or less is an error."""
    raw = spark.read.option("header", True).csv(path)
    if raw.columns != list(spec.columns):
        raise TableError(f"{spec.name}: header {raw.columns}, declared {list(spec.columns)}")
    rows = raw.select(*[F.col(c).try_cast(t).alias(c) for c, t in spec.columns.items()])
    faults = raw.select(*[(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias(c) for c, t in spec.columns.items()])
    bad = faults.agg(*[F.coalesce(F.count_if(F.col(c)), F.lit(0)).alias(c) for c in spec.columns]).first().asDict()
    if wrong := [c for c, n in bad.items() if n]:
        raise TableError(f"{spec.name}: values that don't fit in {wrong}")
    empty = rows.agg(F.count_if(F.col(spec.key).isNull()).alias("keys"), F.count_if(F.col(spec.value).isNull()).alias("values")).first()
    if empty["keys"] or empty["values"]:
        raise TableError(f"{spec.name}: {empty['keys']} rows without {spec.key}, {empty['values']} without {spec.value}")
    sane = U.sanity(rows, spec.key, spec.value).first()
    if sane.not_rising or sane.not_positive:
        raise TableError(f"{spec.name}: {sane.not_rising} repeated keys, {sane.not_positive} values that aren't positive")
    warnings = [f"{spec.name}: {sane.not_monotone} values fall where keys rise"] if spec.monotone and sane.not_monotone else []
    return rows, warnings


def undeclared(spec: TableSpec, used: set[str]) -> list[str]:
    """Columns that somebody uses and the table doesn't declare."""
    return sorted(used - set(spec.columns))
