"""Lookups in versioned tables: exact, interpolated, as of an instant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Reference tables are broadcast up to this many rows.
MOST_BROADCAST = 1000


def exact(rows: DataFrame, at: str, table: DataFrame, key: str) -> DataFrame:
    """rows with the table's columns where its key is rows[at], else null."""
    return rows.join(table, F.col(at) == F.col(key), "left").drop(key)


def sanity(table: DataFrame, key: str, value: str) -> DataFrame:
    """(n, not_rising, not_positive, not_monotone) of a reference table in the order of its key: one row a published value."""
    w = Window.orderBy(key)
    rows = table.select(F.col(key).alias("k"), F.col(value).alias("v"), F.lag(key).over(w).alias("k0"), F.lag(value).over(w).alias("v0"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("k") <= F.col("k0")).alias("not_rising"), F.count_if(F.col("v") <= 0).alias("not_positive"), F.count_if(F.col("v") < F.col("v0")).alias("not_monotone"))


def _between(x: Column, exact: bool) -> Column:
    """The value at x from the bracket (__k, __v) and (__k2, __v2): exact, linear, or null."""
    linear = F.col("__v") + (x - F.col("__k")) * (F.col("__v2") - F.col("__v")) / (F.col("__k2") - F.col("__k"))
    return F.when(x == F.col("__k"), F.col("__v")).otherwise(linear).cast("decimal(28,12)" if exact else "double")


def interpolate(rows: DataFrame, at: str, table: DataFrame, key: str, value: str, out: str, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """rows with the table's value at rows[at]: exact, or linear between its two neighbours; null outside of the table's keys.

    The table's keys are distinct. Tables of up to most_broadcast rows are broadcast with their brackets. For larger ones, the distinct values of
    rows[at] and the keys are put in order together, within stretches of about equal weight; each looks back and ahead in its stretch, and beyond
    it to the nearest key of the stretches before and after. Rows then find their value by equality. Whole and decimal keys and values give a decimal of 12 places,
    others a double, whatever the size of the table.
    """
    kinds = [dict(rows.dtypes)[at], dict(table.dtypes)[key], dict(table.dtypes)[value]]
    exact = not any(k in ("float", "double", "string") for k in kinds)
    as_key, as_value = ("decimal(18,4)", "decimal(18,6)") if exact else ("double", "double")
    table = table.select(F.col(key).cast(as_key).alias(key), F.col(value).cast(as_value).alias(value))
    asked_at = F.col(at).cast(as_key)
    if table.limit(most_broadcast + 1).count() <= most_broadcast:
        w = Window.orderBy(key)  # bounded by most_broadcast
        t = table.select(F.col(key).alias("__k"), F.col(value).alias("__v"), F.lead(key).over(w).alias("__k2"), F.lead(value).over(w).alias("__v2"))
        x = asked_at
        fits = (x == F.col("__k")) | ((x > F.col("__k")) & (x < F.col("__k2")))
        joined = rows.join(F.broadcast(t), fits, "left")
        return joined.withColumn(out, _between(x, exact)).drop("__k", "__v", "__k2", "__v2")
    bounds = sorted(set(table.approxQuantile(key, [i / 200 for i in range(1, 200)], 0.002)))
    stretch = lambda x: F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= x))
    point = F.struct(F.col("__at").alias("k"), F.col("__val").alias("v"))
    keys = table.select(F.col(key).alias("__at"), F.col(value).alias("__val"), F.lit(True).alias("__is"))
    asked = rows.select(asked_at.alias("__at")).where("__at is not null").distinct()
    both = keys.union(asked.select("__at", F.lit(None).cast(as_value), F.lit(False))).withColumn("__s", stretch(F.col("__at")))
    ends = keys.withColumn("__s", stretch(F.col("__at"))).groupBy("__s").agg(F.min(point).alias("lo"), F.max(point).alias("hi"))
    every = table.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias("__s")).join(ends, "__s", "left")
    w = Window.orderBy("__s")  # one row a stretch
    every = every.select("__s", F.last("hi", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"), F.first("lo", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("__after"))
    own = Window.partitionBy("__s").orderBy("__at", F.col("__is").desc())
    known = F.when(F.col("__is"), point)
    back, ahead = F.last(known, True).over(own.rowsBetween(Window.unboundedPreceding, 0)), F.first(known, True).over(own.rowsBetween(1, Window.unboundedFollowing))
    found = both.withColumn("__b", back).withColumn("__a", ahead).where("not __is").join(F.broadcast(every), "__s")
    found = found.withColumn("__b", F.coalesce("__b", "__before")).withColumn("__a", F.coalesce("__a", "__after"))
    found = found.select("__at", F.col("__b.k").alias("__k"), F.col("__b.v").alias("__v"), F.col("__a.k").alias("__k2"), F.col("__a.v").alias("__v2"))
    found = found.select(F.col("__at").alias("__x"), _between(F.col("__at"), exact).alias(out))
    return rows.join(found, asked_at == F.col("__x"), "left").drop("__x")


def as_of(events: DataFrame, key: str, order: list[Column], is_version: Column, value: Column, out: str) -> DataFrame:
    """Each event with the last version's value before it, of the same key; one shuffle, no join."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn(out, F.last(F.when(is_version, value), ignorenulls=True).over(w))
