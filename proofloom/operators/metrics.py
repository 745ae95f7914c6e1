"""Metrics over logs and cases. Where there is no data there is no number: null, never zero, and has_data says so."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def clean_rate(events: DataFrame, tenant: str, case: str, ts: str, finished: Column, objected: Column) -> DataFrame:
    """(tenant, finished, has_data, rate): of the finished cases the share without an objection before their end."""
    first = lambda p: F.min(F.when(p, F.col(ts)))
    per = events.groupBy(tenant, case).agg(first(finished).alias("done"), first(objected).alias("bad"))
    clean = F.count_if(F.col("done").isNotNull() & (F.col("bad").isNull() | (F.col("bad") >= F.col("done"))))
    rate = F.round(clean / F.nullif(F.count("done"), F.lit(0).cast("long")), 6)
    return per.groupBy(tenant).agg(F.count("done").alias("finished"), (F.count("done") > 0).alias("has_data"), rate.alias("rate"))


def conditional_sum(rows: DataFrame, by: Column, value: Column, holds: Column) -> DataFrame:
    """(by, savings, n, has_data): the sum over rows that hold."""
    return rows.groupBy(by).agg(F.sum(F.when(holds, value)).alias("savings"), F.count_if(holds).alias("n"), (F.count_if(holds) > 0).alias("has_data"))


def by_origin(rows: DataFrame, origin: str, case: str, spread: Column) -> DataFrame:
    """(origin, n, cases, spread), summed up by case first, so that no distinct meets in one task."""
    per = rows.groupBy(origin, case).agg(F.count("*").alias("n"), F.count_if(spread).alias("spread"))
    return per.groupBy(origin).agg(F.sum("n").alias("n"), F.count(case).alias("cases"), F.sum("spread").alias("spread"))


def shortage(demand: DataFrame, capacity: DataFrame, keys: list[str]) -> DataFrame:
    """demand (keys, …, demand) that is above capacity (keys, capacity), and by how much."""
    return demand.join(capacity, keys).where("demand > capacity").withColumn("short", F.col("demand") - F.col("capacity"))


def team_load(events: DataFrame, actor: str, case: str, admin: Column, reassigned: Column) -> DataFrame:
    """(actor, cases, actions, admin, reassigned)."""
    per = events.groupBy(actor, case).agg(F.count("*").alias("actions"), F.count_if(admin).alias("admin"), F.count_if(reassigned).alias("reassigned"))
    return per.groupBy(actor).agg(F.count(case).alias("cases"), *[F.sum(x).alias(x) for x in ("actions", "admin", "reassigned")])


def mix(cases: DataFrame, method: str, out: str) -> DataFrame:
    """(out, n, low_share, open_a_case) of (method, case, n, low, open)."""
    return cases.groupBy(F.col(method).alias(out)).agg(
        F.sum("n").alias("n"), F.round(F.sum("low") / F.sum("n"), 6).alias("low_share"), F.round(F.sum("open") / F.count("*"), 6).alias("open_a_case")
    )


def run_health(runs: DataFrame, step: str, failed: Column, cost: Column, budget: float) -> DataFrame:
    """(step, runs, errors, slowest, mean, over_budget)."""
    return runs.groupBy(step).agg(
        F.count("*").alias("runs"), F.count_if(failed).alias("errors"), F.max(cost).alias("slowest"), F.round(F.avg(cost), 6).alias("mean"), F.count_if(cost > budget).alias("over_budget")
    )


def quantiles(rows: DataFrame, key: str, value: str, wanted: dict[str, float]) -> DataFrame:
    """(key, wanted…, n): for each share the least value that at least this share of a key's values doesn't exceed.

    Equal values are counted first; running counts go over the distinct values of a key. Nulls don't count.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key)
    at = counts.withColumn("upto", F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
    found = [F.min(F.when(F.col("upto") >= F.greatest(F.ceil(F.col("all") * share), F.lit(1)), F.col(value))).alias(name) for name, share in wanted.items()]
    return at.groupBy(key).agg(*found, F.max("all").alias("n"))


def continuous_quantiles(rows: DataFrame, value: str, shares: dict[str, float], buckets: int = 500) -> dict[str, float | None]:
    """For each share the value at it, between two neighbours if it falls there; n as well. Null without rows; nulls don't count.

    Equal values are counted first. Approximate quantiles cut the range into buckets of about equal weight, whose counts tell in which ones the
    wanted ranks are; only those are put in order.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    bounds = sorted(set(counts.approxQuantile("v", [i / buckets for i in range(1, buckets)], 0.5 / buckets)))
    if not bounds:
        return dict.fromkeys(shares) | {"n": 0}
    counts = counts.withColumn("b", F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x < F.col("v"))))
    base, total = {}, 0
    for r in counts.groupBy("b").agg(F.sum("n").alias("n")).orderBy("b").collect():
        base[r.b], total = total, total + r.n
    ranks = sorted({f(share * (total - 1)) for share in shares.values() for f in (math.floor, math.ceil)})
    bucket = {k: max(b for b, start in base.items() if start <= k) for k in ranks}
    upto = F.sum("n").over(Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    some = counts.where(F.col("b").isin(sorted(set(bucket.values())))).withColumn("upto", upto)
    at = some.agg(*[F.min(F.when((F.col("b") == b) & (F.col("upto") > k - base[b]), F.col("v"))).alias(f"r{k}") for k, b in bucket.items()]).first()
    out: dict[str, float | None] = {}
    for name, share in shares.items():
        lo, hi = math.floor(share * (total - 1)), math.ceil(share * (total - 1))
        out[name] = at[f"r{lo}"] + (at[f"r{hi}"] - at[f"r{lo}"]) * (share * (total - 1) - lo)
    return out | {"n": total}


def ranked(rows: DataFrame, keys: list[str], order: str, out: str, width: int = 50_000) -> DataFrame:
    """rows with their rank from 1 within keys, by a whole-number order. Ranks are counted within stretches of the order and the stretches' counts
    are summed, so a key with very many rows doesn't meet in one task."""
    rows = rows.withColumn("__s", F.floor(F.col(order) / width))
    sizes = rows.groupBy(*keys, "__s").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*keys, "__s", F.coalesce(before, F.lit(0)).alias("__base"))
    own = F.row_number().over(Window.partitionBy(*keys, "__s").orderBy(order))
    return rows.withColumn("__own", own).join(sizes, [*keys, "__s"]).withColumn(out, F.col("__base") + F.col("__own")).drop("__s", "__own", "__base")
