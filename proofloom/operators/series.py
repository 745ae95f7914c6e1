"""Time series of a unit: sampling interval, running share, fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofloom.operators import fold


def modal_gap(rows: DataFrame, key: str, ts: Column, order: list[str], unit_seconds: int) -> DataFrame:
    """(key, gap, n): the most frequent gap between neighbours in whole units, the smallest of equals."""
    seconds = F.floor(F.unix_seconds(ts.cast("timestamp")) / unit_seconds)
    gaps = rows.withColumn("gap", seconds - F.lag(seconds).over(Window.partitionBy(key).orderBy(*order))).where("gap is not null")
    counts = gaps.groupBy(key, "gap").agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.max(F.struct("n", (-F.col("gap")).alias("g"))).alias("m")).select(key, (-F.col("m.g")).alias("gap"), F.col("m.n").alias("n"))


def running_share(rows: DataFrame, key: str, running: Column, value: Column, hours: float) -> DataFrame:
    """(key, n, n_running, mean_running, hours_running): mean over running rows, and hours a year from their share."""
    return rows.groupBy(key).agg(
        F.count("*").alias("n"), F.count_if(running).alias("n_running"), F.round(F.avg(F.when(running, value)), 6).alias("mean_running"), F.round(F.count_if(running) * hours / F.count("*"), 6).alias("hours_running")
    )


def fingerprint(rows: DataFrame, key: str, order: list[str], line: Column) -> DataFrame:
    """(key, n, sha256) of the lines in order."""
    return fold.digests(rows, key, order, line)
