"""Most frequent items by cell, as summaries that merge: cells roll up to coarser ones without reading the rows again, and the error is known.

A cell's summary has its largest counts and a floor, the largest count that it left out (0 if it left out none). Of an item that a cell's summary
lacks, no more than the floor can have been there. So of an item's count over several cells there is a lower end, the sum of what the
summaries have, and an upper end, which adds the floors of the cells that lack it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _kept(counts: DataFrame, cell: list[str], item: str, most: int) -> DataFrame:
    """(cell, items: array of (low, high, item), floor) of (cell, item, low, high, floor): the largest by low, ties by item; the floor covers what goes."""
    entry = F.struct((-F.col("low")).alias("o"), F.col(item).alias("i"), "high")
    rows = counts.groupBy(*cell).agg(F.array_sort(F.collect_list(entry)).alias("__all"), F.max("floor").alias("floor"))
    gone = F.coalesce(F.array_max(F.transform(F.slice("__all", most + 1, 2**31 - 1 - most), lambda x: x["high"])), F.lit(0).cast("long"))
    items = F.transform(F.slice("__all", 1, most), lambda x: F.struct((-x["o"]).alias("low"), x["high"].alias("high"), x["i"].alias(item)))
    return rows.select(*cell, items.alias("items"), F.greatest("floor", gone).alias("floor"))


def summaries(rows: DataFrame, cell: list[str], item: str, most: int, weight: Column | None = None) -> DataFrame:
    """(cell, items, floor): each cell's ``most`` largest counts. Items are a closed list (rules, variables, reasons), so a cell has a bounded number of them."""
    n = F.sum(weight if weight is not None else F.lit(1)).cast("long")
    counts = rows.where(F.col(item).isNotNull()).groupBy(*cell, item).agg(n.alias("low")).select("*", F.col("low").alias("high"), F.lit(0).cast("long").alias("floor"))
    return _kept(counts, cell, item, most)


def merged(summary: DataFrame, cell: list[str], item: str, most: int) -> DataFrame:
    """The summaries of coarser cells, from those of finer ones; cell names columns that they still have."""
    floors = summary.groupBy(*cell).agg(F.sum("floor").cast("long").alias("floors"))
    each = summary.select(*cell, "floor", F.explode("items").alias("x")).select(*cell, "floor", "x.*")
    sums = each.groupBy(*cell, item).agg(F.sum("low").cast("long").alias("low"), F.sum("high").cast("long").alias("h"), F.sum("floor").cast("long").alias("own"))
    same = F.lit(True)
    for c in cell:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    floors = floors.select(*[F.col(c).alias(f"__{c}") for c in cell], "floors")
    sums = sums.join(floors, same).select(*cell, item, "low", (F.col("h") + F.col("floors") - F.col("own")).alias("high"), F.col("floors").alias("floor"))
    return _kept(sums, cell, item, most)


def top(summary: DataFrame, cell: list[str], item: str, k: int) -> DataFrame:
    """(cell, place, item, low, high): the k largest of each cell by their lower ends; counts lie between low and high."""
    return summary.select(*cell, F.posexplode(F.slice("items", 1, k)).alias("p", "x")).select(*cell, (F.col("p") + 1).alias("place"), f"x.{item}", "x.low", "x.high")
