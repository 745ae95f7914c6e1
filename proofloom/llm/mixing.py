"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions.

Every source is a stream: its documents in a shuffled order, cut into blocks of equal numbers of words, and read again from the start where the
target is larger than the source. Slots of the mix take their source from golden-ratio points mapped through the cumulative
targets, so that every stretch of the mix is near the wanted shares; the k-th slot of a source takes its k-th block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofloom.llm.shared import WORD, cut, running_start

#: The golden ratio's fraction, and that of 2^20 times it: slots are taken as 2^20 * high + low, so that products stay exact to 1e-9 for all of them.
_GOLDEN, _GOLDEN_20 = 0.6180339887498949, 0.607787409740351


@dataclass(frozen=True)
class Mixing:
    #: Weights of the sources by code point, null last, repeating.
    weights: tuple[int, ...] = (3, 1, 2)
    #: Words of the mix by words of all documents, and the most that a source gives by its size.
    share: float = 1.5
    most: float = 2.0
    #: Words of a block.
    block: int = 1024
    #: Rows that one task sums in order.
    span_rows: int = 50_000


def sizes(docs: DataFrame, *more: str | Column) -> DataFrame:
    return docs.select(*more, "doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"))


def targets(sized: DataFrame, cfg: Mixing) -> DataFrame:
    """(source, source_size, target, quota): target in words, quota the whole number of them. One row a source.

    Below a level, a source's target is the level times its weight; a source for which that is over ``most`` times its size stops there.
    The level rises until the targets share all words; only sums leave the executors.
    """
    spark = sized.sparkSession
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, cfg.weights)), (place % len(cfg.weights)) + 1))
    s = cut(spark, s.withColumn("stop", cfg.most * F.col("source_size")), "sources")
    words = s.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * cfg.share
    level = 0.0
    while True:
        stopped = F.col("stop") <= level * F.col("weight")
        full, free = s.agg(F.coalesce(F.sum(F.when(stopped, F.col("stop"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~stopped, F.col("weight"))), F.lit(0))).first()
        if not free or (words - full) / free <= level:
            break
        level = (words - full) / free
    s = s.withColumn("target", F.least("stop", level * F.col("weight")) if words else F.lit(0.0))
    return s.select("source", "source_size", "target", F.least(F.round("target"), F.floor("stop")).cast("long").alias("quota"))


def points_at(slot: Column) -> Column:
    """The golden-ratio point in [0, 1) of a slot."""
    high, low = F.floor(slot / (1 << 20)), slot % (1 << 20)
    return ((low + 0.5) * _GOLDEN + high * _GOLDEN_20) % 1


def schedule(goals: DataFrame, cfg: Mixing) -> DataFrame:
    """(slot, source, rank): slot orders the mix; every rank below a source's number of blocks is there once."""
    spark = goals.sparkSession
    goals = goals.where("quota > 0").withColumn("blocks", F.ceil(F.col("quota") / cfg.block))
    n_sources, slots = goals.agg(F.count("*"), F.coalesce(F.sum("blocks"), F.lit(0))).first()
    cells = max(4096, n_sources)
    to = F.sum("blocks").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, 0))
    spans = goals.withColumn("hi", to / max(slots, 1)).withColumn("lo", (to - F.col("blocks")) / max(slots, 1))
    last = F.least(F.lit(cells - 1), F.floor(F.col("hi") * cells))
    spans = spans.select("source", "blocks", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * cells), last)).alias("cell"))
    points = spark.range(slots).select(F.col("id").alias("slot"), points_at(F.col("id")).alias("x"))
    points = points.withColumn("cell", F.floor(F.col("x") * cells))
    drawn = points.join(spans, "cell").where("x >= lo and x < hi").withColumn("one", F.lit(1)).select("slot", "source", "blocks", "one")
    ranked = running_start(drawn, ["source"], [F.col("slot")], "one", "rank", F.floor(F.col("slot") / cfg.span_rows))
    ranked = cut(spark, ranked.where("rank < blocks").select("slot", "source", "rank"), "slots")
    # The few blocks whose slots the points were short of come last.
    had = ranked.groupBy("source").agg(F.count("*").alias("had"))
    short = goals.join(had, goals.source.eqNullSafe(had.source), "left").select(goals.source, F.coalesce("had", F.lit(0)).alias("had"), "blocks").where("had < blocks")
    short = short.select("source", F.explode(F.sequence(F.col("had"), F.col("blocks") - 1)).alias("rank"))
    return ranked.union(short.select((F.lit(slots) + F.col("rank")).alias("slot"), "source", "rank"))


def mix(docs: DataFrame, cfg: Mixing | None = None, row: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix, the sized documents and the targets.

    Mix: (slot, source, doc_id, round, first, n): in this slot, n words of the document from word first on, read for the round-th time (0 or
    more). Documents without words, null texts included, are in no slot. Null is a source. The order within a source is that of md5(doc_id),
    then doc_id, size and text, so reruns agree; rows without doc_id come last. Rows that repeat a doc_id or have none are documents of their
    own: ``row`` names a column of docs that tells all rows apart, which mix and sized documents then have too.
    """
    cfg = cfg or Mixing()
    spark = docs.sparkSession
    number = F.col(row) if row else F.monotonically_increasing_id()
    sized = cut(spark, sizes(docs, number.alias("__row"), F.xxhash64("text").alias("__tie")), "sizes")
    goals = cut(spark, targets(sized, cfg), "targets")
    rows = sized.count()
    order = [F.col("__key").asc_nulls_last(), *map(F.col, ("doc_id", "size", "__tie", "__row"))]
    placed = sized.withColumn("__key", F.md5(F.col("doc_id").cast("string"))).repartitionByRange(max(1, -(-rows // cfg.span_rows)), *order)
    placed = cut(spark, placed.withColumn("__part", F.spark_partition_id()), "spans")  # ranges of rows: no doc_id, null neither, fills a span alone
    placed = running_start(placed, ["source"], order, "size", "at", F.col("__part"))
    g = goals.select(F.col("source").alias("s"), "source_size", "quota")
    placed = placed.join(g, placed.source.eqNullSafe(g.s)).where("size > 0")
    rounds = F.sequence(F.lit(0), F.floor((F.col("quota") - F.col("at") - 1) / F.col("source_size")))
    turns = placed.where("at < quota").withColumn("round", F.explode(rounds)).withColumn("lo", F.col("at") + F.col("round") * F.col("source_size"))
    turns = turns.withColumn("hi", F.least(F.col("lo") + F.col("size"), "quota"))
    parts = turns.withColumn("rank", F.explode(F.sequence(F.floor(F.col("lo") / cfg.block), F.floor((F.col("hi") - 1) / cfg.block))))
    begin = F.greatest("lo", F.col("rank") * cfg.block)
    parts = parts.select(F.col("source").alias("s"), F.col("rank").alias("r"), "__row", "doc_id", "round", (begin - F.col("lo")).alias("first"), (F.least("hi", (F.col("rank") + 1) * cfg.block) - begin).alias("n"))
    slots = schedule(goals, cfg)
    mixed = parts.join(slots, F.col("s").eqNullSafe(slots.source) & (F.col("r") == slots.rank)).select("slot", "source", "__row", "doc_id", "round", "first", "n")
    mixed, sized = (df.withColumnRenamed("__row", row) if row else df.drop("__row") for df in (mixed, sized.drop("__tie")))
    return mixed, sized, goals
