"""A training corpus in five stages, each written and read again before the next.

Quality rules drop junk, near-duplicate groups keep one document, repeated passages stay in their first document only, sources are mixed to
their target weights, and what is left is packed into sequences. All but the last stage return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.llm.mixing import mix
from proofloom.llm.near_dup import NearDup, near_duplicates
from proofloom.llm.packing import pack
from proofloom.llm.quality_rules import keep_good
from proofloom.llm.repeats import remove_repeats
from proofloom.llm.shared import SPACE, cut, with_rows

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return keep_good(docs).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links of similarity 0.8 or more hold together: that of the smallest doc_id, none being the largest."""
    docs = with_rows(spark, docs.select(*COLUMNS))
    groups = near_duplicates(docs.select(F.col("row").alias("doc_id"), "text"), NearDup(percent=80)).select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "tie", "row")
    kept = groups.join(docs.select("row", "doc_id", F.xxhash64("text").alias("tie")), "row").groupBy("component_id").agg(F.min_by("row", order).alias("row"))
    return docs.join(kept, "row", "left_semi").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that repeat a passage of an earlier document; others as they were. Documents may become empty."""
    rows = remove_repeats(docs.withColumn("whole", F.col("text")))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("whole"))
    return rows.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads them, a row for each time; where the mix ends within one, only its words up to there."""
    docs = with_rows(spark, docs.select(*COLUMNS))
    mixed, sized, _ = mix(docs, row="row")
    turns = mixed.groupBy("row", "round").agg(F.sum("n").alias("n")).join(sized.select("row", "size"), "row")
    turns = cut(spark, turns, "turns")
    words = F.filter(F.split("text", f"{SPACE}+"), lambda x: x != "")
    part = F.when(F.col("n") < F.col("size"), F.array_join(F.slice(words, 1, F.col("n").cast("int")), " ")).otherwise(F.col("text"))
    rows = docs.join(turns, "row").withColumn("text", part)
    return rows.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of a document stands in the packed sequences."""
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources", mixed_sources),
    ("best-fit packing", packed_sequences),
]

#: Packing has no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
