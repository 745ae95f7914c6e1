"""The queries of this package: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.llm.oracles import ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proofloom.llm.tokens import read_documents, token_files

    return read_documents(token_files(table(spark, sf_dir, "documents")))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proofloom.llm.media import media_columns

    return media_columns(table(spark, sf_dir, "documents"))


def op3_mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proofloom.llm.mixing import mix

    mixed, sized, goals = mix(table(spark, sf_dir, "documents").withColumn("row", F.monotonically_increasing_id()), row="row")
    taken = mixed.groupBy("row").agg(F.sum("n").alias("taken"))
    goals = goals.select(F.col("source").alias("s"), "source_size", "target")
    rows = sized.join(goals, sized.source.eqNullSafe(goals.s)).join(taken, "row", "left")
    return rows.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), F.coalesce("taken", F.lit(0)).alias("taken"))


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proofloom.llm.repeats import remove_repeats

    rows = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proofloom.llm.packing import pack_apart

    return pack_apart(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proofloom.llm.quality_rules import quality

    return quality(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("n_lines")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proofloom.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proofloom.llm.tokens import section_tokens

    return section_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proofloom.llm.url_rules import judge

    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proofloom.llm.quality_model import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proofloom.llm.simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proofloom.llm.prefix_trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proofloom.llm.hard_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label))


#: In the order of the operators.
ALL = (
    op1_token_files,
    op2_media_columns,
    op3_mixed_sources,
    op4_repeated_passages,
    op5_packed_sequences,
    op6_quality_rules,
    op7_near_duplicates,
    op8_section_tokens,
    op9_url_rules,
    op10_quality_model,
    op11_simhash_groups,
    op12_prefix_trie,
    op13_hard_negatives,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in queries()}
