"""Event logs as lines of JSON: one event a line, keys in order, decimals and instants as text. Batch and stream read the same lines."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: An event's line.
LINE = "event_id long, user_id long, ts string, event_type string, value string, seq long, prev_hash string, own_hash string"


def lines(events: DataFrame) -> DataFrame:
    """events as canonical lines (user_id, seq, value): absent fields are left out, so a line is the same whoever writes it."""
    names = [c.split()[0] for c in LINE.split(", ")]
    there = {c: F.col(c) for c in names if c in events.columns}
    there["ts"] = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    there["value"] = F.col("value").cast("decimal(18,4)").cast("string")
    body = F.struct(*[there[c].alias(c) for c in sorted(there)])
    order = F.col("seq") if "seq" in events.columns else F.col("event_id")
    return events.select("user_id", order.alias("seq"), F.to_json(body).alias("value"))


def write_log(events: DataFrame, path: str) -> None:
    """Append to a log: files of lines by case bucket, in each case's order."""
    rows = lines(events).repartition("user_id").sortWithinPartitions("user_id", "seq")
    rows.select("value").write.mode("append").text(path)


def append_once(events: DataFrame, path: str) -> None:
    """Append to a log by days what isn't there yet: a line is its own identity, so a job that is repeated adds nothing.

    Only the days of the given events are read again. One writer at a time; what a failed job has written, Spark doesn't commit.
    """
    spark = events.sparkSession
    rows = lines(events).dropDuplicates(["value"]).withColumn("day", F.to_date(F.get_json_object("value", "$.ts").cast("timestamp")))
    days = [r.day for r in rows.select("day").distinct().collect()]  # those of one delivery
    try:
        there = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        there = None
    if there is not None and "day" in there.columns:
        same = F.col("day").isin([d for d in days if d is not None]) | F.col("day").isNull()
        rows = rows.join(there.where(same).select(F.sha2("value", 256).alias("__sha")), F.sha2("value", 256) == F.col("__sha"), "left_anti")
    rows = rows.repartition("day", "user_id").sortWithinPartitions("day", "user_id", "seq")
    rows.select("value", "day").write.partitionBy("day").mode("append").text(path)


def _parsed(raw: DataFrame) -> DataFrame:
    rows = raw.select(F.from_json("value", LINE).alias("e")).select("e.*")
    return rows.withColumn("ts", F.to_timestamp("ts")).withColumn("value", F.col("value").cast("decimal(18,4)"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The events of a log. Hashes are read, not recomputed: ``operators.log.broken_links`` does that."""
    return _parsed(spark.read.text(path))


def stream_log(spark: SparkSession, path: str, files_a_time: int = 1) -> DataFrame:
    """The same, as a stream of what is appended."""
    return _parsed(spark.readStream.option("maxFilesPerTrigger", files_a_time).text(path))
