"""Folders of documents: files by content, their lines, parts with ids of their own. ``tree`` writes folders and reads them again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, bytes, content) of all files below a folder; hidden and temporary ones are left out. Read by Spark, wherever the folder is."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    rows = rows.select("path", name.alias("name"), F.col("length").alias("bytes"), "content")
    return rows.where(~F.col("name").rlike(r"^[._~]") & ~F.col("name").rlike(r"(~|\.tmp|\.part)$"))


def ingested(files: DataFrame) -> DataFrame:
    """(doc_id, path, format, bytes, n_lines, warning): documents by the fingerprint of their bytes, taken before anything else is done with them.

    Text formats are read; what has no reader here is a document with a warning, never an error. Equal contents are one document, under their first path.
    """
    kind = F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1))
    rows = files.select(F.sha2("content", 256).alias("doc_id"), "path", kind.alias("format"), "bytes", F.when(kind.isin("txt", "csv", "json", "jsonl", "md", "yaml"), F.decode("content", "UTF-8")).alias("text"))
    rows = rows.select("doc_id", "path", "format", "bytes", F.size(F.split("text", "\n")).alias("lines"), F.when(F.col("text").isNull(), F.concat(F.lit("no reader for "), "format")).alias("warning"))
    first = F.min(F.struct("path", "format", "bytes", "lines", "warning"))
    rows = rows.groupBy("doc_id").agg(first.alias("f"))
    return rows.select("doc_id", "f.path", "f.format", "f.bytes", F.when(F.col("f.lines") > 0, F.col("f.lines")).alias("n_lines"), "f.warning")


def pages_of(files: DataFrame) -> DataFrame:
    """(doc_id, page, text): the pages of text documents, a form feed between them; equal contents once."""
    kind = F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1))
    texts = files.where(kind.isin("txt", "md")).select(F.sha2("content", 256).alias("doc_id"), F.decode("content", "UTF-8").alias("text")).dropDuplicates(["doc_id"])
    return texts.select("doc_id", F.posexplode(F.split("text", "\f")).alias("p", "text")).select("doc_id", (F.col("p") + 1).alias("page"), "text")


def read_documents(pages: DataFrame, begins: Column) -> DataFrame:
    """(id, doc_id, first, last, text): what is read of pages (doc_id, page, text): documents as they are, and the parts of combined ones instead of them.

    begins: whether a page begins a document of its own. With two such pages or more a document is combined; pages before the first of them belong to no part.
    """
    w = Window.partitionBy("doc_id")  # a document's pages
    rows = pages.withColumn("__part", F.count_if(begins).over(w.orderBy("page").rowsBetween(Window.unboundedPreceding, 0))).withColumn("__cuts", F.count_if(begins).over(w))
    rows = rows.where("__cuts < 2 or __part > 0").withColumn("__part", F.when(F.col("__cuts") >= 2, F.col("__part")).otherwise(0))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\f")
    parts = rows.groupBy("doc_id", "__part").agg(F.min("page").alias("first"), F.max("page").alias("last"), texts.alias("text"))
    own = F.when(F.col("__part") > 0, part_id(F.col("doc_id"), F.col("__part"), F.col("first"))).otherwise(F.col("doc_id"))
    return parts.select(own.alias("id"), "doc_id", "first", "last", "text")


def part_id(doc_id: Column, number: Column, page: Column) -> Column:
    """The id of a part of a combined document."""
    return F.sha2(F.concat(doc_id, F.lit(":p"), number.cast("string"), F.lit("-"), page.cast("string")), 256)
