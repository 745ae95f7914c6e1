"""Shared folder, tables cut out of the lineage, and small helpers for the operators of this package."""

from __future__ import annotations

import os
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What separates words, and a word, as patterns of Java, RE2 and Python.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Unset, a temporary folder stands in for it, and only where everything runs on this one machine (local[*]).
    """
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local.get(app) or _local.setdefault(app, "file://" + tempfile.mkdtemp(prefix="proofloom-"))
    return f"{base.rstrip('/')}/proofloom-{app}"


def new_folder(spark: SparkSession, name: str) -> str:
    """The URI of a folder in the shared folder that nobody has used; it is made when something is written to it."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut(spark: SparkSession, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df written as a table in the shared folder and read again.

    Its lineage ends there: a lost executor costs no earlier work. Shuffle files of plans that nobody holds any more go once the driver's
    JVM collects garbage, which is asked for here now and then, since nothing else makes it happen in time.
    """
    collect_garbage(spark)
    path = new_folder(spark, name)
    if lists := _discarded.get():
        lists[-1].append(path)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Of each thread of the driver its own lists of tables to delete.
_discarded: ContextVar[tuple[list[str], ...]] = ContextVar("discarded", default=())


@contextmanager
def discarding() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are cut within are deleted at the end, but for those given to the function that this yields.

    Only for steps whose results are cut themselves: nothing that is evaluated later may read what goes. A failed step leaves its tables.
    """
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(f.rsplit("/", 1)[0].rstrip("/").rsplit("/", 1)[-1] for f in df.inputFiles())
        return df

    outer, own = _discarded.get(), []
    _discarded.set((*outer, own))
    try:
        yield keep
    finally:
        _discarded.set(outer)
    for path in own:
        if path.rsplit("/", 1)[-1] in kept:
            if outer:
                outer[-1].append(path)
            continue
        try:
            fs, local = file_system(path)
            fs.delete_dir(local)
        except (OSError, ValueError):  # a store that only Spark reaches, or a table that is gone
            pass


_collected = [0.0]


def collect_garbage(spark: SparkSession, every: float = 3.0) -> None:
    """Let Spark's cleaner see which shuffles nobody needs any more, at most once in so many seconds. Nothing where the driver's JVM is out of reach.

    every=0: now, and once more after a moment, since the scheduler lets go of the last job a little later than it ends.
    """
    jvm = getattr(getattr(spark, "_sc", None), "_jvm", None)
    if jvm is None or time.monotonic() - _collected[0] < every:
        return
    jvm.System.gc()
    if not every:
        time.sleep(1.5)
        jvm.System.gc()
    _collected[0] = time.monotonic()


def with_rows(spark: SparkSession, df: DataFrame, out: str = "row") -> DataFrame:
    """df with a number for each row, written so that it stays: doc_ids may be null or repeat, row numbers don't."""
    return cut(spark, df.withColumn(out, F.monotonically_increasing_id()), "rows")


def find_package(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package wherever it was started; a cluster is given the package as usual."""
    if spark.sparkContext.master.startswith("local["):
        root = str(Path(__file__).resolve().parents[2])
        paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
        if root not in paths:
            spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def file_system(uri: str):
    """pyarrow's file system for a URI of the shared folder, and the path in it. A bare path is local."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def running_start(df: DataFrame, keys: list[str], order: list[Column], amount: str, out: str, span: Column) -> DataFrame:
    """df with the exclusive running sum of amount within keys, in the order of (span, *order).

    span is a bucket number that rises with the order and holds a bounded number of rows: sums run within a bucket, and the buckets'
    totals are summed once more. So no key, however frequent, meets in one task but for one row a bucket.
    """
    df = df.withColumn("__span", span)
    totals = df.groupBy(*keys, "__span").agg(F.sum(amount).alias("__total"))
    before = Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col("__span").alias("__s"),
        F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__base"),
    )
    within = Window.partitionBy(*keys, "__span").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__before", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    same = F.col("__span") == F.col("__s")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    df = df.join(totals, same).withColumn(out, F.col("__base") + F.col("__before"))
    return df.drop("__span", "__s", "__base", "__before", *[f"__k{i}" for i in range(len(keys))])
