"""Best-fit packing of documents into sequences of equal capacity, without two of one source or one group of copies in a sequence.

Documents longer than a sequence are cut into pieces. Pieces are dealt by hash into blocks of bounded size that are packed apart from each
other: largest first, each into the fullest bin that still has room and holds neither its source nor its copies. Bins are kept in the order
of what room they have left; the search goes from the tightest fit up until a compatible bin is found, and a new bin is opened if there is none.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from proofloom.llm import words
from proofloom.llm.near_dup import NearDup, near_duplicates
from proofloom.llm.shared import cut, find_package, with_rows


@dataclass(frozen=True)
class Packing:
    #: Words of a sequence.
    capacity: int = 2048
    #: Pieces that are packed together.
    block: int = 2048
    #: Whether a sequence holds a source once at most (copies are kept apart in any case).
    sources_apart: bool = True


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, first word in it) of each piece; sizes are in descending order, sources and clusters small numbers."""
    room: list[tuple[int, int]] = []  # (words left, bin), in order
    held: list[tuple[int, int]] = []  # bitmaps of a bin's sources and clusters
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = 1 << source, 1 << cluster
        i = bisect_left(room, (size, -1))
        while i < len(room) and (held[room[i][1]][0] & s or held[room[i][1]][1] & c):
            i += 1
        if i < len(room):
            left, b = room.pop(i)
        else:
            left, b = capacity, len(held)
            held.append((0, 0))
        held[b] = held[b][0] | s, held[b][1] | c
        out.append((b, capacity - left))
        if left > size:
            insort(room, (left - size, b))
    return out


def pack_block(table: pa.Table, cfg: Packing) -> pa.Table:
    """A block's pieces (block, doc_id, piece, first, n_words, source, cluster) with bin and offset."""
    table = table.combine_chunks().sort_by([("n_words", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
    source = table.column("source").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_pylist()
    _, cluster = np.unique(table.column("cluster").to_numpy(), return_inverse=True)
    if not cfg.sources_apart:  # every piece is a source of its own
        source = range(len(source))
    placed = best_fit(table.column("n_words").to_pylist(), source, cluster.tolist(), cfg.capacity)
    block = table.column("block").to_numpy()
    return pa.table(
        {
            "doc_id": table.column("doc_id"),
            "piece": table.column("piece"),
            "first": table.column("first"),
            "n_words": table.column("n_words"),
            "bin": pa.array(block * (1 << 20) + np.array([b for b, _ in placed], np.int64)),
            "offset": pa.array([o for _, o in placed], pa.int64()),
        }
    )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [words.bounds(data, off)[2] for _, _, data, off in words.pieces(batch.column("text"))]
        rest = batch.drop_columns(["text"])
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(np.concatenate(n) if n else np.zeros(0, np.int64), pa.int64())], [*rest.schema.names, "size"])


def with_size(docs: DataFrame) -> DataFrame:
    """docs with the number of words of its text as size, in place of the text."""
    find_package(docs.sparkSession)
    kept = [f for f in docs.schema if f.name != "text"]
    return docs.mapInArrow(words.tidied(_counted), StructType([*kept, StructField("size", LongType())]))


def pack(docs: DataFrame, cfg: Packing | None = None) -> DataFrame:
    """(doc_id, piece, first, n_words, bin, offset): words first to first + n_words of the document stand in a sequence from offset on.

    Which pieces share a block, and so a sequence, depends on the order of rows in the files of docs, so that rows alike are dealt apart.
    Documents without words, null texts included, have one row with no bin. Copies are documents of equal text, or of equal ``cluster``
    if docs has such a column; null is a source. Rows that repeat a doc_id are packed each. Further columns are ignored.
    """
    cluster = F.xxhash64("cluster") if "cluster" in docs.columns else F.xxhash64("text")
    return pack_sizes(with_size(docs.select("doc_id", "source", cluster.alias("cluster"), "text")), cfg or Packing())


def pack_apart(docs: DataFrame, cfg: Packing | None = None, near: NearDup | None = None) -> DataFrame:
    """pack, with the rows of a near-duplicate component (similarity 0.8 unless told) as copies of each other."""
    docs = with_rows(docs.sparkSession, docs.select("doc_id", "source", "text"))
    groups = near_duplicates(docs.select(F.col("row").alias("doc_id"), "text"), near or NearDup(percent=80))
    groups = groups.select(F.col("doc_id").alias("row"), F.xxhash64("component_id").alias("cluster"))
    sized = with_size(docs.select("row", "doc_id", "source", "text")).join(groups, "row")
    return pack_sizes(sized.select("doc_id", "source", "size", "cluster"), cfg or Packing())


def pack_sizes(sized: DataFrame, cfg: Packing) -> DataFrame:
    """pack for documents (doc_id, source, size, cluster) whose words are counted and whose copies are known."""
    spark = sized.sparkSession
    find_package(spark)
    sized = cut(spark, sized.withColumn("__row", F.monotonically_increasing_id()), "sizes")
    pieces = sized.where("size > 0").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / cfg.capacity))))
    pieces = pieces.withColumn("first", F.col("piece") * cfg.capacity)
    pieces = pieces.withColumn("n_words", F.least(F.lit(cfg.capacity).cast("long"), F.col("size") - F.col("first")))
    blocks = max(1, -(-pieces.count() // cfg.block))
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("__row", "piece"), F.lit(blocks)).cast("long"))

    def packed(group: pa.Table) -> pa.Table:
        return pack_block(group, cfg)

    placed = pieces.select("block", "doc_id", "piece", "first", "n_words", "source", "cluster").groupBy("block").applyInArrow(
        packed, "doc_id long, piece long, first long, n_words long, bin long, offset long"
    )
    none = F.lit(None).cast("long")
    empty = sized.where("size = 0").select("doc_id", *[F.lit(0).cast("long").alias(c) for c in ("piece", "first", "n_words")], none.alias("bin"), none.alias("offset"))
    return placed.union(empty)
