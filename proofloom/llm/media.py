"""Media columns: payloads in tar shards by content, their places in rows, and columns filled by range reads of the stored form.

A payload is stored as a PNG of 8-bit grey samples, a row of pixels for each 192 bytes. Its digest, a column function, says which it is.
Payloads that only one row has are written by the task that reads the row, so they don't move; of others each task makes one copy, the copies meet by
digest in compressed form, and one is written. Width and height come from range reads of the PNG's first 33 bytes, the other features
from the samples that are read back.
"""

from __future__ import annotations

import hashlib
import io
import os
import struct
import tarfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.llm.shared import collect_garbage, cut, discarding, file_system, find_package, new_folder
from proofloom.llm.words import tidied

_PNG = b"\x89PNG\r\n\x1a\n"


@dataclass(frozen=True)
class Media:
    #: Bytes of a row of pixels, and what fills up the last one.
    width: int = 192
    fill: bytes = b" "
    level: int = 6
    #: Digests of payloads that several rows have are broadcast up to this number (32 bytes each), else joined by a shuffle of the texts.
    most_broadcast: int = 500_000
    #: Bytes of a shard that are read together.
    read_bytes: int = 1 << 18


def padded(data: bytes, cfg: Media) -> bytes:
    """data, filled up to a positive multiple of the width."""
    return data + cfg.fill * (-len(data) % cfg.width if data else cfg.width)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, cfg: Media) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, cfg.width)
    samples = np.zeros((len(rows), cfg.width + 1), np.uint8)  # each row after its filter byte, 0 for none
    samples[:, 1:] = rows
    header = struct.pack(">IIBBBBB", cfg.width, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(samples.tobytes(), cfg.level)) + _chunk(b"IEND", b"")


def png_size(head: bytes) -> tuple[int, int]:
    """Width and height from the first 33 bytes."""
    if head[:8] != _PNG or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">II", head[16:24])


def from_png(stored: bytes) -> np.ndarray:
    """The samples of a PNG of 8-bit grey values without filters, a row for each row of pixels."""
    width, height = png_size(stored)
    at, body = 8, []
    while at < len(stored):
        n, kind = struct.unpack(">I4s", stored[at : at + 8])
        if kind == b"IDAT":
            body.append(stored[at + 8 : at + 8 + n])
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows are not read")
    return rows[:, 1:]


def compress(batches: Iterator[pa.RecordBatch], cfg: Media) -> Iterator[pa.RecordBatch]:
    """(text) to (digest, stored): each payload of a partition once. A null text is empty."""
    seen: set[bytes] = set()
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for i in range(0, len(texts), 1000):
            rows = []
            for text in texts[i : i + 1000]:
                payload = padded((text or "").encode(), cfg)
                digest = hashlib.sha256(payload).digest()
                if digest not in seen:
                    seen.add(digest)
                    rows.append((digest, to_png(payload, cfg)))
            digests, stored = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(stored, pa.binary())], ["digest", "stored"])


def write_shards(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """A partition's (digest, stored), equal digests next to each other, to one tar shard with each digest once, and (digest, shard, offset, length).

    The shard takes its name when it is whole, so tasks may run twice.
    """
    task = TaskContext.get()
    shard = f"{folder}/shard-{task.partitionId():08d}.tar"
    fs, path = file_system(shard)
    fs.create_dir(os.path.dirname(path), recursive=True)
    own = f"{path}.{task.taskAttemptId()}"
    at, last = 0, None
    with fs.open_output_stream(own) as out:
        for batch in batches:
            rows = []
            for digest, stored in zip(batch.column("digest").to_pylist(), batch.column("stored").to_pylist(), strict=True):
                if digest == last:
                    continue
                last = digest
                info = tarfile.TarInfo(f"{digest.hex()}.png")
                info.size = len(stored)
                entry = info.tobuf()
                rows.append((digest, at + len(entry), len(stored)))
                for part in (entry, stored, bytes(-len(stored) % 512)):
                    out.write(part)
                    at += len(part)
            digests, offsets, lengths = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([shard] * len(rows), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["digest", "shard", "offset", "length"])
        out.write(bytes(1024))
    fs.move(own, path)


def _feature(samples: np.ndarray) -> str:
    """Mean and spread of the samples in thousandths, and 64 bits that say which of 64 stretches are brighter than all of them."""
    flat = samples.ravel().astype(np.int64)
    n, total = len(flat), int(flat.sum())
    spread = (n * int((flat * flat).sum()) - total * total) * 1_000_000 // (n * n)
    edges = np.arange(65) * n // 64
    sums = np.diff(np.append(0, np.cumsum(flat))[edges])
    bits = sums * n > total * np.diff(edges)
    return f"{1000 * total // n}:{int(spread**0.5)}:{np.packbits(bits).tobytes().hex()}"


def read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places (digest, shard, offset, length) to what the stored bytes say."""
    name, source = None, None
    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"]
    kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32())
    place = ["shard", "offset", "length"]
    for batch in batches:
        rows = []
        for digest, shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("digest", "shard", "offset", "length")), strict=True):
            if shard != name:
                fs, path = file_system(shard)
                name, source = shard, fs.open_input_file(path)
            width, height = png_size(source.read_at(33, offset))
            stored = source.read_at(length, offset)
            samples = from_png(stored)
            payload = samples.tobytes()
            rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), _feature(samples), width, height))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), *(batch.column(c) for c in place)], [*names, *place])


def read_file(uri: str) -> dict[str, bytes]:
    """All entries of a shard by name, as any tar reader sees them."""
    fs, path = file_system(uri)
    with fs.open_input_file(path) as f, tarfile.open(fileobj=io.BytesIO(f.read())) as tar:
        return {m.name: tar.extractfile(m).read() for m in tar.getmembers()}


def payload_columns(text: Column, cfg: Media) -> tuple[Column, Column]:
    """n_bytes and digest of a text's payload, as ``padded`` makes it."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    n = F.octet_length(data)
    whole = F.greatest(F.ceil(n / cfg.width), F.lit(1)) * cfg.width
    return n.cast("long"), F.unhex(F.sha2(F.rpad(data, whole.cast("int"), F.lit(cfg.fill)), 256))


def media_columns(docs: DataFrame, cfg: Media | None = None, folder: str | None = None) -> DataFrame:
    """Store the texts of docs (doc_id, text); per row its place (shard, offset, length) and what the stored bytes say.

    Null and empty texts are one row of blanks. Every row is returned, repeated ones and those with null doc_ids too; equal texts
    have one payload and equal values, but for doc_id. Other columns are ignored. Empty in, empty out.

    A payload that several rows have crosses the network once for each task that has it, compressed; one task reads all these copies one by
    one and keeps one.
    """
    cfg = cfg or Media()
    spark = docs.sparkSession
    find_package(spark)
    folder = folder or new_folder(spark, "media")
    n, digest = payload_columns(F.col("text"), cfg)
    with discarding() as keep:
        digests = docs.select(digest.alias("digest"))
        several = cut(spark, digests.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest", F.lit(True).alias("several")), "several")
        several = F.broadcast(several) if several.count() <= cfg.most_broadcast else several.hint("merge")
        told = docs.select("text", digest.alias("digest")).join(several, "digest", "left")
        made = "digest binary, stored binary"
        alone = told.where("several is null").select("text").mapInArrow(tidied(compress, cfg=cfg), made)
        shared = told.where("several").select("text").mapInArrow(tidied(compress, cfg=cfg), made).repartition("digest").sortWithinPartitions("digest")
        places = alone.union(shared).mapInArrow(tidied(write_shards, folder=folder), "digest binary, shard string, offset long, length long")
        places = keep(cut(spark, places, "places"))
    collect_garbage(spark, every=0)
    shards = max(1, places.select("shard").distinct().count())
    stretch = F.floor(F.col("offset") / cfg.read_bytes)  # shards hold from a few payloads to very many
    by_shard = places.repartition(shards, F.col("shard"), stretch).sortWithinPartitions("shard", "offset")
    read = "digest binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, shard string, offset long, length long"
    found = by_shard.mapInArrow(tidied(read_shards), read)
    return docs.select("doc_id", n.alias("n_bytes"), digest.alias("digest")).join(found.hint("merge"), "digest").drop("digest")
