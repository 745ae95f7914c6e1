"""Near-duplicate documents by SimHash fingerprints of 64 bits, compared exactly in tiles.

A fingerprint has a bit set where more than half of the document's shingle hashes have it. Equal fingerprints are one from here on. A
tile holds the fingerprints whose four 16-bit quarters have the same population counts. Those counts differ by no more, in sum, than the
fingerprints differ in bits, so a tile meets itself and the tiles whose counts differ by the radius at most, and all other pairs of
tiles are skipped unseen. Tiles that meet are compared whole by exclusive-or and bit counts.

A tile has bounded blocks, and a cell of the comparison holds one block of a tile and one of each tile that it meets: fingerprints move
packed, eight bytes each, once for each cell. Cells return links that span their components, not all pairs. There are 17^4 tiles at most,
so a table of their sizes is small at every size of the input.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from proofloom.llm import words
from proofloom.llm.near_dup import components
from proofloom.llm.shared import SPACE, cut, discarding, find_package

U64 = np.uint64
#: Quarters of a fingerprint, and how many population counts each can have.
_QUARTERS, _COUNTS = 4, 17
TILES = _COUNTS**_QUARTERS


@dataclass(frozen=True)
class SimHash:
    shingle: int = 3
    seed: int = 42
    #: Linked: so many differing bits at most.
    radius: int = 2
    #: Fingerprints of a block, and of the packed rows that a task takes at a time.
    block: int = 1 << 14
    group: int = 1 << 18
    #: Bytes of a text whose shingles are in memory at a time.
    part_bytes: int = 1 << 20


_GAP = re.compile(SPACE.encode())


def _parts(text: bytes, size: int) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + size)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def shingle_hashes(text: bytes, cfg: SimHash) -> Iterator[np.ndarray]:
    """XXH64 of all shingles, repeats included, in arrays of bounded size; of the whole sequence where it has fewer words."""
    last: list[bytes] = []
    k = cfg.shingle
    found = False
    for part in _parts(text.lower(), cfg.part_bytes):
        own = last + part.split()
        if len(own) >= k:
            found = True
            yield np.fromiter(map(xxh64_intdigest, map(b" ".join, zip(*(own[i:] for i in range(k)), strict=False)), repeat(cfg.seed)), U64, len(own) - k + 1)
        last = own[1 - k :] if k > 1 else []
        if not found:
            last = own
    if not found and last:
        yield np.array([xxh64_intdigest(b" ".join(last), cfg.seed)], U64)


def _bit_sums(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int32)


def fingerprints(column: pa.Array, cfg: SimHash) -> np.ndarray:
    """The fingerprints of texts; zero for null and for texts without words."""
    out = np.zeros(len(column), U64)
    for i, j, data, off in words.pieces(column, cfg.part_bytes):
        sums = np.zeros((j - i, 64), np.int64)
        n = np.zeros(j - i, np.int64)
        text = data.tobytes()
        held: list[np.ndarray] = []
        rows: list[int] = []
        for r in range(j - i):
            for h in shingle_hashes(text[off[r] : off[r + 1]], cfg):
                held.append(h)
                rows.append(r)
                n[r] += len(h)
            if held and (r == j - i - 1 or sum(map(len, held)) > 1 << 17):
                starts = np.cumsum([0, *map(len, held[:-1])])
                np.add.at(sums, rows, _bit_sums(np.concatenate(held), starts))
                held, rows = [], []
        if held:
            starts = np.cumsum([0, *map(len, held[:-1])])
            np.add.at(sums, rows, _bit_sums(np.concatenate(held), starts))
        out[i:j] = np.packbits(2 * sums > n[:, None], axis=1, bitorder="little").view(U64).ravel()
    return out


def _printed(batches: Iterator[pa.RecordBatch], cfg: SimHash) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = fingerprints(batch.column("text"), cfg)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "print"])


def tile_of(fingerprint: Column) -> Column:
    """The number of a fingerprint's tile: its quarters' population counts as digits."""
    counts = [F.bit_count(F.shiftrightunsigned(fingerprint, 64 // _QUARTERS * i).bitwiseAND(F.lit((1 << 64 // _QUARTERS) - 1))) for i in range(_QUARTERS)]
    return sum((c * _COUNTS**i for i, c in enumerate(counts[1:], 1)), counts[0]).cast("int")


def steps(radius: int) -> list[tuple[int, ...]]:
    """Differences of population counts to the tiles that a tile meets, one of each two opposite ones."""
    found = (d for d in product(range(-radius, radius + 1), repeat=_QUARTERS) if sum(map(abs, d)) <= radius)
    return [d for d in found if d > (0,) * _QUARTERS]


def _digits(tile: int) -> list[int]:
    return [tile // _COUNTS**i % _COUNTS for i in range(_QUARTERS)]


def met(tile: int, sizes: np.ndarray, radius: int, sign: int) -> list[int]:
    """Tiles with fingerprints that a tile takes in (sign 1) or that take it in (sign -1)."""
    own = _digits(tile)
    out = []
    for d in steps(radius):
        to = [x + sign * y for x, y in zip(own, d, strict=True)]
        if all(0 <= x < _COUNTS for x in to):
            u = sum(x * _COUNTS**i for i, x in enumerate(to))
            if sizes[u]:
                out.append(u)
    return out


_PACKED = "tile int, block int, part int, home boolean, prints binary"


def pack(table: pa.Table, sizes: np.ndarray, cfg: SimHash) -> pa.Table:
    """Blocks of tiles (tile, block, print) to packed rows for each cell (tile, block, part) that they take part in.

    A cell's home is a block of its tile. Its visitors are the blocks numbered part of the tiles that it takes in, and of its own tile if that is a later block.
    """
    tile, block, prints = (table.column(c).to_numpy() for c in ("tile", "block", "print"))
    order = np.lexsort((block, tile))
    tile, block, prints = tile[order], block[order], prints[order]
    starts = np.flatnonzero(np.append(True, (np.diff(tile) != 0) | (np.diff(block) != 0)))
    out: list[tuple] = []
    blocks = lambda t: int(-(-sizes[t] // cfg.block))
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(tile)], strict=True):
        t, b, data = int(tile[lo]), int(block[lo]), prints[lo:hi].tobytes()
        out += [(t, b, part, True, data) for part in range(max(map(blocks, [t, *met(t, sizes, cfg.radius, 1)])))]
        out += [(u, i, b, False, data) for u in met(t, sizes, cfg.radius, -1) for i in range(blocks(u))]
        out += [(t, i, b, False, data) for i in range(b)]
    columns = list(zip(*out, strict=True)) if out else [()] * 5
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()), strict=True)], names=["tile", "block", "part", "home", "prints"])


def _close(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in a and in b of pairs that differ in radius bits at most, a bounded number of comparisons at a time."""
    some = max(1, (1 << 20) // max(1, len(b)))
    for i in range(0, len(a), some):
        x, y = np.nonzero(np.bitwise_count(a[i : i + some, None] ^ b[None, :]) <= radius)
        yield x + i, y


def _joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels after links x - y: each the least place that can be reached."""
    while len(x):
        lo, hi = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        open_ = lo < hi
        if not open_.any():
            return label
        x, y = x[open_], y[open_]
        np.minimum.at(label, hi[open_], lo[open_])
        while (label[label] != label).any():
            label = label[label]
    return label


def compare(table: pa.Table, cfg: SimHash) -> pa.Table:
    """Cells' packed rows to links (a, b) that span the components found in each cell."""
    cells: dict[tuple[int, int, int], list[tuple[bool, bytes]]] = {}
    for t, b, p, home, prints in zip(*(table.column(c).to_pylist() for c in ("tile", "block", "part", "home", "prints")), strict=True):
        cells.setdefault((t, b, p), []).append((home, prints))
    out: list[np.ndarray] = []
    for (_, block, part), rows in cells.items():
        home = [np.frombuffer(p, U64) for h, p in rows if h]
        if not home:
            continue
        both = np.concatenate([home[0], *(np.frombuffer(p, U64) for h, p in rows if not h)])
        own, n = home[0], len(home[0])
        label = np.arange(len(both))
        if block == part:  # within the block, once
            for x, y in _close(own, own, cfg.radius):
                label = _joined(label, x[x < y], y[x < y])
        for x, y in _close(own, both[n:], cfg.radius):
            label = _joined(label, x, y + n)
        linked = np.flatnonzero(label != np.arange(len(both)))
        out.append(np.stack((both[label[linked]], both[linked]), axis=1))
    found = (np.concatenate(out) if out else np.zeros((0, 2), U64)).view(np.int64)
    return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})


def links(prints: DataFrame, cfg: SimHash) -> DataFrame:
    """Links (a, b) that hold together all of the distinct fingerprints (print) that differ in few bits."""
    spark = prints.sparkSession
    tiled = prints.select(F.col("print"), tile_of(F.col("print")).alias("tile"))
    counts = cut(spark, tiled.groupBy("tile").agg(F.count("*").alias("n")), "tiles")
    sizes = np.zeros(TILES, np.int64)
    for r in counts.collect():  # 17^4 rows at most
        sizes[r.tile] = r.n
    n = int(sizes.sum())
    own = F.pmod(F.xxhash64("print"), F.ceil(F.col("n") / cfg.block)).cast("int")
    dealt = tiled.join(F.broadcast(counts), "tile").select("tile", own.alias("block"), "print")

    def packed(group: pa.Table) -> pa.Table:
        return pack(group, sizes, cfg)

    def compared(group: pa.Table) -> pa.Table:
        return compare(group, cfg)

    groups = max(1, n // cfg.group)
    sent = dealt.groupBy(F.pmod(F.xxhash64("tile", "block"), F.lit(groups)).alias("g")).applyInArrow(packed, _PACKED)
    cells = max(1, n * (len(steps(cfg.radius)) + 1) // cfg.group)
    return sent.groupBy(F.pmod(F.xxhash64("tile", "block", "part"), F.lit(cells)).alias("g")).applyInArrow(compared, "a long, b long")


def simhash_groups(docs: DataFrame, cfg: SimHash | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id, text).

    fingerprint: 16 hexadecimal digits; a null text or one without words has zero, which links like any other. component_id: the smallest
    doc_id that links of ``radius`` differing bits or fewer reach. Rows that repeat a doc_id are documents of their own; rows without doc_id link
    like others and never name a component, which is null where no row in it has a doc_id. Other columns are ignored. Empty in, empty out.
    """
    cfg = cfg or SimHash()
    spark = docs.sparkSession
    find_package(spark)
    rows = docs.select("doc_id", "text").mapInArrow(words.tidied(_printed, cfg=cfg), "doc_id long, print long")
    rows = cut(spark, rows, "prints")
    prints = cut(spark, rows.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct")
    with discarding() as keep:
        found = cut(spark, links(prints, cfg), "links", "lz4")
        comps = None if found.isEmpty() else components(spark, found).withColumnRenamed("id", "print")
        own = prints.withColumn("comp", F.col("print")) if comps is None else prints.join(comps, "print", "left").withColumn("comp", F.coalesce("comp", "print"))
        least = own.groupBy("comp").agg(F.min("least").alias("component_id"))
        named = keep(cut(spark, own.join(least, "comp").select("print", "component_id"), "named"))
    shown = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return rows.join(named, "print").select("doc_id", shown.alias("fingerprint"), "component_id")
