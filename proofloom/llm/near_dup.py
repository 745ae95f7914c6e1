"""Near-duplicate documents by SetSketch registers, bands, a joint likelihood estimate and a check on full sets.

Each document is the set of its word shingles. ``sketch`` makes its registers: for each of m hash functions the smallest
exponentially distributed value over the set, kept as the exponent of its place among the powers of a base (so registers of a union are
the maxima of registers). Bands of registers that agree make two sets candidates; the chance to agree in none of 32 bands of 4 is
6e-11 at a similarity of 0.85 and 5e-8 at 0.8. Candidates of which the registers say by likelihood that they are less similar are
left out; the others are compared on their full sets.

Buckets of candidates are never expanded into pairs. First each member is held against one pivot of its buckets, the smallest, which
brings groups of copies together. Buckets whose members are then still in different components are compared by registers, members of the
smaller components against all others, in cells of bounded size: at first only the likeliest partner of each member is compared
on full sets, which joins most components. At last every pair between components that the registers leave open is: a cell's open
pairs stay one packed row, the texts of its members come to it, and only links that join components leave it. So no candidate pair between
components is left out, none within a component is looked at, and no row is made for a pair.

Texts are read twice: for the sketches, and once more for those in buckets with others, which are written as the table that all
comparisons read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.llm import words
from proofloom.llm.shared import cut, discarding, find_package

U64 = np.uint64


@dataclass(frozen=True)
class NearDup:
    shingle: int = 5
    #: Linked: 100 * intersection >= percent * union.
    percent: int = 85
    bands: int = 32
    rows: int = 4
    #: Base of the registers' powers, and the largest register.
    base: float = 1.001
    top: int = 65535
    #: A pair is left out unread if the likelihood of the wanted similarity is e^-slack of the best one's or less.
    slack: float = 14.0
    #: Members that one task holds against a pivot at a time, and members of a bucket that one task compares, and shingles of them.
    group: int = 128
    block: int = 1024
    block_shingles: int = 1 << 20
    #: Rounds in which each member of a mixed bucket is held against its likeliest partner only, before all open pairs are.
    best_rounds: int = 1

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes, offsets): the sorted distinct shingle hashes of the rows from the first on."""
    for i, j, data, off in words.pieces(column):
        s, e, counts = words.bounds(data, off)
        h = words.hashes(data, s, e, lower=True)
        g, at = words.windows(h, counts, k)
        starts = words.row_slices(counts)
        row = np.searchsorted(starts, at, side="right") - 1
        short = np.flatnonzero((counts > 0) & (counts < k))
        if len(short):  # the whole sequence as one shingle
            whole = np.array([_sequence(h[starts[r] : starts[r + 1]]) for r in short], U64)
            g, row = np.concatenate((g, whole)), np.concatenate((row, short))
        order = np.lexsort((g, row))
        g, row = g[order], row[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
        g, row = g[new], row[new]
        yield i, g, np.searchsorted(row, np.arange(j - i + 1))


def _sequence(h: np.ndarray) -> int:
    total = len(h)
    for x in h.tolist():
        total = (total * 0xD6E8FEB86659FD93 + x) % (1 << 64)
    return total


def registers(g: np.ndarray, off: np.ndarray, cfg: NearDup) -> np.ndarray:
    """Registers of non-empty sets, a row for each."""
    rng = np.random.default_rng(20240229)
    a = rng.integers(0, 1 << 63, cfg.registers, dtype=U64) * U64(2) + U64(1)
    b = rng.integers(0, 1 << 63, cfg.registers, dtype=U64)
    least = np.empty((cfg.registers, len(off) - 1), U64)
    x = np.empty_like(g)
    for i in range(cfg.registers):
        np.multiply(g, a[i], out=x)
        x += b[i]
        least[i] = np.minimum.reduceat(x, off[:-1])
    exponential = -np.log1p(-(least.T.astype(np.float64) + 0.5) / 2.0**64)
    lift = np.ceil(np.log(44) / np.log(cfg.base))  # a double's largest is below 44: registers of small sets are told apart too
    return np.clip(np.floor(1 + lift - np.log(np.clip(exponential, 1e-300, 44)) / np.log(cfg.base)), 0, cfg.top).astype(np.uint16)


def sketch(batches: Iterator[pa.RecordBatch], cfg: NearDup) -> Iterator[pa.RecordBatch]:
    """(doc_id, of, text) to (doc_id, n_shingles, digest of the set, registers, of); digest and registers are null for an empty set."""
    for batch in batches:
        for i, g, off in shingle_sets(batch.column("text"), cfg.shingle):
            n = np.diff(off)
            full = np.flatnonzero(n)
            digests, regs = [None] * len(n), [None] * len(n)
            if len(full):
                r = registers(g, np.append(off[full], off[-1]), cfg)
                for k, row in enumerate(full.tolist()):
                    digests[row] = blake2b(g[off[row] : off[row + 1]].tobytes(), digest_size=16).digest()
                    regs[row] = r[k].tobytes()
            ids, of = (batch.column(c).slice(i, len(n)) for c in ("doc_id", "of"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(regs, pa.binary()), of], ["doc_id", "n_shingles", "digest", "regs", "of"])


def _matrix(column: pa.Array, cfg: NearDup) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), cfg.registers)


def band_keys(batches: Iterator[pa.RecordBatch], cfg: NearDup) -> Iterator[pa.RecordBatch]:
    """(id, n, regs) to (key, id, n), a row for each band."""
    for batch in batches:
        if not len(batch):
            continue
        r = _matrix(batch.column("regs"), cfg).astype(U64).reshape(len(batch), cfg.bands, cfg.rows)
        key = np.broadcast_to(np.arange(1, cfg.bands + 1, dtype=U64), r.shape[:2]).copy()
        for i in range(cfg.rows):
            key = words.mix(key * U64(0xD6E8FEB86659FD93) + r[:, :, i])
        key -= key % U64(cfg.bands)  # a key says of which band it is
        key += np.arange(cfg.bands, dtype=U64)
        ids, n = (np.repeat(batch.column(x).to_numpy(), cfg.bands) for x in ("id", "n"))
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(ids), pa.array(n)], ["key", "id", "n"])


def likely(ru: np.ndarray, rv: np.ndarray, nu: np.ndarray, nv: np.ndarray, cfg: NearDup) -> np.ndarray:
    """Whether the registers leave room for the wanted similarity, by the likelihood of the numbers of larger, smaller and equal registers."""
    up, down = (ru > rv).sum(1), (ru < rv).sum(1)
    same = cfg.registers - up - down
    u, v = nu / (nu + nv), nv / (nu + nv)

    def log_likelihood(j):
        p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (cfg.base - 1) / cfg.base) / np.log(cfg.base)
        a, b = p(u - v * j), p(v - u * j)
        parts = ((up, a), (down, b), (same, 1 - a - b))
        return sum(np.where(n > 0, n * np.log(np.maximum(q, 1e-12)), 0) for n, q in parts)

    most = np.minimum(u / v, v / u)  # no similarity is larger than the ratio of the sizes
    wanted = cfg.percent / 100
    best = np.max([log_likelihood(np.minimum(j, most)) for j in np.linspace(0, 1, 21)], axis=0)
    at_least = np.max([log_likelihood(np.clip(j, 0, most)) for j in np.linspace(wanted, 1, 7)], axis=0)
    return (100 * np.minimum(nu, nv) >= cfg.percent * np.maximum(nu, nv)) & (at_least >= np.maximum(best, at_least) - cfg.slack)


def estimate(batches: Iterator[pa.RecordBatch], cfg: NearDup) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, and n and regs of both) that may be similar enough: (a, b)."""
    for batch in batches:
        if len(batch):
            ru, rv = _matrix(batch.column("regs_a"), cfg), _matrix(batch.column("regs_b"), cfg)
            ok = likely(ru, rv, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), cfg)
            yield batch.select(["a", "b"]).filter(pa.array(ok))


def verify(table: pa.Table, cfg: NearDup) -> pa.Table:
    """Of one pivot's group (a, b, text; the pivot itself has a = b), the pairs that are linked."""
    table = table.combine_chunks()
    ids = table.column("b").to_numpy()
    pivot = int(table.column("a")[0].as_py())
    own = int(np.flatnonzero(ids == pivot)[0])
    (_, mine, _), *_ = shingle_sets(table.column("text").slice(own, 1), cfg.shingle)
    linked = []
    for i, g, off in shingle_sets(table.column("text"), cfg.shingle):
        place = np.minimum(np.searchsorted(mine, g), len(mine) - 1)
        shared = np.add.reduceat(np.append(mine[place] == g, False).astype(np.int64), off[:-1]) * (np.diff(off) > 0)
        union = len(mine) + np.diff(off) - shared
        linked += ids[i : i + len(union)][100 * shared >= cfg.percent * union].tolist()
    linked = [x for x in linked if x != pivot]
    return pa.table({"a": pa.array([pivot] * len(linked), pa.int64()), "b": pa.array(linked, pa.int64())})


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable by links (a, b), for ids that have any. Smallest labels spread along links, then labels of labels."""
    both = cut(spark, links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = cut(spark, both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("comp").alias("m"))
        step = labels.join(near, labels.id == near.a).select("id", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        far = step.select(F.col("id").alias("i"), F.col("comp").alias("further"))
        step = cut(spark, step.join(far, step.comp == far.i).select("id", "old", F.col("further").alias("comp")), "labels")
        labels = step.select("id", "comp")
        if step.where("old <> comp").isEmpty():
            return labels


def open_in_cells(table: pa.Table, cfg: NearDup) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (key, part, id, comp, n, regs, left, right): row numbers x, y of pairs of different components that may be similar enough, how many registers are equal, and the pair's cell.

    Within a cell (key, part), members on the left are held against those on the right. A pair is judged in the first band that both share.
    """
    key, part, ids, comp, n = (table.column(c).to_numpy() for c in ("key", "part", "id", "comp", "n"))
    left, right = (table.column(c).to_numpy(zero_copy_only=False) for c in ("left", "right"))
    both = left & right
    regs = _matrix(table.column("regs"), cfg)
    band = (key.view(U64) % U64(cfg.bands)).astype(np.int64)
    order = np.lexsort((part, key))
    runs = np.flatnonzero(np.append(True, (np.diff(key[order]) != 0) | (np.diff(part[order]) != 0)))
    cell = np.empty(len(order), np.int64)
    cell[order] = np.repeat(np.arange(len(runs)), np.diff(np.append(runs, len(order))))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def judge(x: np.ndarray, y: np.ndarray) -> None:
        ok = (comp[x] != comp[y]) & ~(both[x] & both[y] & (ids[x] > ids[y])) & (100 * np.minimum(n[x], n[y]) >= cfg.percent * np.maximum(n[x], n[y]))
        x, y = x[ok], y[ok]
        for i in range(0, len(x), 20_000):
            u, v = x[i : i + 20_000], y[i : i + 20_000]
            agree = (regs[u] == regs[v]).reshape(len(u), cfg.bands, cfg.rows).all(2)
            first = agree.argmax(1) == band[u]
            u, v = u[first], v[first]
            if len(u):
                ok = likely(regs[u], regs[v], n[u], n[v], cfg)
                u, v = u[ok], v[ok]
                found.append((u, v, (regs[u] == regs[v]).sum(1)))

    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for lo, hi in zip(runs, np.append(runs[1:], len(order)), strict=True):
        rows = order[lo:hi]
        x, y = rows[left[rows]], rows[right[rows]]
        for some in np.array_split(x, max(1, len(x) * len(y) // 200_000)):
            waiting.append((np.repeat(some, len(y)), np.tile(y, len(some))))
            size += len(some) * len(y)
            if size > 200_000:
                judge(*map(np.concatenate, zip(*waiting, strict=True)))
                waiting, size = [], 0
    if waiting:
        judge(*map(np.concatenate, zip(*waiting, strict=True)))
    x, y, same = map(np.concatenate, zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 3
    return x, y, same, cell[x]


def best_partners(table: pa.Table, cfg: NearDup) -> pa.Table:
    """Of each id its open pair with most equal registers: (a, b, same) with the id as b."""
    table = table.combine_chunks()
    x, y, same, _ = open_in_cells(table, cfg)
    ids = table.column("id").to_numpy()
    a, b, same = np.append(ids[x], ids[y]), np.append(ids[y], ids[x]), np.append(same, same)
    order = np.lexsort((a, -same, b))
    first = order[np.append(True, np.diff(b[order]) != 0)] if len(order) else order
    return pa.table({"a": pa.array(a[first], pa.int64()), "b": pa.array(b[first], pa.int64()), "same": pa.array(same[first], pa.int64())})


_CELLS = "key long, part long, ids array<long>, comps array<long>, pairs binary"


def open_cells(table: pa.Table, cfg: NearDup) -> pa.Table:
    """A row for each cell with open pairs: its members in them, their components, and the pairs as places among those members, packed."""
    table = table.combine_chunks()
    x, y, _, cell = open_in_cells(table, cfg)
    key, part, ids, comp = (table.column(c).to_numpy() for c in ("key", "part", "id", "comp"))
    order = np.argsort(cell, kind="stable")
    out: list[list] = [[], [], [], [], []]
    for own in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1) if len(order) else []:
        rows, place = np.unique(np.append(x[own], y[own]), return_inverse=True)
        pairs = place.reshape(2, -1).T.astype(np.uint32)
        values = (key[rows[0]], part[rows[0]], ids[rows], comp[rows], pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))].tobytes())
        for column, value in zip(out, values, strict=True):
            column.append(value)
    longs = pa.list_(pa.int64())
    return pa.table({k: pa.array(v, t) for k, v, t in zip(("key", "part", "ids", "comps", "pairs"), out, (pa.int64(), pa.int64(), longs, longs, pa.binary()), strict=True)})


def verify_cells(table: pa.Table, cfg: NearDup) -> pa.Table:
    """Cells' members (key, part, id, comp, text) and rows of pairs (key, part, ids, pairs) to links (a, b) that join components within a cell."""
    table = table.combine_chunks()
    given = table.column("pairs").is_valid().to_numpy(zero_copy_only=False)
    members = table.filter(pa.array(~given))
    key, part, ids, comp = (members.column(c).to_numpy() for c in ("key", "part", "id", "comp"))
    sets: list[np.ndarray] = []
    for _, g, off in shingle_sets(members.column("text"), cfg.shingle):
        sets += [g[i:j] for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    of = {k: i for i, k in enumerate(zip(key.tolist(), part.tolist(), ids.tolist(), strict=True))}
    out: list[tuple[int, int]] = []
    for row in table.filter(pa.array(given)).select(["key", "part", "ids", "pairs"]).to_pylist():
        at = np.array([of[row["key"], row["part"], i] for i in row["ids"]])
        pairs = np.frombuffer(row["pairs"], np.uint32).reshape(-1, 2)
        out += [(min(i, j), max(i, j)) for i, j in _joining([sets[i] for i in at], comp[at], pairs, cfg, ids[at])]
    return pa.table({c: pa.array([x[k] for x in out], pa.int64()) for k, c in enumerate("ab")})


def _joining(sets: list[np.ndarray], comp: np.ndarray, pairs: np.ndarray, cfg: NearDup, ids: np.ndarray) -> Iterator[tuple[int, int]]:
    """Of pairs (places of two sets, in the order of the first), those ids that are linked and join components. Shingles count as small numbers; those of one set alone only by how many they are."""
    n = np.array([len(x) for x in sets])
    _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[code] > 1
    code, size = code[shared], np.add.reduceat(shared.astype(np.int64), np.cumsum(n) - n)
    codes = np.split(code, np.cumsum(size)[:-1])
    mark, comp = np.zeros(len(often), np.int64), comp.copy()
    for own in np.split(pairs, np.flatnonzero(np.diff(pairs[:, 0])) + 1):
        pivot, others = own[0, 0], own[:, 1]
        others = others[(comp[others] != comp[pivot]) & (size[others] > 0)]
        if not len(others):
            continue
        mark[codes[pivot]] = 1
        hits = np.add.reduceat(mark[np.concatenate([codes[j] for j in others])], np.cumsum(size[others]) - size[others])
        mark[codes[pivot]] = 0
        for j in others[100 * hits >= cfg.percent * (n[others] + n[pivot] - hits)]:
            if comp[j] != comp[pivot]:
                comp[comp == comp[j]] = comp[pivot]
                yield int(ids[pivot]), int(ids[j])


def deal(here: DataFrame, reps: DataFrame, cfg: NearDup) -> tuple[DataFrame, int]:
    """Members (key, id, n, comp, main, minors, mains) of buckets, with regs of reps, dealt into cells, and in how many groups of bounded size the cells fit.

    mains and minors are the numbers of blocks of the main component and of all others. A cell (key, part) holds one block of minor members on
    the left and one block of members on the right, so that any two members that are not both of the main component meet in one cell.
    """
    here = here.withColumn("minor", F.col("comp") != F.col("main"))
    here = here.withColumn("small", (F.col("mains") <= 1) & (F.col("minors") <= 1))
    here = here.withColumn("own", F.pmod(F.xxhash64("id", "key"), F.when(F.col("minor"), F.col("minors")).otherwise(F.col("mains"))))
    cell = lambda part, left, right: F.struct(part.cast("long").alias("part"), left.alias("left"), right.alias("right"))
    yes, no, own, zero = F.lit(True), F.lit(False), F.col("own"), F.lit(0).cast("long")
    to = lambda n: F.sequence(zero, F.col(n) - 1)
    against_main = F.transform(to("mains"), lambda j: cell(own * F.col("mains") + j, yes, no))
    among_minor = F.transform(to("minors"), lambda j: cell(-1 - F.least(own, j) * F.col("minors") - F.greatest(own, j), own <= j, own >= j))
    by_minor = F.transform(to("minors"), lambda i: cell(i * F.col("mains") + own, no, yes))
    cells = F.when(F.col("small"), F.array(cell(zero, F.col("minor"), yes))).when(F.col("minor"), F.concat(against_main, among_minor)).otherwise(by_minor)
    copies = F.when(F.col("small"), 1).when(F.col("minor"), F.col("mains") + F.col("minors")).otherwise(F.col("minors"))
    n = here.agg(F.coalesce(F.sum(copies), F.lit(0))).first()[0]
    rows = here.join(reps.select("id", "regs").hint("merge"), "id").withColumn("cell", F.explode(cells))
    return rows.select("key", "cell.part", "id", "comp", "n", "regs", "cell.left", "cell.right"), max(1, n // (4 * cfg.block))


def mixed_buckets(spark: SparkSession, active: DataFrame, comps: DataFrame, cfg: NearDup) -> DataFrame:
    """Members (key, id, n, comp, main, minors, mains) of buckets that hold more than one component."""
    here = active.join(comps, "id", "left").select("key", "id", "n", F.coalesce("comp", "id").alias("comp"))
    sizes = here.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("n").alias("shingles"))
    most = F.max(F.struct("n", "comp", "shingles"))
    sizes = sizes.groupBy("key").agg(most.alias("m"), F.sum("n").alias("n"), F.sum("shingles").alias("shingles"), F.count("*").alias("comps")).where("comps > 1")
    blocks = lambda n, shingles: F.greatest(F.ceil(n / cfg.block), F.ceil(shingles / cfg.block_shingles))
    sizes = sizes.select("key", F.col("m.comp").alias("main"), blocks(F.col("m.n"), F.col("m.shingles")).alias("mains"), blocks(F.col("n") - F.col("m.n"), F.col("shingles") - F.col("m.shingles")).alias("minors"))
    return cut(spark, here.join(cut(spark, sizes, "sizes", "lz4"), "key"), "mixed", "lz4")


def likeliest(spark: SparkSession, here: DataFrame, reps: DataFrame, cfg: NearDup) -> DataFrame:
    """For each member of mixed buckets its likeliest open partner: pairs (a, b)."""
    rows, groups = deal(here, reps, cfg)

    def compared(group: pa.Table) -> pa.Table:
        return best_partners(group, cfg)

    pairs = rows.groupBy(F.pmod(F.xxhash64("key", "part"), F.lit(groups)).alias("g")).applyInArrow(compared, "a long, b long, same long")
    pairs = pairs.groupBy("b").agg(F.max_by("a", F.struct("same", -F.col("a"))).alias("a"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def check_cells(spark: SparkSession, here: DataFrame, reps: DataFrame, texts: DataFrame, cfg: NearDup) -> DataFrame:
    """Links (a, b) among all open pairs of mixed buckets, as many as join the components of a cell."""
    rows, groups = deal(here, reps, cfg)

    def opened(group: pa.Table) -> pa.Table:
        return open_cells(group, cfg)

    def verified(group: pa.Table) -> pa.Table:
        return verify_cells(group, cfg)

    cells = cut(spark, rows.groupBy(F.pmod(F.xxhash64("key", "part"), F.lit(groups)).alias("g")).applyInArrow(opened, _CELLS), "cells", "lz4")
    members = cells.select("key", "part", F.explode(F.arrays_zip("ids", "comps")).alias("m")).select("key", "part", F.col("m.ids").alias("id"), F.col("m.comps").alias("comp"))
    most = members.join(reps.select("id", "n"), "id").agg(F.coalesce(F.count("*"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    groups = max(1, most[0] // (2 * cfg.block), most[1] // cfg.block_shingles)
    none = lambda t: F.lit(None).cast(t)
    members = members.join(texts.hint("merge"), "id").select("key", "part", "id", "comp", "text", none("array<long>").alias("ids"), none("binary").alias("pairs"))
    pairs = cells.select("key", "part", none("long").alias("id"), none("long").alias("comp"), none("string").alias("text"), "ids", "pairs")
    linked = members.union(pairs).groupBy(F.pmod(F.xxhash64("key", "part"), F.lit(groups)).alias("g")).applyInArrow(verified, "a long, b long")
    return cut(spark, linked, "linked", "lz4")


def find_links(spark: SparkSession, reps: DataFrame, docs: DataFrame, cfg: NearDup) -> DataFrame | None:
    """(id, comp) of reps (id, n, regs, of) that are linked with others; docs (doc_id, of, text) has their texts, told apart by of. None: no links."""
    keys = cut(spark, reps.select("id", "n", "regs").mapInArrow(partial(band_keys, cfg=cfg), "key long, id long, n long"), "bands", "lz4")
    shared = cut(spark, keys.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("a")).where("size > 1").select("key", "a"), "shared", "lz4")
    active = cut(spark, keys.join(shared, "key"), "buckets", "lz4")
    if active.isEmpty():
        return None
    used = active.select("id").distinct().join(reps.select("id", "of"), "id")
    texts = docs.select(F.col("doc_id").alias("id"), "of", "text").join(used.hint("merge"), ["id", "of"], "left_semi")
    texts = cut(spark, texts.groupBy("id", "of").agg(F.max("text").alias("text")).select("id", "text"), "texts")
    pairs = active.where("a <> id").groupBy(F.col("id").alias("b")).agg(F.min("a").alias("a")).select("a", "b")
    ra, rb = (reps.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}")) for x in "ab")
    maybe = pairs.join(ra, "a").join(rb, "b").mapInArrow(partial(estimate, cfg=cfg), "a long, b long")
    links = check(spark, cut(spark, maybe, "maybe", "lz4"), texts, cfg)
    comps = components(spark, links)
    active = active.select("key", "id", "n")
    for best in [True] * cfg.best_rounds + [False]:
        here = mixed_buckets(spark, active, comps, cfg)
        if here.isEmpty():
            break
        found = check(spark, cut(spark, likeliest(spark, here, reps, cfg), "maybe", "lz4"), texts, cfg) if best else check_cells(spark, here, reps, texts, cfg)
        if not found.isEmpty():
            links = links.union(found)
            comps = components(spark, links)
    return comps


def check(spark: SparkSession, pairs: DataFrame, texts: DataFrame, cfg: NearDup) -> DataFrame:
    """The pairs (a, b) that are linked. A pivot's members are dealt into groups, to each of which its text goes once."""
    size = cut(spark, pairs.groupBy("a").agg(F.count("*").alias("n")), "sizes", "lz4")
    pairs = pairs.join(size, "a").select("a", "b", (F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / cfg.group))).cast("int").alias("part"))
    every = pairs.union(pairs.select("a", F.col("a").alias("b"), "part").distinct())
    rows = every.join(texts.select(F.col("id").alias("b"), "text").hint("merge"), "b").select("a", "part", "b", "text")

    def verified(group: pa.Table) -> pa.Table:
        return verify(group, cfg)

    linked = rows.groupBy("a", "part").applyInArrow(verified, "a long, b long")
    return cut(spark, linked, "linked", "lz4")


def near_duplicates(docs: DataFrame, cfg: NearDup | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id).

    A null text or one without words has an empty set and is linked with nothing. Rows that repeat a doc_id are one document
    (rows of one doc_id should have one text; else the largest set counts), and rows without doc_id are dropped. Other columns are ignored. Empty in, empty out.
    """
    cfg = cfg or NearDup()
    spark = docs.sparkSession
    find_package(spark)
    docs = docs.select("doc_id", F.xxhash64("text").alias("of"), "text").where("doc_id is not null")
    sketches = docs.mapInArrow(words.tidied(sketch, cfg=cfg), "doc_id long, n_shingles long, digest binary, regs binary, of long")
    sketches = sketches.groupBy("doc_id").agg(F.max(F.struct("n_shingles", "digest", "regs", "of")).alias("s")).select("doc_id", "s.*")
    sketches = cut(spark, sketches, "sketches")
    sets = sketches.where("n_shingles > 0")
    classes = cut(spark, sets.groupBy("digest").agg(F.min("doc_id").alias("id")), "classes")
    members = sets.select("doc_id", "digest").join(classes, "digest").select("doc_id", "id")
    reps = sets.join(classes.select(F.col("id").alias("doc_id"), F.col("digest")), ["doc_id", "digest"])
    reps = cut(spark, reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "regs", "of"), "reps")
    with discarding() as keep:
        comps = find_links(spark, reps, docs, cfg)
        comps = comps if comps is None else keep(comps)
    if comps is not None:
        members = members.join(comps, "id", "left").select("doc_id", F.coalesce("comp", "id").alias("component_id"))
    else:
        members = members.select("doc_id", F.col("id").alias("component_id"))
    out = sketches.select("doc_id", "n_shingles").join(members, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
