"""Hard negatives by an exact nearest-neighbour join over Voronoi cells.

Scores are inner products of integer vectors. With one more component, sqrt(largest norm² - norm²) for candidates and zero for anchors,
the higher score is the smaller distance, so distances to pivots bound scores. Candidates go to the cell of their nearest pivot. The
anchors of a cell are dealt into groups of bounded size. A group first meets the candidates of its own cell; what it finds there bounds how far
away a candidate can be that still matters to one of its anchors, and the triangle inequality turns that into a band of distances to
each other pivot. Only candidates in its band of a cell go to a group. There, blocks are joined exactly.

Rows of equal label and vector are one candidate, which keeps the few smallest vec_ids that can be among the first; anchors of equal label
and vector are one anchor. So a vector that very many rows share is compared once. Candidates of a group are dealt into chunks, each of
which keeps the first rows of each anchor; a window with a rank limit, which Spark also applies before the shuffle, merges them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofloom.llm.shared import cut, discarding, find_package
from proofloom.llm.words import tidied


@dataclass(frozen=True)
class HardNegatives:
    anchor_every: int = 100
    positives: int = 5
    negatives: int = 5
    #: A negative's score is this share (in percent) of the positive's at least, and no more than all of it.
    least_percent: int = 80
    #: Components are multiplied by this and rounded down; they end at +-largest, so that scores of 4096 components fit a long.
    scale: int = 256
    largest: int = 1 << 25
    #: Anchors of a group, candidates of a chunk, cells at most, and candidates of which pivots are chosen.
    group: int = 256
    chunk: int = 1 << 14
    most_cells: int = 256
    pivot_sample: int = 2048


def whole_vectors(rows: DataFrame, cfg: HardNegatives) -> DataFrame:
    """Rows (vec_id, label, embedding) as (vec_id, label, q): integer components. Rows with a null or non-finite part are left out."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    limit = float(cfg.largest)
    whole = F.transform(x, lambda v: F.floor(F.greatest(F.lit(-limit), F.least(F.lit(limit), v.cast("double") * cfg.scale))).cast("int"))
    rows = rows.where(F.col("label").isNotNull() & x.isNotNull() & finite)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("q"))


def _matrix(column: pa.Array, width: int, kind: type = np.int64) -> np.ndarray:
    """Lists as rows of a matrix; shorter ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    off = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), kind)
    n = np.diff(off)
    out[np.repeat(np.arange(len(n)), n), np.arange(off[0], off[-1]) - np.repeat(off[:-1], n)] = values[off[0] : off[-1]]
    return out


def scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products. Floating-point products are exact while all sums stay below 2^53."""
    most = lambda m: int(np.abs(m).max(initial=0))
    if most(anchors) * most(candidates) * max(1, anchors.shape[1]) < 1 << 53:
        return (anchors.astype(np.float64) @ candidates.T.astype(np.float64)).astype(np.int64)
    return anchors @ candidates.T


def far_apart(vectors: np.ndarray, n: int) -> np.ndarray:
    """Places of n vectors that lie far from each other, the first included; fewer if there are fewer distinct ones."""
    x = vectors.astype(np.float64)
    chosen, least = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < n and least.max() > 0:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, ((x - x[chosen[-1]]) ** 2).sum(1))
    return np.array(chosen)


@dataclass(frozen=True)
class Space:
    """Pivots with their extra component, the largest norm², and how many components vectors have."""

    pivots: np.ndarray
    largest: float
    width: int

    def distances(self, q: np.ndarray, candidate: bool) -> np.ndarray:
        """Distances of vectors to all pivots; an anchor's extra component is zero."""
        x = q.astype(np.float64)
        norm = (x * x).sum(1)
        extra = np.sqrt(np.maximum(self.largest - norm, 0)) if candidate else np.zeros(len(x))
        x = np.column_stack((x, extra))
        square = (x * x).sum(1)[:, None] + (self.pivots**2).sum(1)[None, :] - 2 * x @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))

    def reach(self, norm: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance of candidates of a score to anchors of a norm²."""
        return np.sqrt(np.maximum(norm + self.largest - 2 * score, 0))

    @property
    def slack(self) -> float:
        """More than rounding can move a distance, or the root of a difference of squares near zero."""
        return 1e-5 * np.sqrt(self.largest + 1) + 1e-3


def _placed(batches: Iterator[pa.RecordBatch], space: Space) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d = space.distances(_matrix(batch.column("q"), space.width), True)
        cell = d.argmin(1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], [*batch.schema.names, "cell", "r"])


def _bands(batches: Iterator[pa.RecordBatch], space: Space) -> Iterator[pa.RecordBatch]:
    """Anchors (cell, block, q, low, high: scores that still matter) to (cell, block, other, lo, hi): distances to other pivots at which such candidates can be."""
    for batch in batches:
        if not len(batch):
            continue
        q = _matrix(batch.column("q"), space.width)
        norm = (q.astype(np.float64) ** 2).sum(1)
        d = space.distances(q, False)
        near = space.reach(norm, batch.column("high").to_numpy(zero_copy_only=False))[:, None]
        far = space.reach(norm, batch.column("low").to_numpy(zero_copy_only=False))[:, None]
        lo, hi = np.maximum(d - far, near - d) - space.slack, d + far + space.slack
        cell, block = batch.column("cell").to_numpy(), batch.column("block").to_numpy()
        order = np.lexsort((block, cell))
        starts = np.flatnonzero(np.append(True, (np.diff(cell[order]) != 0) | (np.diff(block[order]) != 0)))
        lo, hi = np.minimum.reduceat(lo[order], starts), np.maximum.reduceat(hi[order], starts)
        n, own = d.shape[1], order[starts]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(cell[own], n)), pa.array(np.repeat(block[own], n)), pa.array(np.tile(np.arange(n, dtype=np.int32), len(own))), pa.array(lo.ravel()), pa.array(hi.ravel())],
            ["cell", "block", "other", "lo", "hi"],
        )


def _first(score: np.ndarray, least_id: np.ndarray, n: int) -> np.ndarray:
    """Places of the n first by score, then by id; more where ids and scores tie."""
    if len(score) > n:
        limit = np.partition(score, len(score) - n)[len(score) - n]
        at = np.flatnonzero(score >= limit)
    else:
        at = np.arange(len(score))
    at = at[np.lexsort((least_id[at], -score[at]))]
    return at[:n]


_FOUND = "anchor long, wanted long, score long, vec_id long, candidate long"
_NO_ID = np.iinfo(np.int64).max


def _join_block(anchors: pa.Table, candidates: pa.Table, find: Callable, width: int) -> Iterator[tuple]:
    """find's rows for each anchor of a block, given the scores of a chunk's candidates."""
    a, c = _matrix(anchors.column("q"), width), _matrix(candidates.column("q"), width)
    of = candidates.column("label").to_numpy()
    ids = candidates.column("ids").to_pylist()
    least = np.array([x[0] if x[0] is not None else _NO_ID for x in ids], np.int64)
    cids = candidates.column("cid").to_numpy()
    some = max(1, (1 << 21) // max(1, len(c)))
    listed = anchors.select(["cid", "label", "wanted"]).to_pylist()
    for i in range(0, len(a), some):
        for s, row in zip(scores(a[i : i + some], c), listed[i : i + some], strict=True):
            for wanted, at in find(s, of, least, row):
                rows = [(int(s[k]), v, int(cids[k])) for k in at for v in ids[k]]
                yield from ((row["cid"], wanted, *r) for r in rows)


def find_positives(n: int) -> Callable:
    """Rows of the anchor's label with the highest scores."""

    def find(s: np.ndarray, of: np.ndarray, least: np.ndarray, row: dict) -> Iterator[tuple[int, np.ndarray]]:
        own = np.flatnonzero(of == row["label"])
        yield 0, own[_first(s[own], least[own], n)]

    return find


def find_negatives(n: int, percent: int) -> Callable:
    """For each wanted score, rows of other labels with the highest scores up to it, and not below the given percent of it."""

    def find(s: np.ndarray, of: np.ndarray, least: np.ndarray, row: dict) -> Iterator[tuple[int, np.ndarray]]:
        wanted = row["wanted"]
        if not wanted:
            return
        other = np.flatnonzero((of != row["label"]) & (100 * s >= percent * min(wanted)) & (s <= max(wanted)))
        for w in wanted:
            at = other[(s[other] <= w) & (100 * s[other] >= percent * w)]
            if len(at):
                yield w, at[_first(s[at], least[at], n)]

    return find


def join_groups(pairs: DataFrame, find: Callable, width: int, tasks: int) -> DataFrame:
    """Anchors and candidates (cell, block, chunk, is_anchor, cid, label, q, ids, wanted), joined within (cell, block, chunk), to _FOUND."""

    def joined(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        keys = [table.column(c).to_numpy() for c in ("chunk", "block", "cell")]
        order = np.lexsort(keys)
        new = np.any([np.diff(k[order]) != 0 for k in keys], axis=0)
        starts = np.flatnonzero(np.append(True, new)) if len(order) else []
        out: list[tuple] = []
        for rows in np.split(order, starts[1:]) if len(order) else []:
            own = table.take(pa.array(rows))
            anchors, candidates = own.filter(own.column("is_anchor")), own.filter(pa.compute.invert(own.column("is_anchor")))
            if len(anchors) and len(candidates):
                out += _join_block(anchors, candidates, find, width)
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["anchor", "wanted", "score", "vec_id", "candidate"])

    return pairs.groupBy(F.pmod(F.xxhash64("cell", "block", "chunk"), F.lit(tasks)).alias("g")).applyInArrow(joined, _FOUND)


def _ranked(found: DataFrame, n: int) -> DataFrame:
    """The n first rows of each anchor and wanted score, with their rank."""
    order = Window.partitionBy("anchor", "wanted").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "candidate")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _literal(values: list[int], at: str) -> Column:
    """values[at] of a short list."""
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col(at) + 1)


class Join:
    """Exact searches of anchors among candidates (cid, label, q, ids), placed in the cells of a space."""

    def __init__(self, candidates: DataFrame, anchors: DataFrame, cfg: HardNegatives):
        self.spark, self.cfg = candidates.sparkSession, cfg
        norm = F.aggregate("q", F.lit(0.0), lambda a, v: a + v.cast("double") * v)
        size = candidates.agg(F.count("*").alias("n"), F.max(norm).alias("norm"), F.max(F.size("q")).alias("width")).first()
        n_anchors = anchors.count()
        self.width = max(1, size.width or 0)
        sample = candidates.select("q").orderBy(F.xxhash64("q"), "q").limit(cfg.pivot_sample)
        sample = np.array([r.q + [0] * (self.width - len(r.q)) for r in sample.collect()], np.int64).reshape(-1, self.width)  # pivot_sample rows at most
        most = int(min(cfg.most_cells, max(1, -(-n_anchors // cfg.group))))
        chosen = sample[far_apart(sample, most)].astype(np.float64)
        extra = np.sqrt(np.maximum(size.norm - (chosen**2).sum(1), 0))
        self.space = Space(np.column_stack((chosen, extra)), float(size.norm), self.width)
        place = tidied(_placed, space=self.space)
        self.candidates = cut(self.spark, candidates.mapInArrow(place, "cid long, label long, q array<int>, ids array<long>, cell int, r double"), "placed")
        placed = cut(self.spark, anchors.join(self.candidates.select("cid", "cell", "r"), "cid"), "anchors")
        cells = len(chosen)
        have, asked = [0] * cells, [0] * cells
        for table, counts in ((self.candidates, have), (placed, asked)):
            for r in table.groupBy("cell").count().collect():  # most_cells rows at most
                counts[r["cell"]] = r["count"]
        self.blocks = [max(1, -(-n // cfg.group)) for n in asked]
        self.chunks = [max(1, -(-n // cfg.chunk)) for n in have]
        self.all_chunks = max(1, -(-sum(have) // cfg.chunk))
        self.n_anchors, self.n_candidates = n_anchors, sum(have)
        self.asked = asked
        self.anchors = placed.withColumn("block", F.pmod(F.xxhash64("cid"), _literal(self.blocks, "cell")).cast("int"))

    def _sides(self, anchors: DataFrame, candidates: DataFrame) -> DataFrame:
        cols = ["cell", "block", "chunk"]
        a = anchors.select(*cols, F.lit(True).alias("is_anchor"), "cid", "label", "q", F.lit(None).cast("array<long>").alias("ids"), "wanted")
        return a.union(candidates.select(*cols, F.lit(False), "cid", "label", "q", "ids", F.lit(None).cast("array<long>")))

    def search(self, anchors: DataFrame, find: Callable, keep: int, bounds: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """The first ``keep`` rows that find yields for anchors (cid, label, q, cell, block, wanted), over all candidates: _FOUND and rank.

        bounds(anchors, found in their own cells): the anchors with low and high, the scores beyond which nothing matters.
        """
        tasks = lambda rows: max(1, int(rows // (2 * self.cfg.chunk)))
        sequence = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        own_chunk = F.pmod(F.xxhash64("cid"), _literal(self.chunks, "cell")).cast("int")
        near = self._sides(
            anchors.withColumn("chunk", sequence(_literal(self.chunks, "cell"))),
            self.candidates.where(_literal(self.asked, "cell") > 0).withColumn("chunk", own_chunk).withColumn("block", sequence(_literal(self.blocks, "cell"))),
        )
        copies = sum(h * b for h, b in zip(self.chunks, self.blocks, strict=True)) * self.cfg.chunk
        here = cut(self.spark, _ranked(join_groups(near, find, self.width, tasks(copies)), keep), "near", "lz4")
        open_ = bounds(anchors, here)
        bands = open_.select("cell", "block", "q", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"))
        bands = bands.mapInArrow(tidied(_bands, space=self.space), "cell int, block int, other int, lo double, hi double").where("cell <> other")
        bands = cut(self.spark, bands.groupBy("cell", "block", "other").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "bands", "lz4")
        spread = bands.select(F.col("cell").alias("to"), F.col("block").alias("to_block"), "other", "lo", "hi", sequence(F.lit(self.all_chunks)).alias("part"))
        dealt = self.candidates.withColumn("chunk", F.pmod(F.xxhash64("cid"), F.lit(self.all_chunks)).cast("int"))
        sent = dealt.join(spread, (F.col("cell") == F.col("other")) & (F.col("chunk") == F.col("part")) & F.col("r").between(F.col("lo"), F.col("hi")))
        sent = sent.select(F.col("to").alias("cell"), F.col("to_block").alias("block"), "chunk", "cid", "label", "q", "ids")
        far = self._sides(anchors.withColumn("chunk", sequence(F.lit(self.all_chunks))), sent)
        there = join_groups(far, find, self.width, tasks(sum(self.blocks) * self.n_candidates))
        return cut(self.spark, _ranked(here.drop("rank").union(there), keep), "found", "lz4")


def hard_negatives(rows: DataFrame, cfg: HardNegatives | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from rows (vec_id, label, embedding).

    Anchors are rows whose vec_id is divisible by ``anchor_every``. Their positives are the first other rows of their label by score, then by vec_id;
    the negatives of both are the first rows of other labels whose score lies between ``least_percent`` of the positive's and all of it.
    Rows without label or vector, or with a component that is null or not finite, take no part. Rows that repeat a vec_id are rows of
    their own. A row without vec_id comes last among equal scores and is no anchor. Missing components of shorter vectors are zero.
    Other columns are ignored. Empty in, empty out.
    """
    cfg = cfg or HardNegatives()
    spark = rows.sparkSession
    find_package(spark)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    with discarding() as keep:
        rows = whole_vectors(rows, cfg)
        more = cfg.positives + 1  # an anchor may be among its own
        order = Window.partitionBy("label", "q").orderBy(F.col("vec_id").asc_nulls_last())
        first = rows.withColumn("at", F.row_number().over(order)).where(F.col("at") <= max(more, cfg.negatives))
        first = first.groupBy("label", "q").agg(F.sort_array(F.collect_list(F.struct("at", "vec_id"))).alias("ids"))
        classes = cut(spark, first.select(F.monotonically_increasing_id().alias("cid"), "label", "q", F.col("ids.vec_id").alias("ids")), "vectors")
        anchors = rows.where(F.col("vec_id") % cfg.anchor_every == 0).join(classes.drop("ids"), ["label", "q"])
        anchors = cut(spark, anchors.select(F.col("vec_id").alias("anchor_id"), "cid"), "anchors")
        asked = classes.drop("ids").join(anchors.select("cid").distinct(), "cid", "left_semi")
        asked = cut(spark, asked, "asked")
        if asked.isEmpty():
            return spark.createDataFrame([], schema)
        join = Join(classes, asked, cfg)

        def as_good(anchors: DataFrame, found: DataFrame) -> DataFrame:
            least = found.where(F.col("rank") == more).select(F.col("anchor").alias("cid"), F.col("score").alias("low"))
            return anchors.join(least, "cid", "left").withColumn("low", F.coalesce(F.col("low").cast("double"), F.lit(-2.0**62))).withColumn("high", F.lit(2.0**62))

        def between(anchors: DataFrame, found: DataFrame) -> DataFrame:
            full = found.where(F.col("rank") == cfg.negatives).groupBy(F.col("anchor").alias("cid")).agg(F.map_from_entries(F.collect_list(F.struct("wanted", "score"))).alias("full"))
            floor_ = lambda w: F.coalesce(F.try_element_at("full", w).cast("double"), w.cast("double") * cfg.least_percent / 100)
            lows = F.array_min(F.transform("wanted", floor_))
            return anchors.where(F.size("wanted") > 0).join(full, "cid", "left").withColumn("low", lows).withColumn("high", F.array_max("wanted"))

        none = F.lit(None).cast("array<long>")
        found = join.search(join.anchors.withColumn("wanted", none), find_positives(more), more, as_good)
        listed = F.sort_array(F.collect_list(F.struct("rank", "score", "vec_id", "candidate")))
        best = cut(spark, found.groupBy(F.col("anchor").alias("cid")).agg(listed.alias("best")), "best", "lz4")
        wanted = F.filter(F.array_distinct(F.col("best.score")), lambda s: s >= 0)  # no score lies between 80 % and all of less than nothing
        seeking = cut(spark, join.anchors.join(best, "cid").withColumn("wanted", wanted).drop("best"), "seeking")
        found = join.search(seeking, find_negatives(cfg.negatives, cfg.least_percent), cfg.negatives, between)
        entry = F.struct(F.col("wanted").alias("key"), F.sort_array(F.collect_list(F.struct("rank", "score", "vec_id"))).alias("value"))
        lists = found.groupBy("anchor", "wanted").agg(entry["value"].alias("value"))
        lists = lists.groupBy(F.col("anchor").alias("cid")).agg(F.map_from_entries(F.collect_list(F.struct("wanted", "value"))).alias("negatives"))
        per = best.join(lists, "cid").select("cid", "best", "negatives")
        # an anchor's own row goes from its positives once
        own = lambda x: (x["candidate"] == F.col("cid")) & (x["vec_id"] == F.col("anchor_id"))
        at = F.transform("best", lambda x: own(x).eqNullSafe(F.lit(True)))
        pos = F.array_position(at, True)
        others = F.filter("best", lambda x, i: (pos == 0) | (i + 1 != pos))
        pairs = anchors.join(per, "cid").select("anchor_id", "negatives", F.explode(F.slice(others, 1, cfg.positives)).alias("p"))
        out = pairs.select("anchor_id", "p", F.explode(F.try_element_at("negatives", F.col("p.score"))).alias("x"))
        out = out.select("anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("x.rank").cast("int").alias("rank"), F.col("x.vec_id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("x.score").alias("negative_score"))
        return keep(cut(spark, out, "negatives"))
