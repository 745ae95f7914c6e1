"""Exact repeated passages across documents, found by fixed-block anchors and removed from all but the first document.

A window of 13 words that also starts in a document of smaller doc_id is a repeat. Every such window of the earlier document holds one
of its non-overlapping blocks of 7 words whole (7 + 7 - 1 = 13). So the blocks of all documents are the index, and every rolling 7-word
window of all documents probes it (``anchors``, ``match_anchors``). Hits are then extended: the 13-word windows around them are held
against each other by two independent 64-bit hashes, and neighbours merge into maximal runs (``extend``, ``match_windows``).

Hashes travel packed, a row for each bucket and batch of documents; buckets grow in number with the corpus, and beyond a few thousand of them
entries take two hops, so that rows hold many entries at every size. What is found goes back packed by buckets of documents, in which each
document's part becomes one row. A batch first settles what it can within itself and sends on the least document of each hash, its
greatest, and what is still open: a passage that very many documents share costs a bucket a few entries a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from proofloom.llm import words
from proofloom.llm.words import tidied
from proofloom.llm.shared import collect_garbage, cut, discarding, find_package

U64 = np.uint64
_FAR = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Repeats:
    #: Words of a window. Its anchor blocks have half as many, rounded up.
    window: int = 13
    #: Bytes of text that a batch takes at a time, and for which there is a bucket.
    batch_bytes: int = 2 << 20
    bucket_bytes: int = 8 << 20
    #: Buckets that one hop sends to; with more of them, entries take two hops and stay packed.
    fan: int = 4096

    @property
    def block(self) -> int:
        return (self.window + 1) // 2


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def _ends(starts: np.ndarray, n: int) -> np.ndarray:
    return np.append(starts[1:], n)[: len(starts)]


def _lengths(starts: np.ndarray, n: int) -> np.ndarray:
    return _ends(starts, n) - starts


def _packed(bucket: np.ndarray, ids: np.ndarray, tags: np.ndarray | None = None, **values: np.ndarray) -> Iterator[tuple[int, bytes, bytes, dict[str, bytes]]]:
    """For each bucket: its number, the distinct ids as differences (and their tags), how often each stands, and the values, packed."""
    order = np.argsort(bucket, kind="stable")
    at = _runs(bucket[order])
    for lo, hi in zip(at, _ends(at, len(order)), strict=True):
        rows = order[lo:hi]
        own = ids[rows]
        first = _runs(own) if tags is None else _pair_runs(own, tags[rows])
        head = np.diff(own[first], prepend=0).tobytes() + (b"" if tags is None else tags[rows][first].tobytes())
        yield int(bucket[rows[0]]), head, _lengths(first, len(own)).astype(np.uint32).tobytes(), {k: v[rows].tobytes() for k, v in values.items()}


def _pair_runs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Where runs of equal pairs begin."""
    return np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))) if len(x) else np.zeros(0, np.int64)


def _ids(heads: pa.ChunkedArray, counts: pa.ChunkedArray, tagged: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Ids, and their tags if they have any, one for each entry."""
    ids, tags = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for h, c in zip(heads.to_pylist(), counts.to_pylist(), strict=True):
        n, x = np.frombuffer(c, np.uint32), np.frombuffer(h, np.int64)
        ids.append(np.repeat(np.cumsum(x[: len(n)]), n))
        if tagged:
            tags.append(np.repeat(x[len(n) :], n))
    return np.concatenate(ids), np.concatenate(tags) if tagged else None


def _values(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _read(batch: pa.RecordBatch, cfg: Repeats) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, doc_ids, word hashes, numbers of words) of parts of a batch; rows without doc_id or a whole window have no words."""
    known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
    doc_ids = batch.column("doc_id").fill_null(0).to_numpy()
    for i, j, data, off in words.pieces(batch.column("text"), cfg.batch_bytes):
        s, e, counts = words.bounds(data, off)
        h = words.hashes(data, s, e)
        used = known[i:j] & (counts >= cfg.window)
        yield i, doc_ids[i:j], h[np.repeat(used, counts)], np.where(used, counts, 0)


_PROBE, _HIT = 0, 1
#: Packed entries of a bucket: probes (a: hashes; b: block flags or positions), or hits and runs on their way to their documents (a: values).
_SENT = "bucket long, kind int, ids binary, counts binary, a binary, b binary"
_SENT_TYPES = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), *((k, pa.binary()) for k in ("ids", "counts", "a", "b"))])


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_SENT_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SENT_TYPES, strict=True)], schema=_SENT_TYPES)


@dataclass(frozen=True)
class Buckets:
    """How many there are, and how many neighbours travel together on the first of two hops (1: there is one hop)."""

    n: int
    together: int = 1

    def of_hash(self, g: np.ndarray) -> np.ndarray:
        return ((g >> U64(32)) % U64(self.n)).astype(np.int64)

    def of_doc(self, ids: np.ndarray) -> np.ndarray:
        """Some neighbouring ids share a bucket, since batches mostly hold neighbours."""
        return self.of_hash(words.mix((ids >> 8).astype(U64)))


def _probes(bucket: np.ndarray, ids: np.ndarray, a: np.ndarray, b: np.ndarray, tags: np.ndarray | None = None) -> list[tuple]:
    return [(k, _PROBE, d, c, v["a"], v["b"]) for k, d, c, v in _packed(bucket, ids, tags, a=a, b=b)]


def _to_docs(ids: np.ndarray, values: np.ndarray, to: Buckets, tags: np.ndarray | None = None, last: bool = False) -> list[tuple]:
    """Values for documents, packed by the documents' buckets, or several of them together before the last hop; equal ids (and tags) stand together."""
    bucket = to.of_doc(ids) // (1 if last else to.together)
    return [(k, _HIT, d, c, v["a"], b"") for k, d, c, v in _packed(bucket, ids, tags, a=values)]


def refine(batches: Iterator[pa.RecordBatch], cfg: Repeats, to: Buckets, width: int, tagged: bool) -> Iterator[pa.RecordBatch]:
    """The second hop: entries packed by several buckets together to entries packed by each. Values of hits take width bytes; runs and windows are tagged.

    Probes of a batch, which come from very many batches of documents, are settled among each other first, so a passage that all documents share sends few entries on.
    """
    for batch in batches:
        rows = []
        for kind in (_PROBE, _HIT):
            own = batch.filter(pc.equal(batch.column("kind"), kind))
            if not len(own):
                continue
            ids, tags = _ids(own.column("ids"), own.column("counts"), tagged)
            if kind == _HIT:
                values = _values(own.column("a"), np.dtype((np.void, width)))
                order = np.argsort(ids, kind="stable") if tags is None else np.lexsort((tags, ids))
                rows += _to_docs(ids[order], values[order], to, None if tags is None else tags[order], last=True)
            elif tagged:
                w, pos = _values(own.column("a"), U64).reshape(len(ids), 2), _values(own.column("b"), np.uint32).astype(np.int64)
                rows += _window_rows(w, ids, tags, pos, cfg, to, last=True)
            else:
                rows += _anchor_rows(_values(own.column("a"), U64), ids, _values(own.column("b"), bool), to, last=True)
        yield _sent(rows)


def _settle(key: np.ndarray, ids: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries (key, id, whether it is a reference block): which are hits among these, and which must be sent on.

    A hit follows a reference block of an earlier document or is one that a later document holds too.
    """
    if not len(key):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.argsort(key, kind="stable")
    starts = _runs(key[order])
    n = _lengths(starts, len(order))
    own, ref = ids[order], block[order]
    least_ref = np.minimum.reduceat(np.where(ref, own, _FAR), starts)
    most = np.maximum.reduceat(own, starts)
    hit = (own > np.repeat(least_ref, n)) | (ref & (own < np.repeat(most, n)))
    on = ~hit | (ref & (own == np.repeat(least_ref, n))) | (own == np.repeat(most, n))
    hits, sends = np.zeros(len(key), bool), np.zeros(len(key), bool)
    hits[order], sends[order] = hit, on
    return hits, sends


def _anchor_rows(g: np.ndarray, ids: np.ndarray, block: np.ndarray, to: Buckets, last: bool) -> list[tuple]:
    """Entries settled among each other: packed probes of those that are sent on, and settled hits on their way to their documents."""
    hits, on = _settle(g, ids, block)
    at = np.flatnonzero(on)
    at = at[np.argsort(ids[at], kind="stable")]
    whole = to.together > 1 and not last
    rows = _probes(to.of_hash(g[at]) // (to.together if whole else 1), ids[at], g[at] if whole else g[at].astype(np.uint32), block[at])
    order = np.argsort(ids[hits], kind="stable")
    return rows + _to_docs(ids[hits][order], g[hits][order].astype(np.uint32), to, last=last)


def anchors(batches: Iterator[pa.RecordBatch], cfg: Repeats, to: Buckets) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to packed probes (a: 32 bits of each hash, or all 64 on the first of two hops; b: whether it is a reference block) and settled hits."""
    for batch in batches:
        for _, doc_ids, h, counts in _read(batch, cfg):
            g, at = words.windows(h, counts, cfg.block)
            if not len(g):
                continue
            starts = words.row_slices(counts)
            row = np.searchsorted(starts, at, side="right") - 1
            yield _sent(_anchor_rows(g, doc_ids[row], (at - starts[row]) % cfg.block == 0, to, last=to.together == 1))


def _passed(whole: pa.Table, rows: list[tuple]) -> pa.Table:
    """Rows found in a bucket, and those on their way to documents that came along."""
    return pa.concat_tables([pa.Table.from_batches([_sent(rows)]), whole.filter(pc.equal(whole.column("kind"), _HIT)).select(_SENT_TYPES.names).cast(_SENT_TYPES)])


def match_anchors(whole: pa.Table, to: Buckets) -> pa.Table:
    """A bucket's probes to the hits among them, packed by document buckets. Settled hits pass."""
    table = whole.filter(pc.equal(whole.column("kind"), _PROBE))
    ids, _ = _ids(table.column("ids"), table.column("counts"))
    low, block = _values(table.column("a"), np.uint32), _values(table.column("b"), bool)
    hits, _ = _settle(low, ids, block)
    own, low = ids[hits], low[hits]
    order = np.argsort(own, kind="stable")
    return _passed(whole, _to_docs(own[order], low[order], to))


def by_document(table: pa.Table, width: int, tagged: bool) -> pa.Table:
    """A document bucket's packed values, of width bytes each, to a row (doc_id, tag, values) for each document, or each tag of it."""
    ids, tags = _ids(table.column("ids"), table.column("counts"), tagged)
    tags = np.zeros(len(ids), np.int64) if tags is None else tags
    order = np.lexsort((tags, ids))
    values = _values(table.column("a"), np.dtype((np.void, width)))[order]
    ids, tags = ids[order], tags[order]
    starts = _pair_runs(ids, tags)
    ends = _ends(starts, len(ids))
    packed = pa.array([values[i:j].tobytes() for i, j in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())
    return pa.table({"doc_id": pa.array(ids[starts], pa.int64()), "tag": pa.array(tags[starts], pa.int64()), "values": packed})


def _merged(ids: np.ndarray, tags: np.ndarray, pos: np.ndarray, cfg: Repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window positions to maximal runs of covered words: ids, tags, and pairs (first word, end word)."""
    order = np.lexsort((pos, tags, ids))
    ids, tags, pos = ids[order], tags[order], pos[order]
    new = np.append(True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]) | (pos[1:] > pos[:-1] + cfg.window))[: len(ids)]
    starts = np.flatnonzero(new)
    ends = _ends(starts, len(ids)) - 1
    return ids[starts], tags[starts], np.stack((pos[starts], pos[ends] + cfg.window), axis=1).astype(np.uint32).reshape(-1, 2)


def _run_rows(ids: np.ndarray, tags: np.ndarray, pos: np.ndarray, cfg: Repeats, to: Buckets, last: bool) -> list[tuple]:
    ids, tags, runs = _merged(ids, tags, pos, cfg)
    return _to_docs(ids, runs, to, tags, last)


def _same_windows(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of windows, of two hashes each, and where runs of equal ones begin in it."""
    order = np.lexsort((w[:, 1], w[:, 0]))
    v = w[order]
    return order, np.flatnonzero(np.append(True, (v[1:] != v[:-1]).any(1))) if len(v) else np.zeros(0, np.int64)


def _window_rows(w: np.ndarray, ids: np.ndarray, tags: np.ndarray, pos: np.ndarray, cfg: Repeats, to: Buckets, last: bool) -> list[tuple]:
    """Windows settled among each other: packed probes of the least document's, and the runs of later ones."""
    order, groups = _same_windows(w)
    least = np.empty(len(w), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(ids[order], groups), _lengths(groups, len(w)))
    later, on = ids > least, np.flatnonzero(ids == least)
    on = on[np.lexsort((tags[on], ids[on]))]
    bucket = to.of_hash(w[on, 1]) // (1 if last else to.together)
    rows = _probes(bucket, ids[on], w[on], pos[on].astype(np.uint32), tags[on])
    return rows + _run_rows(ids[later], tags[later], pos[later], cfg, to, last)


def extend(batches: Iterator[pa.RecordBatch], cfg: Repeats, to: Buckets) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, hits, tag) to packed windows around the hits (a: two hashes of 64 bits; b: positions) and settled runs. A tag tells texts of one doc_id apart."""
    for batch in batches:
        hit_lists = batch.column("hits").to_pylist()
        all_tags = batch.column("tag").to_numpy()
        for i, doc_ids, h, counts in _read(batch, cfg):
            g, at = words.windows(h, counts, cfg.block)
            if not len(g):
                continue
            starts = words.row_slices(counts)
            row = np.searchsorted(starts, at, side="right") - 1
            lows = [np.frombuffer(x, np.uint32) for x in hit_lists[i : i + len(counts)]]
            wanted = np.unique(np.repeat(np.arange(len(lows), dtype=U64), [len(x) for x in lows]) << U64(32) | np.concatenate(lows).astype(U64))
            if not len(wanted):
                continue
            mine = row.astype(U64) << U64(32) | (g & U64(0xFFFFFFFF))
            hit = np.zeros(len(h) + 1, np.int64)
            hit[at + 1] = wanted[np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)] == mine
            sums = np.cumsum(hit)  # hits before each word
            first_hash, first = words.windows(h, counts, cfg.window, seed=1)
            near = sums[first + cfg.window - cfg.block + 1] > sums[first]
            w = np.stack((first_hash[near], words.windows(h, counts, cfg.window, seed=2)[0][near]), axis=1)
            first = first[near]
            if not len(w):
                continue
            row = np.searchsorted(starts, first, side="right") - 1
            yield _sent(_window_rows(w, doc_ids[row], all_tags[i : i + len(counts)][row], first - starts[row], cfg, to, last=to.together == 1))


def match_windows(whole: pa.Table, cfg: Repeats, to: Buckets) -> pa.Table:
    """A bucket's windows to the runs of those that an earlier document holds. Settled runs pass."""
    table = whole.filter(pc.equal(whole.column("kind"), _PROBE))
    ids, tags = _ids(table.column("ids"), table.column("counts"), tagged=True)
    w, pos = _values(table.column("a"), U64).reshape(-1, 2), _values(table.column("b"), np.uint32).astype(np.int64)
    if not len(w):
        return _passed(whole, [])
    order, groups = _same_windows(w)
    later = ids[order] > np.repeat(np.minimum.reduceat(ids[order], groups), _lengths(groups, len(w)))
    return _passed(whole, _run_rows(ids[order][later], tags[order][later], pos[order][later], cfg, to, last=to.together == 1))


def keep_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, runs, ...) to the same rows with n_words, n_removed and the kept words joined by one space."""
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            own = (text or "").encode().split()
            n_words.append(len(own))
            if runs:
                keep = np.ones(len(own), bool)
                for a, b in np.frombuffer(runs, np.uint32).reshape(-1, 2).tolist():
                    keep[a:b] = False
                own = [own[i] for i in np.flatnonzero(keep).tolist()]
            n_removed.append(n_words[-1] - len(own))
            kept.append(b" ".join(own).decode())
        rest = batch.drop_columns(["text", "runs"])
        yield pa.RecordBatch.from_arrays(
            [*rest.columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
            [*rest.schema.names, "n_words", "n_removed", "kept_text"],
        )


def repeated_runs(docs: DataFrame, cfg: Repeats) -> DataFrame:
    """(doc_id, tag, values): pairs of first and end word, as unsigned 32-bit numbers, of runs that an earlier document holds; they may overlap. tag: xxhash64 of the text."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("tag"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // cfg.bucket_bytes))
    to = Buckets(n, -(-n // cfg.fan))

    def anchors_matched(group: pa.Table) -> pa.Table:
        return match_anchors(group, to)

    def windows_matched(group: pa.Table) -> pa.Table:
        return match_windows(group, cfg, to)

    def hop(sent: DataFrame, width: int, tagged: bool) -> DataFrame:
        if to.together == 1:
            return sent
        return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidied(refine, cfg=cfg, to=to, width=width, tagged=tagged), _SENT)

    def to_documents(sent: DataFrame, width: int, tagged: bool) -> DataFrame:
        def gathered(group: pa.Table) -> pa.Table:
            return by_document(group, width, tagged)

        return cut(spark, hop(sent, width, tagged).groupBy("bucket").applyInArrow(gathered, "doc_id long, tag long, values binary"), "runs", "lz4")

    sent = hop(docs.select("doc_id", "text").mapInArrow(tidied(anchors, cfg=cfg, to=to), _SENT), 4, False)
    hits = to_documents(sent.groupBy("bucket").applyInArrow(anchors_matched, _SENT), 4, False).select("doc_id", "values")
    del sent
    collect_garbage(spark, every=0)  # the anchors' shuffle goes before the windows' one is written
    sent = docs.join(hits.withColumnRenamed("values", "hits").hint("merge"), "doc_id").mapInArrow(tidied(extend, cfg=cfg, to=to), _SENT)
    return to_documents(hop(sent, 8, True).groupBy("bucket").applyInArrow(windows_matched, _SENT), 8, True)


def remove_repeats(docs: DataFrame, cfg: Repeats | None = None) -> DataFrame:
    """Rows of docs (doc_id, text, ...) with n_words, n_removed and kept_text (kept words joined by one space) in place of text.

    A word goes if a window that covers it also starts in a document of smaller doc_id; windows are judged on the given texts. Null
    texts have no words. Rows without doc_id lose nothing and nothing is lost for them. Rows that repeat a doc_id are documents of their own, none
    earlier than the others, whether their texts are alike or not. Further columns stay, but for those named like the new ones.
    """
    cfg = cfg or Repeats()
    find_package(docs.sparkSession)
    with discarding() as keep:
        runs = keep(repeated_runs(docs, cfg)).withColumnRenamed("values", "runs")
    collect_garbage(docs.sparkSession, every=0)  # nothing needs the shuffles behind the runs any more
    rest = docs.drop("n_words", "n_removed", "kept_text", "runs")
    schema = [f for f in rest.schema if f.name not in ("text", "doc_id")]
    runs = runs.select(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag"), "runs").hint("merge")
    rows = rest.select("doc_id", *[f.name for f in schema], "text", F.xxhash64("text").alias("__own"))
    rows = rows.join(runs, (F.col("doc_id") == F.col("__id")) & (F.col("__own") == F.col("__tag")), "left").drop("__id", "__tag", "__own")
    new = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_text", StringType())]
    return rows.mapInArrow(tidied(keep_rest), StructType([docs.schema["doc_id"], *schema, *new]))
