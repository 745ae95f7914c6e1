"""Folds over the ordered rows of a key that hold one key's state and no rows: a log of any length goes through, batch by batch.

Rows are dealt by key and sorted (Spark spills), so each task reads every key's rows in order. What is no chain by nature is folded by spans
instead (``replay_spans``): spans of a bounded number of events become maps from state to state, which compose.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

_KEY, _CONTENT = "__key", "__content"


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list, list]]:
    for batch in batches:
        yield batch, batch.column(_KEY).to_pylist(), batch.column(_CONTENT).to_pylist()


def _sorted(rows: DataFrame, key: str, order: list[str], content: Column) -> DataFrame:
    rows = rows.withColumn(_KEY, F.coalesce(F.col(key).cast("string"), F.lit("\0"))).withColumn(_CONTENT, F.coalesce(content, F.lit("")))
    return rows.repartition(_KEY).sortWithinPartitions(_KEY, *order)


def linked(rows: DataFrame, key: str, order: list[str], content: Column) -> DataFrame:
    """rows with seq (from 1), prev_hash and own_hash = sha256(prev_hash | content) along each key's order; the first prev_hash is empty."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seq, head = None, 0, ""
        for batch, keys, contents in _keyed(batches):
            seqs, before, own = [], [], []
            for k, x in zip(keys, contents, strict=True):
                if k != last:
                    last, seq, head = k, 0, ""
                seq += 1
                seqs.append(seq)
                before.append(head)
                head = hashlib.sha256(f"{head}|{x}".encode()).hexdigest()
                own.append(head)
            rest = batch.drop_columns([_KEY, _CONTENT])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(seqs, pa.int64()), pa.array(before, pa.string()), pa.array(own, pa.string())], [*rest.schema.names, "seq", "prev_hash", "own_hash"])

    new = [StructField("seq", LongType()), StructField("prev_hash", StringType()), StructField("own_hash", StringType())]
    return _sorted(rows, key, order, content).mapInArrow(chain, StructType([*rows.schema.fields, *new]))


def _per_key(rows: DataFrame, key: str, order: list[str], content: Column, start: Callable, step: Callable, end: Callable, out: str) -> DataFrame:
    """(key, n, out): end(state) after step(state, content) along each key's order."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, value, n, state, some = None, None, 0, None, False
        names = [key, "n", out]
        kind = None
        for batch, keys, contents in _keyed(batches):
            kind = batch.schema.field(key).type
            values, done = batch.column(key), ([], [], [])
            for i, (k, x) in enumerate(zip(keys, contents, strict=True)):
                if not some or k != last:
                    if some:
                        for column, v in zip(done, (value, n, end(state)), strict=True):
                            column.append(v)
                    last, value, n, state, some = k, values[i].as_py(), 0, start(), True
                state, n = step(state, x), n + 1
            yield pa.RecordBatch.from_arrays([pa.array(done[0], kind), pa.array(done[1], pa.int64()), pa.array(done[2], pa.string())], names)
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([value], kind), pa.array([n], pa.int64()), pa.array([end(state)], pa.string())], names)

    schema = StructType([rows.schema[key], StructField("n", LongType()), StructField(out, StringType())])
    return _sorted(rows.select(key, *[o for o in order if o != key], content.alias(_CONTENT)), key, order, F.col(_CONTENT)).mapInArrow(fold, schema)


def heads(rows: DataFrame, key: str, order: list[str], content: Column) -> DataFrame:
    """(key, n, head): the last hash of each key's chain, as ``linked`` has it."""
    step = lambda h, x: hashlib.sha256(f"{h}|{x}".encode()).hexdigest()
    return _per_key(rows, key, order, content, str, step, str, "head")


def heads_by_kind(rows: DataFrame, key: str, order: list[str], content: Column, kind: str) -> DataFrame:
    """(key, n, kinds, head): ``heads``, and how many kinds a key's rows are of. order begins with kind; rows are dealt by key already."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, last, n, kinds, seen, head, type_ = False, None, 0, 0, None, "", None
        names = [key, "n", "kinds", "head"]

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], type_), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], names)

        for batch in batches:
            type_, done = batch.schema.field(key).type, []
            for k, x, text in zip(batch.column(key).to_pylist(), batch.column(kind).to_pylist(), batch.column(_CONTENT).to_pylist(), strict=True):
                if not some or k != last:
                    if some:
                        done.append((last, n, kinds, head))
                    some, last, n, kinds, seen, head = True, k, 0, 0, None, ""
                if kinds == 0 or x != seen:
                    kinds, seen = kinds + 1, x
                n, head = n + 1, hashlib.sha256(f"{head}|{text}".encode()).hexdigest()
            yield batch_of(done)
        if some:
            yield batch_of([(last, n, kinds, head)])

    schema = StructType([rows.schema[key], StructField("n", LongType()), StructField("kinds", LongType()), StructField("head", StringType())])
    told = rows.sortWithinPartitions(key, *order).select(key, kind, F.coalesce(content, F.lit("")).alias(_CONTENT))  # what is read is made of sorted rows
    return told.mapInArrow(fold, schema)


def digests(rows: DataFrame, key: str, order: list[str], line: Column) -> DataFrame:
    """(key, n, sha256) of each key's lines in order, joined by line ends."""

    def step(state, x):
        h, first = state
        h.update((x if first else "\n" + x).encode())
        return h, False

    return _per_key(rows, key, order, line, lambda: (hashlib.sha256(), True), step, lambda s: s[0].hexdigest(), "sha256")


def replay_spans(events: DataFrame, key: str, order: list[str], states: list[str], start: str, step: Callable[[Column, Column], Column], fields: list[Column], span: int = 1000) -> DataFrame:
    """(key, state, rejected, error) after all events of each key. step(state, event) is the next state, or null where the event is refused.

    Events are sorted by ranges of key and order, so a key with very many of them is many tasks' work, and become spans of so many; of each span it is told where every state leads, how many events it refuses on the way and which refusal was
    the first (state -> event's ``kind``). A key's spans, a row for so many events, are then composed.
    """
    by = [F.col(key), *[F.col(o) for o in order if o != key]]
    rows = events.select(key, *[o for o in order if o != key], F.struct(*fields).alias("__e")).repartitionByRange(*by).sortWithinPartitions(*by)
    rows = rows.select(key, F.monotonically_increasing_id().alias("__i"), "__e")  # ascends from range to range and within each
    log = F.transform(F.array_sort(F.collect_list(F.struct("__i", "__e"))), lambda x: x["__e"])
    spans = rows.groupBy(key, F.floor(F.col("__i") / span).alias("__span")).agg(log.alias("__log"))

    def after(acc: Column, e: Column) -> Column:
        to = step(acc["state"], e)
        refused = F.concat(acc["state"], F.lit(" -> "), e["kind"])
        return F.struct(F.coalesce(to, acc["state"]).alias("state"), (acc["rejected"] + F.when(to.isNull(), 1).otherwise(0)).alias("rejected"), F.coalesce(acc["error"], F.when(to.isNull(), refused)).alias("error"))

    zero = lambda s: F.struct(s.alias("state"), F.lit(0).alias("rejected"), F.lit(None).cast("string").alias("error"))
    leads = F.map_from_entries(F.transform(F.array(*map(F.lit, states)), lambda s: F.struct(s, F.aggregate("__log", zero(s), after))))
    spans = spans.select(key, "__span", leads.alias("__leads"))
    per = F.transform(F.array_sort(F.collect_list(F.struct("__span", F.map_entries("__leads").alias("m")))), lambda x: F.map_from_entries(x["m"]))

    def compose(acc: Column, m: Column) -> Column:
        to = F.element_at(m, acc["state"])
        return F.struct(to["state"].alias("state"), (acc["rejected"] + to["rejected"]).alias("rejected"), F.coalesce(acc["error"], to["error"]).alias("error"))

    return spans.groupBy(key).agg(F.aggregate(per, zero(F.lit(start)), compose).alias("s")).select(key, "s.state", "s.rejected", "s.error")


def replayed(events: DataFrame, key: str, order: list[str], kind: str, moves: dict[tuple[str, str], str], start: str) -> DataFrame:
    """events with seq, state (after each of them) and accepted: each key's events in order over a graph of moves; a refused one leaves the state as it is.

    A key's events are read in order by one task, which holds its state and no rows.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seq, state = None, 0, start
        for batch, keys, kinds in _keyed(batches):
            seqs, states, taken = [], [], []
            for k, x in zip(keys, kinds, strict=True):
                if k != last:
                    last, seq, state = k, 0, start
                to = moves.get((state, x))
                seq, state = seq + 1, to or state
                seqs.append(seq)
                states.append(state)
                taken.append(to is not None)
            rest = batch.drop_columns([_KEY, _CONTENT])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(seqs, pa.int64()), pa.array(states, pa.string()), pa.array(taken, pa.bool_())], [*rest.schema.names, "seq", "state", "accepted"])

    new = [StructField("seq", LongType()), StructField("state", StringType()), StructField("accepted", BooleanType())]
    return _sorted(events, key, order, F.col(kind)).mapInArrow(walk, StructType([*events.schema.fields, *new]))
