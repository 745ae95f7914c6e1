"""The append-only event log: hash chains, their check, replay to a state, propagation, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofloom.operators import fold


def chained(events: DataFrame, key: str, order: list[str], content: Column) -> DataFrame:
    """(key, n_events, head): the head of the chain h(i) = sha256(h(i-1) | content(i)) from the empty text on."""
    return fold.heads(events, key, order, content).withColumnRenamed("n", "n_events")


def linked(events: DataFrame, key: str, order: list[str], content: Column) -> DataFrame:
    """events with seq (from 1), own and previous hash: an own hash covers the content and the one before."""
    return fold.linked(events, key, order, content)


def broken_links(stored: DataFrame, key: str, content: Column) -> DataFrame:
    """(key, first_broken): the first seq whose stored hash or link isn't what its content and predecessor say; only broken logs.

    Who alters a row consistently must alter all later ones and the head, which ``chained`` has told before.
    """
    w = Window.partitionBy(key).orderBy("seq")
    recomputed = F.sha2(F.concat("prev_hash", F.lit("|"), F.coalesce(content, F.lit(""))), 256)
    bad = (F.col("own_hash") != recomputed) | (F.col("prev_hash") != F.lag("own_hash", 1, "").over(w)) | (F.col("seq") != F.lag("seq", 1, 0).over(w) + 1)
    return stored.withColumn("bad", bad).where("bad").groupBy(key).agg(F.min("seq").alias("first_broken"))


def replay(events: DataFrame, key: str, order: list[str], start: str, moves: dict[tuple[str, str], str], kind: str) -> DataFrame:
    """(key, state, rejected): events folded in order over a graph of moves (state, event type) -> state; others are counted as rejected."""
    states = sorted({start, *(a for a, _ in moves), *moves.values()})

    def step(state: Column, e: Column) -> Column:
        to = F.lit(None).cast("string")
        for (a, event), target in moves.items():
            to = F.when((state == a) & (e["kind"] == event), target).otherwise(to)
        return to

    return fold.replay_spans(events, key, order, states, start, step, [F.col(kind).alias("kind")]).drop("error")


def spread(marked: DataFrame, members: DataFrame, group: str, member: str) -> DataFrame:
    """(group, member, direct) of all members of groups that have a marked one. marked: (member)."""
    m = members.join(marked.select(F.col(member).alias("__m")).distinct(), F.col(member) == F.col("__m"), "left").withColumn("direct", F.col("__m").isNotNull())
    hit = m.groupBy(group).agg(F.max("direct").alias("hit")).where("hit").select(F.col(group).alias("__g"))
    return m.join(hit, F.col(group) == F.col("__g")).select(group, member, "direct")


def divergences(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows by key in which two tables differ: (keys, side, fields)."""
    a = left.select(*keys, *[F.col(v).alias(f"a_{v}") for v in values], F.lit(True).alias("in_a"))
    b = right.select(*keys, *[F.col(v).alias(f"b_{v}") for v in values], F.lit(True).alias("in_b"))
    fields = F.array_compact(F.array(*[F.when(~F.col(f"a_{v}").eqNullSafe(F.col(f"b_{v}")), v) for v in values]))
    side = F.when(F.col("in_b").isNull(), "left").when(F.col("in_a").isNull(), "right").otherwise("both")
    return a.join(b, keys, "full").select(*keys, side.alias("side"), F.array_join(fields, ",").alias("fields")).where("side <> 'both' or fields <> ''")


def rebuilt(events: DataFrame, key: str, order: str, payload: str, variables: list[str]) -> DataFrame:
    """(key, variables…): the last value that a case's events give each variable, from their payloads {"variable", "value"} alone."""
    p = events.select(key, order, F.from_json(payload, "variable string, value string").alias("p"))
    return p.groupBy(key).agg(*[F.max_by(F.when(F.col("p.variable") == v, F.col("p.value")), F.when(F.col("p.variable") == v, F.col(order))).cast("int").alias(v) for v in variables])


def documents(events: DataFrame, doc: str, order: str, registers: Column, splits: Column, classifies: Column, kind: str) -> DataFrame:
    """(doc, registered, kind) of documents that are registered and not split, with the kind that was said last."""
    last = F.max_by(F.when(classifies, F.col(kind)), F.when(classifies, F.col(order)))
    rows = events.groupBy(doc).agg(F.count_if(registers).alias("registered"), F.coalesce(F.bool_or(splits), F.lit(False)).alias("split"), last.alias(kind))
    return rows.where("registered > 0 and not split").drop("split")


#: Members of a group that meet an objection in one task; more of them are dealt to further tasks.
SLICE = 500


def peer_events(marked: DataFrame, members: DataFrame, group: str, member: str, named: str, event: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """marked (group, named, …) for every member of its group: (…, member, direct). Each objection writes a row into each log of its bundle, as it must.

    known (member, event): what logs have already is left out. It meets the objections before they are multiplied, so that the product, which grows with
    objections times members, never moves. Members of a group are dealt to slices, so that a large group is many tasks' work.
    """
    if known is not None:
        own = known.select(F.col(event).alias("__e"), F.col(member).alias("__had")).join(marked.select(F.col(event).alias("__e")).distinct(), "__e").groupBy("__e").agg(F.collect_set("__had").alias("__had"))
        marked = marked.join(own, F.col(event) == F.col("__e"), "left").drop("__e")
    most = members.groupBy(group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    n = -(-most // SLICE) or 1
    dealt = members.withColumn("__slice", F.pmod(F.xxhash64(member), F.lit(n)).cast("int"))
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as few small rows make many: adaptive execution would put them into one task
    sides = (marked.withColumn("__slice", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))), dealt)
    left, right = (x.repartition(tasks, group, "__slice") for x in sides)
    rows = left.join(right, [group, "__slice"])
    if known is not None:
        rows = rows.where(~F.coalesce(F.array_contains("__had", F.col(member)), F.lit(False))).drop("__had")
    return rows.withColumn("direct", F.col(named) == F.col(member)).drop(group, named, "__slice")


# The kinds of events of a run, in the order in which they are recorded.
RUN = ("case opened", "sheet assigned", "document registered", "document split", "document classified", "evidence proposed", "datum consolidated", "conflict detected", "observation recorded", "calculation done", "verdict given")


def _coded(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, rank, place, payload) of all kinds that parts has."""
    if unknown := sorted(set(parts) - set(RUN)):
        raise ValueError(f"no such kinds of events: {', '.join(unknown)}")
    out = None
    for rank, kind in enumerate(RUN):
        if kind in parts:
            rows = parts[kind].select(key, F.lit(rank).alias("rank"), F.col("place").cast("string").alias("place"), F.col("payload").cast("string").alias("payload"))
            out = rows if out is None else out.union(rows)
    if out is None:
        raise ValueError("a run without events")
    return out


def _kind() -> Column:
    return F.element_at(F.array(*map(F.lit, RUN)), F.col("rank") + 1)


def run_events(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, rank, place, kind, payload) of a run: the events of all kinds that parts has, each (key, place, payload), in the order of kinds; place orders those of one kind."""
    return _coded(parts, key).select(key, "rank", "place", _kind().alias("kind"), "payload")


def recorded(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """The chained log of each case's run: (key, rank, place, kind, payload, seq, prev_hash, own_hash). The same run gives the same log, byte for byte."""
    return fold.linked(run_events(parts, key), key, ["rank", "place", "payload"], F.concat_ws(":", "kind", "payload"))


def recorded_heads(parts: dict[str, DataFrame], key: str, digested: tuple[str, ...] = ()) -> DataFrame:
    """(key, n, kinds, head): how many events ``recorded`` has of each case, of how many kinds, and its last hash. Payloads of the kinds in digested are their SHA-256.

    Events move once, by the number of their kind and with what a payload is made of; texts and digests are made where they are read, and only heads come out.
    """
    rows = _coded(parts, key).repartition(key)
    if digested:
        rows = rows.withColumn("payload", F.when(F.col("rank").isin([RUN.index(k) for k in digested]), F.sha2("payload", 256)).otherwise(F.col("payload")))
    return fold.heads_by_kind(rows, key, ["rank", "place", "payload"], F.concat_ws(":", _kind(), "payload"), "rank")
