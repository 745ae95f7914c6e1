"""Prefix trie of conversations by partition refinement.

``number_turns`` puts turns in order, ``conversation_sequences`` makes one sequence of turns for each conversation, and ``trie`` builds the nodes.
All conversations start as one class, the root. A round splits the classes that are still active by their next turns; a class that has
become a single sequence is retired, and its tail is emitted as a unary chain without looking at its turns again. Rounds take more turns
each time (1, 2, 4, ... up to ``most_turns``), so long sequences that agree for long cost few rounds. Conversations with equal sequences
are one member of a class from the start, with a weight, so copies retire like any other.

Turns travel as digests of 128 bits and sizes; texts are read once. A class, however large, is counted by partial aggregates and never
collected. Folding back takes one aggregate: every node but the root belongs to the smallest of its members, and what a
subtree sums to is the sum of its members' own nodes, less those of its smallest member above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofloom.llm.shared import cut, discarding, find_package, running_start


@dataclass(frozen=True)
class Trie:
    #: Turns that a round refines by at most.
    most_turns: int = 64
    #: Neighbouring turns of a conversation, and neighbouring conv_ids, that one task takes together.
    span: int = 1024


def _digest(*columns: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(*columns), 256)), 1, 16)


def number_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, chars): turns in order from 1 on, a digest of role and text, and the text's code points.

    Turns are ordered by turn, null first, and by a digest of role and text where turns are equal. A null role or text is empty. Rows
    without conv_id are of no conversation. A conversation may be of any length: turns are sorted by ranges, not within one task.
    """
    spark = conversations.sparkSession
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        "conv_id", "turn", _digest(F.octet_length(role).cast("string").cast("binary"), F.lit(b":"), role.cast("binary"), text.cast("binary")).alias("digest"), F.char_length(text).cast("long").alias("chars")
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("tie")]
    turns = turns.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    turns = cut(spark, turns.select("conv_id", "digest", "chars", F.monotonically_increasing_id().alias("at")), "turns")
    part = F.shiftrightunsigned("at", 33)  # as monotonically_increasing_id is defined
    parts = turns.groupBy("conv_id", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), (earlier - F.col("first")).alias("base"))
    placed = turns.join(parts, (F.col("conv_id") == F.col("c")) & (part == F.col("p")))
    return placed.select("conv_id", (F.col("at") + F.col("base") + 1).alias("pos"), "digest", "chars")


def branched(turns: DataFrame, group: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations of numbered turns as branches of their group's first: (conv_id, len), and turns as number_turns has them.

    Conversation c takes the first h turns of conversation c - c % group, where h is the crc32 of c in decimal modulo heads, and then its own turns after its first h.
    """
    spark = turns.sparkSession
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    firsts = turns.where(F.col("pos") < heads).where(F.col("conv_id") % group == 0)
    have = firsts.groupBy(F.col("conv_id").alias("base")).agg(F.count("*").alias("have"))
    convs = cut(spark, convs.join(have, "base", "left").withColumn("taken", F.least("h", F.coalesce("have", F.lit(0)))), "conversations")
    head = convs.select(F.col("conv_id").alias("of"), "base", "taken").where("taken > 0").join(firsts, F.col("base") == F.col("conv_id")).where("pos <= taken")
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos > h")
    rows = head.select(F.col("of").alias("conv_id"), "pos", "digest", "chars").union(own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "chars"))
    return convs.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), cut(spark, rows, "sequences")


def collapse(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, len, rep): the smallest conversation of equal turns. Equal: two sums of 64 bits over all turns and their places agree."""
    mark = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "pos", "digest"))
    marks = turns.groupBy("conv_id").agg(mark(1).alias("x"), mark(2).alias("y"))
    convs = cut(convs.sparkSession, convs.join(marks, "conv_id", "left").na.fill(0, ["x", "y"]), "marks")
    reps = convs.groupBy("len", "x", "y").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n"))
    return convs.join(reps, ["len", "x", "y"]).select("conv_id", "len", "rep")


def _chain(prefixes: Column, turn: Column) -> Column:
    return F.concat(prefixes, F.array(_digest(F.coalesce(F.try_element_at(prefixes, F.lit(-1)), F.lit(b"")), turn["digest"])))


def split(rest: DataFrame, members: DataFrame, depth: int, turns: int) -> DataFrame:
    """(cls, depth, prefix, rep, n, chars) for the next turns of the members (rep, cls, n): prefix tells the sequences of a class apart up to depth."""
    near = rest.where(F.col("pos") <= depth + turns).join(members, "rep")
    own = near.groupBy("rep", "cls", "n").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "chars"))).alias("t"))  # of so many turns at most
    prefixes = F.aggregate("t", F.array().cast("array<binary>"), _chain)
    own = own.select("rep", "cls", "n", F.explode(F.arrays_zip(F.col("t.pos").alias("depth"), F.col("t.chars").alias("chars"), prefixes.alias("prefix"))).alias("s"))
    return own.select("cls", F.col("s.depth").alias("depth"), F.col("s.prefix").alias("prefix"), "rep", "n", F.col("s.chars").alias("chars"))


_SHARED = "rep long, n long, depth long, owner long, reps long, convs long, chars long"


def refine(seqs: DataFrame, turns: DataFrame, cfg: Trie) -> list[DataFrame]:
    """Tables (rep, n, depth, owner, reps, convs, chars), a row for each sequence and node that it shares with others.

    seqs (rep, n, len) are distinct sequences, n conversations each, with turns (rep, pos, digest, chars). owner: a node's smallest sequence; reps, convs: how many it has.
    """
    spark = seqs.sparkSession
    root = seqs.agg(F.min("rep"), F.count("*"), F.sum("n")).first()
    if not root[1]:
        return []
    level = seqs.select("rep", "n", *[F.lit(x).cast("long").alias(c) for c, x in (("depth", 0), ("owner", root[0]), ("reps", root[1]), ("convs", root[2]), ("chars", 0))])
    levels = [level]
    if root[1] < 2:
        return levels
    members, rest = level.select("rep", F.col("owner").alias("cls"), "n"), turns
    depth, step = 0, 1
    while True:
        found = cut(spark, split(rest, members, depth, step), "split", "lz4")
        nodes = found.groupBy("cls", "depth", "prefix").agg(F.count("*").alias("reps"), F.sum("n").alias("convs"), F.min("rep").alias("owner")).where("reps > 1")
        level = cut(spark, found.join(nodes, ["cls", "depth", "prefix"]).select("rep", "n", "depth", "owner", "reps", "convs", "chars"), "level", "lz4")
        levels.append(level)
        depth += step
        members = level.where(F.col("depth") == depth).select("rep", F.col("owner").alias("cls"), "n")
        rest = cut(spark, rest.where(F.col("pos") > depth).join(members.select("rep"), "rep", "left_semi"), "rest", "lz4")
        if rest.isEmpty():
            return levels
        step = min(2 * step, cfg.most_turns)


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, bucket, ids as text) in order to (rep, ends_sha256); what is hashed is read batch by batch."""
    rep, state = None, None
    for batch in batches:
        done: list[tuple[int, str]] = []
        for r, ids in zip(batch.column("rep").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if r != rep:
                if state:
                    done.append((rep, state.hexdigest()))
                rep, state = r, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_pydict({"rep": pa.array([r for r, _ in done], pa.int64()), "ends_sha256": pa.array([x for _, x in done], pa.string())})
    if state:
        yield pa.RecordBatch.from_pydict({"rep": pa.array([rep], pa.int64()), "ends_sha256": pa.array([state.hexdigest()], pa.string())})


def ends(convs: DataFrame, cfg: Trie) -> DataFrame:
    """(rep, ends_sha256) of sequences that several conversations (conv_id, rep) have: the hash of their conv_ids in order, joined by commas.

    The hash is defined over one string. Its ids are put in order and joined in spans of bounded size; one task reads a sequence's spans one by one.
    """
    bucket = F.floor(F.col("conv_id") / cfg.span)
    spans = convs.groupBy("rep", bucket.alias("bucket")).agg(F.array_join(F.sort_array(F.collect_set("conv_id")).cast("array<string>"), ",").alias("ids"))
    return spans.repartition("rep").sortWithinPartitions("rep", "bucket").select("rep", "ids").mapInArrow(_hash_ids, "rep long, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame, cfg: Trie | None = None) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row for each node.

    convs (conv_id, len) has each conversation once, turns (conv_id, pos, digest, chars) their turns with pos from 1 to len. A node is a distinct
    sequence of the first turns of some conversation, named by the smallest conv_id that begins with it and its depth; the root has no
    parent. n_leaves counts the childless nodes of its subtree, saved_tokens sums (n_convs - 1) * chars over it, and ends_sha256 hashes the
    conv_ids that end at it. No conversations, no nodes.
    """
    cfg = cfg or Trie()
    spark = turns.sparkSession
    find_package(spark)
    span = lambda c: F.floor(F.col(c) / cfg.span)
    with discarding() as keep:
        convs = cut(spark, collapse(convs, turns), "copies")
        copies = convs.groupBy("rep").agg(F.count("*").alias("n"), F.max("len").alias("len"))
        seqs = keep(cut(spark, copies, "distinct"))
        several = seqs.where("n > 1").select("rep")
        hashes = ends(convs.join(several, "rep"), cfg)
        hashes = cut(spark, seqs.join(hashes, "rep", "left").select("rep", F.coalesce("ends_sha256", F.sha2(F.col("rep").cast("string"), 256)).alias("ends_sha256")), "ends")
        rows = turns.withColumnRenamed("conv_id", "rep").join(seqs.select("rep"), "rep", "left_semi")
        rows = cut(spark, rows, "turns")
        levels = refine(seqs, rows, cfg)
        if not levels:
            levels = [spark.createDataFrame([], _SHARED)]
        shared = levels[0]
        for level in levels[1:]:
            shared = shared.union(level)
        shared = cut(spark, shared, "shared", "lz4")
        # of each sequence the last node that it shares, and who owns that
        last = shared.groupBy("rep").agg(F.max(F.struct("depth", "owner", "reps")).alias("m")).select("rep", F.col("m.depth").alias("q"), F.col("m.owner").alias("to"), F.col("m.reps").alias("with"))
        seqs = cut(spark, seqs.join(last, "rep").join(hashes, "rep"), "sequences")
        # nodes that a sequence has alone; what each saves together with all below it needs turns only where conversations are copies
        alone = seqs.where("len > q").select("rep", "n", "q", "to", "len", "ends_sha256", F.explode(F.sequence(F.col("q") + 1, F.col("len"))).alias("depth"))
        copied = rows.join(seqs.where("n > 1 and len > q").select("rep", F.col("n").alias("m"), "q"), "rep").where("pos > q")
        copied = copied.select("rep", F.col("pos").alias("depth"), ((F.col("m") - 1) * F.col("chars")).alias("own"))
        sums = copied.groupBy("rep").agg(F.sum("own").alias("tail"))
        above = running_start(copied, ["rep"], [F.col("depth")], "own", "above", span("depth")).join(sums, "rep").select("rep", "depth", (F.col("tail") - F.col("above")).alias("below"))
        chains = alone.join(above, ["rep", "depth"], "left").select(
            F.col("rep").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("q") + 1, F.col("to")).otherwise(F.col("rep")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
            (F.col("depth") < F.col("len")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.coalesce("below", F.lit(0)).cast("long").alias("saved_tokens"),
            F.when(F.col("depth") == F.col("len"), F.col("ends_sha256")).otherwise(F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
        # shared nodes: what their members' own nodes sum to, less their owner's own nodes above
        owned = shared.where("rep = owner").select("rep", "depth", ((F.col("convs") - 1) * F.col("chars")).alias("own"))
        before = running_start(owned, ["rep"], [F.col("depth")], "own", "above", span("depth")).select(F.col("rep").alias("owner"), "depth", "above")
        total = owned.select("rep", "own").union(sums.select("rep", "tail")).groupBy("rep").agg(F.sum("own").alias("total"))
        leaf = (F.col("len") > F.col("q")) | (F.col("with") == 1)
        weights = cut(spark, seqs.join(total, "rep", "left").select("rep", leaf.cast("long").alias("leaf"), F.coalesce("total", F.lit(0)).alias("total")), "weights", "lz4")
        folded = shared.join(weights, "rep").groupBy("owner", "depth").agg(F.max("convs").alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.sum("total").alias("total"))
        up = shared.where("rep = owner and depth > 0").select("rep", "depth").join(shared.select("rep", (F.col("depth") + 1).alias("depth"), F.col("owner").alias("parent")), ["rep", "depth"])
        up = cut(spark, up.select(F.col("rep").alias("owner"), "depth", "parent"), "parents", "lz4")
        children = up.select(F.col("parent").alias("owner"), (F.col("depth") - 1).alias("depth")).union(seqs.where("len > q").select("to", "q")).groupBy("owner", "depth").agg(F.count("*").alias("n_children"))
        ended = shared.join(seqs.where("len = q").select("rep", F.col("len").alias("depth"), "ends_sha256"), ["rep", "depth"]).select("owner", "depth", "ends_sha256")
        nodes = folded.join(before, ["owner", "depth"]).join(up, ["owner", "depth"], "left").join(children, ["owner", "depth"], "left").join(ended, ["owner", "depth"], "left")
        nodes = nodes.select(
            F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
            "n_leaves", (F.col("total") - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
        return keep(cut(spark, nodes.union(chains), "nodes"))


def conversation_trie(conversations: DataFrame, cfg: Trie | None = None) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) rebuilt as branches of each hundred's first one. Other columns are ignored."""
    with discarding() as keep:
        turns = cut(conversations.sparkSession, number_turns(conversations.select("conv_id", "turn", "role", "text")), "numbered")
        return keep(trie(*branched(turns), cfg))
