"""Phrases of a lexicon table in texts, all at once.

Texts and phrases are folded to words of letters and digits, and a phrase is found where its words stand in a row. A lexicon of bounded size
is sent to all tasks once and becomes an Aho-Corasick automaton in each worker, which reads a text once whatever the number of
phrases. A larger lexicon stays a table: runs of words, as long as its phrases are, meet it by equality.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.functions import text as T

#: Characters of a lexicon that is sent to all tasks.
MOST_CHARS = 4_000_000


def plain_words(x: Column) -> Column:
    """Folded words of letters and digits, a blank between them and at both ends; a single blank if there is none."""
    said = F.trim(F.regexp_replace(T.fold(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", " "))
    return F.when(said == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), said, F.lit(" ")))


_built: dict[int, object] = {}


def _automaton(sent):
    """The automaton of a broadcast list of phrases, built once in each worker."""
    import ahocorasick

    if sent.value[0] not in _built:
        found = ahocorasick.Automaton()
        for p in sent.value[1]:
            found.add_word(p, p)
        found.make_automaton()
        _built.clear()
        _built[sent.value[0]] = found
    return _built[sent.value[0]]


#: Characters of texts that a worker has as Python objects at once, and hits after which it hands over what it has.
MOST_READ, MOST_HITS = 2_000_000, 20_000


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, str]]:
    """(row, text) of a batch; no more texts than ``MOST_READ`` are Python objects together, unless a single one is longer."""
    rows, texts = batch.column("row"), batch.column("text")
    sizes = pc.binary_length(texts).to_pylist()
    start = held = 0
    for i, n in enumerate([*sizes, None]):
        if n is None or (held + n > MOST_READ and i > start):
            yield from zip(rows.slice(start, i - start).to_pylist(), texts.slice(start, i - start).to_pylist(), strict=True)
            start, held = i, 0
        held += n or 0


def _scan(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """(row, text) to (row, phrase, at): each phrase of a text once, with the number of words before it. Hits go out in pieces of a bounded size."""

    def out(hits: list[tuple[int, str, int]]) -> pa.RecordBatch:
        rows, phrases, places = zip(*hits, strict=True) if hits else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(phrases, pa.string()), pa.array(places, pa.int32())], ["row", "phrase", "at"])

    for batch in batches:
        hits: list[tuple[int, str, int]] = []
        for row, text in _texts(batch):
            first: dict[str, int] = {}
            for end, phrase in _automaton(sent).iter(text):
                if phrase not in first:
                    first[phrase] = end - len(phrase) + 1
            seen = words = 0
            for phrase, start in sorted(first.items(), key=lambda x: x[1]):
                words += text.count(" ", seen, start)
                seen = start
                hits.append((row, phrase.strip(), words))
                if len(hits) >= MOST_HITS:
                    yield out(hits)
                    hits = []
        yield out(hits)


def found(docs: DataFrame, key: str, text: str, lexicon: DataFrame, phrase: str, most_chars: int = MOST_CHARS) -> DataFrame:
    """(key, phrase, at): the distinct phrases of each text, folded, and how many words stand before the first place of each.

    Phrases that fold to the same words are one; a phrase without words is in no text. key tells rows of docs apart; a null text has no phrase.
    """
    spark = docs.sparkSession
    known = lexicon.select(F.trim(plain_words(F.col(phrase))).alias("phrase")).where("phrase <> ''").distinct()
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("phrase")), F.lit(0)).alias("chars")).first()
    texts = docs.select(F.col(key).alias("row"), plain_words(F.col(text)).alias("text"))
    if not size.n:
        return texts.select(F.col("row").alias(key), F.lit("").alias("phrase"), F.lit(0).alias("at")).where("1 = 0")
    if size.chars <= most_chars:
        listed = sorted(f" {r.phrase} " for r in known.collect())  # most_chars at most
        sent = spark.sparkContext.broadcast((hash(tuple(listed)), listed))
        hits = texts.where(F.col("row").isNotNull()).mapInArrow(lambda batches: _scan(batches, sent), "row long, phrase string, at int")
        return hits.select(F.col("row").alias(key), "phrase", "at")
    known = known.withColumn("n", F.size(F.split("phrase", " ")))
    lengths = [r.n for r in known.select("n").distinct().collect()]  # numbers of words, a few
    words = F.filter(F.split("text", " "), lambda w: w != "")
    each = texts.where(F.col("row").isNotNull()).select("row", words.alias("w"))
    runs = F.flatten(F.array(*[F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0))), lambda i: F.when(i + n <= F.size("w"), F.struct(F.array_join(F.slice("w", i + 1, n), " ").alias("phrase"), i.alias("at")))) for n in lengths]))  # noqa: B023
    each = each.select("row", F.explode(F.filter(runs, lambda x: x.isNotNull())).alias("x")).groupBy("row", F.col("x.phrase").alias("phrase")).agg(F.min("x.at").alias("at"))
    return each.join(known.select("phrase"), "phrase").select(F.col("row").alias(key), "phrase", F.col("at").cast("int").alias("at"))


def scores(hits: DataFrame, key: str, lexicon: DataFrame, phrase: str, kind: str) -> DataFrame:
    """(key, kind, said): how many of a kind's phrases each text has. A phrase may be of several kinds."""
    known = lexicon.select(F.trim(plain_words(F.col(phrase))).alias("__p"), F.col(kind).alias(kind)).where("__p <> ''").distinct()
    return hits.join(known, F.col("phrase") == F.col("__p")).groupBy(key, kind).agg(F.count("*").alias("said"))


def best_kind(scored: DataFrame, key: str, kind: str, whole: DataFrame | None = None, least: float = 0.0) -> DataFrame:
    """(key, kind, share): the kind of which a text says the largest share of phrases (whole: kind, n), or most of them without it; under least none; ties by kind."""
    rows = scored.withColumn("share", F.col("said").cast("double")) if whole is None else scored.join(whole.select(F.col(kind).alias("__k"), "n"), F.col(kind) == F.col("__k")).withColumn("share", F.col("said") / F.col("n")).drop("__k", "n")
    top = rows.where(F.col("share") >= least).groupBy(key).agg(F.min(F.struct((-F.col("share")).alias("s"), F.col(kind).alias("k"))).alias("b"))
    return top.select(key, F.col("b.k").alias(kind), (-F.col("b.s")).alias("share"))


#: Weights of a title and of the share of phrases, and of that share without a title, in hundredths.
TITLE, WITH_TITLE, WITHOUT_TITLE = 60, 40, 50


def weighed(scored: DataFrame, key: str, kind: str, whole: DataFrame, titles: DataFrame, excluded: DataFrame) -> DataFrame:
    """(key, kind, score): six tenths for the kind that a text's title says and four for its share of phrases; without the title half of the share, and nothing where the text says what excludes the kind.

    scored: (key, kind, said), whole: (kind, n), titles: (key, kind) of texts whose title says a kind, excluded: (key, kind). Kinds of score 0 are left out.
    """
    t = titles.select(F.col(key).alias("__k"), F.col(kind).alias("__t"), F.lit(True).alias("__titled"))
    e = excluded.select(F.col(key).alias("__ek"), F.col(kind).alias("__et"), F.lit(True).alias("__out")).distinct()
    every = scored.select(key, kind, "said").unionByName(titles.select(key, kind, F.lit(0).cast("long").alias("said"))).groupBy(key, kind).agg(F.max("said").alias("said"))
    rows = every.join(whole.select(F.col(kind).alias("__w"), "n"), F.col(kind) == F.col("__w"))
    rows = rows.join(t, (F.col(key) == F.col("__k")) & (F.col(kind) == F.col("__t")), "left").join(e, (F.col(key) == F.col("__ek")) & (F.col(kind) == F.col("__et")), "left")
    share = F.col("said") / F.col("n")
    score = F.when(F.col("__titled"), TITLE + WITH_TITLE * share).when(F.col("__out").isNull(), WITHOUT_TITLE * share)
    return rows.select(key, kind, (score / 100).alias("score")).where("score > 0")
