"""Quality rules as a short-circuit cascade, in DataFrame functions only.

``measure`` computes the base measures of every document. ``cascade`` estimates on a sample what each further rule costs and what share it
rejects, orders the rules by rejection per cost, and joins them into one CASE: a document that a rule rejects isn't shown to the next. The
order changes the cost only; a document is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.llm.shared import SPACE, WORD, cut, discarding

#: Measures that every document gets.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_dup_line_percent: int = 40
    max_symbols_per_100_words: int = 20
    max_capital_percent: int = 40
    #: Characters of ten words.
    mean_word_x10: tuple[int, int] = (20, 150)
    min_letter_word_percent: int = 60
    min_distinct_percent: int = 5
    #: Documents of the sample on which rules are measured, and how often each rule reads it.
    sample_rows: int = 2000
    sample_turns: int = 3


def measure(docs: DataFrame) -> DataFrame:
    """The rows of docs as a struct ``row``, with their words and base measures in ``__``-named columns. A null text counts as empty."""
    t = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs["text"], F.lit("")).alias("__text"))
    t = t.withColumn("__words", F.filter(F.split("__text", f"{SPACE}+"), lambda x: x != ""))
    t = t.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: x.rlike(WORD)))
    t = t.withColumn("__n_words", F.size("__words").cast("long"))
    three = F.transform(
        F.sequence(F.lit(0), F.size("__words") - 3), lambda i: F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2))
    )
    t = t.withColumn("__three", F.when(F.size("__words") >= 3, three).otherwise(F.array().cast("array<bigint>")))
    # Windows found twice: neighbours in the order of their hashes. Only texts that have any are sorted.
    placed = F.sort_array(F.transform("__three", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    t = t.withColumn("__placed", F.when(F.size(F.array_distinct("__three")) < F.size("__three"), placed).otherwise(none))
    twice = F.filter("__placed", lambda x, i: (x["h"] == F.get("__placed", i + 1)["h"]) | (x["h"] == F.get("__placed", i - 1)["h"]))
    t = t.withColumn("__at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.transform("__at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("__at", i + 1) - p, F.lit(3))))
    t = t.withColumn("__n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x))
    t = t.withColumn("__word_chars", F.char_length(F.array_join("__words", "")).cast("long"))
    t = t.withColumn("__n_symbols", F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long"))
    t = t.withColumn("__n_lines", F.size("__lines").cast("long"))
    return t.withColumn("__n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))


def base_failed(cfg: QualityRules) -> Column:
    return (F.col("__n_words") < cfg.min_words) | (100 * F.col("__n_repeat_words") > cfg.max_repeat_percent * F.col("__n_words"))


def rules(cfg: QualityRules) -> dict[str, Column]:
    """Name -> whether the rule rejects a document."""
    n, words = F.col("__n_words"), F.col("__words")
    low, high = cfg.mean_word_x10
    return {
        "repeated lines": 100 * F.col("__n_dup_lines") > cfg.max_dup_line_percent * F.col("__n_lines"),
        "symbols": 100 * F.col("__n_symbols") > cfg.max_symbols_per_100_words * n,
        "capitals": 100 * F.regexp_count("__text", F.lit(r"\p{Lu}")) > cfg.max_capital_percent * F.col("__word_chars"),
        "word length": (10 * F.col("__word_chars") < low * n) | (10 * F.col("__word_chars") > high * n),
        "words with letters": 100 * F.size(F.filter(words, lambda x: x.rlike(r"\p{L}"))) < cfg.min_letter_word_percent * n,
        "distinct words": 100 * F.size(F.array_distinct(words)) < cfg.min_distinct_percent * n,
    }


def rule_order(docs: DataFrame, cfg: QualityRules) -> list[str]:
    """Rule names by rejected share per second, largest first, as measured on a sample of the documents.

    Every rule reads the sample so many times over that a job's own time is small against it, twice; the shorter time less that of a run
    without a rule counts.
    """
    spark = docs.sparkSession
    rows = docs.count()
    sample = measure(docs.sample(min(1.0, cfg.sample_rows / max(rows, 1)), seed=7))
    sample = cut(spark, sample.select(*[c for c in sample.columns if c.startswith("__")]).drop("__lines", "__three", "__placed", "__at"), "sample")
    again = sample.withColumn("__turn", F.explode(F.sequence(F.lit(1), F.lit(cfg.sample_turns))))

    def run(rejects: Column) -> tuple[int, float]:
        seconds = []
        for _ in range(2):
            began = time.perf_counter()
            found = again.agg(F.coalesce(F.count_if(rejects & (F.col("__turn") > 0)), F.lit(0))).first()[0]
            seconds.append(time.perf_counter() - began)
        return found, min(seconds)

    run(F.col("__n_words") < 0)
    _, idle = run(F.col("__n_words") < 0)
    score = {}
    for name, rejects in rules(cfg).items():
        found, seconds = run(rejects)
        score[name] = found / max(seconds - idle, 1e-3)
    return sorted(score, key=lambda k: -score[k])


def cascade(docs: DataFrame, cfg: QualityRules) -> Column:
    """Of ``measure``'s rows, whether a document of docs passes the base limits and all rules, judged in the order of ``rule_order``."""
    every = rules(cfg)
    verdict = F.when(base_failed(cfg), False)
    with discarding():
        order = rule_order(docs, cfg)
    for name in order:
        verdict = verdict.when(every[name], False)
    return verdict.otherwise(True)


def quality(docs: DataFrame, cfg: QualityRules | None = None) -> DataFrame:
    """docs without text, with the base measures, base_failed and kept. Empty and null texts have no words and fail.

    Rows are judged one by one, repeated ones alike. Columns of docs that are named like the new ones give way to them. Empty in, empty out.
    """
    cfg = cfg or QualityRules()
    new = [*MEASURES, "base_failed", "kept"]
    rest = [c for c in docs.columns if c not in (*new, "text")]
    measured = measure(docs.select(*[docs[c] for c in rest], "text"))
    kept = cascade(docs.select("text"), cfg)
    return counted(measured.select(*[F.col("row")[c].alias(c) for c in rest], *[F.col(f"__{m}").alias(m) for m in MEASURES], base_failed(cfg).alias("base_failed"), kept.alias("kept")))


def counted(judged: DataFrame) -> DataFrame:
    """judged (…, kept), with the numbers of judged and rejected documents as observed metrics ("quality rules").

    Counting has to see every row, so filters on kept stay above it, and measures are computed once a row, not anew for every use in a filter.
    """
    return judged.observe("quality rules", F.count(F.lit(1)).alias("judged"), F.count_if(~F.col("kept")).alias("rejected"))


def keep_good(docs: DataFrame, cfg: QualityRules | None = None) -> DataFrame:
    """The rows of docs that pass, with their columns."""
    cfg = cfg or QualityRules()
    judged = counted(measure(docs).select("row", cascade(docs.select("text"), cfg).alias("kept")))
    return judged.where("kept").select("row.*")
