"""What may enter a log, how foreign reports become events, and how objections are read: guards, synchronisation, citations, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def guarded(events: DataFrame, kinds: DataFrame, roles: DataFrame, kind: str, actor: str, role: str) -> DataFrame:
    """events with ``refused``: why an event may not enter the log, else null. The first reason counts.

    kinds (kind, human_only) is the closed list of event kinds, roles (role, kind) says who may produce what; both are lists of a few dozen rows
    that are kept by hand, so they are broadcast.
    """
    k = F.broadcast(kinds.select(F.col("kind").alias("__k"), "human_only"))
    may = F.broadcast(roles.select(F.col("role").alias("__r"), F.col("kind").alias("__rk")).distinct())
    rows = events.join(k, F.col(kind) == F.col("__k"), "left").join(may, (F.col(role) == F.col("__r")) & (F.col(kind) == F.col("__rk")), "left")
    why = F.when(F.col("__k").isNull(), "unknown kind").when(F.col("human_only") & (F.col(actor) != "human"), "human only").when(F.col("__r").isNull(), "role may not")
    return rows.withColumn("refused", why).drop("__k", "human_only", "__r", "__rk")


def synchronised(reports: DataFrame, key: str, at: str, rank: Column, arrival: str, same: list[str]) -> DataFrame:
    """Each report once (the first to arrive of those alike in ``same``), with seq in the order of instant, rank (states before tasks) and arrival."""
    once = reports.groupBy(*same).agg(F.min(arrival).alias(arrival))
    w = Window.partitionBy(key).orderBy(at, rank, arrival)
    return once.withColumn("seq", F.row_number().over(w))


def mapped_literals(rows: DataFrame, literal: str, table: DataFrame) -> DataFrame:
    """rows with the state that the platform's literal stands for (table: literal, state); an unknown one is reflected as it is and escalated.

    The table is kept by hand (a few dozen rows), so it is broadcast.
    """
    t = F.broadcast(table.select(F.col("literal").alias("__l"), F.col("state").alias("__s")))
    joined = rows.join(t, F.col(literal) == F.col("__l"), "left")
    return joined.withColumn("state", F.coalesce("__s", literal)).withColumn("escalate", F.col("__l").isNull() & F.col(literal).isNotNull()).drop("__l", "__s")


def one_of_each(table: DataFrame, mark: str, marks: list[str]) -> DataFrame:
    """(mark, n) of special marks that don't stand in exactly one row of a table."""
    found = table.groupBy(mark).agg(F.count("*").alias("n"))
    want = table.sparkSession.createDataFrame([(m,) for m in marks], f"{mark} string")
    return want.join(found, mark, "left").select(mark, F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")


def index_codes(cases: DataFrame, code: str, case: str) -> tuple[DataFrame, DataFrame]:
    """(code, case) of codes that one case has, and (code, n) of those that several have."""
    n = cases.groupBy(code).agg(F.count("*").alias("n"), F.min(case).alias(case))
    return n.where("n = 1").select(code, case), n.where("n > 1").select(code, "n")


def resolved(refs: DataFrame, ref: str, index: DataFrame, code: str, case: str) -> DataFrame:
    """refs with the case of the code that a reference is or, failing that, of the one code that it holds between hyphens; null if it holds none or several.

    The longest code says how many hyphenated parts are looked up together; all runs of up to so many parts of a reference are held against the
    codes by equality: no pattern meets every code. Blanks around a reference don't count.
    """
    most = index.agg(F.max(F.size(F.split(code, "-")))).first()[0] or 1
    rows = refs.withColumn("__id", F.monotonically_increasing_id())
    whole = F.trim(ref)
    parts = F.split(whole, "-")
    runs = F.flatten(F.transform(parts, lambda _, i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size(parts) - i)), lambda n: F.array_join(F.slice(parts, i + 1, n), "-"))))
    tried = rows.select("__id", whole.alias("__ref"), F.explode(F.array_distinct(runs)).alias("__code"))
    own = index.select(F.col(code).alias("__code"), F.col(case).alias("__case"))
    hits = tried.join(own, "__code").groupBy("__id").agg(F.max(F.when(F.col("__code") == F.col("__ref"), F.col("__case"))).alias("exact"), F.min("__case").alias("only"), F.count("*").alias("codes"))
    hits = hits.select("__id", F.coalesce("exact", F.when(F.col("codes") == 1, F.col("only"))).alias(case))
    return rows.join(hits, "__id", "left").drop("__id")


def term_weights(candidates: DataFrame, item: str, terms: Column) -> DataFrame:
    """(item, term, w): the distinct terms of each candidate, each weighing a millionth part of 1 / candidates that have it (whole numbers, so sums are exact)."""
    rows = candidates.select(item, F.explode(F.array_distinct(terms)).alias("term"))
    df = rows.groupBy("term").agg(F.count("*").alias("df"))
    return rows.join(df, "term").select(item, "term", F.floor(F.lit(1_000_000) / F.col("df")).alias("w"))


#: Weighted terms of candidates that are sent to all tasks; more of them meet the reasons' terms by a join.
MOST_WEIGHTS = 200_000


def scored(reasons: DataFrame, keys: list[str], terms: Column, weights: DataFrame, item: str, most: int = 3) -> DataFrame:
    """(keys, item, confidence): candidates that share a weight of 1 or a fifth of their own with a reason, the best three within six tenths of the best.

    Confidence is the shared share in hundredths, 90 at most. Candidates are indexed by term. An index of a checked size is broadcast, so that the reasons'
    terms, the frequent ones too, stay where they are; pairs are summed before they move. Of each reason no more than the best few are kept together.
    """
    whole = weights.groupBy(item).agg(F.sum("w").alias("whole"))
    index = weights.groupBy("term").agg(F.collect_list(F.struct(item, "w")).alias("in"))  # a term's candidates: of hundreds, a few
    index = F.broadcast(index) if weights.limit(MOST_WEIGHTS + 1).count() <= MOST_WEIGHTS else index
    said = reasons.select(*keys, F.explode(F.array_distinct(terms)).alias("term"))
    shared = said.join(index, "term").select(*keys, F.explode("in").alias("x")).groupBy(*keys, F.col(f"x.{item}").alias(item)).agg(F.sum("x.w").alias("shared"))
    pairs = shared.where("shared >= 1000000").join(whole, item).where(5 * F.col("shared") >= F.col("whole"))
    order = Window.partitionBy(*keys).orderBy(F.col("shared").desc(), item)
    top = pairs.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= most).withColumn("best", F.max("shared").over(Window.partitionBy(*keys)))
    top = top.where(10 * F.col("shared") >= 6 * F.col("best"))
    return top.select(*keys, item, F.least(F.lit(90), F.floor(100 * F.col("shared") / F.col("whole"))).cast("int").alias("confidence"))


def reopened(cases: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """cases with ``refused`` (the first check that fails, in order) and ``events``: the two that a reopening writes, none if refused."""
    why = F.lit(None).cast("string")
    for name, holds in reversed(list(checks.items())):
        why = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(why)
    rows = cases.withColumn("refused", why)
    two = F.array(F.lit("requirement interpreted"), F.lit("case reopened"))
    return rows.withColumn("events", F.when(F.col("refused").isNull(), two).otherwise(F.array().cast("array<string>")))


def rarest_terms(docs: DataFrame, doc: str, terms: Column, most: int, heavy: float = 3e-4, least: int = 20) -> DataFrame:
    """(doc, term, df, k): the terms of each document (a list of distinct ones) that fewest documents have, ties by name.

    Lists are made once and dealt by document; terms are counted and looked up from there. Terms in more than a share ``heavy`` of the documents are few
    (the mean number of terms over that share, at most), so they are broadcast with their counts. They come after all lighter ones of their document, so
    those that can't be among the first are dropped where they are; lighter terms, in which none is hot, and what heavy ones are left meet their counts
    by a shuffle.
    """
    lists = docs.select(doc, terms.alias("terms")).repartition(doc)
    rows = lists.select(doc, F.explode_outer("terms").alias("term")).where("term is not null")  # not explode: its filter would make each list a second time
    df = rows.groupBy("term").agg(F.count("*").alias("df"))
    few = F.broadcast(df.where(F.col("df") > max(docs.count() * heavy, least)).select("term", F.col("df").alias("__heavy")))
    light_first = Window.partitionBy(doc).orderBy(F.coalesce("__heavy", F.lit(0)))  # light ones are alike: all have rank 1
    kept = rows.join(few, "term", "left").withColumn("__k", F.rank().over(light_first)).where(F.col("__k") <= most).select(doc, "term")
    rarest = Window.partitionBy(doc).orderBy("df", "term")
    return kept.join(df, "term").withColumn("k", F.row_number().over(rarest)).where(F.col("k") <= most).select(doc, "term", "df", "k")


def interpreted(reasons: DataFrame, keys: list[str], cited: DataFrame, scored_: DataFrame, item: str) -> DataFrame:
    """(keys, item, confidence, by): what each reason is about, an explicit citation (100) before a likeness; a reason about nothing has one row, by "escalation".

    cited: (keys, item); scored_: (keys, item, confidence). An item that is cited and alike is there once.
    """
    both = cited.select(*keys, item, F.lit(100).alias("confidence"), F.lit("citation").alias("by")).unionByName(scored_.select(*keys, item, "confidence", F.lit("likeness").alias("by")))
    one = both.groupBy(*keys, item).agg(F.max(F.struct("confidence", "by")).alias("b")).select(*keys, item, "b.confidence", "b.by")
    none = reasons.select(*keys).join(one.select(*keys).distinct(), keys, "left_anti")
    return one.unionByName(none.select(*keys, F.lit(None).cast(dict(one.dtypes)[item]).alias(item), F.lit(None).cast("int").alias("confidence"), F.lit("escalation").alias("by")))
