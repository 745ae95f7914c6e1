"""Facts from many documents: keys, reliability, conflicts, collections, ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.functions import text as T


def rank_in(kind: Column, order: list[str]) -> Column:
    """The place of a kind in an order; unknown ones come last."""
    out = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        out = F.when(kind == name, i).otherwise(out)
    return out


def consolidate(facts: DataFrame, keys: list[str], value: str, unreliable: Column, kind: Column, kinds: list[str], order: str) -> DataFrame:
    """One row a fact: n_used, conflict, value (null in conflict), kind and raw value of the best source, suspects.

    Unreliable facts count only where there is no reliable one; else those that disagree with what was chosen are suspects, never a conflict.
    Best is the first kind in kinds, then the lowest order. Equal facts are summed up first, so a fact with very many sources doesn't meet in one task.
    """
    best = F.struct(rank_in(kind, kinds).alias("rank"), F.col(order).alias("order"), F.col(value).alias("v"), kind.alias("kind"))
    per = facts.groupBy(*keys, F.col(value).alias("v"), unreliable.alias("u")).agg(F.count("*").alias("n"), F.min(best).alias("best"))
    known, sure = F.bool_or(~F.col("u")), ~F.col("u")
    pick = lambda f, x: F.when(known, f(F.when(sure, x))).otherwise(f(x))
    said = per.groupBy(*keys).agg(
        known.alias("known"), pick(F.min, F.col("v")).alias("lo"), pick(F.max, F.col("v")).alias("hi"), pick(F.sum, F.col("n")).alias("n_used"), pick(F.min, F.col("best")).alias("best")
    )
    said = said.select(*keys, "known", "n_used", (F.col("lo") < F.col("hi")).alias("conflict"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("value"), F.col("best.kind").alias("kind"), F.col("best.v").alias("raw"))
    suspects = per.where("u").join(said.where("known"), keys).where(F.col("v") != F.coalesce("value", "raw")).groupBy(*keys).agg(F.sum("n").alias("suspects"))
    return said.join(suspects, keys, "left").withColumn("suspects", F.coalesce("suspects", F.lit(0))).drop("known")


def conflict_within(facts: DataFrame, keys: list[str], kind: str, value: str) -> DataFrame:
    """(keys, conflict_within_kind, kinds): whether sources of one kind disagree; between kinds they may."""
    per = facts.groupBy(*keys, kind).agg((F.min(value) < F.max(value)).alias("differ"))
    return per.groupBy(*keys).agg(F.coalesce(F.bool_or("differ"), F.lit(False)).alias("conflict_within_kind"), F.count("*").alias("kinds"))


def collection(facts: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, items): distinct values in the order of their first sight."""
    first = facts.groupBy(*keys, value).agg(F.min(order).alias("o"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("o", F.col(value).alias("v")))), lambda x: x["v"])
    return first.groupBy(*keys).agg(items.alias("items"))


def out_of_range(value: Column, low: float, high: float) -> Column:
    """"below" or "above" the plausible range, else null."""
    return F.when(value < low, "below").when(value > high, "above")


def with_keys(facts: DataFrame, variable: str, key: str, value: str, key_variable: str, unit_prefix: str) -> DataFrame:
    """facts with unit_key (the fact's key, or its value where it is the key) and level: unit, unassigned (a unit's, but whose?) or case."""
    own = F.coalesce(F.col(key), F.when(F.col(variable) == key_variable, F.col(value)))
    level = F.when(own.isNotNull(), "unit").when(F.col(variable).startswith(unit_prefix), "unassigned").otherwise("case")
    return facts.withColumn("unit_key", own).withColumn("level", level)


def admitted(facts: DataFrame, variable: str, source: str, declared: DataFrame) -> DataFrame:
    """Facts whose source the declarations (variable, source) admit for their variable; variables that aren't declared are always admitted."""
    pairs = declared.select(F.col("variable").alias("__v"), F.col("source").alias("__s")).distinct()
    known = pairs.select(F.col("__v").alias("__k")).distinct()
    rows = facts.join(known, F.col(variable) == F.col("__k"), "left").join(pairs, (F.col(variable) == F.col("__v")) & (F.col(source) == F.col("__s")), "left")
    return rows.where("__k is null or __v is not null").drop("__k", "__v", "__s")


def counts_where_not_told(found: DataFrame, told: DataFrame, keys: list[str], item: str) -> DataFrame:
    """(keys, n, explicit): told numbers (keys, n) as they are, else how many distinct items were found."""
    counted = found.groupBy(*keys, item).agg(F.lit(1).alias("one")).where(F.col(item).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"))
    rest = counted.join(told, keys, "left_anti")
    return told.select(*keys, "n", F.lit(True).alias("explicit")).unionByName(rest.select(*keys, "n", F.lit(False).alias("explicit")))


def suspects(facts: DataFrame, keys: list[str], value: str, unreliable: Column, said: DataFrame) -> DataFrame:
    """The unreliable facts, whole, that disagree with what reliable ones say: facts with ``chosen``. said: (keys, value, raw) as ``consolidate`` gives it."""
    sure = facts.where(~unreliable).select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    chosen = said.select(*[F.col(k).alias(f"__{k}") for k in keys], F.coalesce("value", "raw").alias("chosen"))
    same = lambda rows: [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    rows = facts.where(unreliable).join(sure, same(facts), "left_semi").join(chosen, same(facts)).where(F.col(value) != F.col("chosen"))
    return rows.drop(*[f"__{k}" for k in keys])


def levels(facts: DataFrame, variable: str, key: Column, declared: dict[str, str], unit_roots: list[str]) -> DataFrame:
    """facts with level: the declared one of their variable, else unit if they have a key or their variable's root is a unit's, else case."""
    said = F.try_element_at(F.create_map(*[x for n, v in declared.items() for x in (F.lit(n), F.lit(v))]), F.col(variable)) if declared else F.lit(None).cast("string")
    root = F.split_part(F.col(variable), F.lit("."), F.lit(1))
    return facts.withColumn("level", F.coalesce(said, F.when(key.isNotNull() | root.isin(*unit_roots), "unit").otherwise("case")))


def renamed(docs: DataFrame, name: str, sha: str, declared: DataFrame) -> DataFrame:
    """docs whose fingerprint somebody declares (declared: sha, name) under another name, with ``declared_name``. Names are compared folded; a declaration without a name tells nothing."""
    own = declared.where("sha is not null and name is not null").select(F.lower("sha").alias("__sha"), F.col("name").alias("declared_name")).distinct()
    rows = docs.join(own, F.lower(F.col(sha)) == F.col("__sha"))
    return rows.where(T.fold(F.col(name)) != T.fold(F.col("declared_name"))).drop("__sha")
