"""Rules in three phases over whole tables of cases: what stops what, reasons, readings applied, remedies."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.functions import three_valued as K
from proofloom.operators.verdict import PASSED, VERDICTS


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    holds: Column
    #: scope: a failure stops all later ones; data: a failing blocking rule skips the calculation; calculation.
    phase: str = "data"
    reads: tuple[str, ...] = ()
    #: The recorded reading of the norm that the rule applies, and the documents that would mend a failure.
    note: str | None = None
    remedy: tuple[str, ...] = ()


def _any(columns: list[Column]) -> Column:
    out = F.lit(False)
    for x in columns:
        out = out | x
    return out


def evaluate(cases: DataFrame, rules: list[Rule], conflict: Column | None = None, calculated: Column | None = None) -> DataFrame:
    """cases with stopped, skipped and a column for each rule: true, false, or null (not evaluable, or not reached).

    A conflict between sources skips the calculation; so does ``calculated`` where it is false (open: it counts as done).
    """
    failed = lambda r: F.coalesce(~F.col(r.name), F.lit(False))
    of = lambda phase: [r for r in rules if r.phase == phase]
    rows = cases.withColumns({r.name: r.holds for r in of("scope")})
    rows = rows.withColumn("stopped", _any([failed(r) for r in of("scope")]))
    rows = rows.withColumns({r.name: F.when(~F.col("stopped"), r.holds) for r in of("data")})
    skipped = F.col("stopped") | _any([failed(r) for r in of("data") if r.severity == "DATA"])
    for also in (conflict, None if calculated is None else ~calculated):
        skipped = skipped if also is None else skipped | F.coalesce(also, F.lit(False))
    rows = rows.withColumn("skipped", skipped)
    return rows.withColumns({r.name: F.when(~F.col("skipped"), r.holds) for r in of("calculation")})


def verdict(rules: list[Rule], conflict: Column | None = None, phases: tuple[str, ...] = ("scope", "data", "calculation")) -> Column:
    """The verdict of the worst severity among failing rules of some phases; a conflict is no better than a blocking rule's failure."""
    out = F.lit(PASSED)
    for severity, said in reversed(list(VERDICTS.items())):
        if said:
            fails = _any([F.coalesce(~F.col(r.name), F.lit(False)) for r in rules if r.severity == severity and r.phase in phases])
            if severity == "DATA" and conflict is not None:
                fails = fails | F.coalesce(conflict, F.lit(False))
            out = F.when(fails, said).otherwise(out)
    return out


def missing(rows: DataFrame, rules: list[Rule], keys: list[str]) -> DataFrame:
    """(keys, rule, missing): the absent inputs, sorted, of each rule that was reached and could not be evaluated."""
    reached = {"scope": F.lit(True), "data": ~F.col("stopped"), "calculation": ~F.col("skipped")}

    def why(r: Rule) -> Column:
        absent = F.array_compact(F.array(*[F.when(F.col(x).isNull(), x) for x in sorted(r.reads)]))
        return F.struct(F.lit(r.name).alias("rule"), F.when(F.col(r.name).isNull() & reached[r.phase], F.array_join(absent, ",")).alias("missing"))

    return rows.select(*keys, F.explode(F.array(*map(why, rules))).alias("m")).select(*keys, "m.*").where("missing is not null")


def notes(rules: list[Rule]) -> Column:
    """The readings of all rules that were evaluated, distinct and sorted, as one text."""
    return F.array_join(F.array_distinct(F.array_sort(F.array_compact(F.array(*[F.when(F.col(r.name).isNotNull(), r.note) for r in rules if r.note])))), ",")


def remedies(rules: list[Rule]) -> Column:
    """The documents that would mend the failing rules, distinct and sorted, as one text."""
    none = F.array().cast("array<string>")
    each = [F.when(~F.col(r.name), F.array(*map(F.lit, r.remedy))).otherwise(none) for r in rules if r.remedy]
    return F.array_join(F.array_sort(F.array_distinct(F.flatten(F.array(*each)))), ",")


def lacking(cases: DataFrame, has: str, needed: dict[str, Column]) -> DataFrame:
    """cases with ``lacking``: needed kinds that aren't in the array has. A kind is needed where its condition holds; an open condition doesn't oblige."""
    want = F.array_compact(F.array(*[F.when(holds, kind) for kind, holds in needed.items()]))
    return cases.withColumn("lacking", F.array_except(want, F.coalesce(F.col(has), F.array().cast("array<string>"))))


def provisional(a: Column, b: Column, allowed: Column) -> tuple[Column, Column]:
    """The smaller of two inputs; where just one is missing and that is allowed, the other one, and whether that was so."""
    one = a.isNull() != b.isNull()
    stands_in = F.coalesce(allowed & one, F.lit(False))
    return F.coalesce(K.least_known(a, b), F.when(stands_in, F.coalesce(a, b))), stands_in


def two_worlds(cases: DataFrame, rules: list[Rule], stand_ins: dict[str, str], conflict: Column | None = None) -> DataFrame:
    """``evaluate`` with results as known, and with results in which a missing input is stood in for, in one pass.

    stand_ins: columns of results as known, and of those with stand-ins. The stand-ins count where the verdict before the calculation is that of
    a failure that can be mended. New: ``provisional``, ``verdict``, and ``verdict_as_known``, which takes no stand-in; the columns as known then have what counts,
    and nothing where the calculation is skipped. Rules of the calculation read them by those names.
    """
    calculation = [r for r in rules if r.phase == "calculation"]
    before = [r for r in rules if r.phase != "calculation"]
    rows = evaluate(cases, before, conflict).withColumn("__early", verdict(before, conflict))
    rows = rows.withColumn("provisional", (F.col("__early") == VERDICTS["FIXABLE"]) & ~F.col("skipped"))
    known = [replace(r, name=f"__{r.name}") for r in calculation]
    rows = rows.withColumns({r.name: F.when(~F.col("skipped"), r.holds) for r in known})
    both = lambda a, b: F.when(F.col("provisional"), F.coalesce(F.col(a), F.col(b))).otherwise(F.col(a))
    rows = rows.withColumns({a: F.when(~F.col("skipped"), both(a, b)) for a, b in stand_ins.items()})
    rows = rows.withColumns({r.name: F.when(~F.col("skipped"), r.holds) for r in calculation})
    rows = rows.withColumn("verdict", verdict(rules, conflict)).withColumn("verdict_as_known", verdict([*before, *known], conflict))
    return rows.drop("__early", *[r.name for r in known])


def ordered(long: DataFrame, rules: list[Rule]) -> DataFrame:
    """(…, rule, …) with place: by phase, then as the rules are listed."""
    phases = ["scope", "data", "calculation"]
    order = sorted(range(len(rules)), key=lambda i: (phases.index(rules[i].phase), i))
    place = F.lit(None).cast("int")
    for k, i in enumerate(order):
        place = F.when(F.col("rule") == rules[i].name, k).otherwise(place)
    return long.withColumn("place", place)
