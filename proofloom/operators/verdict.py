"""Rules as boolean columns: phases, worst severity, shortfalls."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severities and the verdicts that a failing rule of each leads to, worst first.
VERDICTS = {"SCOPE": "NOT_ELIGIBLE", "DATA": "BLOCKED", "FIXABLE": "FIXABLE", "NOTICE": None}
PASSED = "PREVALIDATED"


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    holds: Column
    #: Rules of phase 0 decide on scope; if one fails, the others aren't evaluated.
    phase: int = 1


def results(cases: DataFrame, rules: list[Rule]) -> DataFrame:
    """cases with a column for each rule: true, false, or null (not evaluable, or masked by a failed scope)."""
    scope = [~F.coalesce(r.holds, F.lit(True)) for r in rules if r.phase == 0]
    stopped = F.lit(False)
    for s in scope:
        stopped |= s
    masked = [(F.when(~stopped, r.holds) if r.phase else r.holds).alias(r.name) for r in rules]
    return cases.select("*", stopped.alias("stopped"), *masked)


def verdict(rules: list[Rule]) -> Column:
    """Of rows of ``results``: the verdict of the worst severity among failing rules."""
    out = F.lit(PASSED)
    for severity, said in reversed(list(VERDICTS.items())):
        if said:
            for r in rules:
                if r.severity == severity:
                    out = F.when(~F.col(r.name), said).otherwise(out)
    return out


def long_form(rows: DataFrame, keys: list[str], rules: list[Rule]) -> DataFrame:
    """(keys, rule, severity, result) with result PASS, FAIL or NOT_EVALUABLE: one pass, no shuffle."""
    said = lambda c: F.when(c, "PASS").when(~c, "FAIL").otherwise("NOT_EVALUABLE")
    each = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), said(F.col(r.name)).alias("result")) for r in rules])
    return rows.select(*keys, F.explode(each).alias("r")).select(*keys, "r.*")


def shortfalls(long: DataFrame, most: int) -> DataFrame:
    """The most frequently failing rules."""
    return long.where("result = 'FAIL'").groupBy("rule", "severity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule").limit(most)
