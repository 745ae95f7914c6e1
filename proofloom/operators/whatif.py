"""Rule sets against each other: cases rebuilt from their log and judged by several versions of the rules in one pass."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.operators import rulebook as R


def last_values(events: DataFrame, key: str, variable: Column, value: Column, order: list[str], names: dict[str, str]) -> DataFrame:
    """(key, a column for each name): the last value that a case's events give a variable, typed; null if none does.

    names: variable -> Spark type. One partial aggregate for all variables; the log is read once and never sorted.
    """
    at = F.struct(*order)
    said = lambda n: F.when((variable == n) & value.isNotNull(), at)
    return events.groupBy(key).agg(*[F.max_by(F.when(variable == n, value), said(n)).try_cast(t).alias(n) for n, t in names.items()])


def rule_names(versions: dict[str, list[R.Rule]]) -> list[str]:
    """The rules of all versions, each once, as they first come; a rule's bit is its place."""
    names = list(dict.fromkeys(r.name for rules in versions.values() for r in rules))
    if len(names) > 62:
        raise ValueError("a bit set holds 62 rules")
    return names


def judged(cases: DataFrame, versions: dict[str, list[R.Rule]]) -> DataFrame:
    """cases with {version}_failed, {version}_open (bit sets over ``rule_names``) and {version}_verdict for each version. No shuffle, one pass."""
    names = rule_names(versions)
    rows, own = cases, cases.columns
    for v, rules in versions.items():
        mine = [replace(r, name=f"__{v}_{r.name}") for r in rules]
        rows = R.evaluate(rows, mine).drop("stopped", "skipped")
        bit = lambda r: F.lit(1 << names.index(r.name)).cast("long")
        set_of = lambda holds: sum((F.when(holds(F.col(m.name)), bit(r)).otherwise(F.lit(0).cast("long")) for r, m in zip(rules, mine, strict=True)), F.lit(0).cast("long"))  # noqa: E731,B023
        rows = rows.withColumns({f"{v}_failed": set_of(lambda x: F.coalesce(~x, F.lit(False))), f"{v}_open": set_of(lambda x: x.isNull()), f"{v}_verdict": R.verdict(mine)})
        rows = rows.select(*own, *[f"{w}_{x}" for w in list(versions)[: list(versions).index(v) + 1] for x in ("failed", "open", "verdict")])
    return rows


def names_of(bits: Column, names: list[str]) -> Column:
    """The rules of a bit set, in order."""
    return F.array_compact(F.array(*[F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, n) for i, n in enumerate(names)]))


def changes(rows: DataFrame, keys: list[str], versions: dict[str, list[R.Rule]], base: str) -> DataFrame:
    """(keys, version, before, after, newly_failing, mended): a row for each case and version whose verdict isn't the base version's."""
    names = rule_names(versions)
    old = F.col(f"{base}_failed")

    def entry(v: str) -> Column:
        new = F.col(f"{v}_failed")
        return F.struct(
            F.lit(v).alias("version"), F.col(f"{base}_verdict").alias("before"), F.col(f"{v}_verdict").alias("after"),
            F.array_join(names_of(new.bitwiseAND(F.bitwise_not(old)), names), ",").alias("newly_failing"), F.array_join(names_of(old.bitwiseAND(F.bitwise_not(new)), names), ",").alias("mended"),
        )

    each = F.filter(F.array(*[entry(v) for v in versions if v != base]), lambda e: e["before"] != e["after"])
    return rows.select(*keys, F.explode(each).alias("c")).select(*keys, "c.*")
