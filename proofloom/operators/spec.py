"""What a specification says of itself before any case is judged: phases and levels of rules, coverage of what may stay open, versions in force.

A specification is a few dozen rules and variables, kept by hand; all of this is plain Python on the driver, once a specification.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from pathlib import PurePath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class SpecError(ValueError):
    """A specification contradicts itself."""


@dataclass(frozen=True)
class Variable:
    name: str
    level: str = "case"
    #: Variables that it is derived from, the source it is measured by, its closed list of values.
    derived_from: tuple[str, ...] = ()
    source: str | None = None
    values: tuple[str, ...] = ()
    #: Kinds of documents that say it. The key that a reference table is looked up by, if it comes from one ("": a table without a key).
    documents: tuple[str, ...] = ()
    table_key: str | None = None
    #: Whether rules count, sum or filter it: then it is a list and never in conflict.
    counted: bool = False


@dataclass(frozen=True)
class SpecRule:
    name: str
    severity: str
    reads: tuple[str, ...]
    #: What it counts, sums or filters, and what it looks up in a table; whether it is judged for each unit whatever it reads.
    counts: tuple[str, ...] = ()
    tables: tuple[str, ...] = ()
    each_unit: bool = False


@dataclass(frozen=True)
class Spec:
    name: str
    version: str
    variables: dict[str, Variable]
    rules: tuple[SpecRule, ...]
    outputs: frozenset[str] = frozenset()
    since: date | None = None
    until: date | None = None
    enums: frozenset[str] = field(default_factory=frozenset)
    #: Kinds of documents and whether a case must have them; outputs of the calculation and its controls with what they read; constants.
    documents: dict[str, bool] = field(default_factory=dict)
    output_reads: dict[str, tuple[str, tuple[str, ...]]] = field(default_factory=dict)
    controls: dict[str, tuple[str, ...]] = field(default_factory=dict)
    constants: frozenset[str] = frozenset()
    #: Whether a rule that can be mended asks for all documents that must be there.
    asks_for_documents: bool = True


def roots(spec: Spec, names: tuple[str, ...]) -> set[str]:
    """The variables that names come from in the end. A circle is an error."""
    out: set[str] = set()

    def walk(name: str, above: tuple[str, ...]) -> None:
        if name in above:
            raise SpecError(f"{' -> '.join((*above, name))} is a circle")
        v = spec.variables.get(name)
        if v is None or not v.derived_from:
            out.add(name)
        for x in v.derived_from if v else ():
            walk(x, (*above, name))

    for n in names:
        walk(n, ())
    return out


def phase_of(spec: Spec, rule: SpecRule) -> str:
    """scope by severity; calculation if an output or a control is read; else data."""
    if rule.severity == "SCOPE":
        return "scope"
    return "calculation" if any(n in spec.outputs or n in spec.output_reads or n in spec.controls for n in rule.reads) else "data"


def blocks_calculation(spec: Spec, rule: SpecRule) -> bool:
    """Whether a rule is judged before the calculation and may keep it from being done: by severity, or because it looks something up."""
    return phase_of(spec, rule) != "calculation" and (rule.severity in ("SCOPE", "DATA") or bool(rule.tables))


def level_of(spec: Spec, names: tuple[str, ...]) -> str:
    """unit if any name is a unit's, else case."""
    return "unit" if any(is_unit(spec, n) for n in names) else "case"


def collections(spec: Spec) -> list[str]:
    """Variables that are lists: declared so, or counted, summed or filtered by some rule."""
    used = {n for r in spec.rules for n in r.counts}
    return sorted(v.name for v in spec.variables.values() if v.counted or v.name in used)


def derivations_for(spec: Spec, source: str) -> list[str]:
    """Variables that a source measures."""
    return sorted(v.name for v in spec.variables.values() if v.source == source)


def enum_values(spec: Spec) -> set[str]:
    """All closed values. One that is also a variable's name is an error: a rule could not tell them apart."""
    values = set(spec.enums) | {x for v in spec.variables.values() for x in v.values}
    if both := sorted(values & set(spec.variables)):
        raise SpecError(f"values that are variables as well: {', '.join(both)}")
    return values


def _under(root: str, kinds) -> list[str]:
    """The kinds of documents that a name stands for: its own, or those that it begins."""
    return sorted(k for k in kinds if k == root or k.startswith(root + "_"))


def covered(spec: Spec, name: str) -> tuple[bool | None, tuple[str, ...]]:
    """Whether something that can be mended tells when a name is missing, and the path that shows it: a witness, or what isn't covered. Null: no such name.

    Covered is what a rule that can be mended reads; a variable of a document that a case must have; such a document itself; what is derived, looked up
    or calculated from nothing but covered names; and a constant. A circle of derivations reopens nothing.
    """
    mended = set().union(*(roots(spec, r.reads) | set(r.reads) for r in spec.rules if r.severity == "FIXABLE"))
    must = {k for k, needed in spec.documents.items() if needed} if spec.asks_for_documents else set()

    def all_of(names: tuple[str, ...], path: tuple[str, ...]) -> tuple[bool | None, tuple[str, ...]]:
        results = [walk(n, path) for n in names]
        for want in (False, None):
            if found := [p for ok, p in results if ok is want]:
                return want, found[0]
        return True, results[0][1] if results else path

    def walk(n: str, above: tuple[str, ...]) -> tuple[bool | None, tuple[str, ...]]:
        path = (*above, n)
        if n in above:
            return True, path
        if n in mended:
            return True, (*path, "a rule that can be mended")
        if v := spec.variables.get(n):
            if kinds := sorted(set(v.documents) & must):
                return True, (*path, kinds[0])
            if v.table_key is not None:
                return (True, (*path, "a table")) if v.table_key == "" else walk(v.table_key, path)
            return all_of(v.derived_from, path) if v.derived_from else (False, path)
        if kinds := _under(n, must):
            return True, (*path, kinds[0])
        if n in spec.output_reads:
            return all_of(spec.output_reads[n][1], path)
        if n in spec.controls:
            return all_of(spec.controls[n], path)
        return (True, (*path, "a constant")) if n in spec.constants else (None, path)

    return walk(name, ())


def is_unit(spec: Spec, name: str, seen: frozenset[str] = frozenset()) -> bool:
    """Whether a name is a unit's: a variable by its level, an output by what it is the output of, a control by what it reads, a document if all variables that it says are."""
    if name in seen:
        return False
    if v := spec.variables.get(name):
        return v.level == "unit" or any(is_unit(spec, x, seen | {name}) for x in v.derived_from)
    if name in spec.output_reads:
        return spec.output_reads[name][0] == "unit"
    if name in spec.controls:
        return any(is_unit(spec, x, seen | {name}) for x in spec.controls[name])
    said = [v for v in spec.variables.values() if set(v.documents) & set(_under(name, spec.documents))]
    return bool(said) and all(v.level == "unit" for v in said)


def uncovered(spec: Spec) -> dict[str, tuple[str, ...]]:
    """Blocking rules that may stay open unseen, each with the path to what nothing covers. Names that the specification doesn't have are passed over."""
    out = {}
    for r in spec.rules:
        if r.severity in ("SCOPE", "DATA"):
            for ok, path in (covered(spec, n) for n in r.reads):
                if ok is False:
                    out.setdefault(r.name, path)
    return dict(sorted(out.items()))


def load(spec: Spec, path: str) -> Spec:
    """The specification if it may be used. Proposals are never loaded."""
    if "proposals" in PurePath(path).parts:
        raise SpecError(f"{path} is a proposal")
    if len({r.name for r in spec.rules}) < len(spec.rules):
        raise SpecError("a rule's name repeats")
    enum_values(spec)
    for r in spec.rules:
        roots(spec, r.reads)
    return spec


def version_numbers(version: str) -> tuple[int, ...]:
    return tuple(int(p) if p.isdigit() else 0 for p in version.split("."))


def choose(specs: list[Spec], version: str | None, day: date) -> tuple[Spec, list[str]]:
    """The version that is asked for, else the one in force on a day, else the highest with a warning."""
    if version is not None:
        if found := [s for s in specs if s.version == version]:
            return found[0], []
        raise SpecError(f"no version {version}")
    ordered = sorted(specs, key=lambda s: version_numbers(s.version))
    in_force = [s for s in ordered if (s.since is None or day >= s.since) and (s.until is None or day <= s.until)]
    return (in_force[-1], []) if in_force else (ordered[-1], [f"no version is in force on {day}; the highest is taken"])


def columns_by_name(header: list[str], signals: dict[str, tuple[str, ...]], fold) -> dict[str, str]:
    """Field -> column of a header, by signals in the columns' folded names; the first column that fits. Fields without one are left out."""
    out: dict[str, str] = {}
    for name, words in signals.items():
        for c in header:
            if c not in out.values() and any(w in fold(c) for w in words):
                out[name] = c
                break
    return out


def method(prose: str, methods: dict[str, tuple[str, ...]]) -> tuple[str | None, list[str]]:
    """The implemented method that a prose description means, by keywords; an unknown one is told and never invented."""
    for name, words in methods.items():
        if all(w in prose.lower() for w in words):
            return name, []
    return None, [f"unknown method: {prose}"]


def with_version(rows: DataFrame, day: Column, specs: list[Spec]) -> DataFrame:
    """rows with the version in force on their day, else the highest, and whether that is so: ``choose`` for whole tables."""
    version, sure = F.lit(max(specs, key=lambda s: version_numbers(s.version)).version), F.lit(False)
    for s in sorted(specs, key=lambda s: version_numbers(s.version)):
        fits = F.lit(True)
        fits = fits & (day >= F.lit(s.since)) if s.since else fits
        fits = fits & (day <= F.lit(s.until)) if s.until else fits
        version, sure = F.when(fits, s.version).otherwise(version), F.when(fits, True).otherwise(sure)
    return rows.withColumn("version", version).withColumn("in_force", sure)


@dataclass(frozen=True)
class Derived:
    """A rule as it is judged."""

    rule: SpecRule
    phase: str
    level: str
    blocks: bool


def derived(spec: Spec, path: str) -> tuple[list[Derived], list[str], list[str]]:
    """What loading a specification yields: its rules in the order in which they are judged, the variables in the order in which they can be derived, and warnings.

    Warned of is each blocking rule that may stay open unseen, with the path to what nothing covers.
    """
    load(spec, path)
    phases = ["scope", "data", "calculation"]
    rules = [Derived(r, phase_of(spec, r), "unit" if r.each_unit else level_of(spec, r.reads), blocks_calculation(spec, r)) for r in spec.rules]
    rules.sort(key=lambda d: phases.index(d.phase))  # stable: as they are listed within a phase
    order: list[str] = []

    def place(name: str) -> None:
        for x in spec.variables[name].derived_from if name in spec.variables else ():
            place(x)
        if name in spec.variables and spec.variables[name].derived_from and name not in order:
            order.append(name)

    for name in spec.variables:
        place(name)
    return rules, order, [f"{rule} may stay open unseen: {' -> '.join(p)} is not covered" for rule, p in uncovered(spec).items()]
