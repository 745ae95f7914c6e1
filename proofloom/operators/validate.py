"""Nested documents against a schema: what a typed column breaks, with the path of each place.

A schema is a tree of nodes. Walking it yields columns: every check of a node in a struct is one expression, and checks within an array run over its
elements by higher-order functions, so that a violation has a path such as ``units[3].price``. One pass over the rows, no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """What a value must be; every check that is set must hold. A null value breaks ``required`` alone."""

    required: bool = False
    one_of: tuple = ()
    pattern: str | None = None
    least: float | None = None
    most: float | None = None
    #: Of a text: its length; of an array: how many elements.
    least_size: int | None = None
    most_size: int | None = None
    #: Elements of an array that say the same under this name (the elements themselves: "") break it.
    distinct: str | None = None
    #: Further checks by name: false breaks one, open doesn't.
    checks: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    #: Of a struct: its fields. Of an array: its elements.
    fields: dict[str, Node] = field(default_factory=dict)
    items: Node | None = None


def _own(node: Node, x: Column) -> list[tuple[str, Column]]:
    """(name, broken) of a node's own checks of a value."""
    size = F.size(x) if node.items is not None else F.char_length(x)
    out: list[tuple[str, Column]] = []
    if node.required:
        out.append(("required", x.isNull()))
    if node.one_of:
        out.append(("one of", ~x.isin(*node.one_of)))
    if node.pattern is not None:
        out.append(("pattern", ~x.rlike(node.pattern)))
    for name, limit, breaks in (("least", node.least, lambda v: x < v), ("most", node.most, lambda v: x > v), ("least size", node.least_size, lambda v: size < v), ("most size", node.most_size, lambda v: size > v)):
        if limit is not None:
            out.append((name, breaks(F.lit(limit))))
    if node.distinct is not None:
        said = x if node.distinct == "" else F.transform(x, lambda e: e[node.distinct])
        known = F.filter(said, lambda e: e.isNotNull())
        out.append(("distinct", F.size(F.array_distinct(known)) < F.size(known)))
    return [*out, *((name, ~f(x)) for name, f in node.checks.items())]


def _found(node: Node, x: Column, path: Column) -> Column:
    """An array of (path, check) for what a value breaks."""
    each = [F.when(F.coalesce(x.isNotNull() if name != "required" else F.lit(True), F.lit(True)) & F.coalesce(broken, F.lit(False)), F.struct(path.alias("path"), F.lit(name).alias("check"))) for name, broken in _own(node, x)]
    parts = [F.array_compact(F.array(*each))] if each else []
    for name, sub in node.fields.items():
        below = F.concat(path, F.when(path == "", F.lit("")).otherwise(F.lit(".")), F.lit(name))
        parts.append(_found(sub, x[name], below))
    if node.items is not None:
        inner = F.flatten(F.transform(x, lambda e, i: _found(node.items, e, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        parts.append(F.coalesce(inner, F.array().cast("array<struct<path:string,check:string>>")))
    parts = parts or [F.array().cast("array<struct<path:string,check:string>>")]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def violations(schema: dict[str, Node]) -> Column:
    """An array of (path, check), in the order of the schema: what the columns of a row break. Fields of a struct that is null are as null."""
    none = F.array().cast("array<struct<path:string,check:string>>")
    return F.concat(none, *[_found(node, F.col(name), F.lit(name)) for name, node in schema.items()])


def report(rows: DataFrame, keys: list[str], schema: dict[str, Node]) -> DataFrame:
    """(keys, path, check): a row for each place that breaks the schema."""
    return rows.select(*keys, F.explode(violations(schema)).alias("v")).select(*keys, "v.*")


def parsed(rows: DataFrame, text: str, type_: str, out: str) -> DataFrame:
    """rows with a JSON text as a typed column, and ``{out}_kind``: "malformed" for what isn't JSON at all, else null."""
    value = F.from_json(text, type_, {"mode": "PERMISSIVE"})
    broken = F.col(text).isNotNull() & F.try_parse_json(text).isNull()
    return rows.withColumn(out, value).withColumn(f"{out}_kind", F.when(broken, "malformed"))
