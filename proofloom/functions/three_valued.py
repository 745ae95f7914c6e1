"""Three-valued logic where null means "cannot be evaluated". Spark's and, or, not are right as they are; these are the cases that aren't."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_list(x: Column, items: Column) -> Column:
    """Membership that takes no notice of null items; null if x is."""
    return F.array_contains(F.filter(items, lambda e: e.isNotNull()), x)


def least_known(*columns: Column) -> Column:
    """The least of all, null if any is null."""
    missing = columns[0].isNull()
    for c in columns[1:]:
        missing |= c.isNull()
    return F.when(~missing, F.least(*columns))


def count_known(items: Column, holds: Callable[[Column], Column]) -> Column:
    """How many items hold, null if that is open for any."""
    return F.when(~F.exists(items, lambda e: holds(e).isNull()), F.size(F.filter(items, holds)))


def for_each(items: Column, holds: Callable[[Column], Column]) -> Column:
    """Whether all items hold; null for no items."""
    return F.when(F.size(items) > 0, F.forall(items, holds))


def unique(items: Column) -> Column:
    """Whether there is one distinct item besides nulls; null if there is none."""
    known = F.array_except(items, F.array(F.lit(None)))  # compiled with what makes the items, as a lambda isn't
    return F.when(F.size(known) > 0, F.size(known) == 1)


def family(kind: str) -> str:
    """What kind of values a Spark type has: boolean, number, text, date or bytes."""
    if kind in ("boolean", "date"):
        return kind
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return "number"
    return "text" if kind == "string" else "date" if kind.startswith("timestamp") else "bytes"


_COMPARED: dict[str, Callable[[Column, Column], Column]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


def compare(rows: DataFrame, a: Column, op: str, b: Column) -> Column:
    """a op b over rows, within one family of values. Open, and never a silent cast, between families, and where values that have no order (texts, booleans, bytes) are put in order."""
    x, y = (family(kind) for _, kind in rows.select(a, b).dtypes)
    fits = x == y and (op in ("==", "!=") or x in ("number", "date"))
    return _COMPARED[op](a, b) if fits else F.lit(None).cast("boolean")


# ---- over the rows of a group


def all_rows(x: Column) -> Column:
    """False if any row is, else null if any row is or there is none, else true."""
    return F.when(F.count_if(~x) > 0, False).when((F.count("*") > 0) & (F.count_if(x.isNull()) == 0), True)


def sum_rows(x: Column) -> Column:
    """Sum, null if any row is null."""
    return F.when(F.count("*") == F.count(x), F.sum(x))


def unique_rows(x: Column) -> Column:
    """Whether the rows have one distinct value besides nulls; null if they have none. By min and max: no distinct shuffle."""
    return F.min(x) == F.max(x)
