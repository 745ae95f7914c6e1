"""The savings calculation of a unit and a case: derivations, preconditions, formula, controls, totals, trace. Exact decimals throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.functions import three_valued as K

_WHOLE, _EXACT = "decimal(38,0)", "decimal(38,10)"


def power(x: Column, n: int) -> Column:
    """x ** n for a whole n of 1 or more, as a product: decimals stay exact."""
    out = x
    for _ in range(n - 1):
        out = out * x
    return out


def exact_quotient(numerator: Column, denominator: Column, places: int) -> Column:
    """numerator / denominator, cut off (not rounded) after so many places; null for a zero denominator. Both are whole numbers."""
    scaled = F.call_function("div", numerator.cast(_WHOLE) * F.lit(10**places).cast(_WHOLE), F.nullif(denominator.cast(_WHOLE), F.lit(0).cast(_WHOLE)))
    return scaled.cast(_EXACT) / F.lit(10**places).cast("decimal(11,0)")


def hours(before: Column, after: Column) -> Column:
    """The smaller of two numbers of hours, open if one is."""
    return K.least_known(before, after)


def unit_saving(power_net: Column, places_net: int, n1: Column, n2: Column, h: Column, places: int = 7) -> Column:
    """net power * (1 - (n2 / n1)**3) * h. Net power (rated power less the table's losses) is given as a whole number of 10**-places_net."""
    cubes = power(n1.cast("decimal(6,0)"), 3) - power(n2.cast("decimal(6,0)"), 3)
    whole = power_net.cast("decimal(10,0)") * cubes.cast("decimal(19,0)") * h.cast("decimal(5,0)")
    return (exact_quotient(whole, power(n1.cast("decimal(6,0)"), 3), places) / F.lit(10**places_net).cast("decimal(11,0)")).cast("decimal(28,10)")


def rollup(checks: list[Column]) -> Column:
    """Of several checks: false if one fails, true if all hold, else (and without checks) open."""
    if not checks:
        return F.lit(None).cast("boolean")
    out = checks[0]
    for x in checks[1:]:
        out = out & x
    return out


def evaluate(units: DataFrame, output: Column, preconditions: list[Column], controls: dict[str, Column], out: str = "output") -> DataFrame:
    """units with out, ``precondition`` and ``controls``: no output where a precondition doesn't hold, and none left where a control fails.

    Controls may read the column named out.
    """
    rows = units.withColumn("precondition", rollup(preconditions)).withColumn(out, F.when(F.col("precondition"), output))
    rows = rows.withColumn("controls", rollup(list(controls.values())))
    return rows.withColumn(out, F.when(F.coalesce(F.col("controls"), F.lit(True)), F.col(out)))


def totals(units: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, units, total, truncated): a total only if every unit has a value; truncated to a whole number, never rounded."""
    total = K.sum_rows(F.col(value))
    rows = units.groupBy(*keys).agg(F.count("*").alias("units"), total.alias("total"))
    return rows.withColumn("truncated", F.col("total").cast("long"))  # a cast to a whole type cuts off


def entry_filter(units: DataFrame, derivable: list[str]) -> DataFrame:
    """units without values for what must be derived, and ``ignored``: how many of those were given."""
    given = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in derivable), F.lit(0))
    return units.withColumn("ignored", given).drop(*derivable)


def trace(parts: dict[str, Column]) -> Column:
    """Named parts of a formula as one text, numbers without zeros at their end."""
    plain = lambda x: F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.concat_ws("; ", *[F.concat(F.lit(f"{k} = "), F.coalesce(plain(v), F.lit("?"))) for k, v in parts.items()])
