"""Reports of cases: markdown and nested JSON, a row a case, made by the executors and written as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.functions import text as T


def markdown(title: Column, sections: dict[str, dict[str, Column]]) -> Column:
    """A report with a table of names and values for each section; what is missing is "no data", never zero."""
    out = [F.concat(F.lit("# "), title)]
    for name, values in sections.items():
        rows = [F.concat(F.lit(f"| {k} | "), F.coalesce(T.markdown_cell(v.cast("string")), F.lit("no data")), F.lit(" |")) for k, v in values.items()]
        out += [F.lit(f"\n## {name}\n"), F.lit("| name | value |\n|-|-|"), *rows]
    return F.concat_ws("\n", *out)


def as_json(fields: dict[str, Column]) -> Column:
    """A report as canonical JSON, decimals as text."""
    return T.canonical_json({k: v.cast("string") for k, v in fields.items()})


def write_reports(cases: DataFrame, key: str, report: Column, path: str) -> None:
    """(key, report) of every case, as lines of JSON."""
    cases.select(F.to_json(F.struct(F.col(key).alias("key"), report.alias("report"))).alias("value")).write.mode("overwrite").text(path)
