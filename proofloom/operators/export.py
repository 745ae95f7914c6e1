"""Cases as documents for others: nested JSON, checks of it, mapping by paths, pairing, manifests and seals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.functions import text as T


class UnknownField(ValueError):
    """A mapping names a field that the document doesn't have."""


def nested(cases: DataFrame, units: DataFrame, key: str, case: dict[str, Column], unit: dict[str, Column], order: list[str]) -> DataFrame:
    """(key, document): canonical JSON of a case and its units in order; keys sorted, numbers as text. A case's units are one array."""
    body = F.struct(*[unit[k].cast("string").alias(k) for k in sorted(unit)])
    own = units.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, body.alias("__b")))), lambda x: x["__b"]).alias("__units"))
    fields = {k: v.cast("string") for k, v in case.items()} | {"units": F.col("__units")}
    return cases.join(own, key, "left").select(key, T.canonical_json(fields).alias("document"))


def violations(checks: dict[str, Column]) -> Column:
    """The names of the constraints that a row breaks, sorted, as one text; an open one isn't broken."""
    return F.array_join(F.array_compact(F.array(*[F.when(~checks[k], k) for k in sorted(checks)])), ",")


def load_mapping(mapping: dict[str, str], known: set[str]) -> dict[str, str]:
    """The mapping (target -> source field); a source that isn't known is an error when it is loaded, not when it is applied."""
    if unknown := sorted({v.split(".")[0] for v in mapping.values()} - known):
        raise UnknownField(", ".join(unknown))
    return dict(mapping)


def paired(units: DataFrame, results: DataFrame, identity: str) -> DataFrame:
    """units with their results by identity, never by position; side says which of both is missing."""
    side = F.when(F.col("__r").isNull(), "no result").when(F.col("__u").isNull(), "no unit").otherwise("both")
    return units.withColumn("__u", F.lit(1)).join(results.withColumn("__r", F.lit(1)), identity, "full").withColumn("side", side).drop("__u", "__r")


def verify_manifest(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """(path, status): ok, altered, missing or extra, of manifest (path, sha, parent) against found (path, sha).

    A part (with a parent) isn't found itself: it has its parent's status.
    """
    files = manifest.where("parent is null").select("path", F.col("sha").alias("want"))
    seen = found.select("path", F.col("sha").alias("got"))
    status = F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("want") != F.col("got"), "altered").otherwise("ok")
    own = files.join(seen, "path", "full").select("path", status.alias("status"))
    parts = manifest.where("parent is not null").select("path", "parent").join(own.select(F.col("path").alias("parent"), "status"), "parent", "left")
    return own.union(parts.select("path", F.coalesce("status", F.lit("missing"))))


def seal(fields: dict[str, Column]) -> Column:
    """The fingerprint of a document without its seal."""
    return F.sha2(T.canonical_json({k: v for k, v in fields.items() if k != "seal"}), 256)


def mapped(cases: DataFrame, keys: list[str], case: dict[str, tuple[Column, bool]], units: str, unit_key: str, unit: dict[str, tuple[str, bool]]) -> DataFrame:
    """(keys, payload, shortfalls): a case mapped field by field, its units too, and what a mapping must have and doesn't find, with its place.

    case: target -> (column, required); unit: target -> (field of an element of the array ``units``, required). A unit is named by its ``unit_key``, else by its place.
    """
    name = lambda u, i: F.coalesce(u[unit_key].cast("string"), i.cast("string"))
    own = F.array_compact(F.array(*[F.when(v.isNull(), f"detail.case.{k}") for k, (v, must) in case.items() if must]))

    def lacking(u: Column, i: Column) -> Column:
        at = F.concat(F.lit("detail.units["), name(u, i), F.lit("]."))
        return F.array_compact(F.array(*[F.when(u[f].isNull(), F.concat(at, F.lit(k))) for k, (f, must) in unit.items() if must]).cast("array<string>"))

    fields = lambda u: F.struct(*[u[f].cast("string").alias(k) for k, (f, _) in unit.items()])
    rows = F.transform(units, lambda u, i: F.struct(name(u, i).alias("key"), fields(u).alias("fields")))
    detail = F.struct(F.struct(*[v.cast("string").alias(k) for k, (v, _) in case.items()]).alias("case"), rows.alias("units"))
    missing = F.concat(own.cast("array<string>"), F.coalesce(F.flatten(F.transform(units, lacking)), F.array().cast("array<string>")))
    return cases.select(*keys, F.to_json(F.struct(detail.alias("detail"))).alias("payload"), missing.alias("shortfalls"))


def attachments(manifest: DataFrame) -> DataFrame:
    """(path, kind, sha, bytes, origin, is_part): what travels with a case, from its manifest alone; nothing is read or hashed again."""
    return manifest.select("path", "kind", "sha", "bytes", F.col("parent").alias("origin"), F.col("parent").isNotNull().alias("is_part"))


def paths_of(source: str) -> list[str]:
    """The JSON paths that a dotted source may mean: keys with dots in them first, the longest first, then step by step."""
    parts = source.split(".")

    def ways(rest: list[str]) -> list[list[str]]:
        if not rest:
            return [[]]
        return [[".".join(rest[:n]), *way] for n in range(len(rest), 0, -1) for way in ways(rest[n:])]

    return ["$" + "".join(f"['{k}']" for k in way) for way in ways(parts)]


def selected(rows: DataFrame, document: str, fields: list[tuple[str, str, bool]]) -> DataFrame:
    """rows with ``payload``, a struct of each field's value as text, and ``shortfalls``, the targets of required fields without one, in order.

    fields: (target, dotted source, required). A document is parsed once; what isn't JSON has nothing.
    """
    v = F.try_parse_json(F.col(document))
    rows = rows.withColumn("__v", v)
    value = lambda source: F.coalesce(*[F.try_variant_get("__v", p, "string") for p in paths_of(source)])
    rows = rows.withColumn("payload", F.struct(*[value(source).alias(target) for target, source, _ in fields]))
    missing = F.array_compact(F.array(*[F.when(F.col(f"payload.{t}").isNull(), t) for t, _, must in fields if must]))
    return rows.withColumn("shortfalls", missing).drop("__v")
