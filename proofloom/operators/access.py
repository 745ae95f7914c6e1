"""Who may see and do what: grants, roles, tenants, blocks of a case. Filters come before every aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matrix_faults(capabilities: DataFrame, events: DataFrame, grants: DataFrame, pending: DataFrame) -> DataFrame:
    """(fault, id): ids of capabilities that repeat, their events that no catalogue has, grants that are pending as well, and grants of nothing."""
    twice = capabilities.groupBy("capability").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated").alias("fault"), F.col("capability").alias("id"))
    unknown = capabilities.join(events, "event", "left_anti").select(F.lit("unknown event"), F.col("event")).distinct()
    both = grants.join(pending, ["profile", "capability"], "left_semi").select(F.lit("granted and pending"), F.concat_ws("/", "profile", "capability"))
    void = grants.join(capabilities, "capability", "left_anti").select(F.lit("grant of nothing"), F.concat_ws("/", "profile", "capability"))
    return twice.union(unknown).union(both).union(void)


def profiles_by_event(capabilities: DataFrame, grants: DataFrame) -> DataFrame:
    """(event, profile): who may cause what."""
    return capabilities.join(grants, "capability").select("event", "profile").distinct()


def conceded(rows: DataFrame, profile: str, capability: str, grants: DataFrame) -> DataFrame:
    """rows whose profile has the capability."""
    return rows.join(grants.select(F.col("profile").alias(profile), F.col("capability").alias(capability)), [profile, capability], "left_semi")


def role_of(candidates: Column, screen: Column, surface: Column) -> Column:
    """The role a principal acts in: the only candidate, else the screen's or the surface's if it is one; null: undecided."""
    fits = lambda x: F.when(F.array_contains(candidates, x), x)
    return F.when(F.size(candidates) == 1, F.get(candidates, F.lit(0))).otherwise(F.coalesce(fits(screen), fits(surface)))


def in_tenant(rows: DataFrame, tenant: str, own: Column, external: Column, is_party: Column) -> DataFrame:
    """rows of the principal's own tenant; outsiders see only the cases to which they are a party."""
    return rows.where((F.col(tenant) == own) & (~external | is_party))


def blocks(declared: Column, admitted: Column) -> Column:
    """The blocks of a view that may be seen, in the order in which they are declared."""
    return F.array_intersect(declared, admitted)


def view(rows: DataFrame, keys: list[str], blocks: dict[str, Column], admitted: Column) -> DataFrame:
    """keys and the blocks that may be seen; others are null and aren't computed for anybody who may not see them."""
    return rows.select(*keys, *[F.when(F.array_contains(admitted, name), value).alias(name) for name, value in blocks.items()])
