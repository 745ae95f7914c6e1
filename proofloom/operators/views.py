"""Views of a case by policy: which blocks a role may see, which of them a request asks for, and why a request is refused.

A policy is compiled into the plan: a block is one struct, present for the roles that may see it, and a block that nobody in the policy may see isn't in
the plan at all, so its columns aren't read. Blocks of a case are columns; blocks of its log are rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The blocks of a view, in order.
BLOCKS = ("identification", "state", "shortfalls", "documents", "evidence", "conflicts", "calculation", "verdict", "history", "platform", "activity", "audit", "aggregates")


@dataclass(frozen=True)
class Policy:
    """Role -> the blocks that it may see; capability -> the blocks that it shows, in order."""

    admitted: dict[str, tuple[str, ...]]
    shown: dict[str, tuple[str, ...]]

    def __post_init__(self) -> None:
        for name, blocks in (*self.admitted.items(), *self.shown.items()):
            if unknown := [b for b in blocks if b not in BLOCKS]:
                raise ValueError(f"{name}: no such blocks: {', '.join(unknown)}")

    def blocks(self, role: str, capability: str) -> tuple[str, ...]:
        """Those that a capability shows and a role may see, in the capability's order."""
        return tuple(b for b in self.shown[capability] if b in self.admitted[role])

    def roles(self, block: str, capability: str) -> list[str]:
        return sorted(r for r in self.admitted if block in self.blocks(r, capability))


def view(rows: DataFrame, keys: list[str], policy: Policy, capability: str, role: str | Column, content: dict[str, dict[str, Column]]) -> DataFrame:
    """keys and a struct for each block of a capability, for one role or for each row's role. content: block -> its columns.

    A block that no role in question may see has no column; a row whose role may not see a block has null there.
    """
    if isinstance(role, str):
        return rows.select(*keys, *[_struct(content, b) for b in policy.blocks(role, capability)])
    out = []
    for b in policy.shown[capability]:
        if roles := policy.roles(b, capability):
            out.append(F.when(role.isin(*roles), _struct(content, b)).alias(b))
    return rows.select(*keys, *out)


def _struct(content: dict[str, dict[str, Column]], block: str) -> Column:
    if block not in content:
        raise ValueError(f"{block} is shown and has no content")
    return F.struct(*[v.alias(k) for k, v in content[block].items()]).alias(block)


def log_view(events: DataFrame, keys: list[str], policy: Policy, capability: str, role: str, block: str, payload: str) -> DataFrame:
    """A block of a case's log as rows: history with payloads, activity and audit without. Nothing for a role that may not see it."""
    rows = events if block == "history" else events.drop(payload)
    cols = [c for c in rows.columns if c not in keys]
    out = rows.select(*keys, *cols)
    return out if block in policy.blocks(role, capability) else out.where(F.lit(False))


@dataclass(frozen=True)
class Capability:
    name: str
    #: read or command.
    kind: str
    roles: tuple[str, ...]
    implemented: bool = True
    justified: bool = False


def prepared(requests: DataFrame, capabilities: list[Capability], kind: str, own_tenant: Column, everywhere: tuple[str, ...], parties: tuple[str, ...], is_party: Column) -> DataFrame:
    """requests (capability, role, as_kind, reason, number_text) with ``refused``: the first check that fails, in order, else null.

    A capability must be known and of the kind that is asked for, its role granted, the case within the role's reach (any tenant for ``everywhere``, its own otherwise; ``parties`` only
    see cases to which they are a party), it must be implemented, amounts must be whole or decimal text, and what asks for a reason must have one.
    """
    known = F.col("capability").isin(*[c.name for c in capabilities])
    of = lambda get: F.coalesce(F.try_element_at(F.create_map(*[x for c in capabilities for x in (F.lit(c.name), get(c))]), F.col("capability")), F.lit(False))
    granted = F.array_contains(F.coalesce(F.try_element_at(F.create_map(*[x for c in capabilities for x in (F.lit(c.name), F.array(*map(F.lit, c.roles)).cast("array<string>"))]), F.col("capability")), F.array().cast("array<string>")), F.col("role"))
    reach = F.col("role").isin(*everywhere) | F.coalesce(own_tenant, F.lit(False))
    party = ~F.col("role").isin(*parties) | F.coalesce(is_party, F.lit(False))
    checks = [
        ("unknown capability", known),
        (f"not a {kind}", of(lambda c: F.lit(c.kind == kind))),
        ("not granted", granted),
        ("other tenant", reach),
        ("not a party", party),
        ("not implemented", of(lambda c: F.lit(c.implemented))),
        ("binary fraction", ~F.coalesce(F.col("number_text").rlike(r"[eE]|^-?\d+\.\d{13,}$"), F.lit(False))),
        ("no reason", ~of(lambda c: F.lit(c.justified)) | (F.trim(F.coalesce("reason", F.lit(""))) != "")),
    ]
    out = F.lit(None).cast("string")
    for name, holds in reversed(checks):
        out = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return requests.withColumn("refused", out)
