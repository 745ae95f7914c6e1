"""The event log as a stream: repeated events dropped, chains and states carried on from batch to batch, a window's counts with late events.

Each case's state is a few values: the last seq and hash, and the state it is in. A batch's events of a case are taken in order; an event that comes
later than a batch after it has been taken joins the end of the chain, as an append-only log has it; ``ordered`` puts late ones in order first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events that come twice within the time that may pass between both, once."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "event_type", "event_id"])


_CARRIED = "user_id long, event_id long, seq long, own_hash string, state string, accepted boolean"


class Carrier(StatefulProcessor):
    """A case's chain and state machine, carried on from batch to batch: its last number, hash and state."""

    def __init__(self, moves: dict[tuple[str, str], str], start: str):
        self.moves, self.start = moves, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "seq long, hash string, state string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seq, head, at = self.head.get() if self.head.exists() else (0, "", self.start)
        new = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out = []
        for event_id, kind in zip(new["event_id"].tolist(), new["event_type"].tolist(), strict=True):
            seq += 1
            head = hashlib.sha256(f"{head}|{event_id}:{kind}".encode()).hexdigest()
            to = self.moves.get((at, kind))
            at = to or at
            out.append((int(key[0]), event_id, seq, head, at, to is not None))
        self.head.update((seq, head, at))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _CARRIED.split(", ")])

    def close(self) -> None:
        pass


def carried(events: DataFrame, moves: dict[tuple[str, str], str], start: str) -> DataFrame:
    """(user_id, event_id, seq, own_hash, state, accepted) for every event as it arrives: chain and state machine of each case.

    The session needs the state store ``ordered.PROVIDER``.
    """
    rows = events.select("user_id", "event_id", "ts", "event_type").where("user_id is not null")
    return rows.groupBy("user_id").transformWithStateInPandas(Carrier(moves, start), _CARRIED, "append", "None")


def counted(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n) by windows of time; a window closes once no event may be late for it any more."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n")
