"""Reports as a stream that enters the log in order: what comes late waits for its turn, and every event says whether the state machine took it.

Reports of a case wait in its state until the watermark has passed them; then they are taken by instant, states before tasks, and arrival. A report
that is alike another one of its instant counts once. What comes later than the watermark allows is dropped by Spark. State is held by Spark in RocksDB, one
case's at a time: its waiting reports, its last number and state.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_WAITING = "at long, rank int, arrival long, kind string"
_OUT = "case_id long, seq long, at timestamp, kind string, arrival long, state string, accepted boolean"
_COLUMNS = [c.split()[0] for c in _OUT.split(", ")]


class Sequencer(StatefulProcessor):
    """moves: (state, kind) -> state; a report that has no move is refused and leaves the state as it is."""

    def __init__(self, moves: dict[tuple[str, str], str], start: str):
        self.moves, self.start = moves, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.head = handle.getValueState("head", "seq long, state string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows))
        held = {(at, kind): (at, rank, arrival, kind) for at, rank, arrival, kind in self.waiting.get()} if self.waiting.exists() else {}
        millis = (new["at"].astype("datetime64[us]").astype("int64")).tolist()
        for at, rank, arrival, kind in zip(millis, new["rank"].tolist(), new["arrival"].tolist(), new["kind"].tolist(), strict=True):
            if (at, kind) not in held or arrival < held[at, kind][2]:
                held[at, kind] = (at, rank, arrival, kind)
        self.waiting.put(list(held.values()))
        self._wake(min(x[0] for x in held.values()))
        yield pd.DataFrame({c: [] for c in _COLUMNS}).astype({"case_id": "int64", "seq": "int64", "arrival": "int64", "at": "datetime64[us, UTC]", "kind": "object", "state": "object", "accepted": "bool"})

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(micros // 1000 + 1)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready, rest = [x for x in held if x[0] <= passed], [x for x in held if x[0] > passed]
        seq, state = self.head.get() if self.head.exists() else (0, self.start)
        out = []
        for at, _, arrival, kind in ready:
            to = self.moves.get((state, kind))
            seq, state = seq + 1, to or state
            out.append((int(key[0]), seq, datetime.fromtimestamp(at / 1e6, UTC), kind, arrival, state, to is not None))
        if ready:
            self.head.update((seq, state))
        if rest:
            self.waiting.put(rest)
            self._wake(rest[0][0])
        else:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def in_order(reports: DataFrame, moves: dict[tuple[str, str], str], start: str, late: str) -> DataFrame:
    """(case_id, seq, at, kind, arrival, state, accepted) of a stream of reports (case_id, at, rank, arrival, kind), as ``late`` lets them be out of order.

    The session needs the state store PROVIDER (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = reports.select("case_id", "at", F.col("rank").cast("int").alias("rank"), "arrival", "kind").where("case_id is not null and at is not null").withWatermark("at", late)
    return rows.groupBy("case_id").transformWithStateInPandas(Sequencer(moves, start), _OUT, "append", "EventTime")
