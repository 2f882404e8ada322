"""Relay sessions as a stream: the state of operators/sessions.py, kept by key between batches.

Pending requests and answered ids are two maps, which a batch reads once (MOST_PENDING and MOST_RECENT
bound them) and writes back where they differ, as a call to the store costs more than many lines; counters, the pin and the quarantine are one value. An event-time
timer ends a session that was idle for IDLE_S by the watermark: what comes later begins anew. Rows of
a batch are taken in the order of ts and seq, so a stream whose batches follow that order gives what
the batch version gives; rows that are late but within the watermark are taken when they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import MapState, StatefulProcessor, StatefulProcessorHandle

from vigilake.operators.relay import ENFORCE, MOST_PENDING
from vigilake.operators.sessions import SCHEMA, Session

#: Seconds without a line after which a session has ended, and for which rows may be late.
IDLE_S, LATE_S = 86_400, 600
#: What transformWithState needs as its store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Kept(dict):
    """A map state with text keys and one value, as a dictionary: read whole at the beginning, as it is small, and written back where it differs."""

    def __init__(self, state: MapState, size: int) -> None:
        self.state = state
        self.held = {k[0]: v[0] for k, v in state.iterator()} if size else {}
        super().__init__(self.held)

    def save(self) -> None:
        for key, value in self.items():
            if self.held.get(key) != value:
                self.state.updateValue((key,), (value,))
        for key in self.held.keys() - self.keys():
            self.state.removeKey((key,))


class Sessions(StatefulProcessor):
    def __init__(self, mode: str, most: int, idle_s: int) -> None:
        self.mode, self.most, self.idle_ms = mode, most, idle_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "id string", "manifest boolean")
        self.recent = handle.getMapState("recent", "id string", "us long")
        self.rest = handle.getValueState("rest", "waiting long, recent long, generation long, operations long, verified string, pin string, quarantined boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        waiting, recent, generation, operations, verified, pin, quarantined = self.rest.get() or (0, 0, 0, 0, None, None, False)
        waits, answered = _Kept(self.pending, waiting), _Kept(self.recent, recent)
        state = Session(self.mode, self.most, waits, answered, waiting, generation, operations, verified, pin, quarantined)
        lines = pd.concat(list(rows)).sort_values(["us", "seq"], kind="stable")
        lines = lines.astype(object).where(lines.notna(), None)
        out = []
        for us, seq, kind, id_, method, tools_hash, refused in zip(*(lines[c] for c in ("us", "seq", "kind", "id", "method", "tools_hash", "refused")), strict=True):
            outcome = state.line(int(us), kind, id_, method, tools_hash, bool(refused))
            out.append((key[0], seq, outcome, state.generation, state.waiting))
        waits.save()
        answered.save()
        self.rest.update((state.waiting, len(answered), state.generation, state.operations, state.verified, state.pin, state.quarantined))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(max(int(lines["us"].max()) // 1000, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        yield pd.DataFrame(out, columns=["session", "seq", "outcome", "generation", "waiting"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.pending, self.recent, self.rest):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def outcomes(lines: DataFrame, mode: str = ENFORCE, most: int = MOST_PENDING, idle_s: int = IDLE_S, late_s: int = LATE_S) -> DataFrame:
    """As operators.sessions.outcomes, of a stream; ts is a timestamp."""
    lines.sparkSession.conf.set(*STORE)
    timed = lines.withWatermark("ts", f"{late_s} seconds")
    rows = timed.selectExpr("cast(session as string) session", "ts", "unix_micros(ts) us", "cast(seq as long) seq", "kind", "cast(id as string) id", "method", "tools_hash", "refused")
    return rows.groupBy("session").transformWithStateInPandas(Sessions(mode, most, idle_s), SCHEMA, "Append", "EventTime")
