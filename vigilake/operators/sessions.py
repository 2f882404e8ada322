"""What becomes of every line of a relay session: requests that wait, answers, replays, quarantine and generations in one state.

A session is serial by nature: whether a request is forwarded depends on how many still wait, and a
drifted manifest stops all calls behind it. The state of a session is small (MOST_PENDING requests,
MOST_RECENT answered ids), so a session of any length streams through a task in order; sessions are
dealt out by key. streaming/sessions.py keeps the same state between batches of a stream.
"""

from __future__ import annotations

from collections.abc import Iterator, MutableMapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from vigilake.operators.relay import AUDIT_ONLY, ENFORCE, FILTER_ONLY, MOST_PENDING, RECENT_S

#: Answered ids that are remembered, operations between two sweeps of them, and the notice that a manifest changed.
MOST_RECENT, SWEEP = 4096, 64
CHANGED = "notifications/tools/list_changed"

#: kind: request, response or notification; tools_hash: of a response to tools/list; refused: by the gate.
INPUT = ("session", "ts", "seq", "kind", "id", "method", "tools_hash", "refused")
SCHEMA = "session string, seq long, outcome string, generation long, waiting long"


@dataclass
class Session:
    """The state of a session. pending: by id, whether a manifest was asked for; recent: by id, when it was answered (microseconds)."""

    mode: str = ENFORCE
    most: int = MOST_PENDING
    pending: MutableMapping[str, bool] = field(default_factory=dict)
    recent: MutableMapping[str, int] = field(default_factory=dict)
    waiting: int = 0
    generation: int = 0
    operations: int = 0
    verified: str | None = None
    pin: str | None = None
    quarantined: bool = False

    def line(self, us: int, kind: str, id_: str | None, method: str | None, tools_hash: str | None, refused: bool) -> str:
        """The outcome of a line: forwarded, notification, quarantined, blocked or overloaded; matched, drifted, replayed or unknown; passed."""
        if kind == "request":
            return self._request(us, id_, method, refused)
        if kind == "response":
            return self._response(us, id_, tools_hash)
        if method == CHANGED:
            self.generation += 1
            self.verified = None
        return "passed"

    def _request(self, us: int, id_: str | None, method: str | None, refused: bool) -> str:
        if method == "tools/call" and self.mode == ENFORCE and (self.quarantined or refused):
            return "quarantined" if self.quarantined else "blocked"
        if id_ is None:
            return "notification"
        if self.waiting >= self.most:
            return "overloaded"
        if id_ not in self.pending:
            self.waiting += 1
        self.pending[id_] = method == "tools/list"
        self._sweep(us)
        return "forwarded"

    def _response(self, us: int, id_: str | None, tools_hash: str | None) -> str:
        if id_ is None:
            return "unknown"
        if id_ not in self.pending:
            answered = self.recent.get(id_)
            return "replayed" if answered is not None and us - answered <= RECENT_S * 1_000_000 else "unknown"
        manifest = self.pending.pop(id_)
        self.waiting -= 1
        self.recent[id_] = us
        self._sweep(us)
        if not manifest or tools_hash is None or tools_hash == self.verified:
            return "matched"
        # The first manifest is trusted; later ones must be the same, whatever generation they are of.
        self.pin = self.pin or tools_hash
        if tools_hash == self.pin:
            self.verified = tools_hash
            return "matched"
        self.quarantined |= self.mode == ENFORCE
        return "drifted"

    def _sweep(self, us: int) -> None:
        self.operations += 1
        if self.operations % SWEEP and len(self.recent) < MOST_RECENT:
            return
        for old in [i for i, at in self.recent.items() if us - at > RECENT_S * 1_000_000]:
            del self.recent[old]
        for old in sorted(self.recent, key=self.recent.__getitem__)[: max(0, len(self.recent) - MOST_RECENT + 1)]:
            del self.recent[old]


def outcomes(lines: DataFrame, mode: str = ENFORCE, most: int = MOST_PENDING) -> DataFrame:
    """session, seq, outcome, generation and waiting (requests then) of every line, in the order of ts and seq.

    A null session is one of its own; rows of equal ts and seq come in any order; a null kind passes.
    """
    if mode not in (ENFORCE, FILTER_ONLY, AUDIT_ONLY):
        raise ValueError(f"unknown mode {mode!r}")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come by session, and only one session's state is held.
        now, state = object(), Session(mode, most)
        for b in batches:
            out: list[tuple] = []
            for session, ts, seq, kind, id_, method, tools_hash, refused in zip(*(b[c].to_pylist() for c in ("session", "us", *INPUT[2:])), strict=True):
                if session != now:
                    now, state = session, Session(mode, most)
                outcome = state.line(ts, kind, id_, method, tools_hash, bool(refused))
                out.append((session, seq, outcome, state.generation, state.waiting))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["session", "seq", "outcome", "generation", "waiting"])

    rows = lines.selectExpr("cast(session as string) session", "unix_micros(cast(ts as timestamp)) us", "cast(seq as long) seq", "kind", "cast(id as string) id", "method", "tools_hash", "refused")
    return rows.repartition("session").sortWithinPartitions("session", "us", "seq").mapInArrow(each, SCHEMA)
