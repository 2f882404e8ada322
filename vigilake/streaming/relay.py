"""Requests and responses of a relay as a stream: what waits and what was answered is kept by id.

State is two times an id. It goes when RECENT_S have passed since the answer, or PENDING_S since a
request that none came for, by the watermark; a later response is unknown either way, as in the
batch version, which this gives the same result as for input that isn't later than the watermark.
Ids are dealt to SLICES keys of the state, whose lines a batch works through at once: a call for each id
costs a thousand times what its lines do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vigilake.operators.relay import RECENT_S

#: Seconds for which a request waits, and for which rows may be late; keys that the ids are dealt to.
PENDING_S, LATE_S, SLICES = 86_400, 600, 8192
SCHEMA = "id long, seq long, status string"


def classified(lines: DataFrame, pending_s: int = PENDING_S, late_s: int = LATE_S, slices: int = SLICES) -> DataFrame:
    """id, seq and status (matched, replayed, unknown) of every response; lines has id, ts, seq and is_request."""

    def update(key: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # Of each id: when it was asked and answered (microseconds, -1: not yet), and until when it is kept (milliseconds).
        known = {i: (a, t, u) for i, a, t, u in zip(*state.get, strict=True)} if state.exists else {}
        met: dict[int, tuple[int, int, int]] = {}
        out = []
        if not state.hasTimedOut:
            # A request comes before what answers it at the same time.
            rows = pd.concat(list(groups)).sort_values(["ts", "is_request", "seq"], ascending=[True, False, True])
            for i, us, request, seq in zip(rows["id"].tolist(), rows["ts"].astype("datetime64[us]").astype("int64").tolist(), rows["is_request"].tolist(), rows["seq"].tolist(), strict=True):
                first, answered, _ = met.get(i) or known.get(i, (-1, -1, 0))
                if request:
                    first = us if first < 0 else first
                elif first < 0:
                    out.append((i, seq, "unknown"))
                elif answered < 0:
                    answered = us
                    out.append((i, seq, "matched"))
                else:
                    out.append((i, seq, "unknown" if us - answered > RECENT_S * 1_000_000 else "replayed"))
                met[i] = (first, answered, us)
        now = state.getCurrentWatermarkMs()
        # What this batch met stays for one more at least; the rest goes as its time comes.
        kept = {i: e for i, e in known.items() if i not in met and e[2] >= now}
        for i, (first, answered, us) in met.items():
            end = answered // 1000 + RECENT_S * 1000 if answered >= 0 else (first if first >= 0 else us) // 1000 + pending_s * 1000
            kept[i] = (first, answered, max(end, now + 1))
        if kept:
            state.update((list(kept), *map(list, zip(*kept.values(), strict=True))))
            state.setTimeoutTimestamp(max(min(u for _, _, u in kept.values()), now + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"id": [None if key[0] < 0 else i for i, _, _ in out], "seq": [s for _, s, _ in out], "status": [s for _, _, s in out]})

    # A null id is one of its own, alone in a slice.
    slice_ = F.when(F.col("id").isNull(), -1).otherwise(F.pmod(F.xxhash64("id"), F.lit(slices)))
    timed = lines.withWatermark("ts", f"{late_s} seconds").withColumns({"_slice": slice_, "id": F.coalesce("id", F.lit(0).cast("long"))})
    return timed.groupBy("_slice").applyInPandasWithState(update, SCHEMA, "ids array<long>, asked array<long>, taken array<long>, until array<long>", "append", GroupStateTimeout.EventTimeTimeout)
