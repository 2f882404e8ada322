"""Budgets of a stream: counters by session, kept as state.

Rows of one batch are ordered before they are counted; across batches the source must be in
order, as a log is. State is two numbers a session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "event_id long, session_tokens long, session_calls long"


def running(events: DataFrame, session: str) -> DataFrame:
    """event_id and the session's running tokens and calls, the event included; events has ts, event_id and tokens."""

    def update(key: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent, calls = state.get if state.exists else (0, 0)
        rows = pd.concat(list(groups)).sort_values(["ts", "event_id"])
        total = rows["tokens"].cumsum() + spent
        yield pd.DataFrame({"event_id": rows["event_id"], "session_tokens": total, "session_calls": range(calls + 1, calls + 1 + len(rows))})
        state.update((int(total.iloc[-1]), calls + len(rows)))

    return events.groupBy(session).applyInPandasWithState(update, SCHEMA, "spent long, calls long", "append", GroupStateTimeout.NoTimeout)
