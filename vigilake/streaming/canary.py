"""Canary tokens as a stream: the token that a session was given, kept as state, is looked for in what its tools print."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

#: What comes out for every printed text: whether it holds a token that its session had by then.
SCHEMA = "event_id long, session long, echoed boolean"


def echoes(events: DataFrame) -> DataFrame:
    """events: event_id, ts, session, token (null but where one is given) and printed (null where nothing is); later tokens replace earlier ones. A null session is one of its own."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        token = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")
        out = []
        for event_id, given, printed in zip(rows["event_id"], rows["token"], rows["printed"], strict=True):
            if isinstance(given, str) and given:
                token = given
            if isinstance(printed, str):
                out.append((event_id, token is not None and token in printed))
        if token is not None:
            state.update((token,))
        yield pd.DataFrame({"event_id": [e for e, _ in out], "session": pd.array([key[0]] * len(out), "Int64"), "echoed": [x for _, x in out]})

    return events.select("event_id", "ts", "session", "token", "printed").groupBy("session").applyInPandasWithState(step, SCHEMA, "token string", "append", GroupStateTimeout.NoTimeout)
