"""Relay sessions: by hand, against a plain simulation, and as a stream."""

import random
from datetime import datetime, timedelta

from vigilake.operators import relay, sessions
from vigilake.streaming import sessions as stream

SCHEMA = "session string, ts timestamp, seq long, kind string, id string, method string, tools_hash string, refused boolean"
START = datetime(2024, 1, 1)


def made(n, seed, span=8):
    """Lines of three sessions, one of them null, with answers, replays, drift and notices."""
    rng = random.Random(seed)
    out, asked = [], {}
    for i in range(n):
        s = rng.choice(["a", "b", None])
        known = asked.setdefault(s, [])
        ts = START + timedelta(seconds=i * span)
        r = rng.random()
        if r < 0.5 or not known:
            method = rng.choice(["tools/call", "tools/call", "tools/list", "ping"])
            known.append(f"r{i}")
            out.append((s, ts, i, "request", f"r{i}" if rng.random() < 0.95 else None, method, None, rng.random() < 0.1))
        elif r < 0.92:
            out.append((s, ts, i, "response", rng.choice([*known[-6:], "never", None]), None, "h1" if rng.random() < 0.8 else "h2", False))
        else:
            out.append((s, ts, i, "notification", None, sessions.CHANGED if rng.random() < 0.7 else "other", None, False))
    return out


def plain(rows, mode, most):
    """The same by whole lists, without sweeps or counters."""
    out, by = [], {}
    for s, ts, seq, kind, id_, method, h, refused in sorted(rows, key=lambda r: (r[1], r[2])):
        c = by.setdefault(s, {"wait": {}, "done": {}, "gen": 0, "pin": None, "shut": False})
        if kind == "request":
            if method == "tools/call" and mode == "enforce" and c["shut"]:
                o = "quarantined"
            elif method == "tools/call" and mode == "enforce" and refused:
                o = "blocked"
            elif id_ is None:
                o = "notification"
            elif len(c["wait"]) >= most:
                o = "overloaded"
            else:
                c["wait"][id_] = method
                o = "forwarded"
        elif kind == "response":
            if id_ in c["wait"]:
                o = "matched"
                if c["wait"].pop(id_) == "tools/list":
                    c["pin"] = c["pin"] or h
                    if h != c["pin"]:
                        o = "drifted"
                        c["shut"] |= mode == "enforce"
                c["done"][id_] = ts
            else:
                o = "replayed" if id_ in c["done"] and ts - c["done"][id_] <= timedelta(seconds=60) else "unknown"
        else:
            c["gen"] += method == sessions.CHANGED
            o = "passed"
        out.append((s, seq, o, c["gen"], len(c["wait"])))
    return sorted(out, key=lambda r: r[1])


def collected(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[1])


def test_batch_equals_a_plain_simulation(spark):
    seen = set()
    for mode, most, seed in ((relay.ENFORCE, 40, 1), (relay.ENFORCE, 4, 6), (relay.AUDIT_ONLY, 1024, 2), (relay.FILTER_ONLY, 2, 3)):
        rows = made(500, seed)
        random.Random(9).shuffle(rows)
        got = collected(sessions.outcomes(spark.createDataFrame(rows, SCHEMA).repartition(5), mode, most))
        assert got == plain(rows, mode, most)
        seen |= {r[2] for r in got}
    assert seen == {"forwarded", "notification", "quarantined", "blocked", "overloaded", "matched", "drifted", "replayed", "unknown", "passed"}


def test_overload_and_sweeps():
    s = sessions.Session()
    assert [s.line(0, "request", str(i), "ping", None, False) for i in range(1030)] == ["forwarded"] * 1024 + ["overloaded"] * 6
    assert s.line(1, "response", "0", None, None, False) == "matched" and s.line(2, "request", "x", "ping", None, False) == "forwarded" and s.line(3, "request", "y", "ping", None, False) == "overloaded"
    # Answered ids are swept by time, and the oldest go when there are too many.
    s = sessions.Session()
    for i in range(9000):
        s.line(i, "request", str(i), "ping", None, False)
        assert s.line(i, "response", str(i), None, None, False) == "matched" and len(s.recent) <= sessions.MOST_RECENT
    assert s.line(9001, "response", "8999", None, None, False) == "replayed" and s.line(9001, "response", "1", None, None, False) == "unknown"
    s.line(200_000_000, "request", "z", "ping", None, False)
    for i in range(sessions.SWEEP):
        s.line(200_000_000, "request", f"z{i}", "ping", None, False)
    assert len(s.recent) == 0


def test_stream_in_many_batches_equals_batch(spark, tmp_path):
    rows = made(240, 5)
    for k in range(0, 240, 60):
        spark.createDataFrame(rows[k : k + 60], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    lines = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run():
        out = stream.outcomes(lines, most=4)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return collected(spark.read.schema(sessions.SCHEMA).parquet(str(tmp_path / "out")))

    assert run() == plain(rows, relay.ENFORCE, 4)
    # The state outlives a restart: a replay of what was answered before, and the quarantine.
    more = [("a", START + timedelta(seconds=240 * 8 + i), 1000 + i, *r, None, False) for i, r in enumerate([("request", "n1", "ping"), ("response", "n1", None), ("response", "n1", None), ("request", "n2", "tools/call")])]
    spark.createDataFrame(more, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == plain(rows + more, relay.ENFORCE, 4)


def test_an_idle_session_ends(spark, tmp_path):
    day = timedelta(days=3)
    first = [("a", START, 1, "request", "x", "ping", None, False), ("b", START + day, 2, "request", "y", "ping", None, False)]
    then = [("b", START + day, 3, "request", "z", "ping", None, False)]
    last = [("a", START + day, 4, "response", "x", None, None, False)]
    (tmp_path / "in").mkdir()
    lines = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    for rows in (first, then, last):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = stream.outcomes(lines).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r.seq: r.outcome for r in spark.read.schema(sessions.SCHEMA).parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "forwarded", 2: "forwarded", 3: "forwarded", 4: "unknown"}


def test_a_batch_reads_its_maps_once_and_writes_differences():
    class Counted:
        def __init__(self, held):
            self.held, self.calls = held, []

        def iterator(self):
            self.calls.append("read")
            return iter([((k,), (v,)) for k, v in self.held.items()])

        def updateValue(self, key, value):
            self.calls.append(("put", *key, *value))

        def removeKey(self, key):
            self.calls.append(("drop", *key))

    state = Counted({"a": True, "b": False, "c": True})
    kept = stream._Kept(state, 3)
    for i in range(1000):
        kept[f"n{i}"] = True
        assert kept.pop(f"n{i}") and "x" not in kept
    kept["b"] = True
    kept["d"] = False
    del kept["a"]
    kept.save()
    assert state.calls == ["read", ("put", "b", True), ("put", "d", False), ("drop", "a")]
    empty = Counted({})
    stream._Kept(empty, 0).save()
    assert empty.calls == []
