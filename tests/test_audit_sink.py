"""Chains in slices, and the log as a sink that appends once."""

import hashlib
import json
import random
import shutil

import pytest
from pyspark.sql import functions as F

from vigilake.operators import audit
from vigilake.streaming import audit as sink


def test_slices_find_what_whole_logs_do(spark):
    """Damage on and around the borders of slices, in logs of several slices, one null."""
    rng = random.Random(2)
    rows = [(log, i, 10_000 + i, "gate", "block", rng.choice(["r", None]), None, None, f"run {i}", "p") for log, n in (("a", 90), ("b", 7), (None, 40)) for i in range(n)]
    fields = "log string, o int, timestamp long, event string, decision string, rule_id string, category string, surface string, command string, policy_fingerprint string"
    lines = audit.recorded(spark.createDataFrame(rows, fields), "log", "o").collect()
    out = []
    for r in sorted(lines, key=lambda r: (r.log or "", r.line)):
        v = r.value
        kind = rng.random()
        if kind < 0.06:
            continue
        if kind < 0.12:
            v = v[:30]
        elif kind < 0.18:
            v = v.replace('"gate"', '"hook"')
        elif kind < 0.22:
            v = '{"timestamp":1,"event":"e"}'
        elif kind < 0.26:
            v = v.replace('"seq":', '"sec":')
        out.append((r.log, r.line, v))
    df = spark.createDataFrame(out, "log string, line long, value string").repartition(4)

    def found(slice_lines):
        return sorted(map(tuple, audit.defects(df, "log", slice_lines).collect()), key=str)

    whole = found(10_000)
    assert found(1) == whole and found(10) == whole and found(33) == whole
    assert {d for *_, ds in whole for d in ds} == {"malformed", "missing_seq", "sequence_gap", "broken_link", "hash_mismatch"}


def test_digests_are_made_once_and_of_any_text(spark):
    """Escapes with letters, backslashes before what looks like one, and the character that stands for them meanwhile."""
    texts = ["".join(map(chr, range(33))), "\\u001F", "\\\\u001F", "\\\x1f", "\\\\\x1f\\", "\x7f0\x7f1\x7f\x1f", "\x7f\\\x0bu001F", "é\U0001f600\x0e", 'a"\\', None, ""]
    rows = [(log, i, 10 + i, "gate", "block", t, t, None, t, "p") for log, n in (("a", 11), ("b", 3), (None, 11)) for i, t in enumerate(texts[:n])]
    fields = "log string, o int, timestamp long, event string, decision string, rule_id string, category string, surface string, command string, policy_fingerprint string"
    lines = audit.recorded(spark.createDataFrame(rows, fields), "log", "o").cache()
    for r in lines.collect():
        record = json.loads(r.value)
        assert record.pop("hash") == hashlib.sha256(json.dumps(record, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    found = audit.defects(lines, "log")
    assert sorted((r.log or "", r.line, r.defects) for r in found.collect()) == sorted((log or "", i + 1, []) for log, i, *_ in rows)
    # What explodes the defects filters on them, which must not work the digests out a second time.
    plan = found.select("log", F.explode("defects"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 1


def test_small_logs_share_packs(spark):
    """Ten thousand logs of a row each don't take a pack each; rows stay those of their log."""
    rows = spark.range(10_000).select(F.col("id").alias("log"), F.lit(1).alias("o"), F.col("id").cast("string").alias("body"))
    lines = audit.chained(rows.coalesce(1), "log", "o", "body")
    got = lines.collect()
    assert sorted((r.log, r.line, r.body) for r in got) == [(i, 1, str(i)) for i in range(10_000)]
    shuffled = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "_bucket" in shuffled and audit.BUCKETS < 10_000


def test_links_are_verified_in_slices(spark):
    rows = spark.createDataFrame([(log, i, f"b{i}") for log, n in (("a", 50), ("b", 9), (None, 30)) for i in range(n)], "log string, o int, body string")
    lines = audit.chained(rows, "log", "o", "body")
    damaged = lines.where("not (seq in (10, 11, 20))").withColumn("body", F.when(F.col("seq") == 21, "x").otherwise(F.col("body"))).withColumn("prev", F.when(F.col("seq") == 31, "0").otherwise(F.col("prev"))).cache()
    want = None
    for n in (10_000, 1, 10, 7):
        got = sorted(((r.log, r.line, r.defect) for r in audit.verified(damaged, "log", slice_lines=n).collect()), key=str)
        want = want or got
        assert got == want
    assert [(n, d) for log, n, d in want if log == "a" and d] == [(12, "sequence_gap"), (21, "hash_mismatch"), (31, "hash_mismatch")]


def test_a_long_log_is_many_tasks(spark):
    """No task reads a log whole, and the carry is a row a slice."""
    lines = spark.range(200_000).select(F.lit("a").alias("log"), F.col("id").alias("line"), F.col("id").alias("seq"), F.sha2(F.col("id").cast("string"), 256).alias("hash"), F.lit("").alias("prev"), F.lit("").alias("body"))
    parts = audit.verified(lines, "log", slice_lines=1000).withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
    assert len(parts) == 4 and max(r["count"] for r in parts) < 100_000


@pytest.fixture
def rows(spark):
    def make(ids):
        return spark.createDataFrame([(f"u{i % 3}" if i % 4 else None, i, f"body {i}") for i in ids], "log string, o long, body string")

    return make


def checked(spark, path):
    held = sink.lines(spark, path, "log")
    assert audit.verified(held, "log").where("defect is not null").count() == 0
    last = sink.heads(spark, path, "log", "string", 1 << 40)
    assert {r.state for r in audit.against_sidecar(held, "log", last).collect()} == {"intact"}
    return sorted((r.log or "", r.seq, r.body) for r in held.collect())


def test_a_batch_written_twice_leaves_one_copy(spark, tmp_path, rows):
    path = str(tmp_path / "log")
    write = sink.sink(path, "log", "o", "body")
    write(rows(range(20)), 0)
    write(rows(range(20, 30)), 1)
    once = checked(spark, path)
    write(rows(range(20, 30)), 1)
    assert checked(spark, path) == once and len(once) == 30
    write(rows([]), 2)
    write(rows([30, 31]), 3)
    assert len(checked(spark, path)) == 32


def test_heals_after_a_killed_write(spark, tmp_path, rows):
    path = str(tmp_path / "log")
    write = sink.sink(path, "log", "o", "body")
    write(rows(range(20)), 0)
    # Killed between the lines and the heads: the batch is written again, from the heads before it.
    write(rows(range(20, 30)), 1)
    shutil.rmtree(f"{path}/heads/batch=1")
    write(rows(range(20, 30)), 1)
    assert len(checked(spark, path)) == 30
    # Heads lost or cut short: the next batch goes on from the lines.
    shutil.rmtree(f"{path}/heads")
    write(rows(range(30, 40)), 2)
    assert len(checked(spark, path)) == 40
    spark.read.json(f"{path}/heads/batch=2").limit(1).write.mode("overwrite").json(f"{path}/less")
    shutil.rmtree(f"{path}/heads/batch=2")
    shutil.move(f"{path}/less", f"{path}/heads/batch=2")
    write(rows(range(40, 50)), 3)
    assert len(checked(spark, path)) == 50


def test_a_stream_goes_on_after_a_restart(spark, tmp_path, rows):
    (tmp_path / "in").mkdir()
    lines = spark.readStream.schema("log string, o long, body string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for part in (range(10), range(10, 25), range(25, 27)):
        rows(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = lines.writeStream.foreachBatch(sink.sink(str(tmp_path / "log"), "log", "o", "body")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert len(checked(spark, str(tmp_path / "log"))) == 27


def test_a_log_sorts_packs_and_slices_apart(spark):
    """No task that holds a whole log sorts its rows; ties, nulls and logs of a few rows keep their chains."""
    rows = [(log, i // 2, f"b{i}") for log in ("a", "b", None) for i in range(3)] + [("long", i * 7919 % 20_011, f"b{i}") for i in range(20_000)]
    df = spark.createDataFrame(rows, "log string, o int, body string").repartition(5)
    lines = audit.chained(df, "log", "o", "body")
    got = lines.collect()
    assert len(got) == len(rows)
    for log in ("a", "b", None, "long"):
        own = [r for r in got if r.log == log]
        head, number = audit.GENESIS, {b: o for x, o, b in rows if x == log}
        assert [r.seq for r in own] == list(range(1, len(own) + 1))
        assert [number[r.body] for r in own] == sorted(number.values())
        for r in own:
            assert r.prev == head
            head = hashlib.sha256((head + r.body).encode()).hexdigest()
            assert r.hash == head
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "_pack" in plan
    assert audit.verified(lines, "log", slice_lines=500).where("defect is not null").count() == 0
