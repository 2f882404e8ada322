"""Queries of the operators on actions: paths, addresses, rules, budgets, audit, manifests, relay."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigilake.functions.verdicts import degraded, tier_name
from vigilake.operators import audit, hosts, metrics, net, paths, pins, policy, relay
from vigilake.sources.tables import shared_dir, table, written

#: Paths with the expected reason, written by hand; {u} is a user id.
PATHS = [
    ("~/.ssh/known_hosts", False, "path under ~/.ssh"), ("/data/u{u}/notes.txt", False, None), ("/etc/passwd{u}", False, "system path under /etc"), ("/data/../etc/x{u}", True, "system path under /etc"),
    ("C:\\work\\.ENV", False, "dotenv file"), ("src/.env.{u}", True, "dotenv file"), ("src/env.{u}", False, None), ("keys/u{u}.pem", False, "key material (.pem/.key)"),
    ("a/./b/../id_rsa", False, "ssh private key"), ("a/id_rsa.pub", False, None), ("x/aws-credentials-{u}", True, "credentials file"), ("$HOME/.bashrc", True, "shell profile file"),
    ("$HOME/.bashrc", False, None), ("../../private/etc/h{u}", False, "system path under /etc"), ("etcetera/f{u}", False, None), (".sshd/x", True, None),
]
RULES = [policy.ToolRule("click", "command", "run 1*", 8, "ones"), policy.ToolRule("click", "command", "run", 5, "any"), policy.ToolRule("purchase", "args.path", "/data/*9", 6, "nines"), policy.ToolRule("view", "n", "*", 9, "numbers never match"), policy.ToolRule("view", "command", "*", 5, "all")]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("tool"), "value")


def path_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("t", F.pmod("event_id", F.lit(len(PATHS))).cast("int") + 1)
    raw = F.replace(F.element_at(F.array(*[F.lit(p) for p, *_ in PATHS]), F.col("t")), F.lit("{u}"), F.col("user_id").cast("string"))
    write = F.element_at(F.array(*[F.lit(w) for _, w, _ in PATHS]), F.col("t"))
    return e.select("event_id", paths.refused(raw, write, F.lit("/home/me")).alias("reason"))


def ssrf_v4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses found in documents, and others spread over all ranges."""
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    found = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(rf"\b(?:{octet}\.){{3}}{octet}\b"), F.lit(0))).alias("ip"))
    k = F.col("o_orderkey")
    made = table(spark, sf_dir, "orders").select(F.concat_ws(".", F.pmod(k * 7, F.lit(256)), F.pmod(F.floor(k / 3), F.lit(256)), F.pmod(F.floor(k / 5), F.lit(4)), F.pmod(k, F.lit(256))).alias("ip"))
    ips = found.unionByName(made)
    return ips.groupBy(F.coalesce(net.v4_refused(F.col("ip")), F.lit("allowed")).alias("reason")).agg(F.count("*").alias("n"), F.count_distinct("ip").alias("ips"))


def tool_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    u = F.col("user_id").cast("string")
    payload = F.to_json(F.struct(F.concat(F.lit("run "), u).alias("command"), F.struct(F.concat(F.lit("/data/"), u).alias("path")).alias("args"), F.col("user_id").alias("n")))
    hit = policy.tool_rules(F.col("tool"), payload, RULES)
    return e.select("event_id", hit["severity"].alias("severity"), hit["reason"].alias("reason"))


def policy_default_deny(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    allowed = e.where("value > 0").groupBy("tool").agg(F.count("*").alias("n")).where("tool like '%i%'")
    return policy.default_deny(e, "tool", allowed).groupBy("tool").agg(F.count("*").alias("denied"))


def budget_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "role", policy.tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    out = policy.budgets(turns, "conv_id", ["turn"], "role", policy.Budget(max_tokens=120, max_invocations=3), {"user": policy.Budget(max_tokens=100)})
    return out.select("conv_id", "turn", "session_tokens", "session_calls", "exceeded")


def budget_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counters, from a stream over the events that ends when all is read."""
    from vigilake.streaming import budgets

    place = f"{shared_dir(spark)}/budget-stream-{uuid.uuid4().hex}"
    kind = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    counted = budgets.running(events.select("event_id", "ts", "user_id", policy.tokens(F.col("props")).alias("tokens")), "user_id")
    q = counted.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(budgets.SCHEMA).parquet(f"{place}/out")


def canary_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs that hold their session's token; every fifth session leaks it."""
    t = table(spark, sf_dir, "conversations")
    issued = t.select("conv_id").distinct().withColumn("token", F.substring(F.md5(F.col("conv_id").cast("string")), 1, 16))
    said = t.where("role = 'assistant'").withColumn("out", F.when(F.pmod("conv_id", F.lit(5)) == 0, F.concat("text", F.substring(F.md5(F.col("conv_id").cast("string")), 1, 16))).otherwise(F.col("text")))
    return said.join(issued, "conv_id").where(F.contains("out", "token")).select("conv_id", "turn", F.lit("warn").alias("tier"))


def audit_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("body", F.concat_ws("|", "event_id", "tool"))
    return audit.chained(e, "user_id", "event_id", "body").groupBy("user_id").agg(F.max("seq").alias("last_seq"), F.max_by("hash", "seq").alias("head_hash"))


def audit_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains with bodies changed (event_id % 97 = 1) and lines deleted (event_id % 101 = 2)."""
    e = _events(spark, sf_dir).withColumn("body", F.concat_ws("|", "event_id", "tool"))
    lines = audit.chained(e, "user_id", "event_id", "body").withColumn("event_id", F.substring_index("body", "|", 1).cast("long"))
    damaged = lines.where("event_id % 101 <> 2").withColumn("body", F.when(F.expr("event_id % 97 = 1"), F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    return audit.verified(damaged, "user_id").where("defect is not null").select("user_id", "event_id", "defect")


def audit_one_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one log, damaged as above, checked in slices of 1,000 lines."""
    e = _events(spark, sf_dir).select(F.lit("log").alias("log"), "event_id", F.concat_ws("|", "event_id", "tool").alias("body"))
    lines = written(spark, audit.chained(e, "log", "event_id", "body")).withColumn("event_id", F.substring_index("body", "|", 1).cast("long"))
    damaged = lines.where("event_id % 101 <> 2").withColumn("body", F.when(F.expr("event_id % 97 = 1"), F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    return audit.verified(damaged, "log", slice_lines=1000).where("defect is not null").select("event_id", "defect")


def audit_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in four batches to the sink of a stream, the second and the last written twice: every log's head behind them."""
    from vigilake.streaming import audit as sink

    place = f"{shared_dir(spark)}/audit-sink-{uuid.uuid4().hex}"
    e = _events(spark, sf_dir).select("user_id", "event_id", F.concat_ws("|", "event_id", "tool").alias("body"))
    most = e.agg(F.max("event_id")).first()[0] or 0
    write = sink.sink(place, "user_id", "event_id", "body")
    for batch in (0, 1, 1, 2, 3, 3):
        below, upto = (most * batch // 4 if batch else -1), most * (batch + 1) // 4
        write(e.where((F.col("event_id") > below) & (F.col("event_id") <= upto)), batch)
    held = sink.lines(spark, place, "user_id", "bigint")
    return held.groupBy("user_id").agg(F.count("*").alias("lines"), F.max("seq").alias("last_seq"), F.max_by("hash", "seq").alias("head_hash"))


def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    before = p.where("p_partkey % 7 <> 0").select("p_partkey", F.md5("p_name").alias("hash"))
    after = p.where("p_partkey % 11 <> 0").select("p_partkey", F.md5(F.when(F.expr("p_partkey % 13 = 0"), F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))).alias("hash"))
    return pins.drift(before, after, ["p_partkey"]).select("p_partkey", "change")


def id_match_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests; those of every third are answered, some again soon or late; some answers have no request."""
    e = _events(spark, sf_dir).select(F.col("event_id").alias("id"), "ts")
    asked = e.where("id % 10 <> 0")
    answers = e.where("id % 3 = 0").select("id", F.explode(F.expr("filter(array(1, if(id % 2 = 0, 30, null), if(id % 5 = 0, 90, null)), x -> x is not null)")).alias("after"), "ts")
    answers = answers.select("id", (F.unix_micros("ts") + F.col("after") * 1_000_000).alias("us"), F.col("after").cast("long").alias("seq")).select("id", F.timestamp_micros("us").alias("ts"), "seq")
    return relay.classified(asked, answers).groupBy("status").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def degrade_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's tier on each host, counted; a host that can't ask blocks."""
    e = _events(spark, sf_dir).select(F.pmod("event_id", F.lit(4)).cast("int").alias("rank"))
    each = e.select("rank", F.explode(F.create_map(*[F.lit(x) for h, c in hosts.CAN_ASK.items() for x in (h, c)])).alias("host", "can_ask"))
    return each.groupBy("host", tier_name(degraded(F.col("rank"), F.col("can_ask"))).alias("tier")).agg(F.count("*").alias("n"))


def latency_pctl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.nearest_rank(_events(spark, sf_dir).select("tool", "value"), "tool", "value", (0.5, 0.95, 0.99))


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each session: events, and the longest run of one tool."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    run = _events(spark, sf_dir).withColumn("new", (F.coalesce(F.lag("tool").over(w), F.lit("")) != F.col("tool")).cast("int")).withColumn("run", F.sum("new").over(w))
    return run.groupBy("user_id", "run").agg(F.count("*").alias("k")).groupBy("user_id").agg(F.sum("k").alias("events"), F.max("k").alias("longest_run"))


_V4 = " ".join(f"WHEN n >= {int(net.ipaddress.IPv4Address(f))} AND n < {int(net.ipaddress.IPv4Address(f)) + (1 << (32 - b))} THEN '{r}'" for f, b, r in net.V4)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_CHAIN = "(SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, event_id::VARCHAR || '|' || event_type AS body FROM events)"

ORACLES = {
    "path_guard": "SELECT event_id, [" + ", ".join("NULL" if r is None else f"'{r}'" for *_, r in PATHS) + f"][event_id % {len(PATHS)} + 1] AS reason FROM events",
    "ssrf_v4": rf"WITH i AS (SELECT unnest(regexp_extract_all(text, '\b(?:{_OCTET}\.){{3}}{_OCTET}\b')) AS ip FROM documents UNION ALL SELECT concat_ws('.', o_orderkey * 7 % 256, o_orderkey // 3 % 256, o_orderkey // 5 % 4, o_orderkey % 256) FROM orders), k AS (SELECT ip, split_part(ip, '.', 1)::BIGINT * 16777216 + split_part(ip, '.', 2)::BIGINT * 65536 + split_part(ip, '.', 3)::BIGINT * 256 + split_part(ip, '.', 4)::BIGINT AS n FROM i) SELECT CASE {_V4} ELSE 'allowed' END AS reason, count(*) AS n, count(DISTINCT ip) AS ips FROM k GROUP BY 1",
    "tool_rules": "SELECT event_id, CASE WHEN event_type = 'click' AND user_id::VARCHAR LIKE '1%' THEN 8 WHEN event_type = 'click' THEN 5 WHEN event_type = 'purchase' AND user_id::VARCHAR LIKE '%9%' THEN 6 WHEN event_type = 'view' THEN 5 END AS severity, CASE WHEN event_type = 'click' AND user_id::VARCHAR LIKE '1%' THEN 'ones' WHEN event_type = 'click' THEN 'any' WHEN event_type = 'purchase' AND user_id::VARCHAR LIKE '%9%' THEN 'nines' WHEN event_type = 'view' THEN 'all' END AS reason FROM events",
    "policy_default_deny": "SELECT event_type AS tool, count(*) AS denied FROM events e WHERE NOT EXISTS (SELECT 1 FROM events a WHERE a.value > 0 AND a.event_type LIKE '%i%' AND a.event_type = e.event_type) GROUP BY 1",
    "budget_running": "WITH t AS (SELECT conv_id, turn, greatest(1, ceil(length(coalesce(text, '')) / 4))::BIGINT AS k FROM conversations WHERE role = 'user'), w AS (SELECT conv_id, turn, sum(k) OVER w::BIGINT AS session_tokens, count(*) OVER w AS session_calls FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) SELECT *, CASE WHEN session_tokens > 120 THEN 'session tokens' WHEN session_calls > 3 THEN 'session calls' WHEN session_tokens > 100 THEN 'tool tokens' END AS exceeded FROM w".replace("sum(k) OVER w::BIGINT", "(sum(k) OVER w)::BIGINT"),
    "budget_stream": "SELECT event_id, (sum(greatest(1, ceil(length(props) / 4))) OVER w)::BIGINT AS session_tokens, count(*) OVER w AS session_calls FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)",
    "canary_echo": "SELECT conv_id, turn, 'warn' AS tier FROM conversations WHERE role = 'assistant' AND conv_id % 5 = 0",
    "audit_build": f"WITH RECURSIVE l AS {_CHAIN}, c AS (SELECT user_id, seq, sha256(repeat('0', 64) || body) AS h FROM l WHERE seq = 1 UNION ALL SELECT l.user_id, l.seq, sha256(c.h || l.body) FROM c JOIN l ON l.user_id = c.user_id AND l.seq = c.seq + 1) SELECT user_id, max(seq) AS last_seq, max_by(h, seq) AS head_hash FROM c GROUP BY user_id",
    "audit_verify": f"WITH l AS {_CHAIN}, k AS (SELECT *, lag(seq) OVER (PARTITION BY user_id ORDER BY seq) AS before FROM l WHERE event_id % 101 <> 2), d AS (SELECT user_id, event_id, CASE WHEN event_id % 97 = 1 THEN 'hash_mismatch' WHEN before IS NOT NULL AND seq <> before + 1 THEN 'sequence_gap' WHEN before IS NULL AND seq > 1 THEN 'broken_link' END AS defect FROM k) SELECT * FROM d WHERE defect IS NOT NULL",
    "audit_one_log": "WITH k AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS seq FROM events), d AS (SELECT event_id, CASE WHEN event_id % 97 = 1 THEN 'hash_mismatch' WHEN before IS NOT NULL AND seq <> before + 1 THEN 'sequence_gap' WHEN before IS NULL AND seq > 1 THEN 'broken_link' END AS defect FROM (SELECT *, lag(seq) OVER (ORDER BY seq) AS before FROM k WHERE event_id % 101 <> 2)) SELECT * FROM d WHERE defect IS NOT NULL",
    "audit_sink": f"WITH RECURSIVE l AS {_CHAIN}, c AS (SELECT user_id, seq, sha256(repeat('0', 64) || body) AS h FROM l WHERE seq = 1 UNION ALL SELECT l.user_id, l.seq, sha256(c.h || l.body) FROM c JOIN l ON l.user_id = c.user_id AND l.seq = c.seq + 1) SELECT user_id, count(*) AS lines, max(seq) AS last_seq, max_by(h, seq) AS head_hash FROM c GROUP BY user_id",
    "manifest_diff": "WITH a AS (SELECT p_partkey, md5(p_name) AS h FROM part WHERE p_partkey % 7 <> 0), b AS (SELECT p_partkey, md5(CASE WHEN p_partkey % 13 = 0 THEN p_name || '!' ELSE p_name END) AS h FROM part WHERE p_partkey % 11 <> 0) SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.p_partkey = b.p_partkey WHERE a.h IS DISTINCT FROM b.h",
    "id_match_ttl": "WITH r AS (SELECT event_id AS id, unnest([1, CASE WHEN event_id % 2 = 0 THEN 30 END, CASE WHEN event_id % 5 = 0 THEN 90 END]) AS a FROM events WHERE event_id % 3 = 0) SELECT CASE WHEN id % 10 = 0 THEN 'unknown' WHEN a = 1 THEN 'matched' WHEN a - 1 <= 60 THEN 'replayed' ELSE 'unknown' END AS status, count(*) AS n, sum(id)::BIGINT AS ids FROM r WHERE a IS NOT NULL GROUP BY 1",
    "degrade_matrix": "WITH h(host, can_ask) AS (VALUES " + ", ".join(f"('{h}', {str(c).lower()})" for h, c in hosts.CAN_ASK.items()) + ") SELECT host, CASE WHEN event_id % 4 = 2 AND NOT can_ask THEN 'block' ELSE ['allow', 'warn', 'ask', 'block'][event_id % 4 + 1] END AS tier, count(*) AS n FROM events, h GROUP BY ALL",
    "latency_pctl": "WITH r AS (SELECT event_type AS tool, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT tool, p::DOUBLE AS p, value FROM r, (VALUES (0.5), (0.95), (0.99)) q(p) WHERE k = floor(p::DOUBLE * (n - 1) + 0.5)",
    "event_sessions": "WITH a AS (SELECT user_id, ts, event_id, event_type, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS n FROM events), b AS (SELECT user_id, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM a), c AS (SELECT user_id, run, count(*) AS k FROM b GROUP BY ALL) SELECT user_id, sum(k)::BIGINT AS events, max(k) AS longest_run FROM c GROUP BY 1",
}

QUERIES = {f.__name__: f for f in (path_guard, ssrf_v4, tool_rules, policy_default_deny, budget_running, budget_stream, canary_echo, audit_build, audit_verify, audit_one_log, audit_sink, manifest_diff, id_match_ttl, degrade_matrix, latency_pctl, event_sessions)}
