"""Relay sessions made of the events of a user: requests, answers of several kinds, notices; as a batch and as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigilake.operators import sessions
from vigilake.sources.tables import shared_dir, table
from vigilake.streaming import sessions as stream

#: Requests that may wait in these sessions, so that some are too many.
MOST = 3


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of eight events in turn: four requests, an answer to the last request, one to what came three lines before, a notice, and a manifest (of another hash now and then)."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))
    m, name = F.col("seq") % 8, F.concat(F.lit("r"), F.col("seq").cast("string"))
    w = Window.partitionBy("session").orderBy("ts", "seq")
    last, last_list = (F.last(F.when(c, name), ignorenulls=True).over(w) for c in (m < 4, m == 3))
    return e.select(
        "session",
        "ts",
        "seq",
        F.when(m < 4, "request").when(m == 6, "notification").otherwise("response").alias("kind"),
        F.when(m < 4, name).when(m == 4, last).when(m == 5, F.lag(name, 3).over(w)).when(m == 7, last_list).alias("id"),
        F.when(m == 1, "ping").when(m == 3, "tools/list").when(m < 4, "tools/call").when(m == 6, sessions.CHANGED).alias("method"),
        F.when((m == 4) | (m == 5) | (m == 7), F.when(F.col("seq") % 40 == 39, "h2").otherwise("h1")).alias("tools_hash"),
        (F.col("seq") % 16 == 2).alias("refused"),
    )


def relay_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.outcomes(_lines(spark, sf_dir), most=MOST)


def relay_sessions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines as a stream that ends when all is read."""
    place = f"{shared_dir(spark)}/relay-sessions-{uuid.uuid4().hex}"
    rows = _lines(spark, sf_dir)
    rows.write.parquet(f"{place}/in")
    out = stream.outcomes(spark.readStream.schema(rows.schema).parquet(f"{place}/in"), most=MOST)
    q = out.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(sessions.SCHEMA).parquet(f"{place}/out")


#: Line by line with the whole state in lists: what waits (id, whether a manifest), what was answered (id, when), generation, pin, whether shut.
_WALK = f"""
WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS session, epoch_us(ts::TIMESTAMP) AS us, event_id AS seq, event_id % 8 AS m, 'r' || event_id AS name FROM events),
l AS MATERIALIZED (SELECT session, us, seq, row_number() OVER w AS k, CASE WHEN m < 4 THEN 'request' WHEN m = 6 THEN 'notification' ELSE 'response' END AS kind,
    CASE WHEN m < 4 THEN name WHEN m = 4 THEN last_value(CASE WHEN m < 4 THEN name END IGNORE NULLS) OVER w WHEN m = 5 THEN lag(name, 3) OVER w WHEN m = 7 THEN last_value(CASE WHEN m = 3 THEN name END IGNORE NULLS) OVER w END AS id,
    CASE WHEN m = 1 THEN 'ping' WHEN m = 3 THEN 'tools/list' WHEN m < 4 THEN 'tools/call' END AS method, CASE WHEN seq % 40 = 39 THEN 'h2' ELSE 'h1' END AS h, seq % 16 = 2 AS refused
    FROM e WINDOW w AS (PARTITION BY session ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (SELECT session, 0::BIGINT AS k, 0::BIGINT AS seq, '' AS outcome, 0::BIGINT AS generation, []::STRUCT(id VARCHAR, manifest BOOLEAN)[] AS wait, []::STRUCT(id VARCHAR, us BIGINT)[] AS done, NULL::VARCHAR AS pin, false AS shut FROM (SELECT DISTINCT session FROM l)
    UNION ALL
    SELECT session, k, seq, o, generation + (kind = 'notification')::INT,
        CASE WHEN o = 'forwarded' THEN list_append(wait, {{'id': id, 'manifest': method = 'tools/list'}}) WHEN o IN ('matched', 'drifted') THEN list_filter(wait, lambda x: x.id <> id) ELSE wait END,
        CASE WHEN o IN ('matched', 'drifted') THEN list_append(done, {{'id': id, 'us': us}}) ELSE done END,
        CASE WHEN o = 'matched' AND manifest THEN coalesce(pin, h) ELSE pin END, shut OR o = 'drifted'
    FROM (SELECT *, CASE WHEN kind = 'notification' THEN 'passed'
            WHEN kind = 'request' THEN CASE WHEN method = 'tools/call' AND shut THEN 'quarantined' WHEN method = 'tools/call' AND refused THEN 'blocked' WHEN len(wait) >= {MOST} THEN 'overloaded' ELSE 'forwarded' END
            WHEN manifest IS NOT NULL THEN CASE WHEN manifest AND h <> coalesce(pin, h) THEN 'drifted' ELSE 'matched' END
            WHEN len(list_filter(done, lambda x: x.id = id AND us - x.us <= 60000000)) > 0 THEN 'replayed' ELSE 'unknown' END AS o
        FROM (SELECT l.*, s.generation, s.wait, s.done, s.pin, s.shut, list_filter(s.wait, lambda x: x.id = l.id)[1].manifest AS manifest FROM s JOIN l ON l.session = s.session AND l.k = s.k + 1)))
SELECT session, seq, outcome, generation, len(wait)::BIGINT AS waiting FROM s WHERE k > 0
"""
ORACLES = {"relay_sessions": _WALK, "relay_sessions_stream": _WALK}
QUERIES = {f.__name__: f for f in (relay_sessions, relay_sessions_stream)}
