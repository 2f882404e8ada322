"""An audit log as the sink of a stream: each batch is appended once, whatever is written twice or killed.

The lines of a batch lie in a folder of its number, which a second writing of the batch replaces. The
heads of all logs behind it (last_seq, head_hash) are written beside them, after the lines, with how
many they are. A batch goes on from the heads of the batch before it; where these are missing or
incomplete (a killed write, a lost folder), they are healed from the lines that are there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.operators import audit

LINE = "line long, seq long, prev string, hash string, body string"


def _folder(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame | None:
    """What the batches of a kind hold, with their number; None before the first."""
    try:
        return spark.read.schema(f"{schema}, batch long").json(f"{path}/{kind}")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def lines(spark: SparkSession, path: str, log: str, kind: str = "string") -> DataFrame:
    """Every line of the logs below path."""
    held = _folder(spark, path, "lines", f"{log} {kind}, {LINE}")
    return held if held is not None else spark.createDataFrame([], f"{log} {kind}, {LINE}, batch long")


def heads(spark: SparkSession, path: str, log: str, kind: str, before: int) -> DataFrame:
    """log, last_seq and head_hash behind all batches below a number: as written, or healed from the lines."""
    written = _folder(spark, path, "heads", f"{log} {kind}, last_seq long, head_hash string, logs long")
    last = lines(spark, path, log, kind).where(F.col("batch") < before).agg(F.max("batch")).first()[0]
    if written is not None and last is not None:
        # The last batch that has lines must have its heads, all of them.
        state = written.where(F.col("batch") == last).agg(F.count("*").alias("n"), F.max("logs").alias("logs")).first()
        if state.n and state.n == state.logs:
            return written.where(F.col("batch") == last).select(log, "last_seq", "head_hash")
    return audit.healed(lines(spark, path, log, kind).where(F.col("batch") < before), log)


def sink(path: str, log: str, order: str, body: str) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: records are chained by log, in their order, and appended once."""

    def append(records: DataFrame, batch: int) -> None:
        spark, kind = records.sparkSession, records.schema[log].dataType.simpleString()
        known = heads(spark, path, log, kind, batch)
        made = audit.chained(records, log, order, body, known)
        made.write.mode("overwrite").json(f"{path}/lines/batch={batch}")
        # Read back, so that lines are made once; logs that the batch doesn't touch keep their heads.
        new = audit.sidecars(spark.read.schema(f"{log} {kind}, {LINE}").json(f"{path}/lines/batch={batch}"), log)
        old = known.select(F.col(log).alias("_log"), F.col("last_seq").alias("_seq"), F.col("head_hash").alias("_head"))
        both = new.join(old, F.col(log).eqNullSafe(F.col("_log")), "full_outer")
        all_ = both.select(F.when(F.col("last_seq").isNull(), F.col("_log")).otherwise(F.col(log)).alias(log), F.coalesce("last_seq", "_seq").alias("last_seq"), F.coalesce("head_hash", "_head").alias("head_hash"))
        n = all_.count()
        all_.withColumn("logs", F.lit(n).cast("long")).write.mode("overwrite").json(f"{path}/heads/batch={batch}")

    return append
