"""Pins of upstreams as a table of versions: each change is a whole snapshot under a new name, then named as the current one.

A snapshot says how many rows it has, so a torn one isn't taken for whole; a record in `current` that
names it is the switch. A writer that finds another's record of the same number to have won merges
again on top; one that ended before the other's record came can't know, so writers should take turns. Any format but the present one fails closed, older ones are passed over.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.operators import pins

PIN = "upstream string, tools_hash string, tools map<string,string>, first_seen long, last_verified long"
_CURRENT = "number long, name string, rows long, version long"


class Unavailable(ValueError):
    """A store that can't be trusted: broken, or of a format that isn't known."""


def _records(spark: SparkSession, path: str) -> list:
    """The records of all switches, the present one last: a row for each time that pins were written."""
    try:
        rows = spark.read.schema(_CURRENT).json(f"{path}/current").orderBy("number", F.desc("name")).collect()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    if any(v is None for r in rows for v in r):
        raise Unavailable(f"{path} has a record that can't be read")
    return rows


def load(spark: SparkSession, path: str) -> tuple[DataFrame, int, bool]:
    """The pins, the number of their snapshot (0: none yet), and whether an older format was passed over."""
    empty = spark.createDataFrame([], PIN)
    if not (records := _records(spark, path)):
        return empty, 0, False
    last = records[-1]
    if last.version in pins.OLDER:
        return empty, last.number, True
    if last.version != pins.STORE:
        raise Unavailable(f"{path} has pins of version {last.version}, not {pins.STORE}")
    try:
        held = spark.read.schema(PIN).parquet(f"{path}/{last.name}")
        n = held.agg(F.count("upstream")).first()[0]
    except (PySparkException, Py4JJavaError) as e:
        raise Unavailable(f"{path}/{last.name} can't be read") from e
    if n != last.rows:
        raise Unavailable(f"{path}/{last.name} has {n} rows, not {last.rows}")
    return held, last.number, False


def verify(spark: SparkSession, path: str, seen: DataFrame, now: int, expected: DataFrame | None = None, tries: int = 5) -> DataFrame:
    """upstream, verdict and changes of what is seen (upstream, tools_hash, tools); new pins and new times are written.

    A store that can't be trusted gives the verdict unavailable and is left as it is.
    """
    nothing = "array<struct<name:string,change:string>>"
    for _ in range(tries):
        try:
            known, number, _ = load(spark, path)
        except Unavailable:
            return seen.select("upstream").distinct().select("upstream", F.lit("unavailable").alias("verdict"), F.lit(None).cast(nothing).alias("changes"))
        judged = pins.verify_or_record(known, seen, now, expected)
        # Written once: what is told and what is kept come from the same rows.
        work = f"{path}/work-{uuid.uuid4().hex}"
        judged.write.parquet(work)
        judged = spark.read.schema(judged.schema).parquet(work)
        told = judged.where("verdict is not null").select("upstream", "verdict", "changes")
        if judged.where("verdict in ('recorded', 'matched')").isEmpty():
            return told
        name = f"pins-{number + 1:09d}-{uuid.uuid4().hex}"
        judged.where("pin is not null").select("upstream", "pin.*").write.parquet(f"{path}/{name}")
        rows = spark.read.schema(PIN).parquet(f"{path}/{name}").count()
        spark.createDataFrame([(number + 1, name, rows, pins.STORE)], _CURRENT).coalesce(1).write.mode("append").json(f"{path}/current")
        if [r.name for r in _records(spark, path) if r.number == number + 1][-1] == name:
            return told
    raise Unavailable(f"{path} was changed by others {tries} times")
