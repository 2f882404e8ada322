"""Readers for the input tables, and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a dataset folder, read by Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in the one that the cluster names in spark.checkpoint.dir; what it holds may go when the application ends.

    Without the setting only a local master has a folder that all executors share.
    """
    context = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not d and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(d or f'file://{tempfile.gettempdir()}').rstrip('/')}/vigilake-{context.applicationId}"


def written(spark: SparkSession, df: DataFrame) -> DataFrame:
    """What is read more than once and costs much to make, written once to the shared folder."""
    place = f"{shared_dir(spark)}/written-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def spread(df: DataFrame, most: int | None = None) -> DataFrame:
    """For work that is long for each row: a table that comes in fewer partitions than there are cores is dealt out evenly; larger ones are left as they are read.

    most: rows of a partition, so that tasks don't grow with the table.
    """
    parts = df.sparkSession.sparkContext.defaultParallelism
    if most:
        parts = max(parts, -(-df.count() // most))
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df
