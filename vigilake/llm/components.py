"""Connected components by alternating large and small stars, as joins and aggregates.

Each round hangs every node on the least it knows of; written tables cut the lineage, so that a
lost executor costs one round. Minima are combined before the shuffle, and they are written
before they are joined back, so that adaptive execution may split a hub's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm.shared import grown, saved


def _least(pairs: DataFrame) -> DataFrame:
    return saved(pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least")), "cc-least")


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: two long columns. node and component, the least node it reaches, of every node that has an edge to another."""
    a, b = edges.columns
    star = saved(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc-edges")
    state = _state(star)
    while state[0]:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(grown(_least(both)), F.col("u") == F.col("node")).where("v > u").select(F.col("v").alias("u"), F.least("least", "u").alias("v"))
        large = saved(large.distinct(), "cc-large")
        small = large.join(grown(_least(large)), F.col("u") == F.col("node"))
        small = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("least").alias("v")), F.struct(F.col("v").alias("u"), F.col("least").alias("v")))).alias("p")).select("p.*").where("u <> v")
        star = saved(small.distinct(), "cc-star")
        before, state = state, _state(star)
        if state == before:
            break
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
