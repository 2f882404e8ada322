"""Order statistics and detection quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def nearest_rank(df: DataFrame, by: str, value: str, quantiles: tuple[float, ...], slices: int = 256) -> DataFrame:
    """by, p and the value at rank round(p * (n - 1)) of each group; nulls don't count.

    A group is cut into slices by approximate quantiles; only the slice in which a rank falls is sorted, so that a large group is no single task.
    """
    df = df.select(by, value).where(F.col(value).isNotNull())
    cuts = df.groupBy(by).agg(F.count("*").alias("n"), F.percentile_approx(value, [i / slices for i in range(1, slices)], 4 * slices).alias("cuts"))
    # One row for each group, joined by its size.
    cut = df.join(cuts, by).withColumn("slice", F.size(F.filter("cuts", lambda c: c < F.col(value)))).drop("cuts")
    sizes = cut.groupBy(by, "n", "slice").agg(F.count("*").alias("k"))
    sizes = sizes.withColumn("before", F.sum("k").over(Window.partitionBy(by).orderBy("slice")) - F.col("k"))
    ranks = sizes.withColumn("p", F.explode(F.array(*map(F.lit, quantiles)))).withColumn("rank", F.floor(F.col("p") * (F.col("n") - 1) + 0.5))
    held = ranks.where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("k"))).select(by, "slice", "p", (F.col("rank") - F.col("before") + 1).alias("place"))
    own = cut.join(held.select(by, "slice").distinct(), [by, "slice"], "left_semi").withColumn("place", F.row_number().over(Window.partitionBy(by, "slice").orderBy(value)).cast("long"))
    return own.join(held, [by, "slice", "place"]).select(by, "p", value)


def confusion(flagged: Column, true: Column) -> list[Column]:
    """Aggregates tp, fp, fn, tn."""
    return [F.count_if(flagged & true).alias("tp"), F.count_if(flagged & ~true).alias("fp"), F.count_if(~flagged & true).alias("fn"), F.count_if(~flagged & ~true).alias("tn")]
