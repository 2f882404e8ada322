"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source whose target is e times its size and a rest is taken whole e times; the rest is filled
with the documents of the least keys -ln(u)/w, where u is a hash of the document and w its
quality, up to the prefix sum nearest to the rest (the lower on ties). Documents are taken whole.

The prefix sum needs no sorted source in one task: sizes are summed by source and slice of keys
(about the root of the row count many slices), a window over these few sums finds the slice in
which the budget ends, and only that slice's rows are sorted. The table of sources is ranked and
summed by ranges as well, so that there may be any number of them; it is broadcast only while it
has at most SOURCES_BROADCAST rows.

Null text has size 0 and is never taken in part; null sources are one source, the last. Rows of equal
id and text share a key; where the budget ends among them, as many as come nearest to it are taken. An
empty table gives none. Other columns may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigilake.llm.shared import saved

#: Weights of the sources by code point, null last, repeating; and the most that a source repeats.
WEIGHTS, MOST = (5, 2, 1), 3
SOURCES_BROADCAST = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def _quality(text: Column) -> Column:
    """From 0.1 to 1: the share of letters and white space, squared."""
    plain = F.char_length(F.regexp_replace(text, r"[^\p{L}\s]+", "")) / F.greatest(F.char_length(text), F.lit(1))
    return 0.1 + 0.9 * plain * plain


def _key(seed: int) -> Column:
    """The document's exponential variate over its quality."""
    text = F.coalesce("text", F.lit(""))
    h = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text)
    u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(u) / _quality(text)


def measured(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, source, size and key of every document."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), _key(seed).alias("key"))


def running(df: DataFrame, order: list[Column], **sums: str) -> DataFrame:
    """Adds sums of the columns over all rows before a row in this order: rows are dealt by ranges, each range is summed by itself and moved by the total of those below it."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = saved(df.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()), "mix-ranges")
    # One row a range.
    totals = dealt.groupBy("range").agg(*[F.sum(c).alias(name) for name, c in sums.items()]).orderBy("range").collect()
    below = {name: [sum((r[name] for r in totals if r["range"] < p), 0) for p in range(parts)] for name in sums}
    own = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    def whole(name: str, c: str) -> Column:
        return F.coalesce(F.sum(c).over(own), F.lit(0)) + F.element_at(F.array(*map(F.lit, below[name])), F.col("range") + 1)

    return dealt.select("*", *[whole(name, c).alias(name) for name, c in sums.items()]).drop("range")


def targets(sources: DataFrame) -> DataFrame:
    """source, source_size, n and target: shares of the whole by weight, none above MOST times its size, the excess reshared by weight.

    Sources are full in the order of size / weight: what is left for the others after the first full ones
    gives the words of a unit of weight, and the first source that this does not fill ends the full ones.
    """
    ranked = running(sources.withColumn("one", F.lit(1)), [F.col("source").asc_nulls_last()], before="one")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod("before", F.lit(len(WEIGHTS))) + 1).cast("int"))
    weighed = saved(ranked.select("source", "source_size", "n", weight.alias("weight"), (F.col("source_size") * MOST).alias("most"), (F.col("source_size") * MOST / weight).alias("ratio")), "mix-sources")
    all_ = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    full = running(weighed, [F.col("ratio"), F.col("source").asc_nulls_last()], most_before="most", weight_before="weight")
    unit = (F.lit(float(all_.size)) - F.col("most_before")) / (F.lit(all_.weight) - F.col("weight_before"))
    ends = full.withColumn("unit", unit).where("ratio >= unit").agg(F.min_by("unit", F.struct("ratio", "source")).alias("unit")).first()
    level = F.lit(float("inf") if ends.unit is None else ends.unit)
    return weighed.select("source", "source_size", "n", F.when(F.col("ratio") < level, F.col("most").cast("double")).otherwise(F.col("weight") * level).alias("target"))


def plan(rows: DataFrame) -> DataFrame:
    """Of each source: source_size, target, epochs, and the greatest key that the last, partial epoch takes."""
    by = saved(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))), "mix-targets")
    epochs = F.when(F.col("source_size") > 0, F.least(F.lit(MOST), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int")
    goals = by.withColumn("epochs", epochs).select("source", "source_size", "target", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"))
    counted = by.agg(F.count("*").alias("sources"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    few = counted.sources <= SOURCES_BROADCAST
    goals = F.broadcast(goals) if few else goals
    slices = min(1 << 16, max(1, math.isqrt(counted.rows)))
    cut = rows.withColumn("slice", F.floor(F.lit(slices) * F.col("key") / (F.col("key") + 1)).cast("int"))

    run = Window.partitionBy("source").orderBy("slice")
    sums = cut.groupBy("source", "slice").agg(F.sum("size").alias("words")).withColumn("before", F.sum("words").over(run) - F.col("words"))
    # The slice in which the budget ends: the last one that begins below it.
    goal_of = goals.select(F.col("source").alias("of"), "rest")
    ends = sums.join(goal_of, F.col("source").eqNullSafe(F.col("of"))).where("before < rest").groupBy("of").agg(F.max_by(F.struct("slice", "before", "rest"), "slice").alias("end"))
    ends = ends.select("of", F.col("end.slice").alias("at"), "end.before", "end.rest")
    ends = F.broadcast(ends) if few else ends
    last = cut.join(ends, F.col("source").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("at")))
    last = last.groupBy("source", "key").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    total = last.withColumn("total", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("key")))
    # The key at which the sums pass the rest, and of its rows (equal ones share a key) as many as come nearest to it.
    end = F.struct("key", "total", "size", "n", "rest")
    ends = total.groupBy("source").agg(F.coalesce(F.min(F.when(F.col("total") >= F.col("rest"), end)), F.max(end)).alias("end")).select("source", "end.*")
    near = F.ceil((F.col("rest") - F.col("total") + F.col("size")) * F.col("n") / F.col("size") - 0.5)
    some = F.when(F.col("size") > 0, F.least("n", F.greatest(F.lit(0), near))).otherwise(F.col("n"))
    cutoff = ends.select(F.col("source").alias("of"), F.col("key").alias("cutoff"), some.cast("long").alias("some"), F.col("n").alias("ties"))
    cutoff = F.broadcast(cutoff) if few else cutoff
    met = goals.join(cutoff, F.col("source").eqNullSafe(F.col("of")), "left")
    return met.select("source", "source_size", "target", "epochs", F.coalesce("cutoff", F.lit(-1.0)).alias("cutoff"), F.coalesce("some", F.lit(0)).alias("some"), F.coalesce("ties", F.lit(0)).alias("ties"))


def _ranked(tied: DataFrame) -> DataFrame:
    """Adds rank, from 1, to rows of each `of`, in any order: counted by written range, so that no group of equal rows is one task."""
    held = saved(tied.withColumn("at", F.monotonically_increasing_id()), "mix-ties").withColumn("range", F.shiftright("at", 33))
    earlier = Window.partitionBy("o").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    before = held.groupBy(F.col("of").alias("o"), F.col("range").alias("r")).count().withColumn("before", F.coalesce(F.sum("count").over(earlier), F.lit(0))).drop("count")
    met = held.join(before, F.col("of").eqNullSafe(F.col("o")) & (F.col("range") == F.col("r")))
    return met.withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("of", "range").orderBy("at"))).drop("at", "range", "o", "r", "before")


def _copies(rows: DataFrame, source: str, plans: DataFrame) -> DataFrame:
    """Adds source_size, target and copies (how often the mix takes the row) to rows of source and key."""
    part = (F.col("some") > 0) & (F.col("some") < F.col("ties"))
    state = plans.agg(F.count("*").alias("n"), F.coalesce(F.bool_or(part), F.lit(False)).alias("parts")).first()
    plans = (F.broadcast(plans) if state.n <= SOURCES_BROADCAST else plans).withColumnRenamed("source", "of")
    whole = rows.join(plans, F.col(source).eqNullSafe(F.col("of")))
    at_end = F.col("key") == F.col("cutoff")
    once = F.col("epochs") + ((F.col("key") < F.col("cutoff")) | at_end & (F.col("some") > 0)).cast("int")
    if not state.parts:
        out = whole.withColumn("copies", once)
    else:
        # Of rows of one key only some are taken; they are counted out.
        few = _ranked(whole.where(at_end & part)).withColumn("copies", F.col("epochs") + (F.col("rank") <= F.col("some")).cast("int")).drop("rank")
        out = whole.where(~(at_end & part)).withColumn("copies", once).unionByName(few)
    return out.drop("of", "epochs", "cutoff", "some", "ties")


def mix(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Adds source_size, target and copies (how often the mix takes the document) to measured rows."""
    return _copies(rows, "source", plans)


def mixture(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, source, size, key, source_size, target and copies of every document."""
    rows = saved(measured(docs, seed), "mix-rows")
    return mix(rows, saved(plan(rows), "mix-plan"))


def mixed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix itself: the documents, each as often as it is taken. Texts are not shuffled."""
    plans = saved(plan(saved(measured(docs, seed), "mix-rows")), "mix-plan")
    # The row is one column, so that none of its own can clash.
    keyed = docs.select(F.struct("*").alias("row"), F.col("source").alias("from"), _key(seed).alias("key"))
    taken = _copies(keyed, "from", plans)
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).select("row.*")
