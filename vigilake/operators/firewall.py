"""Text scans against severity-scored rules.

One pass over each text, by an automaton of all rules' literals in Arrow batches, tells which rules may
match; only their patterns run, as conditions of one array in the JVM: no join, no shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions.columns import let
from vigilake.functions.firewall_rules import RULES, Rule
from vigilake.functions.literals import candidates
from vigilake.functions.text import normalized
from vigilake.functions.verdicts import DEFAULT, Thresholds, clamped, held, tier_name, tier_rank
from vigilake.operators import urls

#: Surfaces and whether they only warn.
SURFACES = {"read_file": False, "web_fetch": False, "web_search": False, "user_prompt": True, "bash_stdout": True}
_DIALECT = "(?dU)"


def may_match(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The rules that a text may match, by their literals; hits takes it."""
    return candidates(text, tuple(r.guards for r in rules))


def _described(rules: Sequence[Rule]) -> Column:
    """(severity, order, rule_id, category) of each rule, as one literal; order is higher for earlier rules."""
    rows = [{"severity": r.severity, "order": -r.idx, "rule_id": r.id, "category": r.category} for r in rules]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<severity:int,order:int,rule_id:string,category:string>>")


def hits(text: Column, may: Column, rules: Sequence[Rule] = RULES) -> Column:
    """An array of (severity, order, rule_id, category) of every rule that matches."""
    found = F.array_compact(F.array(*[F.when(F.array_contains(may, i) & text.rlike(_DIALECT + r.pattern), i) for i, r in enumerate(rules)]))
    return F.transform(found, lambda i: F.get(_described(rules), i))


def _leak(text: Column, output: Column | None) -> list[Column]:
    """Secrets in the URLs of what a tool printed; behind every rule on ties."""
    if output is None:
        return []
    severity = F.when(output, urls.worst(text))
    return [F.when(severity.isNotNull(), F.struct(severity.cast("int").alias("severity"), F.lit(-1000).alias("order"), F.lit("url-exfil").alias("rule_id"), F.lit("exfiltration").alias("category")))]


def scan(df: DataFrame, text: str, rules: list[Rule] | None = None, two_pass: bool = True, output: Column | None = None) -> DataFrame:
    """Adds hit (the worst, the first on ties; null without one), and whether it was found only after normalisation.

    The second pass sees only texts in which the first found nothing and which normalisation changes.
    output: rows whose text a tool printed; their URLs are looked at as well.
    """
    rules = RULES if rules is None else rules

    def worst(x: Column, may: Column) -> Column:
        found = hits(x, may, rules)
        return F.array_max(F.concat(found, F.array_compact(F.array(*leak)))) if (leak := _leak(x, output)) else F.array_max(found)

    out = held(df.withColumn("_may", may_match(F.col(text), rules)), "_first", worst(F.col(text), F.col("_may")))
    if not two_pass:
        return out.drop("_may", *({"hit"} & set(df.columns))).withColumnRenamed("_first", "hit").withColumn("normalized", F.lit(False))
    changed = F.when(F.col("_first").isNull(), normalized(F.col(text)))
    out = held(out, "_norm", let(changed, lambda x: F.when(x != F.col(text), x)))
    out = held(out.withColumn("_may", may_match(F.col("_norm"), rules)), "_second", worst(F.col("_norm"), F.col("_may")))
    out = out.withColumn("normalized", F.col("_second").isNotNull()).withColumn("hit", F.coalesce("_first", "_second"))
    return out.drop("_may", "_norm", "_first", "_second")


def verdicts(df: DataFrame, text: str, surface: Column | None = None, cuts: Thresholds = DEFAULT) -> DataFrame:
    """Adds tier_rank and tier, by those cutoffs, to what scan adds; a surface that only warns clamps them, and what a shell printed is held against URLs too."""
    out = scan(df, text, output=None if surface is None else F.coalesce(surface == "bash_stdout", F.lit(False)))
    rank = tier_rank(F.col("hit.severity"), *cuts)
    if surface is not None:
        rank = clamped(rank, F.coalesce(surface.isin([s for s, warn in SURFACES.items() if warn]), F.lit(False)))
    return out.withColumn("tier_rank", rank).withColumn("tier", tier_name(F.col("tier_rank")))


def fetched(rank: Column, status: Column) -> Column:
    """The rank of content that had to be fetched: a refused address blocks, any other failure warns; null and "ok" are no failures."""
    return F.when(status == "refused", 3).when(F.coalesce(status != "ok", F.lit(False)), 1).otherwise(rank)
