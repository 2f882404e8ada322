"""The operators as functions of SQL: check_command, scan_prompt, normalized_text, redacted_text, and the table function command_legs.

    register(spark)
    spark.sql("SELECT check_command(command).tier FROM calls")
    spark.sql("SELECT c.id, l.leg FROM calls c, LATERAL command_legs(c.command) l")

The bodies are the columns that the operators build, written out as SQL, so that both give the same
verdicts; only reading commands and scanning for literals go through Python, in Arrow batches. A
configuration, if given, sets cutoffs, packs, the allow list and own blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from vigilake.functions import shell
from vigilake.functions.columns import let
from vigilake.functions.literals import rescanning, scanning
from vigilake.functions.text import normalized, redacted
from vigilake.functions.verdicts import tier_name, tier_rank
from vigilake.operators import firewall, gate
from vigilake.sources.config import Config
from vigilake.sources.packs import GlobRule

#: What a hit is, as SQL has it.
HIT = "STRUCT<severity: INT, order: INT, rule_id: STRING, category: STRING>"
VERDICT = "STRUCT<tier: STRING, rule_id: STRING, severity: INT, category: STRING>"
#: A literal, or an operator that is written like a function, whose name needs quotes.
_PART = re.compile(r"'(?:[^'\\]|\\.)*'|(?<![\w`])(and|or|not|in|[-+*/%<>=!&|^~]+)\(", re.S)


def sql_text(column: Column) -> str:
    """A column of columns, literals, functions and lambdas as an expression of SQL."""
    return _PART.sub(lambda m: f"`{m[1]}`(" if m[1] else m[0], column._jc.node().sql())


def _create(spark: SparkSession, name: str, parameters: str, returns: str, body: Column) -> None:
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {sql_text(body)}")


def _verdict(hit: Column, cuts: tuple[int, int]) -> Column:
    return F.struct(tier_name(tier_rank(hit["severity"], *cuts)).alias("tier"), hit["rule_id"].alias("rule_id"), hit["severity"].alias("severity"), hit["category"].alias("category"))


@F.udtf(returnType="position int, leg string, effective string, counts int")
class CommandLegs:
    """The legs that a command runs, in order; counts as shell has it."""

    def eval(self, command: str | None) -> Iterator[tuple]:
        for i, (leg, effective, counts) in enumerate(shell.every_leg(command) if command else ()):
            yield i, leg, effective, counts


def register(spark: SparkSession, config: Config | None = None, globs: tuple[GlobRule, ...] = ()) -> None:
    """Registers the functions in the session; a later call replaces them. A null command or text is let through."""
    rules = gate.rules_of(config, globs) if config else gate.Rules(globs=globs)
    off = bool(config and config.disable)
    spark.udf.register("vigilake_read", shell.read_each)
    guards = tuple(r.guards for r in firewall.RULES)
    spark.udf.register("vigilake_may", scanning(guards))
    spark.udf.register("vigilake_rescan", rescanning(guards))
    spark.udtf.register("command_legs", CommandLegs)
    command, text, may, hit = F.col("command"), F.col("text"), F.col("may"), F.col("hit")
    _create(spark, "vigilake_gate_hit", f"read {shell.READ.simpleString()}", HIT, rules.worst(F.col("read")))
    _create(spark, "vigilake_verdict", f"hit {HIT}", VERDICT, _verdict(hit, rules.cuts))
    read = F.call_function("vigilake_read", F.when(~rules.allowed(command) & F.lit(not off), command))
    _create(spark, "check_command", "command STRING", VERDICT, F.call_function("vigilake_verdict", F.call_function("vigilake_gate_hit", read)))
    _create(spark, "vigilake_text_hit", "text STRING, may ARRAY<INT>", HIT, F.array_max(firewall.hits(text, may)))
    _create(spark, "normalized_text", "text STRING", "STRING", normalized(text))
    _create(spark, "redacted_text", "text STRING", "STRING", redacted(text))

    # The second pass sees texts that normalisation changes, and counts where the first finds nothing. Its
    # text comes back from the scan, so that it is normalised once.
    changed = let(F.call_function("normalized_text", text), lambda x: F.when(x != text, x))
    _create(spark, "vigilake_changed", "text STRING", "STRING", changed)
    _create(spark, "vigilake_second", "again STRUCT<text: STRING, may: ARRAY<INT>>", HIT, F.call_function("vigilake_text_hit", F.col("again")["text"], F.col("again")["may"]))
    seen = F.when(F.lit(not off), text)
    first = F.call_function("vigilake_text_hit", seen, F.call_function("vigilake_may", seen))
    second = F.call_function("vigilake_second", F.call_function("vigilake_rescan", F.call_function("vigilake_changed", seen)))
    _create(spark, "scan_prompt", "text STRING", VERDICT, F.call_function("vigilake_verdict", F.coalesce(first, second)))
