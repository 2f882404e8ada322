"""What an event is held against, and the one verdict that comes of it.

Each branch is a projection over the same rows (no union, no join): the gate sees the commands of
shells, the path guard the paths of file tools, the firewall what was read, fetched, asked or
printed. Rows that a branch doesn't concern give it null, which it passes by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions.text import cut_bytes, redacted, tokens_masked
from vigilake.functions.verdicts import DEFAULT, held, tier_name, tier_rank, worst
from vigilake.operators import firewall, gate, paths, policy
from vigilake.sources.config import Config
from vigilake.sources.events import POST, PRE, PROMPT

#: What can be switched off, and the tools of each branch.
COMPONENTS = ("gate", "firewall", "pathguard", "canary")
READS, WRITES, FETCHES = ("Read",), ("Write", "Edit"), {"WebFetch": "web_fetch", "WebSearch": "web_search"}


def _verdict(rank: Column, by: str, rule: Column) -> Column:
    return F.struct(F.coalesce(rank, F.lit(0)).alias("rank"), F.lit(by).alias("by"), rule.cast("string").alias("rule"))


def routed(df: DataFrame, off: tuple[str, ...] = ()) -> DataFrame:
    """Adds what each branch is to look at: _command, _path, _write, _text and _surface, null where it has no part.

    df: event, tool, command, path, content (what was read, fetched or printed) and prompt.
    """
    pre, post, prompt = (F.col("event") == e for e in (PRE, POST, PROMPT))
    tool = F.col("tool")
    surface = F.when(prompt, "user_prompt").when(post & (tool == "Bash"), "bash_stdout").when(pre & tool.isin(*READS), "read_file")
    for name, kind in FETCHES.items():
        surface = surface.when(pre & (tool == name), kind)
    return (
        df.withColumn("_command", F.when(pre & (tool == "Bash") & F.lit("gate" not in off), F.col("command")))
        .withColumn("_write", tool.isin(*WRITES))
        .withColumn("_path", F.when(pre & tool.isin(*READS, *WRITES) & F.lit("pathguard" not in off), F.col("path")))
        .withColumn("_surface", F.when(F.lit("firewall" not in off), surface))
        .withColumn("_text", F.when(F.col("_surface").isNotNull(), F.when(prompt, F.col("prompt")).otherwise(F.col("content"))))
    )


def decided(df: DataFrame, home: str, rules: list[policy.ToolRule] | None = None, arguments: str = "input", disabled: bool = False, off: tuple[str, ...] = (), canary: str | None = None, config: Config | None = None) -> DataFrame:
    """Adds rank, tier, by and rule of each event; ties keep the earlier of gate, paths, firewall, canary, tool rules.

    config gives cutoffs, allow list, own blocks, packs, tool rules and what is switched off, besides what is given here.

    A refused path settles a read before its content counts; the canary (a column with the
    session's token) is looked for only in output that the firewall lets through; disabled lets
    all through and plans nothing.
    """
    cuts = config.thresholds() if config else DEFAULT
    if config:
        disabled, off, rules = disabled or config.disable, (*off, *config.disabled), [*(rules or ()), *config.tool_rules]
    if disabled:
        return df.withColumn("rank", F.lit(0)).withColumn("tier", F.lit("allow")).withColumn("by", F.lit(None).cast("string")).withColumn("rule", F.lit(None).cast("string"))
    keep = df.columns
    out = gate.evaluate(routed(df, off), "_command", config=config).withColumn("_gate", F.struct(F.col("tier_rank").alias("rank"), F.col("hit.rule_id").alias("rule"))).drop("hit", "tier", "tier_rank")
    out = out.withColumn("_refused", paths.refused(F.col("_path"), F.col("_write"), F.lit(home)))
    out = out.withColumn("_text", F.when(F.col("_refused").isNull(), F.col("_text")))
    out = firewall.verdicts(out, "_text", F.col("_surface"), cuts)
    found = [
        _verdict(F.col("_gate.rank"), "gate", F.col("_gate.rule")),
        _verdict(F.when(F.col("_refused").isNotNull(), 3), "pathguard", F.col("_refused")),
        _verdict(F.col("tier_rank"), "firewall", F.col("hit.rule_id")),
    ]
    if canary and "canary" not in off:
        echo = (F.col("_surface") == "bash_stdout") & (F.col("tier_rank") == 0) & (F.col(canary) != "") & F.contains(F.col("_text"), F.col(canary))
        found.append(_verdict(F.when(echo, 1), "canary", F.when(echo, F.lit("canary-echo"))))
    if rules:
        hit = policy.tool_rules(F.col("tool"), F.col(arguments), rules)
        found.append(_verdict(F.when(F.col("event") == PRE, tier_rank(hit["severity"], *cuts)), "tool_rule", hit["reason"]))
    out = held(out, "_worst", worst(*found))
    rank = F.col("_worst.rank")
    return out.select(*keep, rank.alias("rank"), tier_name(rank).alias("tier"), F.when(rank > 0, F.col("_worst.by")).alias("by"), F.when(rank > 0, F.col("_worst.rule")).alias("rule"))


#: Fixed value: most bytes of a command in an audit record.
MOST_COMMAND = 512


def rule_label(reason: Column) -> Column:
    """(rule_id, category) that a reason names: `… (category [id])`, or `firewall rule id …`."""
    bracket = r"(?s)^.*\[([^\]\[]*)\]"
    category = F.nullif(F.trim(F.regexp_extract(reason, r"(?s)^.*\(([^(\[]*)\[[^\]\[]*\]", 1)), F.lit(""))
    plain = reason.startswith("firewall rule ")
    rule = F.when(reason.rlike(bracket), F.regexp_extract(reason, bracket, 1)).when(plain, F.nullif(F.regexp_extract(reason, r"^firewall rule (\S*)", 1), F.lit("")))
    return F.struct(rule.alias("rule_id"), F.when(reason.rlike(bracket), category).when(plain, "firewall").alias("category"))


def audit_rows(verdicts: DataFrame, with_commands: bool = True) -> DataFrame:
    """What is logged of decided events: event, surface, decision, rule and the command (or path, address, query), redacted and cut; allowed events and those of no route leave nothing."""
    tool, pre = F.col("tool"), F.col("event") == PRE
    surface = F.when(pre & tool.isin(*READS), "read_file").when(pre & tool.isin(*WRITES), "path_guard").when(F.col("event") == PROMPT, "user_prompt").when((F.col("event") == POST) & (tool == "Bash"), "bash_stdout")
    for name, kind in FETCHES.items():
        surface = surface.when(pre & (tool == name), kind)
    route = F.when(pre & (tool == "Bash"), "gate").when(surface.isNotNull(), "firewall")
    shown = F.when(pre & (tool == "Bash"), F.col("command")).when(pre & tool.isin(*READS, *WRITES), F.col("path")).when(pre & tool.isin(*FETCHES), F.col("target"))
    command = cut_bytes(tokens_masked(redacted(shown)), MOST_COMMAND) if with_commands else F.lit(None).cast("string")
    out = verdicts.where("rank > 0").withColumn("_route", route).where(F.col("_route").isNotNull())
    kept = [c for c in verdicts.columns if c not in ("event", "tool", "command", "path", "content", "prompt", "input", "target", "rank", "tier", "by", "rule")]
    return out.select(*kept, F.col("_route").alias("event"), surface.alias("surface"), F.col("tier").alias("decision"), F.col("rule").alias("rule_id"), command.alias("command"))
