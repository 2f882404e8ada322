"""The gate for shell commands: legs from the lexer, rules as conditions in the JVM, the worst hit."""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigilake.functions.literals import Guards, candidates, candidates_each
from vigilake.functions.shell import IF_BLOCKED, STILL_CODED, UNREAD, arguments_read, command_read, read_after, variables_of
from vigilake.functions.verdicts import DEFAULT, Thresholds, held, tier_name, tier_rank
from vigilake.operators.policy import anchored_glob, unanchored_glob
from vigilake.sources.config import Config
from vigilake.sources.packs import GlobRule


@dataclass(frozen=True)
class GateRule:
    id: str
    severity: int
    category: str
    patterns: tuple[str, ...]  # one of them must match
    pack: str | None = None


#: Ids, severities, categories and patterns of the rules on a leg, in tie order; those of packs are off unless asked for.
RULES = [
    GateRule("rm-rf", 9, "destructive", (r"(?i)\brm\b[^|;&\n]*\s-[a-z]*r[a-z]*f", r"(?i)\brm\b[^|;&\n]*\s-[a-z]*f[a-z]*r")),
    GateRule("find-delete", 8, "destructive", (r"(?i)\bfind\b.*-delete\b",)),
    GateRule("find-exec-rm", 8, "destructive", (r"(?i)\bfind\b.*-exec\s+rm\b",)),
    GateRule("dd-overwrite", 8, "destructive", (r"(?i)\bdd\b[^|;&\n]*\sif=",)),
    GateRule("mkfs", 9, "destructive", (r"(?i)\bmkfs(\.\w+)?\b",)),
    GateRule("chmod-777", 6, "permissions", (r"(?i)\bchmod\b[^|;&\n]*\s0?777\b", r"(?i)\bchmod\b[^|;&\n]*\s(ugo|a)\s*[+=]\s*rwx\b")),
    GateRule("chmod-recursive", 6, "permissions", (r"(?i)\bchmod\b[^|;&\n]*\s(-[a-z]*R|--recursive\b)",)),
    GateRule("chmod-recursive-777-root", 9, "permissions", (r"(?i)\bchmod\b[^|;&\n]*\s(-[a-z]*R[a-z]*\b|--recursive\b)[^|;&\n]*\s0?777\b[^|;&\n]*\s/(\s|\z)", r"(?i)\bchmod\b[^|;&\n]*\s0?777\b[^|;&\n]*\s(-[a-z]*R[a-z]*\b|--recursive\b)[^|;&\n]*\s/(\s|\z)")),
    GateRule("chown-recursive-root", 9, "permissions", (r"(?i)\bchown\b[^|;&\n]*\s-[a-z]*R[^|;&\n]*\s/(\s|\z)",)),
    GateRule("write-block-device", 9, "destructive", (r"(?i)(>|of=)\s*/dev/(sd[a-z]|nvme\d+n\d+|vd[a-z]|hd[a-z]|mmcblk\d+)",)),
    GateRule("mv-to-devnull", 7, "destructive", (r"(?i)\bmv\b[^|;&\n]*\s/dev/null\b",)),
    GateRule("fetch-run-inline", 8, "remote-exec", (r"(?i)\b(bash|sh|zsh|eval|python\d?|perl|ruby)\b.*\$\(\s*(curl|wget)\b",)),
    GateRule("aws-s3-rb-force", 9, "cloud", (r"(?i)\baws\b\s+s3\b\s+rb\b[^|;&\n]*\s--force\b",), "cloud"),
    GateRule("aws-delete", 8, "cloud", (r"(?i)\baws\b[^|;&\n]*\s(delete-\w+|terminate-instances)\b", r"(?i)\baws\b\s+s3\s+rm\b[^|;&\n]*\s--recursive\b"), "cloud"),
    GateRule("gcloud-delete", 8, "cloud", (r"(?i)\bgcloud\b[^|;&\n]*\sdelete\b",), "cloud"),
    GateRule("az-delete", 8, "cloud", (r"(?i)\baz\b[^|;&\n]*\sdelete\b",), "cloud"),
    GateRule("drop-table", 8, "db", (r"(?i)\bdrop\s+table\b",), "db"),
    GateRule("drop-database", 9, "db", (r"(?i)\bdrop\s+(database|schema)\b", r"(?i)\bdropdb\b", r"(?i)\bmysqladmin\b[^|;&\n]*\sdrop\s+\w"), "db"),
    GateRule("truncate", 8, "db", (r"(?i)\btruncate\s+(table\b|\w)",), "db"),
    GateRule("docker-system-prune", 8, "container", (r"(?i)\bdocker\b\s+(system|image|volume|network|container)\s+prune\b[^|;&\n]*\s-[a-z]*[af]",), "container"),
    GateRule("docker-rm-force", 8, "container", (r"(?i)\bdocker\b\s+(container\s+)?(rm|rmi)\b[^|;&\n]*\s(--force\b|-[a-z]*f)",), "container"),
    GateRule("kubectl-delete-all", 9, "container", (r"(?i)\bkubectl\b\s+delete\b[^|;&\n]*\s--all\b",), "container"),
]
#: What fetches, what runs code (and what only begins like it), and the substrings of a plain list, for comparison.
FETCHERS = ("curl", "wget")
RUNNERS = ("sh", "bash", "zsh", "dash", "ksh", "fish", "eval", "perl", "ruby", "node")
RUNNER_BEGINS = "python"
NAIVE = ("rm -rf", "rm -fr", "| bash", "| sh", "|bash", "|sh", "curl ", "wget ", "eval ", "dd if=", "chmod 777", "mkfs")
#: A function that pipes itself into itself, all white space gone: the same name four times.
BOMB = r"(?<![^(){}|&;])([^(){}|&;]+)\(\)\{\1\|\1&\};\1"


def piped(command: Column) -> Column:
    """Whether a stage that fetches is followed by one that runs code, by the first words between bars."""
    heads = F.transform(F.split(command, r"\|"), lambda s: F.regexp_extract(s, r"^\s*(\S*)", 1))
    first = F.array_position(F.transform(heads, lambda h: h.isin(*FETCHERS)), True)
    later = F.exists(heads, lambda h: h.isin(*RUNNERS) | h.startswith(RUNNER_BEGINS))
    behind = F.exists(F.slice(heads, (first + 1).cast("int"), F.size(heads)), lambda h: h.isin(*RUNNERS) | h.startswith(RUNNER_BEGINS))
    return F.when(F.contains(command, F.lit("|")) & command.rlike("curl|wget"), later & (first > 0) & behind).otherwise(False)


def bomb(command: Column) -> Column:
    return F.when(F.contains(command, F.lit("(){")), F.regexp_replace(command, r"\s+", "").rlike(BOMB)).otherwise(False)


def _hit(matched: Column, severity: int, order: int, rule: str, category: str) -> Column:
    return F.when(matched, F.struct(F.lit(severity).alias("severity"), F.lit(-order).alias("order"), F.lit(rule).alias("rule_id"), F.lit(category).alias("category")))


#: Globs from which on they are looked for by their literals.
FEW_GLOBS = 64


@dataclass(frozen=True)
class Rules:
    """What a command is held against: packs that are on, allowed globs, own blocks (glob, severity), rules of community packs, and cutoffs."""

    packs: tuple[str, ...] = ()
    allow: tuple[str, ...] = ()
    blocks: tuple[tuple[str, int], ...] = ()
    globs: tuple[GlobRule, ...] = ()
    cuts: Thresholds = DEFAULT

    def allowed(self, command: Column) -> Column:
        return reduce(Column.__or__, (anchored_glob(command, g) for g in self.allow), F.lit(False))

    def many(self) -> bool:
        """Whether globs are looked for by their literals, instead of each on its own."""
        return len(self.globs) > FEW_GLOBS

    def guards(self) -> tuple[Guards, ...]:
        """Of each glob, the literal that the fewest globs share, the longest of these; none for a glob without literals."""
        parts = [[p.lower() for p in g.pattern.split("*") if p] for g in self.globs]
        shared = Counter(p for ps in parts for p in set(ps))
        return tuple(((min(ps, key=lambda p: (shared[p], -len(p))),),) if ps else () for ps in parts)

    def worst(self, read: Column, may: Column | None = None) -> Column:
        """The worst hit in a command as it is read: pipes and bombs in its normalised text, all other rules by leg. may: of many globs, those that can match."""
        block_at, warn_at = self.cuts

        def indexed(leg: Column) -> list[Column]:
            # Patterns and what a hit tells, as one literal each; only the few that may match are run.
            rows = [{"pattern": "(?s)" + ".*".join(re.escape(p) for p in g.pattern.split("*") if p), "hit": {"severity": g.severity, "order": -(200 + i), "rule_id": g.id, "category": g.category}} for i, g in enumerate(self.globs)]
            table = F.from_json(F.lit(json.dumps(rows)), "array<struct<pattern:string,hit:struct<severity:int,order:int,rule_id:string,category:string>>>")
            return [F.array_max(F.transform(F.filter(may, lambda i: F.rlike(leg, F.get(table, i)["pattern"])), lambda i: F.get(table, i)["hit"]))]

        def per_leg(x: Column) -> Column:
            rules = [_hit(reduce(Column.__or__, (x["effective"].rlike("(?d)" + p) for p in r.patterns)), r.severity, i + 2, r.id, r.category) for i, r in enumerate(RULES) if r.pack is None or r.pack in self.packs]
            custom = [_hit(unanchored_glob(x["leg"], g), s, 100 + i, "custom", "custom") for i, (g, s) in enumerate(self.blocks)]
            shared = indexed(x["effective"]) if may is not None else [_hit(unanchored_glob(x["effective"], g.pattern), g.severity, 200 + i, g.id, g.category) for i, g in enumerate(self.globs)]
            worst = F.array_max(F.array(*rules, *custom, *shared, _hit(x["counts"] == STILL_CODED, warn_at, 1000, "base64-decode-cap", "obfuscation"), _hit(x["counts"] == UNREAD, warn_at, 1001, "expansion-cap", "obfuscation")))
            return F.when((x["counts"] != IF_BLOCKED) | (worst["severity"] >= block_at), worst)

        whole = [_hit(piped(read["text"]), 9, 0, "curl-wget-pipe-shell", "remote-exec"), _hit(bomb(read["text"]), 9, 1, "fork-bomb", "dos")]
        return F.array_max(F.concat(F.array(*whole), F.transform(read["legs"], per_leg)))


def legs_joined(read: Column) -> Column:
    return F.array_join(F.transform(read["legs"], lambda x: x["effective"]), "\n")


def rules_of(config: Config, globs: tuple[GlobRule, ...] = ()) -> Rules:
    return Rules(config.packs, config.allow_list, config.custom_blocks, globs, config.thresholds())


def evaluate(df: DataFrame, command: str, packs: tuple[str, ...] = (), allow: tuple[str, ...] = (), blocks: tuple[tuple[str, int], ...] = (), globs: tuple[GlobRule, ...] = (), config: Config | None = None) -> DataFrame:
    """Adds hit, tier_rank and tier; globs are rules of community packs; allow-listed commands are let through, custom blocks (glob, severity) see the raw legs.

    config takes the place of packs, allow and blocks and gives the cutoffs; a disabled one lets all through and plans nothing.
    """
    if config and config.disable:
        nothing = F.lit(None).cast("struct<severity:int,order:int,rule_id:string,category:string>")
        return df.withColumn("hit", nothing).withColumn("tier_rank", F.lit(0)).withColumn("tier", F.lit("allow"))
    rules = rules_of(config, globs) if config else Rules(packs, allow, blocks, globs)
    raw = F.coalesce(F.col(command), F.lit(""))
    # The legs are read once, however many rules look at them.
    out = df.withColumn("_read", command_read(F.when(~rules.allowed(raw), raw)))
    out = out.withColumn("_globs", candidates(legs_joined(F.col("_read")), rules.guards())) if rules.many() else out
    out = held(out, "hit", rules.worst(F.col("_read"), F.col("_globs") if rules.many() else None)).drop("_read", "_globs")
    return out.withColumn("tier_rank", tier_rank(F.col("hit.severity"), *rules.cuts)).withColumn("tier", tier_name(F.col("tier_rank")))


def evaluate_sessions(df: DataFrame, command: str, session: str, order: str, config: Config | None = None, globs: tuple[GlobRule, ...] = ()) -> DataFrame:
    """As evaluate, with the variables that earlier commands of the session set: of each that a command uses, the last value before it.

    Names go as rows to windows by session and name, and come back by command, so that no session is
    one task. A value that names another variable is put in as it is. A null session is one of its own.
    """
    rules = rules_of(config, globs) if config else Rules(globs=globs)
    if config and config.disable:
        return evaluate(df, command, config=config)
    # A row without variables is one row too; the row itself travels with its first variable only.
    named = df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_row", F.struct(*df.columns))
    each = named.select("_id", F.col(session).alias("_session"), F.col(order).alias("_order"), "_row", F.posexplode_outer(variables_of(F.coalesce(F.col(command), F.lit("")))).alias("_place", "_v"))
    each = each.withColumn("_row", F.when(F.coalesce("_place", F.lit(0)) == 0, F.col("_row"))).select("_id", "_session", "_order", "_row", "_v.*")
    before = Window.partitionBy("_session", "name").orderBy("_order", "_id").rowsBetween(Window.unboundedPreceding, -1)
    # Rows without a name need no window, and would all be one group of it.
    seen = each.where("name is not null").withColumn("_last", F.last("value", ignorenulls=True).over(before)).withColumn("_known", F.when(F.col("used") & F.col("_last").isNotNull(), F.struct("name", "_last")))
    seen = seen.select("_id", "_row", "_known").unionByName(each.where("name is null").select("_id", "_row", F.lit(None).cast(seen.schema["_known"].dataType).alias("_known")))
    back = seen.groupBy("_id").agg(F.first("_row", ignorenulls=True).alias("_row"), F.map_from_entries(F.collect_list("_known")).alias("_known"))
    raw = F.coalesce(F.col(f"_row.{command}"), F.lit(""))
    out = back.withColumn("_read", read_after(F.when(~rules.allowed(raw), raw), F.col("_known")))
    out = out.withColumn("_globs", candidates(legs_joined(F.col("_read")), rules.guards())) if rules.many() else out
    out = held(out, "hit", rules.worst(F.col("_read"), F.col("_globs") if rules.many() else None)).select("_row.*", "hit")
    return out.withColumn("tier_rank", tier_rank(F.col("hit.severity"), *rules.cuts)).withColumn("tier", tier_name(F.col("tier_rank")))


#: Arguments of tool calls that are commands, and those that are code; their names in any case.
COMMAND_ARGS, CODE_ARGS = ("command", "cmd", "script"), ("code",)


def call_arguments(arguments: Column) -> Column:
    """Of a call's JSON object, the top-level strings that are commands or code, by name: name, value and whether it is a command.

    A name that comes twice gives both, since either may be what a tool reads; what is no object has none.
    """
    top = F.map_entries(F.from_json(arguments, "map<string,variant>"))
    strings = F.filter(top, lambda e: F.lower(e["key"]).isin(*COMMAND_ARGS, *CODE_ARGS) & (F.schema_of_variant(e["value"]) == "STRING"))
    return F.array_sort(F.transform(strings, lambda e: F.struct(e["key"].alias("name"), F.variant_get(e["value"], "$", "string").alias("value"), F.lower(e["key"]).isin(*COMMAND_ARGS).alias("command"))))


def tool_call(df: DataFrame, arguments: str, config: Config | None = None, globs: tuple[GlobRule, ...] = (), denied: Column | None = None) -> DataFrame:
    """Adds rank (0 or 3: a transport can't ask), argument and rule_id of a tool call: the first argument, by name, that is refused.

    Each argument is judged alone: commands by the whole gate, if they block, code only by the two
    rules on whole texts. denied: the rank that rules and policies give the call, which come first; asking denies.
    """
    if config and config.disable:
        return df.withColumn("rank", F.lit(0)).withColumns({c: F.lit(None).cast("string") for c in ("argument", "rule_id")})
    rules = rules_of(config, globs) if config else Rules(globs=globs)
    out = df.withColumn("_args", call_arguments(F.col(arguments)))
    commands = F.transform("_args", lambda a: F.when(a["command"] & ~rules.allowed(a["value"]), a["value"]))
    out = out.withColumn("_read", arguments_read(F.when(F.size("_args") > 0, commands)))

    out = out.withColumn("_globs", candidates_each(F.transform("_read", legs_joined), rules.guards())) if rules.many() else out

    def refused(a: Column, i: Column) -> Column:
        hit = rules.worst(F.get("_read", i), F.get("_globs", i) if rules.many() else None)
        by_shape = F.when(piped(a["value"]), "curl-wget-pipe-shell").when(bomb(a["value"]), "fork-bomb")
        return F.struct(a["name"].alias("name"), F.when(a["command"], F.when(hit["severity"] >= rules.cuts[0], hit["rule_id"])).otherwise(by_shape).alias("rule_id"))

    out = held(out, "_first", F.get(F.filter(F.transform("_args", refused), lambda x: x["rule_id"].isNotNull()), F.lit(0))).drop("_args", "_read", "_globs")
    by_policy = F.lit(False) if denied is None else F.coalesce(denied >= 2, F.lit(False))
    rule = F.when(by_policy, "policy").otherwise(F.col("_first.rule_id"))
    return out.withColumn("argument", F.when(~by_policy, F.col("_first.name"))).withColumn("rule_id", rule).withColumn("rank", F.when(rule.isNotNull(), 3).otherwise(0)).drop("_first")


def naive(command: Column) -> Column:
    """Whether a plain list of substrings would flag a leg, cut at every separator."""
    legs = F.split(F.lower(command), r"[;|&\n]")
    return F.exists(legs, lambda x: reduce(Column.__or__, (F.contains(x, F.lit(s)) for s in NAIVE)))
