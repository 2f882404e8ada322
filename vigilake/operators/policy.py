"""Tool rules, declarative policies and budgets.

Rules are configuration: they are few, come from the driver and are expanded into conditions,
so that events are neither joined nor shuffled. Budgets are running sums by session; the session
without id is one more. A session that holds much of all rows is cut into slices of its first order
column, which are summed apart and moved by what the slices before hold, so that it is no single task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vigilake.functions.verdicts import DEFAULT, Thresholds, tier_rank


@dataclass(frozen=True)
class ToolRule:
    tool: str
    arg: str
    pattern: str
    severity: int
    reason: str = ""


@dataclass(frozen=True)
class Budget:
    max_tokens: int | None = None
    max_invocations: int | None = None


@dataclass(frozen=True)
class Policy:
    rules: tuple[ToolRule, ...] = ()
    deny_by_default: bool = False
    allowed: tuple[str, ...] = ()
    session: Budget = Budget()
    per_tool: tuple[tuple[str, Budget], ...] = ()
    fingerprint: str = ""


def unanchored_glob(value: Column, pattern: str) -> Column:
    """`*` stands for anything; without it, a substring. Matches anywhere, and the empty value if all is `*`."""
    if "*" not in pattern:
        return F.contains(value, F.lit(pattern))
    parts = [re.escape(p) for p in pattern.split("*") if p]
    return value.rlike("(?s)" + ".*".join(parts)) if parts else value.isNotNull()


def policy_glob(value: Column, pattern: str) -> Column:
    """As above, but an empty pattern never matches and all-`*` needs a value that isn't empty."""
    if not pattern:
        return F.lit(False)
    return unanchored_glob(value, pattern) if pattern.strip("*") else value != ""


def anchored_glob(value: Column, pattern: str) -> Column:
    """For allow lists: ends without `*` are anchored, parts are sought leftmost first; without `*`, a substring."""
    if "*" not in pattern:
        return F.contains(value, F.lit(pattern))
    parts = [re.escape(p) for p in pattern.split("*") if p]
    if not parts:
        return value.isNotNull()
    # Atomic groups keep each part where it is found first.
    sought = [p if i == 0 and not pattern.startswith("*") else f"(?>.*?{p})" for i, p in enumerate(parts)]
    return value.rlike(r"(?s)\A" + "".join(sought) + ("" if pattern.endswith("*") else r"\z"))


def string_argument(payload: Column, path: str) -> Column:
    """The value at a dotted path if it is a JSON string, else null."""
    v = F.try_parse_json(payload)
    at = F.try_variant_get(v, "$." + path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(v, "$." + path, "string"))


def tool_rules(tool: Column, payload: Column, rules: list[ToolRule], missing_matches: bool = False) -> Column:
    """The worst matching rule, the first on ties, as (severity, order, reason); null without one.

    missing_matches: an argument that isn't there counts as empty, as policies have it; else such a rule is skipped.
    """
    found = []
    for i, r in enumerate(rules):
        value = string_argument(payload, r.arg)
        hit = policy_glob(F.coalesce(value, F.lit("")), r.pattern) if missing_matches else unanchored_glob(value, r.pattern)
        found.append(F.when((tool == r.tool) & hit, F.struct(F.lit(r.severity).alias("severity"), F.lit(-i).alias("order"), F.lit(r.reason).alias("reason"))))
    return F.array_max(F.array(*found))


def default_deny(df: DataFrame, tool: str, allowed: DataFrame) -> DataFrame:
    """Events whose tool no allow entry names; allowed: one row for each tool with a non-empty allow list."""
    return df.join(allowed.select(F.col("tool").alias(tool)).distinct(), tool, "left_anti")


def tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.char_length(text) / 4)).cast("long")


#: Rows from which a session is cut (at most HOT_MOST sessions are, those above this share of all rows), and into how many slices.
HOT, HOT_MOST, SLICES = 1_000_000, 10_000, 256
_WHOLE = -2


def sliced(df: DataFrame, session: str, by: str, hot: int = HOT) -> DataFrame:
    """Adds the session as keys without nulls (_session, _none) and _slice, which ascends with the column by (null first): that of a hot session's row, else _WHOLE.

    Only whole numbers, dates and times cut; sessions in another order stay whole.
    """
    keyed = df.withColumn("_session", F.coalesce(F.col(session).cast("string"), F.lit(""))).withColumn("_none", F.col(session).isNull())
    kind = df.schema[by].dataType
    if not isinstance(kind, T.IntegralType | T.DateType | T.TimestampType | T.TimestampNTZType):
        return keyed.withColumn("_slice", F.lit(_WHOLE))
    at = (F.col(by) if isinstance(kind, T.IntegralType) else F.unix_micros(F.col(by).cast("timestamp"))).cast("double")
    counts = keyed.groupBy("_session", "_none").agg(F.count("*").alias("_n"), F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    most = counts.agg(F.sum("_n") / HOT_MOST).scalar()
    # At most HOT_MOST rows, since each holds more than one part in HOT_MOST of all.
    held = F.broadcast(counts.where((F.col("_n") > hot) & (F.col("_n") > most)))
    place = F.floor((at - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1) * SLICES).cast("int")
    out = keyed.join(held, ["_session", "_none"], "left")
    return out.withColumn("_slice", F.when(F.col("_n").isNull(), _WHOLE).otherwise(F.coalesce(place, F.lit(-1)))).drop("_n", "_lo", "_hi")


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Adds the running sums by keys, this row included; df is sliced."""
    within = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each slice of a hot session.
    totals = df.where(F.col("_slice") != _WHOLE).groupBy(*keys, "_slice").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = totals.select(*keys, "_slice", *[F.sum(n).over(earlier).alias(f"_{n}") for n in sums])
    out = df.withColumns({n: F.sum(c).over(within) for n, c in sums.items()}).join(before, [*keys, "_slice"], "left")
    return out.withColumns({n: F.coalesce(F.col(n) + F.col(f"_{n}"), n, f"_{n}") for n in sums}).drop(*[f"_{n}" for n in sums])


def budgets(charged: DataFrame, session: str, order: list[str], tool: str, session_cap: Budget, tool_caps: dict[str, Budget], calls: Column | None = None, hot: int = HOT) -> DataFrame:
    """Adds the running sums, this row included, and the first cap that is exceeded (null: none); charged has tokens. calls: 1 for a row that counts (all do by default); hot: rows from which a session is cut."""
    calls = F.lit(1) if calls is None else calls
    cut = sliced(charged.withColumn("_tool", F.coalesce(F.col(tool).cast("string"), F.lit(""))).withColumn("_named", F.col(tool).isNotNull()), session, order[0], hot)
    by_session = running(cut, ["_session", "_none"], order, {"session_tokens": F.col("tokens"), "session_calls": calls})
    by_tool = running(by_session, ["_session", "_none", "_tool", "_named"], order, {"tool_tokens": F.col("tokens"), "tool_calls": calls})
    out = by_tool.select(*charged.columns, "session_tokens", "session_calls", "tool_tokens", "tool_calls")
    checks: list[tuple[Column, str]] = []
    for scope, cap, who in [("session", session_cap, None), *[("tool", c, t) for t, c in tool_caps.items()]]:
        mine = F.lit(True) if who is None else F.col(tool) == who
        for kind, most in (("tokens", cap.max_tokens), ("calls", cap.max_invocations)):
            if most is not None:
                checks.append((mine & (F.col(f"{scope}_{kind}") > most), f"{scope} {kind}"))
    return out.withColumn("exceeded", F.coalesce(*[F.when(c, F.lit(n)) for c, n in checks]) if checks else F.lit(None).cast("string"))


def verdict_rank(severity: Column, denied: Column, exceeded: Column, cuts: Thresholds = DEFAULT) -> Column:
    """Rules first, then default-deny, then budgets, then allow."""
    return F.when(severity.isNotNull() & (tier_rank(severity, *cuts) > 0), tier_rank(severity, *cuts)).when(denied, 3).when(exceeded.isNotNull(), 2).otherwise(0)


def decided(df: DataFrame, policy: Policy, session: str, order: list[str], payload: str, chargeable: Column, cuts: Thresholds = DEFAULT) -> DataFrame:
    """Adds rank and reason; df has tool and tokens. Events that a rule or default-deny decides are not charged, others are before they are checked."""
    hit = tool_rules(F.col("tool"), F.col(payload), list(policy.rules), missing_matches=True) if policy.rules else F.lit(None).cast("struct<severity:int,order:int,reason:string>")
    out = df.withColumn("_hit", hit)
    by_rule = F.coalesce(tier_rank(F.col("_hit.severity"), *cuts) > 0, F.lit(False))
    denied = F.lit(policy.deny_by_default) & ~F.coalesce(F.col("tool").isin(*policy.allowed), F.lit(False))
    out = out.withColumn("_counts", (chargeable & ~by_rule & ~denied).cast("int")).withColumn("_tokens", F.col("tokens")).withColumn("tokens", F.col("tokens") * F.col("_counts"))
    out = budgets(out, session, order, "tool", policy.session, dict(policy.per_tool), F.col("_counts"))
    over = F.when(F.col("_counts") == 1, F.col("exceeded"))
    reason = F.when(by_rule, F.col("_hit.reason")).when(denied, "default deny").otherwise(over)
    return out.select(*[c for c in df.columns if c != "tokens"], F.col("_tokens").alias("tokens"), verdict_rank(F.col("_hit.severity"), denied, over, cuts).alias("rank"), reason.alias("reason"))
