"""What hosts can do, and what they are told."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions.text import cut_bytes, neutralized
from vigilake.functions.verdicts import degraded, tier_name
from vigilake.functions.verdicts import DEFAULT
from vigilake.operators import firewall, gate
from vigilake.operators.policy import string_argument
from vigilake.sources.config import Config

#: Kinds of hosts and whether they can put a question to the user.
CAN_ASK = {"hook_json": True, "hook_exit_code": False, "plugin": False, "ide": True, "gateway": False}


def decision_json(rank: Column, reason: Column, can_ask: Column) -> Column:
    """The decision as compact JSON, degraded to what the host can do; allow has no reason."""
    shown = degraded(rank, can_ask)
    return F.to_json(F.struct(tier_name(shown).alias("decision"), F.when(shown > 0, reason).alias("reason")))


def exit_code(rank: Column, can_ask: Column) -> Column:
    """2 for a block, else 0."""
    return F.when(degraded(rank, can_ask) == 3, 2).otherwise(0)


#: Most bytes of a reason, what is added where a question became a refusal, codes of the protocol.
MOST_REASON, PENDING = 4096, " (blocked pending human approval)"
PARSE_ERROR, NO_METHOD, BAD_PARAMS, OVERLOADED = -32700, -32601, -32602, -32002
PROTOCOL = "2024-11-05"


def capped(reason: Column) -> Column:
    return cut_bytes(neutralized(reason), MOST_REASON, "…")


def emission(host: Column, rank: Column, reason: Column) -> Column:
    """(stdout, stderr, exit) of a verdict on a host that can't ask: "stderr" reads its exit code and error stream, "permission" and "allow_tool" a JSON body and exit 0 always."""
    refuses = rank >= 2
    noted = capped(F.when(rank == 2, F.concat(reason, F.lit(PENDING))).otherwise(reason))
    permission = F.to_json(F.struct(F.lit("deny").alias("permission"), noted.alias("user_message")))
    allow_tool = F.to_json(F.struct(F.lit(False).alias("allow_tool"), capped(reason).alias("deny_reason")))
    speaks = host == "stderr"
    return F.struct(
        F.when(refuses & (host == "permission"), permission).when(refuses & (host == "allow_tool"), allow_tool).alias("stdout"),
        F.when(speaks & (rank >= 1), capped(reason)).alias("stderr"),
        F.when(speaks & refuses, 2).otherwise(0).alias("exit"),
    )


def blocked_response(id_json: Column, reason: Column, prefix: str = "blocked: ") -> Column:
    """The answer to a call that isn't forwarded; the id is put in as the client wrote it."""
    content = F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), F.concat(F.lit(prefix), neutralized(reason)).alias("text"))).alias("content"), F.lit(True).alias("isError")))
    return _answer(id_json, "result", content)


def _answer(id_json: Column, key: str, body: Column) -> Column:
    return F.concat(F.lit('{"jsonrpc":"2.0","id":'), F.coalesce(id_json, F.lit("null")), F.lit(f',"{key}":'), body, F.lit("}"))


def error_response(id_json: Column, code: int, message: Column) -> Column:
    return _answer(id_json, "error", F.to_json(F.struct(F.lit(code).alias("code"), message.alias("message"))))


def served(requests: DataFrame, line: str, name: str = "guard", version: str = "1", config: Config | None = None) -> DataFrame:
    """Adds response to protocol requests: initialize, tools/list, and calls of check_command and scan_prompt; blank lines and requests without id (notifications) have none."""
    keep = requests.columns
    v = F.try_parse_json(line)
    out = requests.withColumn("_v", v).withColumn("_id", F.to_json(F.try_variant_get("_v", "$.id", "variant"))).withColumn("_method", F.coalesce(F.try_variant_get("_v", "$.method", "string"), F.lit("")))
    called = F.when(F.col("_method") == "tools/call", F.try_variant_get("_v", "$.params.name", "string"))
    out = out.withColumn("_tool", called).withColumn("_command", F.when(called == "check_command", string_argument(F.col(line), "params.arguments.command"))).withColumn("_prompt", F.when(called == "scan_prompt", string_argument(F.col(line), "params.arguments.prompt")))
    out = gate.evaluate(out, "_command", config=config).withColumn("_said", F.struct("tier", F.col("hit.rule_id").alias("rule"))).drop("hit", "tier", "tier_rank")
    out = firewall.verdicts(out, "_prompt", F.lit("user_prompt"), config.thresholds() if config else DEFAULT)
    said = F.when(F.col("_command").isNotNull(), F.col("_said")).when(F.col("_prompt").isNotNull(), F.struct("tier", F.col("hit.rule_id").alias("rule")))
    text = F.concat_ws(": ", said["tier"], said["rule"])
    result = F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content"), (said["tier"] == "block").alias("isError")))
    hello = f'{{"protocolVersion":"{PROTOCOL}","capabilities":{{"tools":{{}}}},"serverInfo":{{"name":"{name}","version":"{version}"}}}}'
    tools = ",".join(f'{{"name":"{t}","inputSchema":{{"type":"object","properties":{{"{a}":{{"type":"string"}}}},"required":["{a}"]}}}}' for t, a in (("check_command", "command"), ("scan_prompt", "prompt")))
    id_, method = F.col("_id"), F.col("_method")
    response = (
        F.when(F.trim(line) == "", None)
        .when(F.col("_v").isNull(), error_response(F.lit("null"), PARSE_ERROR, F.lit("parse error: invalid JSON")))
        .when(id_.isNull(), None)
        .when(method == "initialize", _answer(id_, "result", F.lit(hello)))
        .when(method == "tools/list", _answer(id_, "result", F.lit(f'{{"tools":[{tools}]}}')))
        .when((method == "tools/call") & said.isNotNull(), _answer(id_, "result", result))
        .when(method == "tools/call", error_response(id_, BAD_PARAMS, F.concat(F.lit("unknown tool or missing argument: "), F.coalesce("_tool", F.lit("")))))
        .otherwise(error_response(id_, NO_METHOD, F.concat(F.lit("method not found: "), method)))
    )
    return out.select(*keep, response.alias("response"))
