"""Requests and responses of a relay, matched by id."""

from __future__ import annotations

import json
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vigilake.functions.text import neutralized
from vigilake.operators.hosts import OVERLOADED, blocked_response, error_response

#: Fixed value: seconds in which a consumed id is known as replayed.
RECENT_S = 60
#: Modes of the relay, and requests that may wait for their answer.
ENFORCE, FILTER_ONLY, AUDIT_ONLY = "enforce", "filter-only", "audit-only"
MOST_PENDING = 1024


def classified(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Adds status to the responses (id, ts, seq): matched for the first after its request, replayed within RECENT_S of it, else unknown."""
    asked = requests.groupBy("id").agg(F.min("ts").alias("asked"))
    both = responses.join(asked, "id", "left").withColumn("valid", F.coalesce(F.col("ts") >= F.col("asked"), F.lit(False)))
    # Summed up before the shuffle and joined by one row an id, so that an id of many responses is no single task.
    first = both.where("valid").groupBy("id").agg(F.min(F.struct("ts", "seq")).alias("first"))
    out = both.join(first, "id", "left")
    late = F.unix_micros("ts") - F.unix_micros("first.ts") > RECENT_S * 1_000_000
    status = F.when(~F.col("valid"), "unknown").when(F.col("seq") == F.col("first.seq"), "matched").when(late, "unknown").otherwise("replayed")
    return out.withColumn("status", status).drop("asked", "valid", "first")


def raw_id(line: str) -> tuple[str, int, int]:
    """Whether a JSON object has one top-level id, with where its text starts and ends."""
    space = " \t\r\n"

    def skip(i: int) -> int:
        while i < len(line) and line[i] in space:
            i += 1
        return i

    read, found = json.JSONDecoder(), []
    i = skip(skip(0) + 1)
    while i < len(line) and line[i] == '"':
        key, i = scanstring(line, i + 1)
        start = skip(skip(i) + 1)
        _, i = read.raw_decode(line, start)
        if key == "id":
            found.append((start, i))
        i = skip(i)
        if line[i : i + 1] != ",":
            break
        i = skip(i + 1)
    return ("absent", 0, 0) if not found else ("ambiguous", 0, 0) if len(found) > 1 else ("found", *found[0])


SPAN = T.StructType([T.StructField("state", T.StringType()), T.StructField("raw", T.StringType()), T.StructField("start", T.IntegerType())])


@F.arrow_udf(SPAN)
def id_span(lines: pa.Array) -> pa.Array:
    """state (found, absent, ambiguous, or broken for no JSON object), the id's exact text and where it starts."""
    out = []
    for x in lines.to_pylist():
        try:
            ok = isinstance(json.loads(x or ""), dict)
            state, s, e = raw_id(x) if ok else ("broken", 0, 0)
        except (ValueError, RecursionError):
            state, s, e = "broken", 0, 0
        out.append({"state": state, "raw": x[s:e] if state == "found" else None, "start": s if state == "found" else None})
    return pa.array(out, pa.struct([("state", pa.string()), ("raw", pa.string()), ("start", pa.int32())]))


def spliced(line: Column, span: Column, new: Column) -> Column:
    """The line with another id in place, byte for byte the same elsewhere."""
    return F.concat(F.substring(line, F.lit(1), span["start"]), new, F.substring(line, span["start"] + F.char_length(span["raw"]) + 1, F.char_length(line)))


def outbound(lines: DataFrame, line: str, blocked: Column, why: Column, pending: Column, proxy_id: Column, mode: str = ENFORCE) -> DataFrame:
    """Adds outcome, upstream (what goes on) and answer (what the client gets at once) of every line of a client.

    blocked: whether its tool is refused; pending: requests that already wait; proxy_id: the id to
    go by, null where no secure one could be made. Only enforce holds refused calls back.
    """
    keep = lines.columns
    out = lines.withColumn("_span", id_span(F.col(line)))
    span, raw = F.col("_span"), F.col("_span.raw")
    v = F.try_parse_json(line)
    method = F.try_variant_get(v, "$.method", "string")
    responds = method.isNull() & (F.try_variant_get(v, "$.result", "variant").isNotNull() | F.try_variant_get(v, "$.error", "variant").isNotNull())
    held = F.lit(mode == ENFORCE) & (method == "tools/call") & blocked
    outcome = (
        F.when(span["state"].isin("broken", "ambiguous"), span["state"])
        .when(responds, "response")
        .when(F.coalesce(held, F.lit(False)), "blocked")
        .when(span["state"] == "absent", "notification")
        .when(pending >= MOST_PENDING, "overloaded")
        .when(proxy_id.isNull(), "denied")
        .otherwise("forwarded")
    )
    out = out.withColumn("outcome", outcome)
    result = F.col("outcome")
    upstream = F.when(result.isin("response", "notification"), F.col(line)).when(result == "forwarded", spliced(F.col(line), span, F.to_json(F.struct(proxy_id.alias("i"))).substr(F.lit(6), F.char_length(F.to_json(F.struct(proxy_id.alias("i")))) - 6)))
    answer = (
        F.when((result == "blocked") & raw.isNotNull(), blocked_response(raw, why))
        .when(result == "overloaded", error_response(raw, OVERLOADED, F.lit("too many requests in flight")))
        .when(result == "denied", blocked_response(raw, F.lit("internal error: secure randomness unavailable")))
    )
    return out.withColumn("upstream", upstream).withColumn("answer", answer).select(*keep, "outcome", "upstream", "answer")


def affected(changes: DataFrame, collisions: DataFrame, by: str) -> DataFrame:
    """by, and a map of tool to reason; changes: by, tool, why; collisions: by, tool, known. A collision's reason comes before a change's."""
    text = F.concat(F.lit("name collision with pinned tool "), F.col("known"))
    both = changes.select(by, "tool", F.lit(1).alias("o"), "why").unionByName(collisions.select(by, "tool", F.lit(0).alias("o"), text.alias("why")))
    each = both.groupBy(by, "tool").agg(F.min(F.struct("o", "why"))["why"].alias("why"))
    return each.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "why")))).alias("affected"))


@F.arrow_udf(T.StringType())
def _stripped(lines: pa.Array, names: pa.Array) -> pa.Array:
    out = []
    for x, gone in zip(lines.to_pylist(), names.to_pylist(), strict=True):
        result = json.loads(x).get("result") if x is not None else None
        if isinstance(result, dict):
            if isinstance(result.get("tools"), list):
                result["tools"] = [t for t in result["tools"] if not (isinstance(t, dict) and t.get("name") in (gone or ()))]
            result["quarantined_tools"] = sorted(gone or ())
        out.append(json.dumps(result, separators=(",", ":"), sort_keys=True, ensure_ascii=False))
    return pa.array(out, pa.string())


def manifest_response(line: Column, host_id: Column, affected: Column, reason: Column, mode: str = ENFORCE) -> Column:
    """What the client gets for a tools/list answer with drift: without the affected tools and with their names; whole and unchanged in audit-only; nothing but a reason where no tool is to blame.

    line is valid JSON; host_id is the client's own text of the id.
    """
    closed = F.to_json(F.struct(F.array().cast("array<string>").alias("tools"), F.lit(True).alias("quarantined"), neutralized(reason).alias("reason")))
    whole = spliced(line, id_span(line), host_id)
    body = F.when(F.size(affected) > 0, _stripped(line, F.map_keys(affected))).otherwise(closed)
    kept = F.concat(F.lit('{"jsonrpc":"2.0","id":'), host_id, F.lit(',"result":'), body, F.lit("}"))
    return F.when(affected.isNull(), whole).when((F.size(affected) > 0) & F.lit(mode == AUDIT_ONLY), whole).otherwise(kept)


def pin_generation(lines: DataFrame, session: str, order: str) -> DataFrame:
    """Adds generation: how often the session's tool list was declared changed up to this line, so that what was pinned before no longer holds; lines have method."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("generation", F.count_if(F.coalesce(F.col("method") == "notifications/tools/list_changed", F.lit(False))).over(w))
