"""Host events as canonical rows: one projection over JSON text, whatever shape a host sends.

Extra keys are ignored and missing ones are null. A line that is no JSON object keeps its text
and says so in parse_error; it is an event without tool, so nothing is decided on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of events, the longest line, and tools by the names that hosts use.
PRE, POST, PROMPT = "PreToolUse", "PostToolUse", "UserPromptSubmit"
MOST_LINE = 16 << 20
TOOLS = {"bash": "Bash", "shell": "Bash", "run_command": "Bash", "read": "Read", "view": "Read", "write": "Write", "edit": "Edit", "webfetch": "WebFetch", "websearch": "WebSearch"}


def _text(v: Column, *paths: str) -> Column:
    """The first of the paths that holds a string."""
    return F.coalesce(*[F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{p}", "variant")) == "STRING", F.try_variant_get(v, f"$.{p}", "string")) for p in paths])


def _object(v: Column, *paths: str) -> Column:
    return F.coalesce(*[F.to_json(F.try_variant_get(v, f"$.{p}", "variant")) for p in paths])


def tool_class(name: Column) -> Column:
    """(kind, server, tool): a known tool, one of an MCP server (mcp__server__tool), or unknown."""
    parts = F.split(name, "__", 3)
    mcp = name.startswith("mcp__") & (F.size(parts) == 3) & (F.try_element_at(parts, F.lit(2)) != "")
    known = F.element_at(F.create_map(*[F.lit(x) for kv in TOOLS.items() for x in kv]), F.lower(name))
    return F.struct(
        F.when(mcp, "mcp").when(known.isNotNull(), "builtin").otherwise("unknown").alias("kind"),
        F.when(mcp, F.try_element_at(parts, F.lit(2))).alias("server"),
        F.when(mcp, F.try_element_at(parts, F.lit(3))).otherwise(F.coalesce(known, name)).alias("tool"),
    )


def canonical(lines: DataFrame, raw: str) -> DataFrame:
    """Adds event, session, tool (class), input and response (JSON text), prompt, command, path, url, parse_error."""
    v = F.when(F.octet_length(raw) <= MOST_LINE, F.try_parse_json(F.rtrim(raw, F.lit("\r\n"))))
    out = lines.withColumn("_v", v)
    v = F.col("_v")
    object_ = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    run, call = _text(v, "pre_run_command.command"), _text(v, "pre_mcp_tool_use.tool_name")
    bare = _text(v, "command")
    event = F.coalesce(_text(v, "hook_event_name", "hookEventName"), F.when(run.isNotNull() | call.isNotNull() | bare.isNotNull(), PRE))
    args = _object(v, "tool_input", "toolInput", "pre_mcp_tool_use.args", "pre_run_command")
    # A tool of any name whose arguments hold a command is a shell.
    name = F.coalesce(_text(v, "tool_name", "toolName"), F.when(run.isNotNull() | _text(v, "pre_mcp_tool_use.args.command").isNotNull() | bare.isNotNull(), "Bash"), call)
    out = out.select(
        *[c for c in lines.columns],
        event.alias("event"), _text(v, "session_id", "sessionId").alias("session"), tool_class(name).alias("tool"), F.coalesce(args, F.when(bare.isNotNull(), F.to_json(v))).alias("input"),
        _object(v, "tool_response", "tool_output", "toolResponse").alias("response"), _text(v, "prompt").alias("prompt"),
        F.coalesce(_text(v, "tool_input.command", "toolInput.command", "pre_mcp_tool_use.args.command"), run, bare).alias("command"),
        _text(v, "tool_input.file_path", "tool_input.path", "toolInput.file_path", "toolInput.path").alias("path"), _text(v, "tool_input.url", "toolInput.url").alias("url"),
        F.when(~object_, F.lit("no JSON object")).alias("parse_error"),
    )
    return out


def output_text(response: Column) -> Column:
    """What a tool printed: a string itself, else stdout and stderr, else the JSON; null for none."""
    v = F.try_parse_json(response)
    both = F.concat_ws("\n", _text(v, "stdout"), _text(v, "stderr"))
    whole = F.when(F.schema_of_variant(v) == "STRING", F.variant_get(v, "$", "string"))
    return F.coalesce(whole, F.when(both != "", both), F.when(F.schema_of_variant(v) != "VOID", F.to_json(v)))
