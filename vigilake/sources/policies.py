"""Policies in TOML: small configuration, read on the driver; any defect refuses the whole file."""

from __future__ import annotations

import hashlib
import json
import re
import tomllib
from typing import Any

from vigilake.operators.policy import Budget, Policy, ToolRule


def _only(table: dict[str, Any], known: set[str], where: str) -> dict[str, Any]:
    if more := set(table) - known:
        raise ValueError(f"unknown keys in {where}: {sorted(more)}")
    return table


#: Characters of a line that are shown whole, and what is shown before and behind the place in a longer one.
SHOWN, BEFORE, BEHIND = 120, 8, 17


def frame(file: str, text: str, error: tomllib.TOMLDecodeError) -> str:
    """Where a policy can't be read: file, line and column, the line, and a caret under the place."""
    place = re.search(r"\(at line (\d+), column (\d+)\)", str(error))
    number, column = map(int, place.groups()) if place else (text.count("\n") + 1, len(text) - text.rfind("\n"))
    line = (text.split("\n")[number - 1 : number] or [""])[0].rstrip("\r")
    at = min(column - 1, len(line))
    first, last = (0, len(line)) if len(line) <= SHOWN else (max(0, at - BEFORE), min(len(line), at + BEHIND))
    shown = ("…" if first else "") + line[first:last] + ("…" if last < len(line) else "")
    gap = " " * len(str(number))
    return f"  --> {file}:{number}:{column}\n{gap} |\n{number} | {shown}\n{gap} | {' ' * (at - first + bool(first))}^\n"


def load(file: str) -> Policy:
    """The policy of a file; what can't be read as TOML is an error that shows the place."""
    with open(file, encoding="utf-8") as f:
        text = f.read()
    try:
        return parse(text)
    except tomllib.TOMLDecodeError as e:
        raise ValueError(f"{e}\n{frame(file, text, e)}") from e


def parse(text: str) -> Policy:
    """The policy and the fingerprint of what it says: the typed policy as compact JSON, defaults filled in, whatever comments, spaces or the order of keys."""
    spec = _only(tomllib.loads(text), {"schema_version", "defaults", "tools", "budgets"}, "the policy")
    if spec.get("schema_version") != 1:
        raise ValueError(f"schema_version {spec.get('schema_version')} is not 1")
    # default_action is the name that files use; action is short for it.
    defaults = _only(spec.get("defaults", {}), {"default_action", "action"}, "defaults")
    action = defaults.get("default_action", defaults.get("action", "allow"))
    if action not in ("allow", "deny"):
        raise ValueError(f"the default action is allow or deny, not {action!r}")
    rules, allowed = [], []
    for tool in spec.get("tools", []):
        _only(tool, {"name", "allow", "deny", "rules"}, "a tool")
        if tool.get("allow"):
            allowed.append(tool["name"])
        for r in tool.get("rules", []):
            _only(r, {"arg", "pattern", "severity", "reason"}, f"a rule of {tool['name']}")
            rules.append(ToolRule(tool["name"], r["arg"], r["pattern"], r["severity"], r["reason"]))
    caps = _only(spec.get("budgets", {}), {"session", "per_tool"}, "budgets")
    whole = _only(caps.get("session", {}), {"max_tokens", "max_tool_invocations"}, "the session's budget")
    each = {t: _only(b, {"max_tokens", "max_invocations"}, f"the budget of {t}") for t, b in caps.get("per_tool", {}).items()}
    typed = {
        "schema_version": 1,
        "defaults": {"default_action": action},
        "tools": [{"name": t["name"], "allow": t.get("allow", []), "deny": t.get("deny", []), "rules": [{k: r[k] for k in ("arg", "pattern", "severity", "reason")} for r in t.get("rules", [])]} for t in spec.get("tools", [])],
        "budgets": {"session": {k: whole.get(k) for k in ("max_tokens", "max_tool_invocations")}, "per_tool": {t: {k: b.get(k) for k in ("max_tokens", "max_invocations")} for t, b in sorted(each.items())}},
    }
    fingerprint = hashlib.sha256(json.dumps(typed, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    per_tool = tuple((t, Budget(b.get("max_tokens"), b.get("max_invocations"))) for t, b in sorted(each.items()))
    return Policy(tuple(rules), action == "deny", tuple(allowed), Budget(whole.get("max_tokens"), whole.get("max_tool_invocations")), per_tool, fingerprint)
