"""Severity-scored text rules, read from rules/text_rules.toml.

A rule has guards, lists of lower-case literals of each of which a matching text must hold one; all
of all rules are looked for in one pass before a pattern is run. `look` marks the patterns that need lookaround, which RE2 lacks.
"""

from __future__ import annotations

import tomllib
from dataclasses import dataclass
from importlib.resources import files

from vigilake.functions.literals import Guards


@dataclass(frozen=True)
class Rule:
    idx: int
    id: str
    severity: int
    category: str
    pattern: str
    guards: Guards = ()
    look: bool = False


def _loaded() -> list[Rule]:
    """In tie order: severity rules, OWASP patterns (severity 8 each), then those with lookaround."""
    spec = tomllib.loads(files("vigilake").joinpath("rules/text_rules.toml").read_text(encoding="utf-8"))
    rows = [(*r, False) for r in spec["severity_rules"]] + [(i, 8, *r, False) for i, *r in spec["owasp_rules"]] + [(*r, True) for r in spec["lookaround_rules"]]

    def lists(guards: list) -> Guards:
        return tuple(map(tuple, guards)) if guards and isinstance(guards[0], list) else (tuple(guards),) if guards else ()

    return [Rule(n, i, severity, category, pattern, lists(guards), look) for n, (i, severity, category, pattern, guards, look) in enumerate(rows)]


RULES: list[Rule] = _loaded()
