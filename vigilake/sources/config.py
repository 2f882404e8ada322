"""Configuration: small TOML files read on the driver, checked, and merged so that a project can only tighten.

The result prunes and parametrises plans before they are built; nothing of it is a table.
"""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, replace

from vigilake.functions.verdicts import BLOCK_AT, LEVELS, WARN_AT
from vigilake.operators.policy import ToolRule

#: Fixed value: the highest severity.
MOST_SEVERE = 9


@dataclass(frozen=True)
class Config:
    block_at: int = BLOCK_AT
    warn_at: int = WARN_AT
    level: str | None = None
    allow_list: tuple[str, ...] = ()
    custom_blocks: tuple[tuple[str, int], ...] = ()
    tool_rules: tuple[ToolRule, ...] = ()
    packs: tuple[str, ...] = ()
    disabled: tuple[str, ...] = ()
    disable: bool = False
    given: frozenset[str] = field(default_factory=frozenset)

    def thresholds(self) -> tuple[int, int]:
        """(block_at, warn_at), of the level if one is named."""
        return LEVELS[self.level] if self.level else (self.block_at, self.warn_at)


def checked(c: Config) -> Config:
    if c.level is not None and c.level not in LEVELS:
        raise ValueError(f"level is one of {', '.join(LEVELS)}, not {c.level!r}")
    if c.warn_at > c.block_at:
        raise ValueError(f"warn_at ({c.warn_at}) is above block_at ({c.block_at})")
    if any(not p for p, _ in c.custom_blocks):
        raise ValueError("a custom block without pattern would match everything")
    for what, severity in [*(("custom block", s) for _, s in c.custom_blocks), *(("tool rule", r.severity) for r in c.tool_rules)]:
        if not 0 <= severity <= MOST_SEVERE:
            raise ValueError(f"severity {severity} of a {what} is not within 0 to {MOST_SEVERE}")
    return c


def parse(text: str) -> Config:
    spec = tomllib.loads(text)
    cuts = spec.get("thresholds", {})
    rules = tuple(ToolRule(r["tool"], r["arg"], r["pattern"], r["severity"], r.get("reason", "")) for r in spec.get("tool_rules", []))
    return checked(
        Config(
            cuts.get("block_at", BLOCK_AT), cuts.get("warn_at", WARN_AT), spec.get("level"), tuple(spec.get("allow_list", ())), tuple((b["pattern"], b["severity"]) for b in spec.get("custom_blocks", ())),
            rules, tuple(spec.get("packs", ())), tuple(spec.get("disabled", ())), spec.get("disable", False), frozenset({*spec, *cuts}),
        )
    )


def tightened(base: Config, project: Config) -> Config:
    """The user's configuration with a project's on top; anything that would let more through is refused.

    Cutoffs may only fall; the allow list and what is disabled only shrink; custom blocks, tool
    rules and packs only grow (a block may get more severe). What a project doesn't mention stays.
    """
    out, given = base, project.given
    if given & {"level", "block_at", "warn_at"}:
        block, warn = base.thresholds()
        if project.level:
            cuts = project.thresholds()
        else:
            cuts = (project.block_at if "block_at" in given else block, project.warn_at if "warn_at" in given else warn)
        if cuts[0] > block or cuts[1] > warn:
            raise ValueError(f"a project may not raise the cutoffs {block}, {warn} to {cuts[0]}, {cuts[1]}")
        out = replace(out, block_at=cuts[0], warn_at=cuts[1], level=None)
    for name in ("allow_list", "disabled"):
        if name in given:
            if more := set(getattr(project, name)) - set(getattr(base, name)):
                raise ValueError(f"a project may not add {sorted(more)} to {name}")
            out = replace(out, **{name: getattr(project, name)})
    if "custom_blocks" in given:
        least = dict(base.custom_blocks)
        own = dict(project.custom_blocks)
        if lost := sorted(p for p, s in least.items() if own.get(p, -1) < s):
            raise ValueError(f"a project may not drop or soften the blocks {lost}")
        out = replace(out, custom_blocks=project.custom_blocks)
    for name in ("tool_rules", "packs"):
        if name in given:
            if lost := [x for x in getattr(base, name) if x not in getattr(project, name)]:
                raise ValueError(f"a project may not drop {lost} from {name}")
            out = replace(out, **{name: getattr(project, name)})
    if project.disable and not base.disable:
        raise ValueError("a project may not switch everything off")
    return checked(out)
