"""Rule packs in TOML: small configuration, read on the driver. Any defect refuses the whole file."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass
from importlib.resources import files
from pathlib import Path


@dataclass(frozen=True)
class GlobRule:
    pack: str
    id: str
    pattern: str
    severity: int
    category: str


def parse(text: str) -> list[GlobRule]:
    """The rules of one pack; severities are 0 to 9, patterns not empty, ids unique, no other keys."""
    spec = tomllib.loads(text)
    meta, rules = spec.get("pack", {}), spec.get("rule", [])
    if spec.get("schema_version") != 1 or set(spec) - {"schema_version", "pack", "rule"}:
        raise ValueError("a pack has schema_version 1, pack and rule, nothing else")
    if not re.fullmatch(r"[a-z0-9]+(?:-[a-z0-9]+)*", meta.get("name", "")):
        raise ValueError("a pack's name is kebab case")
    out = []
    for r in rules:
        if set(r) != {"id", "pattern", "severity", "category"} or not r["pattern"] or not 0 <= r["severity"] <= 9:
            raise ValueError(f"bad rule in {meta['name']}: {r}")
        out.append(GlobRule(meta["name"], r["id"], r["pattern"], r["severity"], r["category"]))
    if len({r.id for r in out}) < len(out):
        raise ValueError(f"an id occurs twice in {meta['name']}")
    return out


def load(directory: str) -> dict[str, list[GlobRule]]:
    """All packs of a folder by name, files in sorted order; a name that occurs twice is refused."""
    out: dict[str, list[GlobRule]] = {}
    for f in sorted(Path(directory).glob("*.toml")):
        rules = parse(f.read_text(encoding="utf-8"))
        for name in {r.pack for r in rules}:
            if name in out:
                raise ValueError(f"pack {name} occurs twice")
            out[name] = rules
    return out


def shipped() -> dict[str, list[GlobRule]]:
    """The packs that come with the package."""
    out = {}
    for f in sorted(files("vigilake").joinpath("rules/packs").iterdir(), key=lambda f: f.name):
        rules = parse(f.read_text(encoding="utf-8"))
        out[rules[0].pack] = rules
    return out
