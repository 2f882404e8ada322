"""JSON in one canonical text: compact, keys sorted, numbers and escapes always written alike.

Digests of tool manifests are taken of this text, so it must be the same wherever it is made: integers
of 64 bits as they are, all other numbers as the shortest text of their double, keys by code point,
only the escapes that JSON needs, and the last value of a name that comes twice.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EXPONENT = re.compile(r"e([+-])0*(\d+)")


class _Number(float):
    """A double that is written with the fewest digits: plainly from 1e-5 to below 1e16, with a bare exponent else."""

    def __repr__(self) -> str:
        text = float.__repr__(self)
        if "e-05" in text:
            digits = text.split("e")[0].replace(".", "").lstrip("-")
            return ("-" if self < 0 else "") + "0.0000" + digits
        return _EXPONENT.sub(lambda m: "e" + m[1].replace("+", "") + m[2], text)


def _is_integer(text: str) -> bool:
    return -(1 << 63) <= int(text) < 1 << 64 and text != "-0"


def _double(text: str) -> _Number:
    x = _Number(text)
    if x in (float("inf"), float("-inf")):
        raise ValueError(f"{text} is no double")
    return x


def _constant(text: str) -> None:
    raise ValueError(f"{text} is no JSON")


def parsed(text: str, odd: list[float] | None = None) -> Any:
    """The value of a JSON text; ValueError where it is none, or holds half a surrogate pair. odd takes the numbers that aren't written as a double is by Python."""

    def double(text: str) -> _Number:
        x = _double(text)
        if odd is not None and "e" in float.__repr__(x):
            odd.append(x)
        return x

    value = json.loads(text, parse_int=lambda t: int(t) if _is_integer(t) else double(t), parse_float=double, parse_constant=_constant)
    if "\\ud" in text.lower():
        _written(value).encode()
    return value


def _written(value: Any) -> str:
    # The C encoder writes subclasses of float by float.__repr__, so numbers are put in as marked texts.
    marks: list[str] = []

    def marked(x: Any) -> Any:
        if isinstance(x, _Number):
            marks.append(repr(x))
            return {"\x00": len(marks) - 1}
        if isinstance(x, dict):
            return {k: marked(x[k]) for k in sorted(x)}
        return [marked(v) for v in x] if isinstance(x, list) else x

    out = json.dumps(marked(value), ensure_ascii=False, separators=(",", ":"))
    return re.sub(r'\{"\\u0000":(\d+)\}', lambda m: marks[int(m[1])], out) if marks else out


def canonical(text: str) -> str:
    return _written(parsed(text))


#: What identifies a tool, and what of it a manifest's digest covers besides.
TOOL, MANIFEST = ("name", "description", "inputSchema"), ("name", "description", "inputSchema", "outputSchema")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _only(tool: Any, keys: tuple[str, ...]) -> dict:
    return {k: tool[k] for k in keys if k in tool} if isinstance(tool, dict) else {}


def _name(tool: dict) -> str:
    return tool["name"] if isinstance(tool.get("name"), str) else ""


#: Writes values of which no number is odd.
_plain = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode


def digests(upstream: str, result: Any, write: Callable[[Any], str] = _written) -> tuple[str, dict[str, str]]:
    """The digest of the canonical text of a tools/list result (upstream, and the tools by name, of which only MANIFEST counts), and that of every tool that has a name; of a name that comes twice, the last.

    Each tool is written once: what the manifest covers besides stands behind what identifies the tool.
    """
    tools = result.get("tools") if isinstance(result, dict) else None
    listed, each = [], {}
    for t in tools if isinstance(tools, list) else ():
        tool = _only(t, MANIFEST)
        parts = [f'"{k}":{write(tool[k])}' for k in sorted(TOOL) if k in tool]
        if isinstance(t, dict) and isinstance(t.get("name"), str):
            each[t["name"]] = digest("{" + ",".join(parts) + "}")
        parts += [f'"{k}":{write(tool[k])}' for k in sorted(set(MANIFEST) - set(TOOL)) if k in tool]
        listed.append((_name(tool), ",".join(parts)))
    listed.sort(key=lambda x: x[0])
    body = ",".join("{" + x + "}" for _, x in listed)
    return digest(f'{{"tools":[{body}],"upstream":{write(upstream)}}}'), each


@F.arrow_udf(T.StringType())
def canonical_text(texts: pa.Array) -> pa.Array:
    """The canonical text; what is no JSON becomes a JSON string of itself, so that two broken texts stay two."""
    out: list[str | None] = []
    for t in texts.to_pylist():
        try:
            out.append(None if t is None else canonical(t))
        except (ValueError, RecursionError):
            out.append(json.dumps(t, ensure_ascii=False))
    return pa.array(out, pa.string())


DIGESTS = T.StructType([T.StructField("tools_hash", T.StringType()), T.StructField("tools", T.MapType(T.StringType(), T.StringType()))])


@F.arrow_udf(DIGESTS)
def manifest_digests(upstreams: pa.Array, results: pa.Array) -> pa.Array:
    """tools_hash and, by tool, its digest, of tools/list results (JSON objects); null for what is no JSON."""
    out = []
    for upstream, text in zip(upstreams.to_pylist(), results.to_pylist(), strict=True):
        try:
            if text is None:
                out.append(None)
                continue
            odd: list[float] = []
            result = parsed(text, odd)
            whole, each = digests(upstream or "", result, _written if odd else _plain)
            out.append({"tools_hash": whole, "tools": sorted(each.items())})
        except (ValueError, RecursionError):
            out.append(None)
    return pa.array(out, pa.struct([("tools_hash", pa.string()), ("tools", pa.map_(pa.string(), pa.string()))]))
