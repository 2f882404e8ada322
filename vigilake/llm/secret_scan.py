"""Secrets in texts: three fixed patterns and an assignment-aware lexer.

The lexer finds where source or configuration syntax gives a name a value: assignments with
subscripts (`cfg["key"] = `), annotations (`let key: string = `, `var key string = `), mappings
(`"key": `, `key => `), settings (`export KEY=`, `ENV KEY `), arguments (`get("KEY", `, `setKey(`),
XML elements and name-value attributes, declarations without a sign (`#define NAME`, `setx NAME`,
`:name, `, `(setq name`), and several names at once. From there it reads the value state by state: strings of
all quotes (triple, raw, formatted, escaped), lists, either value of a condition, sums, neighbours and parentheses over lines, calls,
YAML block scalars, bare words. Names that stand for earlier values hand them on, and every
literal is scored by how sensitive the names are that it ends up in.

Both are columns, so nothing is shuffled and each task scans its own rows. Null and empty texts
have no spans; repeated rows give the same spans; other columns don't matter. Offsets are code
points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilake.llm.shared import runs, utf8

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "literal")
#: The base patterns and the least length of what they must hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: How sensitive a name is by the parts it is made of; the highest counts.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.8, "credentials": 0.8, "bearer": 0.8, "authorization": 0.8,
}
#: Pairs of neighbouring parts that are sensitive only together.
SENSITIVE_PAIRS = {("api", "key"), ("access", "key"), ("private", "key"), ("signing", "key"), ("encryption", "key"), ("auth", "key"), ("master", "key"), ("client", "key"), ("db", "pass"), ("user", "pass")}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|none|null|nil|true|false|undefined|changeme|example.*|your[_-].*|todo|tbd|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%|\$[A-Za-z_]\w*|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)$")
#: A literal is a secret from this product of name and literal scores on.
THRESHOLD = 0.45

# No repetition has an upper bound or gives back what it took, so that long names and literals are read whole in linear time.
_TYPE = r"""(?:&(?:'\w++\x20)?+(?:mut\x20)?+)?+[A-Za-z_][\w.]*+(?:[<\[][\w.,|<>\[\]]*+(?:\x20++[\w.,|<>\[\]]++)*+(?<=[>\]]))?+\??+"""
_SET = r"""(?::=|\?=|\+=|=>|<-(?![-<])|=(?![=>~])|:(?![:/=]))"""
_PAIR = re.compile(
    r"""(?<![\w$.\-])(?:"([^"\n]++)"|'([^'\n]++)'"""
    rf"""|(?:var|const|val|let)\x20++([A-Za-z_$][\w$]*+)\x20++{_TYPE}\x20*+(?==)"""
    r"""|([A-Za-z_$][\w$.\-]*+(?:\[\x20*+(?:"[^"\n]*+"|'[^'\n]*+'|[\w.$]++)\x20*+\])*+))"""
    rf"""(?:\x20*+:\x20*+{_TYPE}\x20*+=(?![=>~])|\x20*+{_SET})\x20*+(?=["'`A-Za-z0-9_$+/(|>\\!\[])"""
)
_ARGUMENT = re.compile(r"""\(\s*+(?:"([^"\n]++)"|'([^'\n]++)')\s*+,\s*+(?=["'`])""")
_SETTER = re.compile(r"""(?<![\w$])([A-Za-z_$][\w$.]*+)\(\s*+(?=["'`])""")
_SETTING = re.compile(r"(?m)^ENV\x20++(\w++)\x20++(?=\S)")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:\-]*+)(?:\x20[^<>]*+)?>\s*+([^<>]*+)</\1\s*+>")
#: Declarations without a sign between name and value.
_DECLARED = [
    ("define", re.compile(r"(?m)^[ \t]*+\#[ \t]*+define[ \t]++([A-Za-z_]\w*+)[ \t]++(?=[\"'])")),
    ("setx", re.compile(r"(?mi)^[ \t]*+setx[ \t]++(\w++)[ \t]++(?=\S)")),
    (":", re.compile(r"(?<![\w:]):([A-Za-z_]\w*+),[ \t]*+(?=[\"'])")),
    ("(", re.compile(r"\((?:setq|setf|defvar|defconst|defparameter|define|def)\s++([A-Za-z*][\w*\-]*+)\s++(?=\")")),
]
#: Several names that get as many values.
_TUPLE = re.compile(r"(?m)^[ \t]*+((?:[A-Za-z_][\w.]*+[ \t]*+,[ \t]*+)++[A-Za-z_][\w.]*+)[ \t]*+=(?![=>~])[ \t]*+\(?+(?=[\"'])")
#: What precedes a value of two that a condition chooses from, and what stands between them.
_ASKED, _OTHERWISE, _ELSE = re.compile(r"[^\n;,?\"'`]*+"), re.compile(r"\?\s*+(?=[\"'`])"), re.compile(r"if\b(?:(?!\belse\b)[^\n\"'`])*+\belse[ \t]++(?=[\"'`])")
_TAG = re.compile(r"!{1,2}[\w:/.]*+[ \t]++")
_JOIN = re.compile(r"(?:\+|[.&](?=[ \t]*+[\"'`])|&(?=[ \t]*+[A-Za-z_$]))")
_ATTRIBUTES = re.compile(r"""\b(?:key|name|id)\x20*+=\x20*+["']([^"'<>\n]++)["']\x20++value\x20*+=\x20*+(?=["'])""")
_QUOTED = re.compile(r"""([rbufRBUF]{0,2})(?:"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`|\\"([^"\\\n]*+)\\")""")
_TRIPLE = re.compile(r"[rbufRBUF]{0,2}(\"\"\"|''')")
_FIELD = re.compile(r"\{([A-Za-z_][\w.]*+)\}")
_NAME = re.compile(r"[A-Za-z_$][\w$]*+(?:\.[A-Za-z_$][\w$]*+|\[\x20*+(?:\"[^\"\n]*+\"|'[^'\n]*+'|[\w.$]++)\x20*+\])*+(?=\s*(?:[;,+&})\]]|$|\n))", re.MULTILINE)
_CALL = re.compile(r"(?:new\x20++)?+([A-Za-z_$][\w$.]*+)\(")
_BLOCK = re.compile(r"[|>][+-]?\d?[+-]?[ \t]*+(?:#[^\n]*+)?\n")
_LINE = re.compile(r"([ \t]*+)([^\n]*+)(?:\n|\Z)")
_BARE = re.compile(r"""[^\s,;"'`{}()\[\]<>#|\\]++""")
_GAP, _WIDE = re.compile(r"(?:[ \t]|\\\r?\n)*+"), re.compile(r"(?:\s|\\\n)*+")
#: Calls whose first argument is a name and no value.
_GETTER = re.compile(r"(?i)(?:^|[._])(?:get\w*|getenv|env|lookup|fetch|read|load|require|property|param|header|config|setting)$")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    if any(w in (low := text.lower()) for w in WORDS) or "api" in low:
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    return out


def hex_spans(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]


def name_score(name: str) -> float:
    parts = [p.lower() for p in _PARTS.findall(name)]
    best = max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0)
    return max(best, 0.9 if SENSITIVE_PAIRS & set(zip(parts, parts[1:], strict=False)) else 0.0)


def literal_score(value: str, quoted: bool) -> float:
    """0 for what can't be a secret, up to 1 for long mixed strings."""
    return _score(Counter(value), value, quoted)


def _score(counts: Counter, sample: str, quoted: bool) -> float:
    """literal_score of a value by its characters and a sample that is a placeholder if the value is one."""
    length = sum(counts.values())
    if length < 6 or PLACEHOLDER.match(sample) or any(c.isspace() for c in counts):
        return 0.0
    seen = "".join(counts)
    kinds = sum(bool(re.search(p, seen)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]"))
    if not quoted and (length < 8 or not re.search("[0-9]", seen) or "/" in seen or "(" in seen):
        return 0.0
    entropy = -sum(n / length * math.log2(n / length) for n in counts.values())
    return min(1.0, 0.25 + 0.1 * kinds + 0.1 * min(entropy, 4.0) + 0.01 * min(length, 20))


#: Characters kept of either end of a value; more than the longest fixed placeholder has.
_ENDS = 32


class _Value:
    """A literal, or a sum of earlier values; of its text only counts, ends and whether all is quoted, as sums of sums grow with a power of two."""

    __slots__ = ("counts", "first", "last", "quoted", "span", "of", "score")

    def __init__(self, counts: Counter, first: str, last: str, quoted: bool, span: tuple[int, int] | None, of: tuple[_Value, ...] = ()):
        self.counts, self.first, self.last, self.quoted, self.span, self.of, self.score = counts, first, last, quoted, span, of, 0.0

    def literal(self) -> float:
        """The ends with every character that is only between them stand for the text."""
        if sum(self.counts.values()) <= _ENDS:
            return _score(self.counts, self.first, self.quoted)
        between = self.counts - Counter(self.first + self.last)
        return _score(self.counts, self.first + "".join(between) + self.last, self.quoted)


def _sum(of: list[_Value]) -> _Value:
    if len(of) == 1:
        return of[0]
    counts: Counter = Counter()
    first = last = ""
    for v in of:
        counts.update(v.counts)
        first = (first + v.first)[:_ENDS] if len(first) < _ENDS else first
        last = (last + v.last)[-_ENDS:]
    return _Value(counts, first, last, all(v.quoted for v in of), None, tuple(of))


def _anchors(text: str) -> list[tuple[int, int, str, int]]:
    """(where the value begins, where the name begins, name, where the value ends or -1) of all that gives a name a value, by the value's place; names with commas get a value each."""
    out = [(m.end(), m.start(), m[1] or m[2] or m[3] or m[4], -1) for m in _PAIR.finditer(text)] if "=" in text or ":" in text or "<-" in text else []
    if "=" in text and "," in text and (several := {m.end(): (m.end(), m.start(), m[1], -1) for m in _TUPLE.finditer(text)}):
        opened = {at - (text[at - 1] == "(") for at in several}
        out = [a for a in out if a[0] not in several and a[0] not in opened] + list(several.values())
    low = text.lower()
    for sign, pattern in _DECLARED:
        if sign in low:
            out += [(m.end(), m.start(), m[1], -1) for m in pattern.finditer(text)]
    if "(" in text:
        out += [(m.end(), m.start(), m[1] or m[2], -1) for m in _ARGUMENT.finditer(text)]
        out += [(m.end(), m.start(), name, -1) for m in _SETTER.finditer(text) if (name := m[1].rsplit(".", 1)[-1]).lower().startswith("set") and name_score(name)]
    if "ENV " in text:
        out += [(m.end(), m.start(), m[1], -1) for m in _SETTING.finditer(text)]
    if "</" in text:
        out += [(m.start(2), m.start(), m[1], m.start(2) + len(m[2].rstrip())) for m in _ELEMENT.finditer(text)]
    if "value" in text:
        out += [(m.end(), m.start(), m[1], -1) for m in _ATTRIBUTES.finditer(text)]
    return sorted(out)


class _Lexer:
    """Reads the values of one text. What the text doesn't close is remembered, so that it isn't looked for again."""

    def __init__(self, text: str) -> None:
        self.text, self.values = text, []
        self.known: dict[str, _Value] = {}
        self.open = {'"""': len(text), "'''": len(text)}
        # The last run of bare characters: how far it was read, its end, and what is in the rest.
        self.at_bare, self.bare_end, self.bare = 0, -1, Counter()
        # The last stretch without a question mark: where it was read from, and its end.
        self.asked = (0, -1)

    def made(self, a: int, b: int, quoted: bool, counts: Counter | None = None) -> _Value:
        text = self.text
        counts = Counter(text[a:b]) if counts is None else counts
        self.values.append(_Value(counts, text[a : min(b, a + _ENDS)], text[max(a, b - _ENDS) : b], quoted, (a, b)))
        return self.values[-1]

    def lines(self, a: int, b: int) -> list[_Value]:
        """The lines of a literal that hold no white space within, such as those of a key."""
        out = []
        while a < b:
            m = _LINE.match(self.text, a, b)
            line = m[2].rstrip()
            if line and not any(c.isspace() for c in line):
                out.append(self.made(m.start(2), m.start(2) + len(line), True))
            a = m.end()
        return out

    def block(self, name_at: int, at: int) -> list[_Value]:
        """The lines of a block scalar: those deeper than the line of its name."""
        text = self.text
        m = _LINE.match(text, text.rfind("\n", 0, name_at) + 1)
        own = len(m[1])
        end = at
        while end < len(text):
            m = _LINE.match(text, end)
            if m[2].strip() and len(m[1]) <= own:
                break
            end = m.end()
        return self.lines(at, end)

    def string(self, at: int) -> tuple[list[_Value], int]:
        """A string's values and its end; at itself where none begins."""
        text = self.text
        if m := _TRIPLE.match(text, at):
            end = text.find(m[1], m.end()) if m.end() <= self.open[m[1]] else -1
            if end >= 0:
                return self.lines(m.end(), end), end + 3
            self.open[m[1]] = min(self.open[m[1]], m.start())
        if not (q := _QUOTED.match(text, at)):
            return [], at
        a, b = q.span(next(i for i in (2, 3, 4, 5) if q[i] is not None))
        out = []
        if q[4] is not None or "f" in q[1].lower():
            # Known names in braces cut the string.
            for f in _FIELD.finditer(text, a, b):
                if f[1] in self.known:
                    cut = f.start() - (q[4] is not None and text[f.start() - 1 : f.start()] == "$")
                    out += [self.made(a, max(a, cut), True), self.known[f[1]]]
                    a = f.end()
        return [*out, self.made(a, b, True)], q.end()

    def values_of(self, at: int, several: bool = False) -> list[list[_Value]]:
        """What each value that begins here is made of: one, those of a list, those that a condition chooses from, or several by comma."""
        text = self.text
        at = m.end() if (m := _TAG.match(text, at)) else at
        if text[at : at + 1] == "[":
            return self.listed(at + 1)
        if several:
            return self.listed(at, False)
        parts, end = self.value(at)
        if parts and (m := _ELSE.match(text, end)):
            return [parts, self.value(m.end())[0]]
        if not any(v.quoted for v in parts) and (m := _OTHERWISE.match(text, self.stop(at))):
            first, end = self.value(m.end())
            end = _WIDE.match(text, end).end()
            return [first, self.value(_WIDE.match(text, end + 1).end())[0]] if text[end : end + 1] == ":" else [first]
        return [parts]

    def stop(self, at: int) -> int:
        """Where a question mark, a quote or the end of what may be a condition stands."""
        begin, end = self.asked
        if not begin <= at <= end:
            self.asked = (at, end := _ASKED.match(self.text, at).end())
        return end

    def listed(self, at: int, wide: bool = True) -> list[list[_Value]]:
        """Values by comma, over lines if wide; other than strings and names end the list."""
        text, out, gap = self.text, [], _WIDE if wide else _GAP
        while True:
            at = gap.match(text, at).end()
            if text[at : at + 1] not in "\"'`" and not (m := _NAME.match(text, at)):
                return out
            parts, at = self.value(at)
            out.append(parts)
            at = gap.match(text, at).end()
            if not parts or text[at : at + 1] != ",":
                return out
            at += 1

    def value(self, at: int) -> tuple[list[_Value], int]:
        """What the value that begins here is made of, and where it ends."""
        text, parts, depth = self.text, [], 0
        calls: list[bool] = []  # of each open parenthesis, whether its next string is only a name
        plus = True  # whether an operand may follow
        while True:
            at = (_WIDE if depth else _GAP).match(text, at).end()
            c = text[at : at + 1]
            if parts and c in "+.&" and c and _JOIN.match(text, at):
                at, plus = _WIDE.match(text, at + 1).end(), True
                continue
            if c == "," and depth:
                at, plus = at + 1, True
                calls[-1] = False
                continue
            if c == ")" and depth:
                at, depth, plus = at + 1, depth - 1, False
                calls.pop()
                continue
            found, end = self.string(at)
            if end > at:
                if not (calls and calls[-1]):
                    parts += found
                at, plus = end, False
                continue
            if not plus:
                return parts, at
            if c == "(":
                at, depth = at + 1, depth + 1
                calls.append(False)
            elif m := _CALL.match(text, at):
                at, depth = m.end(), depth + 1
                calls.append(bool(_GETTER.search(m[1])))
            elif (m := _NAME.match(text, at)) and m[0] in self.known:
                parts.append(self.known[m[0]])
                at, plus = m.end(), False
            elif not parts and not depth:
                return self.bare_word(at), at
            else:
                return parts, at

    def bare_word(self, at: int) -> list[_Value]:
        if self.at_bare <= at < self.bare_end:
            self.bare = self.bare - Counter(self.text[self.at_bare : at])
        elif q := _BARE.match(self.text, at):
            self.bare_end, self.bare = q.end(), Counter(q[0])
        else:
            return []
        self.at_bare = at
        return [self.made(at, self.bare_end, False, self.bare)]


def lexed_spans(text: str) -> list[tuple[int, int, str]]:
    """Literals that a sensitive name is given, at once or through other names."""
    lexer = _Lexer(text)
    for at, name_at, name, end in _anchors(text):
        names = [n.strip() for n in name.split(",")] if "," in name else [name]
        if end >= 0:
            values = [lexer.lines(at, end)]
        elif m := _BLOCK.match(text, at):
            values = [lexer.block(name_at, m.end())]
        else:
            values = lexer.values_of(at, len(names) > 1)
        for i, parts in enumerate(values):
            if not parts:
                continue
            own = names[min(i, len(names) - 1)]
            lexer.known[own] = whole = _sum(parts)
            if len(parts) > 1:
                lexer.values.append(whole)
            if (s := name_score(own)) > 0:
                whole.score = max(whole.score, s * whole.literal())
    # A sum comes behind what it is made of.
    found = set()
    for v in reversed(lexer.values):
        for part in v.of:
            part.score = max(part.score, v.score)
        if v.span and v.score >= THRESHOLD and v.span[1] > v.span[0]:
            found.add(v.span)
    return [(a, b, "literal") for a, b in sorted(found)]


def spans(text: str, has_hex: bool = True) -> list[tuple[int, int, str]]:
    """All spans by start, then kind; a lexed one that lies within a base one is left out."""
    out = base_spans(text) + (hex_spans(text) if has_hex else [])
    if any(c in text for c in "=:(#") or any(w in text for w in ("</", "<-", "ENV ", "setx", "SETX")):
        taken = sorted(out)
        # How far the base spans that begin up to each one reach.
        reach = list(accumulate((b for _, b, _ in taken), max))
        out += [x for x in lexed_spans(text) if not (i := bisect_right(taken, x[0], key=lambda t: t[0])) or reach[i - 1] < x[1]]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def _long_hex(texts: pa.Array) -> np.ndarray:
    """Which texts hold 24 hex digits in a row, for a whole batch at once."""
    data, off = utf8(texts)
    table = np.zeros(256, bool)
    table[[*b"0123456789abcdef"]] = True
    starts, ends, first = runs(table[data], off)
    long = np.concatenate([[0], np.cumsum(ends - starts >= LEAST["hex"])])
    return long[first[1:]] > long[first[:-1]]


def _all_spans(texts: pa.Array) -> list[list[tuple[int, int, str]]]:
    return [spans(t, h) if t else [] for t, h in zip(texts.to_pylist(), _long_hex(texts), strict=True)]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))


@F.arrow_udf(SPANS)
def secret_spans(texts: pa.Array) -> pa.Array:
    """The spans of each text."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
    return pa.array([[{"kind": k, "start": a, "stop": b} for a, b, k in found] for found in _all_spans(texts)], kind)


@F.arrow_udf(T.StringType())
def redacted(texts: pa.Array) -> pa.Array:
    """The texts with every secret replaced, spans that overlap as one; a text without any, or null, stays as it is."""
    out = []
    for t, found in zip(texts.to_pylist(), _all_spans(texts), strict=True):
        at, parts = 0, []
        for a, b, kind in found:
            if b > at:
                parts += [t[at : max(a, at)], f"[{kind.upper()} REMOVED]" if a >= at else ""]
                at = b
        out.append("".join([*parts, t[at:]]) if found else t)
    return pc.cast(pa.array(out, pa.string()), pa.string())


def listed(found: Column) -> Column:
    """kind:start:stop of the spans, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
