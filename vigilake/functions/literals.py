"""Which of many literals texts hold, found in one pass over each text by an Aho-Corasick automaton.

Rules are guarded by lists of literals, of each of which a matching text must hold one. The automaton
tells of each text of a batch which rules that leaves, so that patterns run only for these.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lists of literals, of each of which one must be there.
Guards = tuple[tuple[str, ...], ...]
#: A literal that stands for any character that isn't ASCII; what marks a side where no ASCII word character may be.
BEYOND_ASCII, BAR = "{beyond ascii}", "|"
#: Letters that patterns without case take for ASCII ones, but lower() doesn't.
_FOLDED = str.maketrans("\u017f\u0130\u0131", "sii")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")


class Scanner:
    """The automaton of some rules' guards."""

    def __init__(self, guards: tuple[Guards, ...]) -> None:
        groups = [(rule, group) for rule, lists in enumerate(guards) for group in lists]
        #: The rule of each group, how many groups a rule needs, and the rules that need none.
        self.rule, self.needs = [r for r, _ in groups], [len(lists) for lists in guards]
        self.always = [r for r, n in enumerate(self.needs) if not n]
        self.beyond = sum(1 << g for g, (_, group) in enumerate(groups) if BEYOND_ASCII in group)
        held: dict[str, list[tuple[bool, bool, int]]] = {}
        for g, (_, group) in enumerate(groups):
            for literal in group:
                word = literal.strip(BAR)
                if literal != BEYOND_ASCII:
                    held.setdefault(word, []).append((literal.startswith(BAR), literal.endswith(BAR), 1 << g))
        self.found = ahocorasick.Automaton()
        for word, uses in held.items():
            free = sum(bit for left, right, bit in uses if not left and not right)
            self.found.add_word(word, (len(word), free, [u for u in uses if u[0] or u[1]]))
        self.any = bool(held)
        if self.any:
            self.found.make_automaton()
        self.known: dict[int, tuple[int, ...]] = {}

    def groups(self, text: str) -> int:
        """The groups of which the text holds a literal, as bits."""
        bits = 0
        if not text.isascii():
            bits, text = self.beyond, text.translate(_FOLDED)
        text = text.lower()
        if not self.any:
            return bits
        for end, (size, free, bounded) in self.found.iter(text):
            bits |= free
            for left, right, bit in bounded:
                if not (bits & bit or left and end >= size and text[end - size] in _WORD or right and end + 1 < len(text) and text[end + 1] in _WORD):
                    bits |= bit
        return bits

    def rules(self, text: str) -> tuple[int, ...]:
        """The places of the rules whose groups are all there."""
        groups = self.groups(text)
        if (out := self.known.get(groups)) is None:
            met: Counter = Counter()
            left = groups
            while left:
                met[self.rule[(left & -left).bit_length() - 1]] += 1
                left &= left - 1
            out = tuple(sorted([*self.always, *(r for r, n in met.items() if n == self.needs[r])]))
            if len(self.known) < 1 << 16:
                self.known[groups] = out
        return out


@lru_cache(maxsize=8)
def scanner(guards: tuple[Guards, ...]) -> Scanner:
    """One for each set of rules in a worker."""
    return Scanner(guards)


def scanning(guards: tuple[Guards, ...]) -> Callable[[Column], Column]:
    """An Arrow function: the places of the rules that a text may match, as an array; null for null."""

    @F.arrow_udf("array<int>")
    def scanned(texts: pa.Array) -> pa.Array:
        scan = scanner(guards)
        return pa.array([None if t is None else scan.rules(t) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return scanned


def rescanning(guards: tuple[Guards, ...]) -> Callable[[Column], Column]:
    """As scanning, with the text itself beside the places."""
    kind = pa.struct([("text", pa.string()), ("may", pa.list_(pa.int32()))])

    @F.arrow_udf("text string, may array<int>")
    def scanned(texts: pa.Array) -> pa.Array:
        scan = scanner(guards)
        return pa.array([None if t is None else {"text": t, "may": scan.rules(t)} for t in texts.to_pylist()], kind)

    return scanned


def candidates(text: Column, guards: tuple[Guards, ...]) -> Column:
    """The places of the rules that a text may match, as an array; null for null."""
    return scanning(guards)(text)


def candidates_each(texts: Column, guards: tuple[Guards, ...]) -> Column:
    """As candidates, for every text of an array."""

    @F.arrow_udf("array<array<int>>")
    def scanned(lists: pa.Array) -> pa.Array:
        scan = scanner(guards)
        return pa.array([None if x is None else [None if t is None else scan.rules(t) for t in x] for x in lists.to_pylist()], pa.list_(pa.list_(pa.int32())))

    return scanned(texts)
