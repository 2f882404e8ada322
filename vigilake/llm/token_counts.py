"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging.

Pre-tokens of a batch lie one after another in one array of symbols. In each round every
pre-token finds its pair of lowest rank and all of them merge theirs at once, wherever it
occurs, until none has a pair left; what remains are the tokens. As a round costs a pass over
all symbols, a pre-token of more than LONG bytes goes alone: its places wait by the rank of their
pair, and the lowest rank's places merge at once, so that its time is near its length.

Nothing is shuffled: each task counts its own rows. Null text counts as empty, empty text has
no tokens, repeated rows are counted each, other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm.shared import small_batches, text_rows

#: Pre-tokens whose counts a worker remembers; those of more than LONG bytes aren't, so that they take some 50 MB at most.
CACHE = 400_000
#: Bytes of a pre-token from which on it is merged alone.
LONG = 64
#: The characters with the Unicode property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@lru_cache(maxsize=1)
def other_numbers() -> tuple[str, re.Pattern]:
    """Number characters that re takes for letters, as ranges of a class; and what finds them or any character beyond the BMP."""
    at = [i for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i)) in ("Nl", "No")]
    first = [i for i, j in zip(at, [-2, *at], strict=False) if i != j + 1]
    last = [i for i, j in zip(at, [*at[1:], -2], strict=True) if j != i + 1]
    ranges = "".join(f"\\U{i:08x}-\\U{j:08x}" for i, j in zip(first, last, strict=True))
    # Only classes within the BMP are looked up by re, not searched.
    return ranges, re.compile("[" + "".join(re.escape(chr(i)) for i in at if i < 0x10000) + "]|[\U00010000-\U0010ffff]")


@lru_cache(maxsize=2)
def pretoken_pattern(numbers: bool) -> re.Pattern:
    """The vocabulary's split into contractions, letters, numbers, others and white space, for the re module.

    numbers: for texts with other numbers than decimal digits; to list them all in a class makes it slow.
    """
    other = other_numbers()[0] if numbers else ""
    return re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[^\W\d_{other}]+| ?[\d{other}]+| ?(?:[^\s\w]|[_\x1c-\x1f])+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def pretokens(text: str) -> list[str]:
    return pretoken_pattern(not text.isascii() and bool(other_numbers()[1].search(text))).findall(text)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A vocabulary's merges as sorted arrays."""

    def __init__(self, file: str) -> None:
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.pair_of = key.tolist()
        self.key, self.rank = key[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.first = np.zeros(256, np.int64)
        for c, b in byte_alphabet().items():
            self.first[b] = vocab[c]
        self.by_pair = dict(zip(key.tolist(), range(len(key)), strict=True))
        self.special = [t["content"] for t in spec["added_tokens"]]

    def count(self, pretokens: list[bytes]) -> np.ndarray:
        """How many symbols survive in each pre-token."""
        size = np.array([len(p) for p in pretokens], np.int64)
        out = size.copy()
        for i in np.flatnonzero(size > LONG):
            out[i] = self.count_long(pretokens[i])
        live = np.flatnonzero((size > 1) & (size <= LONG))
        sym = self.first[np.frombuffer(b"".join(pretokens[i] for i in live), np.uint8)]
        size = size[live]
        none = np.int64(len(self.made))
        while len(live):
            start = np.concatenate([[0], np.cumsum(size)[:-1]])
            own = np.repeat(np.arange(len(live)), size)
            pair = sym[:-1] << 32 | sym[1:]
            at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
            rank = np.full(len(sym), none)
            rank[:-1] = np.where((self.key[at] == pair) & (own[1:] == own[:-1]), self.rank[at], none)
            best = np.minimum.reduceat(rank, start)
            hit = (rank == best[own]) & (rank < none)
            i = np.flatnonzero(hit)
            # Where a pair overlaps itself, as in aaa, each second place is left out.
            fresh = np.flatnonzero(np.concatenate([[True], np.diff(i) > 1]))
            turn = np.arange(len(i)) - np.repeat(fresh, np.diff(np.append(fresh, len(i))))
            i = i[turn % 2 == 0]
            sym[i] = self.made[rank[i]]
            keep = np.ones(len(sym), bool)
            keep[i + 1] = False
            size = size - np.bincount(own[i], minlength=len(live))
            going = (best < none) & (size > 1)
            out[live] = size
            sym = sym[keep & going[own]]
            live, size = live[going], size[going]
        return out


    def count_long(self, pretoken: bytes) -> int:
        """The same of one long pre-token. A place waits under the rank of the pair that begins there; a pair that has gone by the time its rank comes is passed over."""
        first = self.first[np.frombuffer(pretoken, np.uint8)]
        n = left = len(first)
        pair = first[:-1] << 32 | first[1:]
        at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
        places = np.flatnonzero(self.key[at] == pair)
        rank = self.rank[at[places]]
        order = np.argsort(rank, kind="stable")
        cut = np.flatnonzero(np.diff(rank[order], prepend=-1))
        waiting = {int(rank[order[s]]): places[order[s:e]].tolist() for s, e in zip(cut, np.append(cut[1:], len(order)), strict=True)}
        heap = sorted(waiting)
        sym, after, before = first.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            best = heapq.heappop(heap)
            made, want = int(self.made[best]), self.pair_of[best]
            for i in sorted(waiting.pop(best)):
                j = after[i]
                if j >= n or sym[i] << 32 | sym[j] != want:
                    continue
                sym[i], sym[j] = made, -1
                left -= 1
                k = after[i] = after[j]
                h = before[i]
                if k < n:
                    before[k] = i
                    if (r := self.by_pair.get(made << 32 | sym[k])) is not None:
                        if r not in waiting:
                            waiting[r] = []
                            heapq.heappush(heap, r)
                        waiting[r].append(i)
                if h >= 0 and (r := self.by_pair.get(sym[h] << 32 | made)) is not None:
                    if r not in waiting:
                        waiting[r] = []
                        heapq.heappush(heap, r)
                    waiting[r].append(h)
        return left


@lru_cache(maxsize=2)
def merges(file: str) -> Merges:
    return Merges(file)


def text_counts(texts: list[str], file: str, cache: dict[str, int]) -> list[int]:
    """Tokens of each text; cache keeps what pre-tokens count."""
    m = merges(file)
    special = re.compile("|".join(map(re.escape, m.special))) if m.special else None
    split = [special.split(t) if special and any(s in t for s in m.special) else [t] for t in texts]
    found = [[w for part in parts for w in pretokens(part)] for parts in split]
    new = list({w for ws in found for w in ws if w not in cache})
    if len(cache) + len(new) > CACHE:
        cache.clear()
        new = list({w for ws in found for w in ws})
    cache.update(zip(new, m.count([w.encode() for w in new]).tolist(), strict=True))
    get = cache.__getitem__
    out = [sum(map(get, ws)) + len(parts) - 1 for ws, parts in zip(found, split, strict=True)]
    # A character is a byte at least.
    for w in new:
        if len(w) > LONG // 4 and len(w.encode()) > LONG:
            del cache[w]
    return out


_caches: dict[str, dict[str, int]] = {}


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""
    small_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            counts: list[int] = []
            i = 0
            while i < len(texts):
                j, chars = i, 0
                while j < len(texts) and (j == i or chars < 1 << 18):
                    chars += len(texts[j])
                    j += 1
                counts += text_counts(texts[i:j], tokenizer, _caches.setdefault(tokenizer, {}))
                i = j
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = text_rows(docs, "doc_id").withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
