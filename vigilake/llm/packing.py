"""Packing documents into fixed windows by patterns fitted with non-negative least squares.

All that the driver needs is the histogram of piece lengths (a row for each length up to the
window). Patterns of one to three lengths that fill a window exactly are enumerated, their
repeat counts fitted to the histogram by non-negative least squares (multiplicative updates),
rounded down, and what is left is packed best-fit, still by counts. Each pattern with its count
then says which piece of a length, by rank, lies where; ranks within a length are counted in
salted groups of about the root of a length's count, so that a common length is no hot key.

Null text is an empty document (one end token); equal documents are packed each; an empty table
gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigilake.llm.shared import saved, small_batches, text_rows
from vigilake.llm.token_counts import byte_alphabet, pretokens

#: Second lengths tried for each first one of a pattern of three, and rounds of fitting.
TRIPLES, FITS = 10, 200
#: The split of the vocabulary's own pre-tokenizer, a fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: White space in a row from which on texts are split here, as the encoder's own split gives up on long runs.
LONG_SPACE = re.compile(r"\s{20000}")


@lru_cache(maxsize=2)
def encoder(file: str) -> tiktoken.Encoding:
    """The vocabulary file's encoding; the ids of its merged symbols are their ranks."""
    with open(file, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = byte_alphabet()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(alphabet[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
    return tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)


def ids_of(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    """The ids of a text, special strings as their tokens."""
    special = enc.special_tokens_set
    if len(text) < 20_000 or not LONG_SPACE.search(text):
        return np.asarray(enc.encode_to_numpy(text, allowed_special=special), "<u4")
    parts = re.split("(" + "|".join(map(re.escape, sorted(special))) + ")", text) if special else [text]
    found: list[int] = []
    for part in parts:
        if part in special:
            found.append(enc.encode_single_token(part))
        else:
            for word in pretokens(part):
                found += enc._encode_single_piece(word)
    return np.array(found, "<u4")


def pieces(docs: DataFrame, tokenizer: str, end: int, window: int) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece; only documents above the window are cut."""
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = np.append(ids_of(enc, text), np.uint32(end)).astype("<u4")
                first = (len(ids) - 1) % window + 1
                borders = [0, *range(first, len(ids) + 1, window)]
                out += [(doc, k, s, e - s, zlib.crc32(ids[s:e].tobytes())) for k, (s, e) in enumerate(zip(borders, borders[1:], strict=False))]
            kinds = [b.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return text_rows(docs, "doc_id").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def patterns(window: int) -> np.ndarray:
    """Rows of three lengths (0: none) that fill the window exactly."""
    out = {(window, 0, 0)} | {(a, window - a, 0) for a in range(1, window // 2 + 1)}
    for a in range(1, window // 3 + 1):
        for b in np.unique(np.linspace(a, (window - a) // 2, TRIPLES).astype(int)):
            out.add((a, int(b), int(window - a - b)))
    return np.array(sorted(out), np.int64)


def fitted(hist: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 that bring sum(x * pattern) near the histogram in least squares."""
    window = len(hist) - 1

    def spread(x: np.ndarray) -> np.ndarray:
        h = np.bincount(rows.ravel(), np.repeat(x, rows.shape[1]), window + 1)
        h[0] = 0
        return h

    # Lengths that don't occur pull their patterns to 0.
    x = np.where(((hist[rows] > 0) | (rows == 0)).all(1), 1.0, 0.0)
    goal = hist[rows].sum(1)
    for _ in range(FITS):
        x *= goal / np.maximum(spread(x)[rows].sum(1), 1e-12)
    return x


def best_fit(hist: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and counts by best fit, longest first, for whole counts at a time."""
    window = len(hist) - 1
    open_: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    for size in range(window, 0, -1):
        left = int(hist[size])
        for room in range(size, window):
            while left and open_.get(room):
                held, n = open_[room].popitem()
                k = min(left, n)
                if n > k:
                    open_[room][held] = n - k
                # As many more of this length as the window still takes, as best fit would put one by one.
                more = min(room // size, max(1, left // k))
                open_[room - size * more][held + (size,) * more] += k
                left -= k * more
            if not left:
                break
        each = window // size
        if left >= each:
            open_[window - size * each][(size,) * each] += left // each
        if left % each:
            open_[window - size * (left % each)][(size,) * (left % each)] += 1
    return [(p, n) for held in open_.values() for p, n in held.items()]


def plan(hist: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used; together they hold every piece of the histogram once."""
    rows = patterns(len(hist) - 1)
    left, out = hist.astype(np.int64).copy(), []
    left[0] = 0
    n = np.floor(fitted(left.astype(float), rows) + 1e-9).astype(np.int64)
    for i in np.argsort(-n, kind="stable"):
        p = tuple(int(v) for v in rows[i] if v)
        k = int(n[i])
        for v in set(p):
            k = min(k, int(left[v]) // p.count(v))
        if k > 0:
            out.append((p, k))
            for v in p:
                left[v] -= k
    return out + best_fit(left)


def pack(docs: DataFrame, tokenizer: str, end: int = 2, window: int = 1024) -> DataFrame:
    """Every piece with the sequence and offset at which it lies."""
    spark = docs.sparkSession
    rows = saved(pieces(docs, tokenizer, end, window), "packing-pieces")
    hist = np.zeros(window + 1, np.int64)
    for r in rows.groupBy("length").count().collect():
        hist[r.length] = r["count"]
    # Slots sorted by length and rank: the pattern's n copies hold n pieces of that length in sequences base to base + n - 1.
    slots, ranks, base = [], np.zeros(window + 1, np.int64), 0
    for p, n in plan(hist):
        at = 0
        for v in p:
            slots.append((v, ranks[v], base, at))
            ranks[v] += n
            at += v
        base += n
    table = np.array(sorted(slots) or [(0, 0, 0, 0)], np.int64)
    spread = spark.sparkContext.broadcast(table)

    salts = F.lit(np.maximum(1, np.ceil(np.sqrt(hist))).astype(int).tolist())
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.element_at(salts, (F.col("length") + 1).cast("int"))))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offset = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("own", F.row_number().over(own)).join(offset, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own") - 1)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = spread.value
        key = t[:, 0] << 40 | t[:, 1]
        for b in batches:
            rank = b.column("rank").to_numpy()
            at = np.searchsorted(key, b.column("length").to_numpy() << 40 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(t[at, 2] + rank - t[at, 1]), pa.array(t[at, 3])], [*b.schema.names[:5], "sequence_id", "offset"])

    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kind = rows.schema["doc_id"].dataType.simpleString()
    return ranked.select(*kept, "rank").mapInArrow(placed, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
