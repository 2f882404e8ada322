"""Interpolated modified Kneser-Ney bigram model, counted in Spark, scored from mapped arrays.

Counting. Each task turns its texts into 64-bit word hashes and combines equal ones before the
shuffle; Spark deals the combined arrays by ranges of hash, and each range is merged and written
as a sorted array to the shared folder (the vocabulary). A second pass counts bigrams as pairs
of places in the vocabulary, dealt by ranges of the pair's hash, so that a frequent context is
spread over all of them. Each range's merge writes its sorted hash array and hands on what is
known of contexts (total, how many followers were seen once, twice, more often) and followers
(how many contexts), which a third deal sums by ranges of the vocabulary.

Scoring. Workers map the arrays from the shared folder and look up whole blocks of texts at
once. The folder must be a path that all executors mount; arrays are written under another name
and renamed, so that a task that runs twice does no harm. The model lists the ranges that were
written, and a worker that does not find one of them fails instead of scoring without it. There is
a range for every RANGE_BYTES of text, so that what a merge holds does not grow with the input.

The order is two: at three the distinct n-grams alone outgrow the disk that the job may use.
Null text is empty; an empty text is one end token; repeated rows are scored, and counted, each.
An empty table is scored to no rows, and learnt from to a model that knows no word. Columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.llm.shared import blocks, mix, saved, shared_dir, small_batches, text_rows, utf8, word_hashes

_U = np.uint64
#: The hash that stands for the end of a text.
END = _U(0x656E6421656E6421)
#: Tokens that a counting task combines at a time, and bytes of text that a scoring task looks up at a time.
COMBINED, LOOKED_UP = 2_000_000, 4 << 20
#: Bytes of training text for each range of hashes.
RANGE_BYTES = 64 << 20


def training(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 10 != 0


def tokens(texts: pa.Array | pa.ChunkedArray, size: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of texts: the word hashes with an end after each text, and each text's number of tokens."""
    data, off = utf8(texts)
    for i, j in blocks(off, size):
        w, first = word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i])
        yield np.insert(w, first[1:], END), np.diff(first) + 1


def squeezed(key: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted keys and counts as compressed byte planes of the differences."""
    step = np.diff(key, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(len(key).to_bytes(8, "little") + step.tobytes() + n.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def stretched(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    size = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(raw, np.uint8, offset=8).reshape(2, 8, size)
    step, n = (np.ascontiguousarray(p.T).reshape(-1).view("<u8") for p in planes)
    return np.cumsum(step, dtype=np.uint64), n.astype(np.int64)


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    return key[start], np.add.reduceat(n, start) if len(key) else n


def summed(pieces: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all pieces and their counts' sums; pieces are unpacked one at a time and merged with others of like length."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for p in pieces:
        held.append(stretched(p))
        while len(held) > 1 and len(held[-2][0]) <= 2 * len(held[-1][0]):
            held.append(merged(held.pop(), held.pop()))
    while len(held) > 1:
        held.append(merged(held.pop(), held.pop()))
    return held[0]


def dealt(h: np.ndarray, parts: int) -> np.ndarray:
    """Which of the equal ranges of 64 bits each hash falls into."""
    return ((h >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)


def pieces(part: np.ndarray, key: np.ndarray, n: np.ndarray, kind: int = 0) -> Iterator[tuple[int, int, bytes]]:
    """Keys sorted by part and value, squeezed part by part."""
    start = np.flatnonzero(np.diff(part, prepend=-1))
    for s, e in zip(start, np.append(start, len(part))[1:], strict=True):
        yield kind, int(part[s]), squeezed(key[s:e], n[s:e])


def rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["kind", "part", "piece"])


PIECES = "kind int, part int, piece binary"


def written(directory: str, name: str, *arrays: np.ndarray) -> None:
    """Arrays under a name of their own first, then renamed; the last of the same task wins."""
    for i, a in enumerate(arrays):
        path = os.path.join(directory, f"{name}.{i}.npy")
        own = f"{path}.{uuid.uuid4().hex}"
        with open(own, "wb") as f:
            np.save(f, a)
        os.replace(own, path)


@lru_cache(maxsize=1 << 14)
def _mapped(directory: str, name: str, n: int) -> list[np.ndarray]:
    """The arrays of one range, mapped when first asked for; a file that is missing is an error."""
    return [np.load(os.path.join(directory, f"{name}.{i}.npy"), mmap_mode="r") for i in range(n)]


class Lookup:
    """Sorted hash arrays of ranges, with arrays of values beside them; sizes: the length of each range that was written."""

    def __init__(self, directory: str, name: str, values: int, parts: int, sizes: dict[int, int]) -> None:
        self.directory, self.name, self.values, self.parts = directory, name, values, parts
        self.first = np.concatenate([[0], np.cumsum([sizes.get(p, 0) for p in range(parts)])])

    def find(self, h: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """For sorted hashes: places in the whole, or -1, and the values there, or 0."""
        at = np.full(len(h), -1)
        values = [np.zeros(len(h), np.int64) for _ in range(self.values)]
        edge = np.searchsorted(dealt(h, self.parts), np.arange(self.parts + 1))
        for p in np.flatnonzero(np.diff(edge)):
            s, e = edge[p], edge[p + 1]
            if self.first[p] == self.first[p + 1]:
                continue
            key, *own = _mapped(self.directory, f"{self.name}-{p}", 1 + self.values)
            i = np.minimum(np.searchsorted(key, h[s:e]), len(key) - 1)
            ok = key[i] == h[s:e]
            at[s:e] = np.where(ok, self.first[p] + i, -1)
            for v, o in zip(values, own, strict=True):
                v[s:e] = np.where(ok, o[i], 0)
        return at, values


def discounts(n: np.ndarray) -> np.ndarray:
    """What counts of 0, 1, 2 and 3 or more lose, from the counts of counts 1 to 4."""
    n1, n2, n3, n4 = (float(x) for x in n[:4])
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1))])


def _path(spark) -> str:
    url = urlparse(shared_dir(spark))
    if url.scheme not in ("", "file"):
        raise ValueError("the model is mapped from files: spark.checkpoint.dir must be a path that every executor mounts")
    return url.path


class Model:
    """What a worker needs: where the arrays are, and a few numbers."""

    def __init__(self, directory: str, parts: int) -> None:
        self.directory, self.parts = directory, parts
        self.size = self.total = self.types = 0
        self.high, self.low = np.zeros(4), np.zeros(4)
        self.low_left = 1.0
        # What was written: lengths of the ranges of words and of pairs.
        self.words: dict[int, int] = {}
        self.pairs: dict[int, int] = {}

    def vocabulary(self) -> Lookup:
        return Lookup(self.directory, "words", 1, self.parts, self.words)

    def bigrams(self) -> Lookup:
        return Lookup(self.directory, "pairs", 1, self.parts, self.pairs)

    def dense(self, name: str, at: np.ndarray, n: int) -> list[np.ndarray]:
        """Values of places in the vocabulary (the begin of a text is one more), kept by ranges of places; at is sorted."""
        part = at * self.parts // (self.size + 1)
        edge = np.searchsorted(part, np.arange(self.parts + 1))
        out = [np.zeros(len(at), np.int64) for _ in range(n)]
        for p in np.flatnonzero(np.diff(edge)):
            s, e = edge[p], edge[p + 1]
            first = -(-p * (self.size + 1) // self.parts)
            # Every place of the vocabulary has followed or been followed, so that its range was written.
            for o, a in zip(out, _mapped(self.directory, f"{name}-{p}", n), strict=True):
                o[s:e] = a[at[s:e] - first]
        return out


def train(docs: DataFrame) -> Model:
    """The model of all rows of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    text = text_rows(docs)
    held = text.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes")).first().bytes or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // RANGE_BYTES))
    model = Model(os.path.join(_path(spark), f"lm-{uuid.uuid4().hex}"), parts)
    os.makedirs(model.directory)
    directory = model.directory

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def told() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            held.clear()
            return rows(list(pieces(dealt(h, parts), h, n)))

        for b in batches:
            for w, _ in tokens(b.column("text")):
                held.append(w)
                if sum(map(len, held)) > COMBINED:
                    yield told()
        yield told()

    def word_range(table: pa.Table) -> pa.Table:
        p = table.column("part")[0].as_py()
        h, n = summed(x.as_py() for x in table.column("piece"))
        written(directory, f"words-{p}", h, n)
        return pa.table({"part": pa.array([p], pa.int32()), "types": pa.array([len(h)], pa.int64()), "tokens": pa.array([int(n.sum())], pa.int64())})

    # One small row for each range comes to the driver.
    got = text.mapInArrow(words, PIECES).groupBy("part").applyInArrow(word_range, "part int, types long, tokens long").collect()
    model.words = {r.part: r.types for r in got}
    model.size, model.total = sum(r.types for r in got), sum(r.tokens for r in got)
    if not model.size:
        return model
    if model.size >= 1 << 32:
        raise ValueError("places in the vocabulary are kept in 32 bits")
    begin = model.size

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.vocabulary()
        held: list[np.ndarray] = []

        def told() -> pa.RecordBatch:
            if not held:
                return rows([])
            key, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            part = dealt(mix(key), parts)
            order = np.argsort(part, kind="stable")
            return rows(list(pieces(part[order], key[order], n[order])))

        for b in batches:
            for w, size in tokens(b.column("text"), LOOKED_UP):
                h, back = np.unique(w, return_inverse=True)
                second = known.find(h)[0][back]
                first = np.concatenate([[begin], second[:-1]])
                first[np.concatenate([[0], np.cumsum(size)[:-1]])] = begin
                held.append(first.astype(np.uint64) << _U(32) | second.astype(np.uint64))
                if sum(map(len, held)) > COMBINED:
                    yield told()
        yield told()

    def pair_range(table: pa.Table) -> pa.Table:
        p = table.column("part")[0].as_py()
        key, n = summed(x.as_py() for x in table.column("piece"))
        h = mix(key)
        order = np.argsort(h)
        written(directory, f"pairs-{p}", h[order], n[order].astype(np.uint32))
        first, second = (key >> _U(32)).astype(np.int64), (key & _U(0xFFFFFFFF)).astype(np.int64)
        of_counts = np.bincount(np.minimum(n, 5), minlength=6)[1:5]
        out: list[tuple[int, int, bytes]] = [(9, p, squeezed(np.arange(5, dtype=np.uint64), np.append(of_counts, len(key))))]
        for kind, place, weight in ((0, first, n), (1, first, n == 1), (2, first, n == 2), (3, first, n > 2), (4, second, n > 0)):
            use = weight > 0
            u, at = np.unique(place[use], return_inverse=True)
            out += pieces(u * parts // (begin + 1), u.astype(np.uint64), np.bincount(at, weight[use], len(u)).astype(np.int64), kind)
        return pa.Table.from_batches([rows(out)])

    def place_range(table: pa.Table) -> pa.Table:
        p = table.column("part")[0].as_py()
        kinds, all_pieces = table.column("kind").to_pylist(), table.column("piece").to_pylist()
        first, end = (-(-q * (begin + 1) // parts) for q in (p, p + 1))
        dense = np.zeros((5, max(0, end - first)), np.int64)
        for kind in range(5):
            if own := [x for x, k in zip(all_pieces, kinds, strict=True) if k == kind]:
                u, n = summed(own)
                dense[kind, u.astype(np.int64) - first] = n
        written(directory, f"places-{p}", *dense)
        low = np.bincount(np.minimum(dense[4], 5), minlength=6)[1:]
        more = [int(dense[4].sum()), int((dense[4] >= 3).sum())]
        return pa.table({"part": pa.array([p], pa.int32()), "low": pa.array([low[:4].tolist() + more], pa.list_(pa.int64()))})

    pairs = saved(text.mapInArrow(bigrams, PIECES).groupBy("part").applyInArrow(pair_range, PIECES), "lm-places")
    # One small row for each range comes to the driver.
    told = {r.part: stretched(bytes(r.piece))[1] for r in pairs.where("kind = 9").collect()}
    model.pairs = {p: int(n[4]) for p, n in told.items()}
    high = np.sum([n[:4] for n in told.values()], 0)
    got = pairs.where("kind <> 9").groupBy("part").applyInArrow(place_range, "part int, low array<long>").collect()
    low = np.sum([r.low for r in got], 0)
    model.high, model.low, model.types = discounts(high), discounts(low), int(low[4])
    model.low_left = float(model.low[1] * low[0] + model.low[2] * low[1] + model.low[3] * low[5]) / model.types
    return model


def followers(model: Model, cc: np.ndarray) -> np.ndarray:
    """The lower order: probability of a word by how many contexts it followed, interpolated with the uniform one over the vocabulary and one unknown."""
    return np.maximum(cc - model.low[np.minimum(cc, 3)], 0) / max(model.types, 1) + model.low_left / (model.size + 1)


def block_scores(model: Model, w: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each text of a block: known tokens, base and model log10 probability."""
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    h, back = np.unique(w, return_inverse=True)
    at, (count,) = model.vocabulary().find(h) if model.size else (np.full(len(h), -1), [np.zeros(len(h), np.int64)])
    base = np.log10((count + 0.1) / (model.total + 0.1 * (model.size + 1)))[back]
    known = (count > 0)[back]
    if not model.size:
        return np.add.reduceat(known, start, dtype=np.int64), np.add.reduceat(base, start), np.add.reduceat(np.full(len(w), np.log10(1.0)), start)
    # Places ascend with hashes, so that at is sorted where it isn't -1.
    cc = np.zeros(len(h), np.int64)
    total, *seen = (np.zeros(len(h) + 1, np.int64) for _ in range(4))
    there = at >= 0
    ctx = np.append(at[there], model.size)
    *values, follow = model.dense("places", ctx, 5)
    cc[there] = follow[:-1]
    for own, v in zip((total, *seen), values, strict=True):
        own[:-1][there], own[-1] = v[:-1], v[-1]
    lower = followers(model, cc)[back]
    left = sum(d * s for d, s in zip(model.high[1:], seen, strict=True)) / np.maximum(total, 1)
    before = np.concatenate([[len(h)], back[:-1]])
    before[start] = len(h)
    place = np.append(at, model.size)
    both = (place[before] >= 0) & (at[back] >= 0)
    key = mix(place[before][both].astype(np.uint64) << _U(32) | at[back][both].astype(np.uint64))
    u, where = np.unique(key, return_inverse=True)
    c = np.zeros(len(w), np.int64)
    c[both] = model.bigrams().find(u)[1][0][where]
    t = total[before]
    p = np.where(t > 0, np.maximum(c - model.high[np.minimum(c, 3)], 0) / np.maximum(t, 1) + left[before] * lower, lower)
    return np.add.reduceat(known, start, dtype=np.int64), np.add.reduceat(base, start), np.add.reduceat(np.log10(p), start)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score and perplexity of every row."""
    small_batches(docs.sparkSession)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, got = [], []
            for w, n in tokens(b.column("text"), LOOKED_UP):
                size.append(n)
                got.append(block_scores(model, w, n))
            if got:
                n = np.concatenate(size)
                known, base, score = (np.concatenate([g[i] for g in got]) for i in range(3))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, (n, known, base, score, 10 ** np.minimum(-score / n, 300)))], ["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return text_rows(docs, "doc_id").mapInArrow(passed, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double, perplexity double")
