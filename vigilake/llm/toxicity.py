"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned from half of a bounded sample of labelled texts (SAMPLE rows, least hash
first): words, and beginnings of words, that toxic texts have far more often than others; a
short public list of insults is added. The trees are fitted on the other half, the calibration
on their out-of-fold predictions. Features of a text: lexicon densities, how near a second
person stands to a hit, capitals, punctuation and obfuscation rates.

The model is a few thousand numbers, so that every document is scored where it is read; only
the sample moves. Null and empty texts have the features of no words and get a score like any
other; repeated rows score alike. Without labels of both kinds every score is the share of
toxic ones, or 0. The labels of rows whose crc32(doc_id) mod 5 is 0 are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.llm.shared import blocks, hash_runs, mix, runs, saved, small_batches, text_rows, utf8

#: Bound of the labelled sample, and of the lexicon.
SAMPLE, LEXICON = 20_000, 4096
#: A lexicon entry needs this many toxic texts of the sample and this log-odds.
LEAST_TEXTS, LEAST_ODDS = 3, 2.5
#: Bytes of the word beginnings that count as stems.
STEMS = (4, 5, 6, 7)
#: Insults to begin with, and second persons of the languages at hand.
INSULTS = ("idiot", "stupid", "moron", "loser", "trash", "scum", "pathetic", "worthless", "disgusting", "dumb", "bastard", "jerk", "fool", "ugly", "hate", "kill", "shut", "dummkopf", "arschloch", "imbecile", "connard", "salaud", "idiota", "imbecil")
SECOND = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "sie", "tu", "te", "toi", "vous", "votre", "ton", "usted", "ti", "tus")

_U = np.uint64
_LETTER, _UPPER, _PUNCT, _DIGIT, _SPACE = (np.zeros(256, bool) for _ in range(5))
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER[65:91] = True
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_DIGIT[48:58] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _keys(words: tuple[str, ...]) -> np.ndarray:
    data, off = utf8(pa.array(words))
    return np.sort(hash_runs(data, np.ones(len(data), bool), off[:-1], off[1:]))


def _member(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where each x stands in the sorted table, or -1."""
    if not len(table):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[at] == x, at, -1)


@dataclass
class Words:
    """The words (runs of letters) of a block of lower-cased texts."""

    key: np.ndarray  # of whole words
    stems: list[np.ndarray]  # keys of the beginnings; 0 where a word is no longer than it
    doc: np.ndarray
    first: np.ndarray


def _words(data: np.ndarray, off: np.ndarray) -> Words:
    inside = _LETTER[data]
    starts, ends, first = runs(inside, off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    stems = []
    for k in STEMS:
        long = ends - starts > k
        key = np.zeros(len(starts), np.uint64)
        if long.any():
            at = starts[long]
            cut = np.zeros(len(data), bool)
            for d in range(k):
                cut[at + d] = True
            key[long] = mix(hash_runs(data, cut, at, at + k) + _U(k))
        stems.append(key)
    return Words(hash_runs(data, inside, starts, ends), stems, doc, first)


@dataclass
class Lexicon:
    key: np.ndarray
    odds: np.ndarray


FEATURES = ("words", "insults", "hits", "hit_density", "stem_hits", "stem_density", "best", "sum", "second", "near", "capitals", "shouts", "punctuation", "marks", "obfuscation", "digits")


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """A row of FEATURES for each text."""
    out = np.zeros((len(texts), len(FEATURES)))
    insults, second = _keys(INSULTS), _keys(SECOND)
    odds = np.append(lexicon.odds, -np.inf)  # of none, at -1
    raw, raw_off = utf8(texts)
    low, low_off = utf8(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    for i, j in blocks(raw_off):
        n = j - i
        w = _words(low[low_off[i] : low_off[j]], low_off[i : j + 1] - low_off[i])
        words = np.diff(w.first)
        per = 100 / np.maximum(words, 1)

        def count(mask: np.ndarray, doc: np.ndarray, n: int = n) -> np.ndarray:
            return np.bincount(doc[mask], minlength=n)

        whole = _member(w.key, lexicon.key)
        stem = np.full(len(w.key), -1)
        for s in w.stems:
            m = _member(s, lexicon.key)
            stem = np.where(odds[m] > odds[stem], m, stem)
        rude = _member(w.key, insults) >= 0
        best, total = np.zeros(n), np.zeros(n)
        for at in (whole, stem):
            k = np.flatnonzero(at >= 0)
            np.maximum.at(best, w.doc[k], odds[at[k]])
            total += np.bincount(w.doc[k], odds[at[k]], n)
        hit = (whole >= 0) | (stem >= 0) | rude
        you = _member(w.key, second) >= 0
        # Words between a hit and the nearest second person of the same text.
        near = np.full(n, 50.0)
        h, y = np.flatnonzero(hit), np.flatnonzero(you)
        if len(h) and len(y):
            r = np.searchsorted(y, h)
            for q in (np.maximum(r - 1, 0), np.minimum(r, len(y) - 1)):
                same = w.doc[y[q]] == w.doc[h]
                np.minimum.at(near, w.doc[h[same]], np.abs(y[q] - h)[same])
        data, off = raw[raw_off[i] : raw_off[j]], raw_off[i : j + 1] - raw_off[i]

        def bytes_(mask: np.ndarray, off: np.ndarray = off) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(mask)])[off])

        size, letters = np.maximum(np.diff(off), 1), np.maximum(bytes_(_LETTER[data]), 1)
        starts, ends, first = runs(~_SPACE[data], off)
        doc = np.repeat(np.arange(n), np.diff(first))
        upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
        shout = (upper[ends] - upper[starts] >= 3) & (upper[ends] - upper[starts] >= 0.6 * (ends - starts))
        # A digit or sign between two letters of one word.
        odd = np.zeros(len(data), bool)
        if len(data) > 2:
            odd[1:-1] = (_DIGIT | _PUNCT)[data[1:-1]] & _LETTER[data[:-2]] & _LETTER[data[2:]]
            # Neighbours are of the same text.
            some = off[1:] > off[:-1]
            odd[off[:-1][some]] = odd[off[1:][some] - 1] = False
        odd = np.concatenate([[0], np.cumsum(odd)])
        tokens = 100 / np.maximum(np.diff(first), 1)
        out[i:j] = np.stack([
            np.log1p(words), count(rude, w.doc) * per, np.log1p(count(whole >= 0, w.doc)), count(whole >= 0, w.doc) * per, np.log1p(count(stem >= 0, w.doc)), count(stem >= 0, w.doc) * per,
            best, np.log1p(total), count(you, w.doc) * per, near, bytes_(_UPPER[data]) / letters, count(shout, doc) * tokens, bytes_(_PUNCT[data]) / size,
            bytes_((data == 33) | (data == 63)) / size, count(odd[ends] > odd[starts], doc) * tokens, bytes_(_DIGIT[data]) / size,
        ], 1)
    return out


@dataclass
class Trees:
    """Boosted trees of one depth; node k has the children 2k+1 and 2k+2."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += leaf[at - (2**self.depth - 1)]
        return out


def boosted(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, ridge: float = 2.0, bins: int = 48) -> Trees:
    """Logistic boosting on histograms of quantiles."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    code = np.stack([np.searchsorted(q, c, "left") for q, c in zip(cuts, x.T, strict=True)], 1)
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(p0 / (1 - p0)))
    raw, inner = np.full(len(y), start), 2**depth - 1
    feature, cut, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        f, c, at = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), int)
        for level in range(depth):
            base, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            for k, q in enumerate(cuts):
                b = len(q) + 1
                cell = (at - base) * b + code[:, k]
                gs, hs = (np.cumsum(np.bincount(cell, v, width * b).reshape(width, b), 1) for v in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain = np.where((hs < 0.5) | (ht - hs < 0.5), 0, gain)[:, :-1]
                if not gain.shape[1]:
                    continue
                top = gain.argmax(1)
                for node in np.flatnonzero(gain[np.arange(width), top] > best):
                    best[node] = gain[node, top[node]]
                    f[base + node], c[base + node] = k, q[top[node]]
            at = 2 * at + 1 + (x[np.arange(len(y)), f[at]] > c[at])
        at -= inner
        leaf = -rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + ridge)
        raw += leaf[at]
        feature.append(f)
        cut.append(c)
        leaves.append(leaf)
    return Trees(np.array(feature), np.array(cut), np.array(leaves), start, depth)


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step function nearest to y, by pooling adjacent violators."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []
    for x, v in zip(raw[order], y[order], strict=True):
        pools.append([x, x, float(v), 1.0])
        while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
            _, hi, s, n = pools.pop()
            pools[-1] = [pools[-1][0], hi, pools[-1][2] + s, pools[-1][3] + n]
    x = np.array([v for lo, hi, *_ in pools for v in (lo, hi)])
    return x, np.repeat([(s + 0.25 * y.mean()) / (n + 0.25) for *_, s, n in pools], 2)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.knots[1][0])
        return np.clip(np.interp(self.trees.raw(features(texts, self.lexicon)), *self.knots), 0, 1)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def _lexicon(sample: DataFrame) -> Lexicon:
    """From the texts of the sample's lexicon half, each distinct text counted once."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            data, off = utf8(pc.utf8_lower(pc.fill_null(b.column("text").cast(pa.large_string()), "")))
            toxic = b.column("toxic").to_numpy()
            for i, j in blocks(off):
                w = _words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                for key in (w.key, *w.stems):
                    pair = np.unique(np.stack([w.doc[key != 0].astype(np.uint64), key[key != 0]]), axis=1) if len(key) else np.zeros((2, 0), np.uint64)
                    seen.append((pair[1], toxic[i + pair[0].astype(int)]))
        if seen:
            key, at = np.unique(np.concatenate([k for k, _ in seen]), return_inverse=True)
            y = np.concatenate([v for _, v in seen])
            n, pos = np.bincount(at, minlength=len(key)), np.bincount(at, y, len(key)).astype(int)
            keep = pos > 0
            yield pa.RecordBatch.from_arrays([pa.array(key[keep].view(np.int64)), pa.array(pos[keep]), pa.array((n - pos)[keep])], ["key", "pos", "neg"])

    half = sample.where("half = 0")
    sizes = {r.toxic: r["count"] for r in half.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    by = half.select("text", "toxic").mapInArrow(counted, "key long, pos long, neg long").groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (n1 + 1)) - F.log((F.col("neg") + 0.5) / (n0 + 1))
    top = by.where(F.col("pos") >= LEAST_TEXTS).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS).orderBy(F.desc("odds"), "key").limit(LEXICON).collect()
    top.sort(key=lambda r: r.key & (2**64 - 1))
    return Lexicon(np.array([r.key for r in top], np.int64).view(np.uint64), np.array([r.odds for r in top], float))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from at most SAMPLE labelled rows outside the held-out fifth."""
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    # At most SAMPLE pairs of numbers, so the broadcast is bounded.
    sample = text_rows(docs.drop("toxic"), "doc_id").join(F.broadcast(ids), "doc_id").groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    sample = saved(sample.withColumn("half", F.pmod("h", F.lit(2))), "toxicity-sample")
    lexicon = _lexicon(sample)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column("text"), lexicon)
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("toxic"), pa.array(list(x), pa.list_(pa.float64()))], ["h", "toxic", "x"])

    rows = sample.where("half = 1").mapInArrow(measured, "h long, toxic int, x array<double>").orderBy("h").collect()
    y = np.array([r.toxic for r in rows], float)
    if not len(y) or y.min() == y.max():
        return Model(lexicon, None, (np.zeros(1), np.array([y.mean() if len(y) else 0.0])))
    x, fold = np.array([r.x for r in rows]), np.arange(len(y)) % 3
    raw = np.zeros(len(y))
    for k in range(3):
        raw[fold == k] = boosted(x[fold != k], y[fold != k]).raw(x[fold == k])
    return Model(lexicon, boosted(x, y), isotonic(raw, y))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    small_batches(docs.sparkSession)
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spread.value.score(b.column("text")))], ["doc_id", "score"])

    return text_rows(docs, "doc_id").mapInArrow(passed, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def clean(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows that score below the limit, with all their columns."""
    small_batches(docs.sparkSession)
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pc.fill_null(b.column("text").cast(pa.large_string()), "")
            yield b.filter(pa.array(spread.value.score(text) < limit))

    return docs.mapInArrow(passed, docs.schema)
