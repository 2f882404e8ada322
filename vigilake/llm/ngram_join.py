"""Jaccard join on word shingles by T-occurrence search over inverted lists.

DivideSkip merges a query's short lists and probes its long ones by binary search for what the
short ones brought up. Here every document is a query at once:

1. One pass makes each document's set of shingle hashes, its size and a 128-bit digest of the
   set; equal sets are one class from here on, its least doc_id stands for it. The same pass
   counts, task by task, which shingles are common.
2. Sets are ordered by hash, common shingles last and the most frequent of them at the end. To
   reach T of n shingles, a document must occur in one of the n - T + 1 lists that come first:
   these are the short lists, and only they are posted; the others are the long ones. The order
   is the same for all; a shingle wrongly taken for rare costs time, never a link.
3. Lists are merged as streams, sorted by Spark. Those of up to SMALL_LIST documents give all
   their pairs; a longer one gives the pairs of its leader (the document made most of common
   shingles, so rather the original than a copy) with all others, and its rest waits for 5.
   Pairs that sizes and positions rule out are dropped.
4. A signature of each set (how many of its hashes fall into each of CELLS cells) bounds a
   pair's overlap by the sum of the lesser counts; pairs below what they need go before any text
   moves. For the others DivideSkip goes on with all lists of a leader over its candidates: the
   short ones are merged with a heap, the survivors probed for in the long ones, and those kept
   that reach the overlap which the two sizes require. Only texts of candidates move.
5. Long lists that still hold several components are cut into blocks of BLOCK documents; every
   two blocks meet in a task that drops pairs of one component and those that sizes, positions
   and signatures rule out, and the others are verified as well. So no link between components
   is lost, though the pairs within one are not all made, and no list is one task's.

Null text is empty; an empty document has size 0 and links with nothing; rows of one doc_id are
one document, linked if any of their texts is; a null doc_id links with nothing and has a null
component. An empty table gives no rows. Other columns are ignored by the join and kept, whatever they
are called, by what removes copies.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.llm.components import components
from vigilake.llm.shared import Marks, blocks, grown, mix, saved, small_batches, text_rows, utf8, word_hashes

#: A shingle is common if HOT_LEAST documents have it; of more than about HOT_MOST, the most frequent are taken, so that 9 MB go to the tasks. Counts are told apart in HOT_STEPS steps from one power of two to the next.
HOT_LEAST, HOT_MOST, HOT_STEPS = 16, 1_000_000, 64
#: A task tells of shingles that this many of its documents have, counting about so many at a time.
HOT_TOLD, HOT_BLOCK = 3, 4_000_000
#: Cells of a set's signature.
CELLS = 128
#: Lists up to this length give all pairs at once.
SMALL_LIST = 12
#: Documents of a block of a long list, rows of lists that a task looks at together, and the longest table that is broadcast.
BLOCK, ROWS, FEW = 1024, 1 << 16, 50_000
#: Parts into which rows of one key are dealt where the other side is too long to broadcast.
SALTS = 16
#: DivideSkip's weight of a binary probe against a heap step.
MU = 0.0085

_U = np.uint64
_M = _U(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array | pa.ChunkedArray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles; of all its words where it has fewer."""
    data, off = utf8(texts)
    for i, j in blocks(off):
        w, first = word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i])
        h = np.zeros(max(0, len(w) - k + 1), np.uint64)
        for d in range(k):
            h = h * _M + w[d : d + len(h)]
        h = mix(h)
        for s, e in zip(first[:-1], first[1:], strict=True):
            if e - s >= k:
                yield np.unique(h[s : e - k + 1])
            elif e > s:
                acc = np.array([e - s], np.uint64)
                for x in w[s:e]:
                    acc = acc * _M + x
                yield mix(acc)
            else:
                yield np.zeros(0, np.uint64)


def required(n: int | np.ndarray, m: int | np.ndarray, t: tuple[int, int]) -> int | np.ndarray:
    """The least overlap of sets of n and m with Jaccard >= t = (numerator, denominator)."""
    return -(-t[0] * (n + m) // (t[0] + t[1]))


def divide_skip(query: np.ndarray, sets: list[np.ndarray], t: tuple[int, int]) -> np.ndarray:
    """Which of the sets reach the overlap with the query that Jaccard >= t needs."""
    sizes = np.array([len(s) for s in sets])
    need = np.maximum(1, required(len(query), sizes, t))
    values = np.concatenate(sets)
    at = np.minimum(np.searchsorted(query, values), max(0, len(query) - 1))
    own = np.repeat(np.arange(len(sets)), sizes)
    same = query[at] == values if len(query) else np.zeros(len(values), bool)
    at, own = at[same], own[same]
    order = np.argsort(at, kind="stable")
    own, length = own[order], np.bincount(at, minlength=len(query))
    start = np.concatenate([[0], np.cumsum(length)])
    least = int(need.min())
    by_length = np.argsort(-length, kind="stable")
    most = int(length.max()) if len(length) else 0
    n_long = min(least - 1, int(least / (MU * math.log2(most) + 1))) if most else 0
    long, short = by_length[:n_long], by_length[n_long:]
    count = np.zeros(len(sets), np.int64)
    for i in heapq.merge(*(own[start[s] : start[s + 1]].tolist() for s in short if length[s])):
        count[i] += 1
    left = np.flatnonzero(count >= need - len(long))
    for s in long:
        held = own[start[s] : start[s + 1]]
        if not len(held):
            break
        p = np.minimum(np.searchsorted(held, left), len(held) - 1)
        count[left] += held[p] == left
    return count >= need


def signature(s: np.ndarray) -> bytes:
    """How many of the set fall into each cell, up to 255."""
    return np.minimum(np.bincount((s >> _U(20) & _U(CELLS - 1)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes()


def overlap_bound(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The most that sets with these signatures (rows) may share; full cells say nothing."""
    return np.where((x == 255) & (y == 255), 1 << 30, np.minimum(x, y).astype(np.int64)).sum(1)


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """A row of each document (kind 0: a is doc_id, n the size, b and c the set's digest, cells its signature) and of each shingle that a task finds common (kind 1: a is the hash, n a count)."""

    names = ["kind", "a", "n", "b", "c", "cells"]

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def told() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            held.clear()
            h, n = h[n >= HOT_TOLD].view(np.int64), n[n >= HOT_TOLD]
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(h), np.int8)), pa.array(h), pa.array(n), pa.array(h), pa.array(h), pa.nulls(len(h), pa.binary())], names)

        for batch in batches:
            n, b, c, cells = [], [], [], []
            for s in shingle_sets(batch.column("text"), k):
                n.append(len(s))
                b.append(mix(s).sum(dtype=np.uint64))
                c.append(mix(s ^ _M).sum(dtype=np.uint64))
                cells.append(signature(s))
                held.append(s)
            d = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (b, c)]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int8)), batch.column("doc_id"), pa.array(n, pa.int64()), *d, pa.array(cells, pa.binary())], names)
            if sum(map(len, held)) > HOT_BLOCK:
                yield told()
        yield told()

    return saved(text_rows(docs, "doc_id").mapInArrow(passed, "kind byte, a long, n long, b long, c long, cells binary"), "join-sets")


def _most_common(told: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes of the HOT_MOST shingles of the highest counts, and the logarithms of these; told: a (the hash), n.

    Of the last step of counts that has room, shingles below a hash are taken. They come as bytes, a row a
    task: as rows they would take half a kilobyte each on the driver, and a sort with a limit brings HOT_MOST of every task.
    """
    step = F.floor(F.log2("n") * HOT_STEPS)
    room, last, share = HOT_MOST, -1, 1.0
    for r in told.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        if r["count"] > room:
            last, share = r["step"], room / r["count"]
            break
        room -= r["count"]
    # Hashes are evenly spread.
    kept = told.where((step > last) | (step == last) & (F.shiftrightunsigned("a", 32) < int(share * (1 << 32))))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("a").to_numpy(), b.column("often").to_numpy()) for b in batches if b.num_rows]
        if held:
            a, often = (np.concatenate(x) for x in zip(*held, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (a, often)], ["a", "often"])

    found = kept.select("a", F.floor(F.log2("n")).cast("byte").alias("often")).mapInArrow(packed, "a binary, often binary").collect()
    key, often = (np.frombuffer(b"".join(r[c] for r in found), kind) for c, kind in (("a", np.uint64), ("often", np.uint8)))
    order = np.argsort(key)
    return key[order], often[order]


def _prefixes(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray], k: int, t: tuple[int, int]) -> DataFrame:
    """doc_id, n, rare (thousandths of the set that are not common) and the prefix of each document; from `common` on its shingles are common ones. hot: their sorted hashes and the logarithms of their counts."""
    spread = docs.sparkSession.sparkContext.broadcast(hot)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = spread.value
        for b in batches:
            n, rare, common, out = [], [], [], []
            for s in shingle_sets(b.column("text"), k):
                at = np.minimum(np.searchsorted(known, s), max(0, len(known) - 1))
                own = known[at] == s if len(known) else np.zeros(len(s), bool)
                first = len(s) - -(-t[0] * len(s) // t[1]) + 1 if len(s) else 0
                n.append(len(s))
                light = int((~own).sum())
                rare.append(1000 * light // max(1, len(s)))
                common.append(light)
                out.append(np.concatenate([s[~own], s[own][np.argsort(often[at[own]], kind="stable")]])[:first].view(np.int64))
            sizes = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int32()), pa.array(rare, pa.int32()), pa.array(common, pa.int32()), lists], ["doc_id", "n", "rare", "common", "prefix"])

    return text_rows(docs, "doc_id").mapInArrow(passed, "doc_id long, n int, rare int, common int, prefix array<long>")


def _possible(n: np.ndarray, m: np.ndarray, p: np.ndarray, q: np.ndarray, t: tuple[int, int]) -> np.ndarray:
    """Whether sets of n and m that first share what stands at p and q may reach the overlap."""
    return np.minimum(n - p, m - q) >= required(n, m, t)


def _short_lists(posts: DataFrame, t: tuple[int, int]) -> DataFrame:
    """Pairs from the lists (kind 0: a the leading, b the other), and the rows of longer lists (kind 1); posts come sorted by hash, rare and doc."""
    names = ["hash", "doc", "n", "rare", "pos"]

    def told(rows: list[np.ndarray], going_on: bool, last: bool) -> tuple[pa.RecordBatch, list[np.ndarray], bool]:
        """What whole lists give, and what to keep of the last one, which may go on: all of a short one, the leader of a long one (going_on)."""
        h, doc, n, rare, pos = rows
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(start, len(h)))
        big = size > SMALL_LIST
        big[0] |= going_on
        kept = [x[:0] for x in rows]
        first_told = int(going_on)
        goes = False
        if not last:
            goes = bool(big[-1])
            kept = [x[start[-1] : start[-1] + 1 if goes else None] for x in rows]
            if not goes:
                start, size, big = start[:-1], size[:-1], big[:-1]
        a, b = [], []
        for g in range(2, SMALL_LIST + 1):
            s = start[(size == g) & ~big]
            for i in range(g):
                for j in range(i + 1, g):
                    a.append(s + i)
                    b.append(s + j)
        lead = np.repeat(start[big], size[big])
        rest = lead + np.arange(len(lead)) - np.repeat(np.concatenate([[0], np.cumsum(size[big])[:-1]]).astype(np.int64), size[big]) if len(lead) else lead
        a, b = np.concatenate([*a, lead]), np.concatenate([*b, rest])
        ok = (doc[a] != doc[b]) & _possible(n[a], n[b], pos[a], pos[b], t)
        pair = np.unique(np.stack([doc[a[ok]], doc[b[ok]]], 1), axis=0)
        rest = rest[rest >= first_told]
        zeros = np.zeros(len(pair), np.int64)
        cols = [np.concatenate([np.zeros(len(pair), np.int8), np.ones(len(rest), np.int8)]), np.concatenate([pair[:, 0], doc[rest]]), np.concatenate([pair[:, 1], h[rest]]), *(np.concatenate([zeros, x[rest]]) for x in (n, rare, pos))]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], ["kind", "a", "b", "n", "rare", "pos"]), kept, goes

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, going_on, held, count = [np.zeros(0, np.int64)] * 5, False, [], 0
        for b in batches:
            held.append([b.column(c).to_numpy().astype(np.int64) for c in names])
            count += b.num_rows
            if count >= ROWS:
                out, kept, going_on = told([np.concatenate(x) for x in zip(kept, *held, strict=True)], going_on, False)
                held, count = [], 0
                yield out
        rows = [np.concatenate(x) for x in zip(kept, *held, strict=True)]
        if len(rows[0]):
            yield told(rows, going_on, True)[0]

    return posts.select(*names).mapInArrow(passed, "kind byte, a long, b long, n long, rare long, pos long")


def _joined_to(rows: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """An inner join to a saved table of one row a key: broadcast if it is short, else with the rows of a key dealt to SALTS tasks."""
    if small.count() <= FEW:
        return rows.join(F.broadcast(small), key)
    salted = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).join(grown(salted), [key, "salt"]).drop("salt")


def _across(rows: DataFrame, lists: DataFrame, t: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of documents from different components of a list that may reach the overlap; rows: hash, doc, n, rare, pos, component, cells; lists: hash, k (how long)."""
    cut = _joined_to(rows, lists.select("hash", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks")), "hash").withColumn("block", F.pmod(F.xxhash64("doc", "hash"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select(F.xxhash64("hash", F.least("block", "other"), F.greatest("block", "other")).alias("cell"), "hash", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "doc", "n", "rare", "pos", "component", "cells")

    def paired(table: pa.Table) -> pa.Table:
        doc, n, rare, pos, component, block = (table.column(c).to_numpy().astype(np.int64) for c in ("doc", "n", "rare", "pos", "component", "block"))
        cells = np.frombuffer(b"".join(table.column("cells").to_pylist()), np.uint8).reshape(-1, CELLS)
        order = np.lexsort((doc, rare))
        low = table.column("low")[0].as_py()
        inside = low == table.column("high")[0].as_py()
        x, y = (order, order) if inside else (order[block[order] == low], order[block[order] != low])
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s in range(0, len(x), 256):
            i, j = x[s : s + 256, None], y[None, :]
            ok = (component[i] != component[j]) & (t[0] * np.maximum(n[i], n[j]) <= t[1] * np.minimum(n[i], n[j])) & _possible(n[i], n[j], pos[i], pos[j], t)
            if inside:
                ok &= np.arange(s, min(s + 256, len(x)))[:, None] < np.arange(len(y))[None, :]
            p, q = np.nonzero(ok)
            for e in range(0, len(p), 1 << 14):
                u, v = x[s + p[e : e + (1 << 14)]], y[q[e : e + (1 << 14)]]
                keep = overlap_bound(cells[u], cells[v]) >= required(n[u], n[v], t)
                a.append(u[keep])
                b.append(v[keep])
        u, v = np.concatenate(a), np.concatenate(b)
        ahead = (rare[u] < rare[v]) | (rare[u] == rare[v]) & (doc[u] < doc[v])
        return pa.table({"a": pa.array(doc[np.where(ahead, u, v)]), "b": pa.array(doc[np.where(ahead, v, u)])})

    return saved(cut.groupBy("cell", "hash").applyInArrow(paired, "a long, b long").distinct(), "join-across")


def _may(n: Column, m: Column, p: Column, q: Column, t: tuple[int, int]) -> Column:
    return (t[0] + t[1]) * F.least(n - p, m - q) >= t[0] * (n + m)


def _plausible(pairs: DataFrame, sizes: DataFrame, t: tuple[int, int]) -> DataFrame:
    """The pairs whose signatures leave room for the overlap that they need; sizes: doc_id, n and cells."""
    x, y = (sizes.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("cells").alias(f"cells_{c}")) for c in "ab")
    both = pairs.join(grown(y), "b").join(grown(x), "a").where(t[0] * F.greatest("n_a", "n_b") <= t[1] * F.least("n_a", "n_b"))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, CELLS) for c in ("cells_a", "cells_b")]
            n, m = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            keep = pa.array(np.flatnonzero(overlap_bound(*cells) >= required(n, m, t)))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(keep) for c in ("a", "b")], ["a", "b"])

    return saved(both.select("a", "b", "n_a", "n_b", "cells_a", "cells_b").mapInArrow(passed, "a long, b long"), "join-plausible")


def _verified(docs: DataFrame, pairs: DataFrame, k: int, t: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    marks = Marks(ends.select(F.xxhash64("doc_id").alias("key")), "key")
    hashed = text_rows(docs, "doc_id").where("doc_id is not null").withColumn("key", F.xxhash64("doc_id"))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array(np.flatnonzero(marks.hit(b.column("key").to_numpy())))
            yield pa.RecordBatch.from_arrays([b.column(c).take(keep) for c in ("doc_id", "text")], ["doc_id", "text"])

    texts = hashed.mapInArrow(wanted, "doc_id long, text string")
    x, y = (grown(texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))) for c in "ab")
    both = pairs.join(y, "b").join(x, "a")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            # Rows come sorted by a, so that a leader's candidates are neighbours.
            a, text = batch.column("a").to_numpy(), batch.column("text_a")
            sets = list(shingle_sets(batch.column("text_b"), k))
            start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            leaders = shingle_sets(text.take(pa.array(start)), k)
            ok = np.zeros(len(a), bool)
            for s, e, q in zip(start, np.append(start[1:], len(a)), leaders, strict=True):
                ok[s:e] = divide_skip(q, sets[s:e], t)
            keep = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(keep) for c in ("a", "b")], ["a", "b"])

    return saved(both.select("a", "b", "text_a", "text_b").mapInArrow(checked, "a long, b long"), "join-links")


def joined(docs: DataFrame, k: int = 5, t: tuple[int, int] = (4, 5)) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of documents."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = _sets(docs, k)
    own = sets.where("kind = 0").select(F.col("a").alias("doc_id"), "n", "b", "c", "cells")
    hot = _most_common(saved(sets.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_LEAST), "join-hot"))
    # Of each set, the least doc_id; what is empty or has no doc_id takes no part.
    linkable = own.where("n > 0 and doc_id is not null")
    classes = saved(linkable.groupBy("n", "b", "c").agg(F.min("doc_id").alias("class")), "join-classes")
    posts = _prefixes(docs, hot, k, t).join(grown(classes.select(F.col("class").alias("doc_id"))), "doc_id", "left_semi")
    posts = posts.select(F.col("doc_id").alias("doc"), "n", "rare", "common", F.posexplode("prefix").alias("pos", "hash")).withColumn("is_hot", F.col("pos") >= F.col("common"))
    columns = ["hash", "doc", "n", "rare", "pos"]
    short = saved(_short_lists(posts.where("not is_hot").select(*columns).repartition("hash").sortWithinPartitions("hash", "rare", "doc"), t), "join-lists")
    common = saved(posts.where("is_hot").select(*columns), "join-common")
    leaders = saved(common.groupBy("hash").agg(F.count("*").alias("k"), F.min(F.struct("rare", "doc", "n", "pos")).alias("lead")).where("k > 1").select("hash", "lead"), "join-leaders")
    led = _joined_to(common, leaders, "hash").where((F.col("doc") != F.col("lead.doc")) & _may(F.col("n"), F.col("lead.n"), F.col("pos"), F.col("lead.pos"), t)).select(F.col("lead.doc").alias("a"), F.col("doc").alias("b"))
    pairs = saved(short.where("kind = 0").select("a", "b").unionByName(led).distinct(), "join-pairs")
    sizes = linkable.select("doc_id", "n", "cells")
    links = _verified(docs, _plausible(pairs, sizes, t), k, t)
    found = saved(components(links), "join-components")

    # Long lists that the leaders have not brought together.
    open_ = short.where("kind = 1").select(F.col("b").alias("hash"), F.col("a").alias("doc"), "n", "rare", "pos").unionByName(common.select("hash", "doc", F.col("n").cast("long").alias("n"), F.col("rare").cast("long").alias("rare"), F.col("pos").cast("long").alias("pos")))
    open_ = saved(open_.join(grown(found.withColumnRenamed("node", "doc")), "doc", "left").withColumn("component", F.coalesce("component", "doc")), "join-open")
    several = saved(open_.groupBy("hash").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("k")).where("least <> most").select("hash", "k"), "join-several")
    more = None
    if several.count():
        left = _joined_to(open_, several.select("hash"), "hash").join(grown(sizes.select(F.col("doc_id").alias("doc"), "cells").dropDuplicates(["doc"])), "doc")
        rest = _across(left, several, t).join(grown(pairs), ["a", "b"], "left_anti")
        more = _verified(docs, rest, k, t)
        links = links.unionByName(more)
    # Rows of one doc_id that hold different sets bring the classes of these together.
    differ = linkable.groupBy("doc_id").agg(F.min(F.struct("n", "b", "c")).alias("x"), F.max(F.struct("n", "b", "c")).alias("y")).where("x <> y").select("doc_id")
    same = saved(linkable.join(grown(differ), "doc_id", "left_semi").join(grown(classes), ["n", "b", "c"]).select(F.col("doc_id").alias("a"), F.col("class").alias("b")), "join-same")
    if same.where("a <> b").count():
        links = links.unionByName(same)
        more = same
    if more is not None and more.count():
        found = saved(components(links), "join-components")

    named = linkable.join(grown(classes), ["n", "b", "c"]).select("doc_id", "n", "class")
    out = named.join(grown(found), F.col("class") == F.col("node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "class").alias("component_id"))
    return out.unionByName(own.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def deduplicated(docs: DataFrame, k: int = 5, t: tuple[int, int] = (4, 5)) -> DataFrame:
    """One document of each group of linked ones, that of the least doc_id, with all its columns; rows without doc_id stay.

    Rows of one doc_id stay or go together; of those with the same text, the first by the other columns stays.
    """
    first = saved(joined(docs, k, t).where("doc_id = component_id").select(F.col("doc_id").alias("first")).distinct(), "join-first")
    # The row is one column, so that none of its own can clash.
    whole = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct("*").alias("row"))
    kept = whole.where("id is not null").join(grown(first), F.col("id") == F.col("first"), "left_semi")
    plain = [f"row.`{f.name}`" for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    kept = kept.groupBy("id", F.xxhash64("row.text").alias("hash"), F.col("row.text").alias("text")).agg(F.min_by("row", F.xxhash64(*plain)).alias("row"))
    return kept.select("row").unionByName(whole.where("id is null").select("row")).select("row.*")
