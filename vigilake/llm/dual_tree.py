"""Centroid clustering: Lloyd's rounds in which a tree over vectors meets a tree over centroids.

Vectors become integers, so that every distance, sum and centroid is exact and no result depends on
how the rows lie. A task reads its vectors in blocks and builds a cover tree over each: centres are
taken farthest first, so that those of a level are a prefix of those below it, lie further apart than
the level's scale, and cover all points within it. The blocks are written once, as rows of arrays.
Each round sends the centroids (at most k) to the tasks, which build a tree over them too and walk
both level by level: a pair of nodes is dropped when its least distance exceeds the greatest that any
point of the vector node has to some centroid; a vector node that is left with one centroid is
settled as a whole, by its sums; pairs of leaves are compared exactly, in integers. Tasks give at
most k rows of sums each. Nothing is shuffled but these rows.

Vectors that are null, of another length, or hold null or non-finite components are left out.
Repeated rows count each, null ids too; equal hashes of ids are taken in the order of id and vector.
An empty table gives no rows; fewer vectors than k give as many centroids. Other columns are
ignored. A component of such magnitude that a squared distance could leave 64 bits is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilake.llm.shared import saved, small_batches

#: Vectors of a block, and leaves of its tree.
BLOCK, LEAVES = 4096, 256
#: A level is kept when it has so many times the nodes of the one above.
GROWTH = 1.5


@dataclass
class Tree:
    """Nodes level by level from the root; the last level's are the leaves, and every node holds the points first..last."""

    level: np.ndarray
    parent: np.ndarray
    centre: np.ndarray  # the place of a point
    radius: np.ndarray
    first: np.ndarray
    last: np.ndarray


def _gaps(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    d = x - at
    return np.einsum("ij,ij->i", d, d)


def cover_tree(points: np.ndarray, leaves: int) -> tuple[np.ndarray, Tree]:
    """The order in which the points are to be held, and the tree over them in that order."""
    x = points.astype(np.float64)
    gap = _gaps(x, x[0])
    near, taken, reach = np.zeros(len(x), np.int64), [0], [np.inf]
    while len(taken) < leaves and (far := int(gap.argmax())) not in taken and gap[far] > 0:
        reach.append(gap[far])
        d = _gaps(x, x[far])
        closer = d < gap
        near[closer], gap[closer] = len(taken), d[closer]
        taken.append(far)
    centres, reach = x[taken], np.sqrt(reach)
    # How many centres lie further apart than each scale; a level for each that grew enough, the last for all.
    counts, scale = [1], reach[1] if len(taken) > 1 else 0.0
    while counts[-1] < len(taken):
        scale /= 2
        n = int((reach > scale).sum())
        if n >= GROWTH * counts[-1] or n == len(taken):
            counts.append(n)
    # The ancestors of each last centre by level: itself, or the nearest of the level above.
    above = [np.arange(len(taken))]
    for n in reversed(counts[:-1]):
        own = above[-1]
        up = np.arange(int(own.max()) + 1)
        for i in range(n, len(up)):
            up[i] = int(_gaps(centres[:n], centres[i]).argmin())
        above.append(up[own])
    above.reverse()
    of = [a[near] for a in above]
    order = np.lexsort(of[::-1])
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    parts, base, before = [], 0, None
    for depth, (n, node) in enumerate(zip(counts, of, strict=True)):
        held = node[order]
        seen, first = np.unique(held, return_index=True)
        by = np.argsort(first)
        seen, first = seen[by], first[by]
        last = np.append(first[1:], len(x))
        far = np.sqrt(np.maximum.reduceat(np.einsum("ij,ij->i", d := x[order] - centres[held], d), first))
        parent = np.full(len(seen), -1) if before is None else base - len(before) + np.searchsorted(before, first, "right") - 1
        parts.append((np.full(len(seen), depth), parent, place[np.array(taken)[seen]], far, first, last))
        base, before = base + len(seen), first
    return order, Tree(*map(np.concatenate, zip(*parts, strict=True)))


def _children(tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Of each node, its first child and how many follow (0 for leaves); children of a node lie side by side."""
    n = len(tree.level)
    count = np.bincount(tree.parent[tree.parent >= 0], minlength=n)
    return np.searchsorted(tree.parent, np.arange(n)), count


def _expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every number of the ranges, and which range it is of."""
    of = np.repeat(np.arange(len(first)), count)
    return np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[of], of


def dual_tree(x: np.ndarray, tree: Tree, centroids: np.ndarray, order: np.ndarray, other: Tree, settle: bool) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]], int]:
    """Nearest centroid and distance of each point (numbers from `order`, ties to the smaller), -1 where a whole node was settled; these nodes as (first, last, centroid); the pairs compared."""
    c = centroids[order]
    xs, cs = x.astype(np.float64), c.astype(np.float64)
    (q_child, q_n), (r_child, r_n) = _children(tree), _children(other)
    q, r = np.zeros(1, np.int64), np.zeros(1, np.int64)
    most = np.full(len(tree.level), np.inf)
    nodes: list[tuple[int, int, int]] = []
    while True:
        dist = np.sqrt(_gaps(xs[tree.centre[q]], cs[other.centre[r]]))
        np.minimum.at(most, q, dist + tree.radius[q])
        # Rounding must not drop a tie.
        keep = dist - tree.radius[q] - other.radius[r] <= most[q] * (1 + 1e-9) + 1e-6
        q, r = q[keep], r[keep]
        if settle:
            left = np.bincount(q, minlength=len(tree.level))
            alone = (left[q] == 1) & (other.last[r] - other.first[r] == 1)
            nodes += zip(tree.first[q[alone]].tolist(), tree.last[q[alone]].tolist(), order[other.first[r[alone]]].tolist(), strict=True)
            q, r = q[~alone], r[~alone]
        if not (q_n[q].any() or r_n[r].any()):
            break
        # Down one level on both sides; leaves stay.
        a, of = _expand(np.where(q_n[q] > 0, q_child[q], q), np.maximum(q_n[q], 1))
        down = a != q[of]
        most[a[down]] = np.minimum(most[a[down]], most[q[of][down]])
        b, by = _expand(np.where(r_n[r[of]] > 0, r_child[r[of]], r[of]), np.maximum(r_n[r[of]], 1))
        q, r = a[by], b
    p, of = _expand(tree.first[q], tree.last[q] - tree.first[q])
    k, by = _expand(other.first[r[of]], (other.last[r] - other.first[r])[of])
    p = p[by]
    near, away = np.full(len(x), -1, np.int64), np.zeros(len(x), np.int64)
    if len(p):
        d = np.concatenate([_gaps(x[p[i : i + 65536]], c[k[i : i + 65536]]) for i in range(0, len(p), 65536)])
        by = np.lexsort((order[k], d, p))
        lead = by[np.flatnonzero(np.diff(p[by], prepend=-1))]
        near[p[lead]], away[p[lead]] = order[k[lead]], d[lead]
    return near, away, nodes, len(p)


def _lists(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.ListArray.from_arrays([0, len(a)], pa.array(a)) for a in arrays]


_NUMBERS = T.ArrayType(T.LongType())
_TREE = [("level", T.LongType()), ("parent", T.LongType()), ("centre", T.LongType()), ("radius", T.DoubleType()), ("first", T.LongType()), ("last", T.LongType())]


def blocks(kept: DataFrame, dims: int) -> DataFrame:
    """ids, points and tree of every block of vectors; kept: vec_id and point."""
    kind = kept.schema["vec_id"].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("points", _NUMBERS), *(T.StructField(n, T.ArrayType(t)) for n, t in _TREE)])

    def block(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(rows).combine_chunks()
        x = whole["point"].combine_chunks().flatten().to_numpy().reshape(-1, dims)
        most = int(max(x.max(), -x.min()))
        if 4 * dims * most * most >= 1 << 63:
            raise ValueError(f"a component is {most} after scaling: squared distances of {dims} such don't fit 64 bits")
        order, tree = cover_tree(x, LEAVES)
        ids = whole["vec_id"].combine_chunks().take(pa.array(order))
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(ids)], ids), *_lists(x[order].ravel(), *vars(tree).values())], names=schema.names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            while b.num_rows:
                room = BLOCK - sum(x.num_rows for x in held)
                held.append(b.slice(0, room))
                b = b.slice(room)
                if sum(x.num_rows for x in held) == BLOCK:
                    yield block(held)
                    held = []
        if held:
            yield block(held)

    return kept.mapInArrow(each, schema)


def _opened(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.Array, np.ndarray, Tree]]:
    for i in range(batch.num_rows):
        row = [batch.column(c)[i].values for c in batch.schema.names]
        yield row[0], row[1].to_numpy().reshape(-1, dims), Tree(*(c.to_numpy() for c in row[2:]))


def sums(built: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, n, compared and the sums of components, at most a row a task and cluster."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, other = cover_tree(centroids, len(centroids))
        n, total, compared = np.zeros(len(centroids), np.int64), np.zeros_like(centroids), 0
        for batch in batches:
            for _, x, tree in _opened(batch, centroids.shape[1]):
                near, _, nodes, pairs = dual_tree(x, tree, centroids, order, other, True)
                compared += pairs
                upto = np.concatenate([np.zeros((1, x.shape[1]), np.int64), np.cumsum(x, axis=0)])
                for first, last, c in nodes:
                    n[c] += last - first
                    total[c] += upto[last] - upto[first]
                own = near >= 0
                n += np.bincount(near[own], minlength=len(n))
                np.add.at(total, near[own], x[own])
        some = np.flatnonzero(n)
        if len(some):
            rows = pa.ListArray.from_arrays(np.arange(len(some) + 1) * total.shape[1], pa.array(total[some].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(np.where(some == some[0], compared, 0)), rows], names=["cluster", "n", "compared", "sums"])

    return built.mapInArrow(each, "cluster long, n long, compared long, sums array<long>")


def assigned(built: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance of every vector."""
    schema = T.StructType([T.StructField("vec_id", built.schema["ids"].dataType.elementType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, other = cover_tree(centroids, len(centroids))
        for batch in batches:
            for ids, x, tree in _opened(batch, centroids.shape[1]):
                near, away, _, _ = dual_tree(x, tree, centroids, order, other, False)
                yield pa.RecordBatch.from_arrays([ids, pa.array(near.astype(np.int32)), pa.array(away)], names=schema.names)

    return built.mapInArrow(each, schema)


def kept_points(embeddings: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id and point, the components times scale rounded down, of the vectors that count."""
    parts = F.col("embedding")
    odd = F.exists(parts, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    point = F.transform(parts, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return embeddings.where((F.size(parts) == dims) & ~odd).select("vec_id", point.alias("point"))


def first_centroids(kept: DataFrame, k: int, seed: str) -> np.ndarray:
    """The points of the k least sha256 of `seed:vec_id`: k rows on the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(key.alias("key"), "vec_id", "point").orderBy("key", "vec_id", "point").limit(k).collect()
    return np.array([r.point for r in rows], np.int64)


def _by_cluster(values: list, kind: str) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)


def clustered(embeddings: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that counts."""
    small_batches(embeddings.sparkSession)
    kept = kept_points(embeddings, dims, scale)
    centroids = first_centroids(kept, k, seed)
    built = saved(blocks(kept, dims), "lloyd-blocks")
    columns = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
    for _ in range(rounds if len(centroids) else 0):
        for r in sums(built, centroids).groupBy("cluster").agg(F.sum("n").alias("n"), *columns).collect():
            centroids[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(dims)]
    if not len(centroids):
        centroids = np.zeros((1, dims), np.int64)
    out = saved(assigned(built, centroids), "lloyd-assigned")
    by = {r.cluster: int(r.total) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    return out.select(
        "vec_id",
        "cluster",
        "distance",
        _by_cluster([by.get(c, 0) for c in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(sum(by.values())).cast("long").alias("inertia"),
        _by_cluster(digests, "string").alias("centroid_sha256"),
    )
