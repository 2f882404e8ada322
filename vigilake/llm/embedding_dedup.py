"""Near-duplicate embeddings by a robust-pruned flat graph.

1. Equal unit vectors are one point with a weight. Every point joins the shards of its nearest
   centroids. Where these are few, they come from k-means on a bounded sample of all points;
   above FEW of them, coarse centroids come from it first, and each coarse group (in salted parts
   of bounded size) gets its own by k-means on a bounded sample of the group, so that a shard
   holds about as many points whatever the input. A shard above twice SHARD points is cut into
   blocks, and every two blocks meet in a cell of their own.
2. In each cell a graph is built: nearest candidates and random ones, robustly pruned (a
   candidate goes if a kept neighbour is nearer to it by the factor ALPHA), made symmetric.
   A point's lists from all its cells are united into one, and it joins the shards of those
   neighbours in its lists that are within range: the lists lead it on into other shards.
3. Each cell is searched with the united lists: greedily from the cell's medoids towards each
   of its points, then on through everything within range. What is found is verified by the
   cosine in double precision; an exact check of the cell's points adds what the search missed, so
   that points which meet in any cell have their link in each that they share.
4. A pair counts in one cell only: that of the least shard which both share. A cell hands on a
   row for each of its points (links, least point reached), never pairs, so that a group of
   many near copies costs no more rows than others.
5. Recall is audited on all points whose id is divisible by AUDIT, AUDITED at a time, against all
   points: the mean over those that have links, so that a large group counts no more than others. Below GOOD_RECALL all is
   done again with twice the overlap; what stays below LEAST_RECALL in the end is an error.

Vectors that are null, zero or hold nulls, NaN or infinities link with nothing; vectors of
different length never link; rows of one vec_id are one vector (the least by value); a null
vec_id links with nothing and has no component. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm.components import components
from vigilake.llm.shared import saved, small_batches

#: Points of a shard, shards of a point to begin with, and the bound of each sample that centroids come from.
SHARD, OVERLAP, SAMPLE = 512, 3, 20_000
#: Centroids up to which one sample gives them all, the most that a sample gives, coarse groups of a point, and points of a part of a group.
FEW, MOST, COARSE, PART = 2048, 2500, 2, 50_000
#: Neighbours kept, candidates near and random, and the factor of robust pruning.
DEGREE, NEAR, RANDOM, ALPHA = 16, 32, 8, 1.2
#: Entry points of a search, and nodes that it opens before it goes on from where it is.
MEDOIDS, OPENED = 6, 32
#: The audit asks the points whose id is divisible by AUDIT, so many at a time; the recall that is good enough, the least that is accepted, and how often the overlap may double.
AUDIT, AUDITED, GOOD_RECALL, LEAST_RECALL, TRIES = 50, 1024, 0.97, 0.9, 3


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by the largest component first, so that nothing overflows."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _points(wide: bool):
    """For batches of vec_id and embedding: the vector as bytes (doubles if wide, else floats), null for what links with nothing, and its unit vector's digest."""
    kind = np.float64 if wide else np.float32

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, same = [], []
            for v in b.column("embedding").to_pylist():
                a = np.array(v, kind) if v and all(x is not None for x in v) else np.zeros(0, kind)
                ok = len(a) > 0 and bool(np.isfinite(a).all()) and bool(np.abs(a).max() > 0)
                out.append(a.tobytes() if ok else None)
                same.append(xxhash.xxh3_128_hexdigest(_unit(a[None]).tobytes()) if ok else None)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(out, pa.binary()), pa.array(same, pa.string())], ["vec_id", "vec", "same"])

    return passed


def _matrix(vectors: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors of rows of bytes, floats or doubles by their length."""
    data = b"".join(vectors)
    return _unit(np.frombuffer(data, np.float64 if len(data) == 8 * dim * len(vectors) else np.float32).reshape(len(vectors), dim))


def _kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from evenly drawn starts."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(6):
        near = np.concatenate([(x[i : i + 2048] @ c.T).argmax(1) for i in range(0, len(x), 2048)])
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        n = np.linalg.norm(s, axis=1, keepdims=True)
        c = np.where(n > 0, s / np.maximum(n, 1e-300), c)
    return c


def pruned(x: np.ndarray, seed: int) -> list[np.ndarray]:
    """The symmetric robust-pruned neighbours of each row."""
    n = len(x)
    if n == 1:
        return [np.zeros(0, int)]
    f = x.astype(np.float32)
    sim = f @ f.T
    np.fill_diagonal(sim, -2)
    k = min(NEAR, n - 1)
    near = np.argpartition(-sim, k - 1, 1)[:, :k]
    rng = np.random.default_rng(seed)
    cand = np.concatenate([near, rng.integers(0, n, (n, min(RANDOM, n)))], 1)
    dist = 2 - 2 * np.take_along_axis(sim, cand, 1)
    order = np.argsort(dist, 1, kind="stable")
    cand, dist = np.take_along_axis(cand, order, 1), np.take_along_axis(dist, order, 1)
    alive = cand != np.arange(n)[:, None]
    rows, src, dst = np.arange(n), [], []
    for _ in range(DEGREE):
        first = alive.argmax(1)
        has = alive[rows, first]
        if not has.any():
            break
        pick = cand[rows, first]
        src.append(rows[has])
        dst.append(pick[has])
        # What the new neighbour is nearer to than the row is, is reached through it.
        alive &= ~((ALPHA * (2 - 2 * sim[pick[:, None], cand]) <= dist) | (cand == pick[:, None])) | ~has[:, None]
    s, d = np.concatenate(src), np.concatenate(dst)
    edges = np.unique(np.stack([np.concatenate([s, d]), np.concatenate([d, s])]), axis=1)
    return np.split(edges[1], np.searchsorted(edges[0], np.arange(1, n)))


def _medoids(x: np.ndarray) -> np.ndarray:
    """The row nearest to the mean, then those farthest from the chosen ones."""
    chosen = [int((x @ x.mean(0)).argmax())]
    nearest = x @ x[chosen[0]]
    while len(chosen) < min(MEDOIDS, len(x)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    return np.array(chosen)


def searched(x: np.ndarray, lists: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, found) of rows with a dot product of at least `least`, as the graph leads to them."""
    n = len(x)
    width = max(1, max(map(len, lists)))
    adj = np.full((n, width), -1)
    for i, own in enumerate(lists):
        adj[i, : len(own)] = own
    sim = np.full((n, n), -np.inf)
    entry = _medoids(x)
    sim[:, entry] = x @ x[entry].T
    opened = np.zeros((n, n), bool)

    def seen(a: np.ndarray, b: np.ndarray) -> None:
        for i in range(0, len(a), 1 << 14):
            s = slice(i, i + (1 << 14))
            sim[a[s], b[s]] = np.einsum("ij,ij->i", x[a[s]], x[b[s]])

    going = np.arange(n)
    for _ in range(OPENED):
        going = going[sim[going, going] == -np.inf]  # until a query meets itself
        if not len(going):
            break
        best = np.where(opened[going], -np.inf, sim[going])
        node = best.argmax(1)
        able = best[np.arange(len(going)), node] > -np.inf
        going, node = going[able], node[able]
        opened[going, node] = True
        to = adj[node]
        q = np.repeat(going, width)[to.ravel() >= 0]
        to = to.ravel()[to.ravel() >= 0]
        fresh = sim[q, to] == -np.inf
        seen(q[fresh], to[fresh])
    np.fill_diagonal(sim, 1.0)
    # From here all queries take a step at once: what their nodes in range lead to is a product of two 0/1 matrices.
    leads = np.zeros((n, n), np.float32)
    leads[np.repeat(np.arange(n), [len(v) for v in lists]), np.concatenate(lists).astype(int)] = 1
    front = sim >= least
    while front.any():
        reached = (front.astype(np.float32) @ leads > 0) & (sim == -np.inf)
        seen(*np.nonzero(reached))
        front = reached & (sim >= least)
    np.fill_diagonal(sim, -np.inf)
    found = sim >= least
    return np.nonzero(found | found.T)


def _cell_links(x: np.ndarray, ids: np.ndarray, weight: np.ndarray, shards: list[list[int]], shard: int, block: np.ndarray, across: bool, lists: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each point: the weight of its links that count in this cell, and the least id reached."""
    found = np.zeros((len(x), len(x)), bool)
    found[searched(x, lists, least)] = True
    # The exact check: what the search missed among points that meet here.
    found |= x @ x.T >= least
    np.fill_diagonal(found, False)
    q, node = np.nonzero(found | found.T)
    if across:
        keep = block[q] != block[node]
        q, node = q[keep], node[keep]
    # The pair counts elsewhere if both are in a lesser shard as well.
    lesser, own = np.unique(np.array([v for vs in shards for v in vs if v < shard], np.int64), return_inverse=True)
    held = np.zeros((len(x), len(lesser)), np.float32)
    held[np.repeat(np.arange(len(x)), [sum(v < shard for v in vs) for vs in shards]), own] = 1
    elsewhere = (held @ held.T > 0)[q, node]
    keep = ~elsewhere
    links = np.bincount(q[keep], weight[node[keep]], len(x)).astype(np.int64)
    root = ids.copy()
    while True:
        before = root.copy()
        np.minimum.at(root, q, before[node])
        if (root == before).all():
            return links, root


def _nearest(x: np.ndarray, c: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The m nearest centroids of each row, ascending by number, and their cosines."""
    s = x @ c.T
    m = min(m, len(c))
    top = np.sort(np.argpartition(-s, m - 1, 1)[:, :m], 1)
    return top, np.take_along_axis(s, top, 1)


def _by_dim(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each dimension in a batch: itself, the places of its rows, and their unit vectors."""
    dims, vectors = np.array(b.column("dim").to_pylist()), b.column("vec").to_pylist()
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield dim, at, _matrix([vectors[i] for i in at], dim)


def _sharded(points: DataFrame, overlap: int) -> DataFrame:
    """points with shards: the numbers of the `overlap` nearest centroids of each."""
    spark = points.sparkSession
    # One row a dimension.
    sizes = {r.dim: r["count"] for r in points.groupBy("dim").count().collect()}
    need = {dim: max(1, math.ceil(n * overlap / SHARD)) for dim, n in sizes.items()}
    sample = points.select("vec", "dim").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    first = {}
    for dim, n in need.items():
        own = [bytes(r.vec) for r in sample if r.dim == dim]
        k = min(n if n <= FEW else min(MOST, math.ceil(math.sqrt(n))), max(1, len(own) // 8))
        first[dim] = _kmeans(_matrix(own, dim), k) if own else np.ones((1, dim))
    known = spark.sparkContext.broadcast(first)
    two_level = [dim for dim, n in need.items() if n > FEW]

    def near(m: int):
        def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                shards: list[list[int]] = [[]] * b.num_rows
                for dim, at, x in _by_dim(b):
                    for i, row in zip(at.tolist(), _nearest(x, known.value[dim], m)[0].tolist(), strict=True):
                        shards[i] = row
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "vec", "dim", "weight")), pa.array(shards, pa.list_(pa.int64()))], ["id", "vec", "dim", "weight", "shards"])

        return assigned

    schema = "id long, vec binary, dim int, weight long, shards array<long>"
    columns = points.select("id", "vec", "dim", "weight")
    if not two_level:
        return saved(columns.mapInArrow(near(overlap), schema), "dedup-shards")

    # Each point in its nearest coarse groups; the groups' own centroids, each from a sample of about SAMPLE of its points.
    coarse = saved(columns.mapInArrow(near(COARSE), schema).withColumn("coarse", F.explode("shards")).drop("shards"), "dedup-coarse")
    held = coarse.groupBy("dim", "coarse").count()
    share = F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.col("count"))
    # One small row for each coarse group, at most MOST of a dimension.
    drawn = coarse.join(F.broadcast(held), ["dim", "coarse"]).where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 20)) < share * (1 << 20))

    def grouped(table: pa.Table) -> pa.Table:
        dim, n = table.column("dim")[0].as_py(), table.column("count")[0].as_py()
        x = _matrix(table.sort_by("id").column("vec").to_pylist(), dim)
        c = _kmeans(x, max(1, min(MOST, len(x) // 8, math.ceil(n * overlap / COARSE / SHARD))))
        return pa.table({"dim": pa.array([dim], pa.int32()), "coarse": table.column("coarse").slice(0, 1), "centroids": pa.array([c.tobytes()], pa.binary()), "parts": pa.array([-(-n // PART)], pa.int32())})

    centroids = saved(drawn.select("dim", "coarse", "count", "id", "vec").groupBy("dim", "coarse").applyInArrow(grouped, "dim int, coarse long, centroids binary, parts int"), "dedup-centroids")
    parts = F.broadcast(centroids.select("dim", "coarse", "parts"))
    dealt = coarse.join(parts, ["dim", "coarse"]).withColumn("part", F.pmod(F.xxhash64("id", F.lit(2)), F.col("parts")).cast("int"))
    each = centroids.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def placed(members: pa.Table, own: pa.Table) -> pa.Table:
        if not members.num_rows or not own.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "shard": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        dim = own.column("dim")[0].as_py()
        c = np.frombuffer(own.column("centroids")[0].as_py(), np.float64).reshape(-1, dim)
        x = _matrix(members.column("vec").to_pylist(), dim)
        top, cosine = _nearest(x, c, overlap)
        return pa.table({"id": pa.array(np.repeat(members.column("id").to_numpy(), top.shape[1])), "shard": pa.array((own.column("coarse")[0].as_py() * MOST + top).ravel()), "cosine": pa.array(cosine.ravel())})

    keys = ["dim", "coarse", "part"]
    found = dealt.select(*keys, "id", "vec").groupBy(*keys).cogroup(each.select(*keys, "centroids").groupBy(*keys)).applyInArrow(placed, "id long, shard long, cosine double")
    top = found.groupBy("id").agg(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("cosine", "shard")), asc=False), 1, overlap), lambda v: v["shard"]).alias("shards"))
    return saved(columns.join(top, "id"), "dedup-shards")


def _celled(sharded: DataFrame, *more: str) -> DataFrame:
    """A row for each cell that a point is in: cell, shard, block, across (whether the cell holds two blocks), and the point's columns."""
    each = sharded.withColumn("shard", F.explode("shards"))
    cut = each.groupBy("dim", "shard").count().where(F.col("count") > 2 * SHARD).select(F.col("dim").alias("of"), F.col("shard").alias("long"), F.ceil(F.col("count") / SHARD).cast("int").alias("blocks"))
    placed = each.join(saved(cut, "dedup-long"), (F.col("dim") == F.col("of")) & (F.col("shard") == F.col("long")), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # A block meets each other one in a cell; the cell of two blocks holds both.
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return placed.select(F.concat_ws("-", "dim", "shard", F.least("block", "other"), F.greatest("block", "other")).alias("cell"), "shard", "block", (F.col("block") != F.col("other")).alias("across"), "id", "vec", "dim", "weight", "shards", *more)


def _cells(points: DataFrame, overlap: int, least: float) -> DataFrame:
    """id, links and root of every point and cell; points: id, vec, dim, weight."""
    sharded = _sharded(points, overlap)

    def built(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, shards = table.column("id").to_numpy(), table.column("shards").to_pylist()
        x = _matrix(table.column("vec").to_pylist(), table.column("dim")[0].as_py())
        lists = pruned(x, len(ids))
        # The shards of neighbours within range, as the cosine in double precision has it.
        further = [sorted({s for j, c in zip(own.tolist(), (x[own] @ x[i]).tolist(), strict=True) if c >= least for s in shards[j]}) for i, own in enumerate(lists)]
        return pa.table({"id": pa.array(ids), "list": pa.array([ids[v].tolist() for v in lists], pa.list_(pa.int64())), "further": pa.array(further, pa.list_(pa.int64()))})

    lists = _celled(sharded).groupBy("cell").applyInArrow(built, "id long, list array<long>, further array<long>")
    united = lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("list"))).alias("list"), F.array_distinct(F.flatten(F.collect_list("further"))).alias("further"))
    led = saved(sharded.join(united, "id").withColumn("shards", F.array_sort(F.array_union("shards", "further"))).drop("further"), "dedup-lists")

    def linked(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids = table.column("id").to_numpy()
        x = _matrix(table.column("vec").to_pylist(), table.column("dim")[0].as_py())
        lists = []
        for own in table.column("list").to_pylist():
            own = np.array(own, np.int64)
            at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
            lists.append(np.unique(at[ids[at] == own]))
        links, root = _cell_links(x, ids, table.column("weight").to_numpy(), table.column("shards").to_pylist(), table.column("shard")[0].as_py(), table.column("block").to_numpy(), table.column("across")[0].as_py(), lists, least)
        return pa.table({"id": pa.array(ids), "links": pa.array(links), "root": pa.array(root)})

    return _celled(led, "list").groupBy("cell").applyInArrow(linked, "id long, links long, root long")


def audit(points: DataFrame, links: DataFrame, least: float) -> float | None:
    """The mean, over those asked that have links, of the share of their links that was found; None if none has any."""
    asked = points.where(F.col("id") % AUDIT == 0)
    if not (n := asked.count()):
        # No id is divisible: the least hashes stand in.
        asked = points.orderBy(F.xxhash64("id"), "id").limit(AUDITED)
        n = AUDITED
    blocks = -(-n // AUDITED)
    shares = [_asked(points, links, asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k), least) for k in range(blocks)]
    count, total = sum(c for c, _ in shares), sum(t for _, t in shares)
    return total / count if count else None


def _asked(points: DataFrame, links: DataFrame, asked: DataFrame, least: float) -> tuple[int, float]:
    """Of a block of about AUDITED points: how many have links, and the sum of the shares that were found."""
    rows = asked.select("id", "vec", "dim").collect()
    by = {d: (np.array([r.id for r in rows if r.dim == d]), _matrix([bytes(r.vec) for r in rows if r.dim == d], d)) for d in {r.dim for r in rows}}
    known = points.sparkSession.sparkContext.broadcast(by)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for b in batches:
            ids, weight = b.column("id").to_numpy(), b.column("weight").to_numpy()
            for d, at, x in _by_dim(b):
                if d in known.value:
                    own, q = known.value[d]
                    hit = (q @ x.T >= least) & (own[:, None] != ids[at])
                    for i, n in zip(own.tolist(), (hit * weight[at]).sum(1).tolist(), strict=True):
                        total[i] = total.get(i, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["id", "truly"])

    true = points.select("id", "vec", "dim", "weight").mapInArrow(counted, "id long, truly long").groupBy("id").agg(F.sum("truly").alias("truly")).where("truly > 0")
    share = F.least(F.coalesce("links", F.lit(0)), F.col("truly")) / F.col("truly")
    out = true.join(links, "id", "left").agg(F.count("*").alias("n"), F.coalesce(F.sum(share), F.lit(0.0)).alias("share")).first()
    known.destroy()
    return out.n, out.share


def near_duplicates(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row, and the audited recall."""
    small_batches(vectors.sparkSession)
    wide = vectors.schema["embedding"].dataType.elementType.typeName() != "float"
    rows = saved(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_points(wide), "vec_id long, vec binary, same string"), "dedup-units")
    one = rows.where("vec_id is not null and vec is not null").groupBy("vec_id").agg(F.min(F.struct("vec", "same")).alias("v")).select("vec_id", "v.*")
    points = saved(one.groupBy("same").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.min("vec").alias("vec")).withColumn("dim", (F.octet_length("vec") / (8 if wide else 4)).cast("int")), "dedup-points")
    overlap, recall = OVERLAP, None
    for _ in range(TRIES):
        cells = saved(_cells(points, overlap, least), "dedup-links")
        links = saved(cells.groupBy("id").agg(F.sum("links").alias("links")), "dedup-counts")
        recall = audit(points, links, least)
        if recall is None or recall >= GOOD_RECALL:
            break
        overlap *= 2
    if recall is not None and recall < LEAST_RECALL:
        raise ValueError(f"the audit found {recall:.3f} of the links at an overlap of {overlap // 2}")
    found = components(cells.select("id", "root"))
    named = points.join(links, "id", "left").join(found, points["id"] == found["node"], "left").select("same", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    ids = one.select("vec_id", F.col("same").alias("same_"))
    by_id = saved(ids.join(saved(named, "dedup-named"), F.col("same_") == F.col("same")).select(F.col("vec_id").alias("id"), "n_links", "component_id"), "dedup-vectors")
    out = rows.select("vec_id").join(by_id, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"), F.lit(recall).cast("double").alias("audited_recall"))
