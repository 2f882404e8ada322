import hashlib
import math

import numpy as np
import pytest
from pyspark.errors import PythonException

from vigilake.llm import dual_tree

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=16, rounds=3, dims=64):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] if r[0] is not None else -1, r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        held = {}
        for _, v in kept:
            held.setdefault(nearest(v)[1], []).append(v)
        for c, vs in held.items():
            centroids[c] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    last = [(i, *reversed(nearest(v))) for i, v in kept]
    of = {c: sum(d for _, b, d in last if b == c) for c in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, of[c], sum(of.values()), digest[c]) for i, c, d in last), key=str)


def result(spark, rows, parts=3, **more):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, dual_tree.clustered(df, **more).collect()), key=str)


def clouds(n, centres, seed, width=0.05):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, 64))
    return [(i, (c[i % centres] + rng.normal(scale=width, size=64)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("centres, width", [(5, 0.05), (40, 0.3), (1, 1.0)])
def test_equals_brute_force(spark, centres, width):
    rows = clouds(700, centres, centres, width)
    assert result(spark, rows) == brute(rows)


def test_small_blocks_and_few_leaves(spark, monkeypatch):
    rows = clouds(300, 7, 3)
    x = np.array([[math.floor(64 * a) for a in v] for _, v in rows])
    for leaves in (1, 2, 9, 300):
        order, tree = dual_tree.cover_tree(x, leaves)
        c = x[:16]
        by, other = dual_tree.cover_tree(c, 16)
        near, away, _, _ = dual_tree.dual_tree(x[order], tree, c, by, other, False)
        d = ((x[order][:, None] - c[None]) ** 2).sum(2)
        assert (near == d.argmin(1)).all() and (away == d.min(1)).all()


def test_cover_tree_holds_its_bounds():
    x = np.random.default_rng(1).integers(-50, 50, (500, 64))
    order, t = dual_tree.cover_tree(x, 64)
    x = x[order]
    for i in range(len(t.level)):
        held = x[t.first[i] : t.last[i]]
        assert np.sqrt(((held - x[t.centre[i]]) ** 2).sum(1)).max() <= t.radius[i] + 1e-9
        assert t.first[i] <= t.centre[i] < t.last[i]
        if t.parent[i] >= 0:
            assert t.first[t.parent[i]] <= t.first[i] < t.last[i] <= t.last[t.parent[i]] and t.level[t.parent[i]] == t.level[i] - 1
    for depth in range(t.level.max() + 1):
        assert (t.last - t.first)[t.level == depth].sum() == len(x)


def test_nodes_are_pruned():
    """Clear clouds are settled with far fewer comparisons than all pairs."""
    x = np.array([[math.floor(64 * a) for a in v] for _, v in clouds(2000, 16, 5)])
    order, tree = dual_tree.cover_tree(x, 256)
    by, other = dual_tree.cover_tree(x[:16], 16)
    near, _, nodes, pairs = dual_tree.dual_tree(x[order], tree, x[:16], by, other, True)
    assert pairs < 2000 and sum(b - a for a, b, _ in nodes) + (near >= 0).sum() == 2000


def test_ties_go_to_the_smaller_number_and_copies_count_each(spark):
    grid = [(i, [float((i >> b & 1) * 2 - 1) for b in range(4)] + [0.0] * 60) for i in range(16)]
    rows = [(100 + i, v) for i, v in grid] * 3 + [(1, [0.0] * 64)] * 50
    assert result(spark, rows) == brute(rows)


def test_odd_vectors_are_left_out(spark):
    good = clouds(40, 4, 9)
    odd = [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [None] + [0.0] * 63), (905, [math.nan] + [0.0] * 63), (906, [math.inf] + [0.0] * 63)]
    assert result(spark, good + odd + [(None, [0.5] * 64)]) == brute(good + [(None, [0.5] * 64)])


def test_few_vectors_and_none(spark):
    rows = clouds(3, 3, 2)
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == [] and result(spark, [(1, None)]) == []


def test_other_columns_and_types(spark):
    rows = clouds(50, 4, 4)
    df = spark.createDataFrame([(i, [float(x) for x in v], "x", 1) for i, v in rows], "vec_id int, embedding array<double>, point string, cluster int")
    assert sorted(map(tuple, dual_tree.clustered(df).collect()), key=str) == brute(rows)


def test_no_silent_overflow(spark):
    with pytest.raises(PythonException, match="don't fit"):
        result(spark, [(1, [1e9] * 64), (2, [0.0] * 64)])
