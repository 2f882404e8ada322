import numpy as np
import pytest

from vigilake.llm import embedding_dedup


def brute(rows, least=0.9):
    """(vec_id, n_links, component_id, kept) by comparing all."""
    vectors = {}
    for i, v in rows:
        if i is not None and v and all(x is not None for x in v) and np.isfinite(v).all() and np.any(v):
            v = np.array(v, float) / np.abs(v).max()
            vectors.setdefault(i, v / np.linalg.norm(v))
    links = {i: {j for j, w in vectors.items() if j != i and len(v) == len(w) and v @ w >= least} for i, v in vectors.items()}
    root = {}
    for i in sorted(vectors):
        if i not in root:
            todo = [i]
            while todo:
                if (k := todo.pop()) not in root:
                    root[k] = i
                    todo += links[k]
    return sorted(((i, len(links.get(i, ())), root.get(i, i), i is None or root.get(i, i) == i) for i, _ in rows), key=str)


def result(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()), key=str)


def clusters(seed, n, dim=16):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(n // 6 + 1, dim))
    rows = []
    for i in range(n):
        v = centre[rng.integers(len(centre))] if rng.random() < 0.7 else rng.normal(size=dim)
        rows.append((i, (v + rng.normal(size=dim) * rng.choice([0.02, 0.2, 0.35])).tolist()))
    return rows


def test_links_equal_brute_force(spark):
    rows = clusters(1, 300)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as cell", "2 as unit")
    assert result(df) == brute(rows)


def test_a_large_group_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD", 24)
    rng = np.random.default_rng(2)
    base = rng.normal(size=8)
    rows = [(i, (base + rng.normal(size=8) * 0.05).tolist()) for i in range(150)] + [(1000 + i, rng.normal(size=8).tolist()) for i in range(50)] + [(2000 + i, base.tolist()) for i in range(40)]
    got, want = (sorted(x) for x in (result(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), brute(rows)))
    assert [r[0] for r in got] == [r[0] for r in want] and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want)
    assert [g[2] for g in got] == [w[2] for w in want]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 0.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.01]), (None, [1.0, 0.0]), (1, [1.0, 0.0]), (11, [1e300, 0.0]), (12, [1e-300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert result(df) == brute(rows)
    assert result(df.limit(0)) == []


def test_recall_on_the_real_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got, want = result(df), brute(rows)
    assert sum(g[1] for g in got) >= 0.9 * sum(w[1] for w in want) and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))


def test_pruning_keeps_the_nearest_and_symmetry():
    x = np.random.default_rng(3).normal(size=(80, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists = embedding_dedup.pruned(x, 0)
    sim = x @ x.T - 2 * np.eye(80)
    for i, own in enumerate(lists):
        assert sim[i].argmax() in own and all(i in lists[j] for j in own)


def test_two_levels_of_centroids(spark, monkeypatch):
    for name, value in (("SHARD", 24), ("FEW", 8), ("MOST", 12), ("PART", 60), ("SAMPLE", 300)):
        monkeypatch.setattr(embedding_dedup, name, value)
    rows = clusters(5, 700)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got, want = result(df), brute(rows)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g[1] for g in got) >= 0.95 * sum(w[1] for w in want)


def test_lists_lead_into_other_shards(spark, monkeypatch):
    """With one shard a point, links across shards are found all the same."""
    monkeypatch.setattr(embedding_dedup, "SHARD", 24)
    monkeypatch.setattr(embedding_dedup, "GOOD_RECALL", 0.0)
    rows = clusters(6, 400)
    points = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = sum(r[1] for r in brute(rows))
    found = []
    for overlap in (1, 2):
        monkeypatch.setattr(embedding_dedup, "OVERLAP", overlap)
        monkeypatch.setattr(embedding_dedup, "LEAST_RECALL", 0.0)
        found.append(sum(r[1] for r in result(points)) / want)
    assert found[1] >= 0.95, found


def test_too_little_recall_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "audit", lambda *_: 0.5)
    df = spark.createDataFrame(clusters(7, 60), "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="audit"):
        result(df)


def test_an_empty_table_and_other_columns(spark):
    schema = "vec_id long, embedding array<float>, id string, links long, shards int"
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0], "x", 5, 6), (2, [1.0, 0.01], "x", 5, 6), (3, None, None, None, None)], schema)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]
