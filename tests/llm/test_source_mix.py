import random
import re

import pytest
from pyspark.sql import functions as F

from vigilake.llm import source_mix


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def shares(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares of the whole by weight; none above `most` times its size, the excess reshared by weight."""
    left, target, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * unit > most * sizes[i]]
        if not full:
            for i in open_:
                target[i] = weights[i] * unit
            break
        for i in full:
            target[i] = float(most * sizes[i])
            left -= target[i]
            open_.discard(i)
    return target


def test_targets_are_capped_and_reshared(spark):
    rng = random.Random(3)
    cases = [[10, 1000, 1000], [], [0, 0], [5], *([rng.choice([0, 1, 7, 50, 3000]) for _ in range(rng.randrange(1, 14))] for _ in range(4))]
    assert shares(cases[0], [5.0, 2.0, 1.0], 3) == [30.0, 1980 * 2 / 3, 1980 / 3]
    for sizes in cases:
        names = [f"s{i:02}" if i < len(sizes) - 1 else None for i in range(len(sizes))]
        table = spark.createDataFrame(list(zip(names, sizes, sizes, strict=True)), "source string, source_size long, n long")
        got = {r.source: r.target for r in source_mix.targets(table).collect()}
        want = shares(sizes, [float((5, 2, 1)[i % 3]) for i in range(len(sizes))], 3)
        assert [got[n] for n in names] == pytest.approx(want)


def brute(rows, n_sources):
    """Targets by source and the documents that exact sorting takes."""
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    target = shares([sum(r.size for r in by[s]) for s in order], [float((5, 2, 1)[i % 3]) for i in range(len(order))], 3)
    taken = []
    for s, t in zip(order, target, strict=True):
        size = sum(r.size for r in by[s])
        e = min(3, int(t // size)) if size else 0
        rest, total, best, pick = t - e * size, 0, t - e * size, 0
        ranked = sorted(by[s], key=lambda r: r.key)
        for k, r in enumerate(ranked, 1):
            total += r.size
            if rest > 0 and abs(total - rest) <= best and (k == len(ranked) or ranked[k].key != r.key):
                if abs(total - rest) < best:
                    best, pick = abs(total - rest), k
        taken += [(r.doc_id, size, t, e + (k < pick)) for k, r in enumerate(ranked)]
    return taken


def test_mixture_equals_sorting(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("source", F.when(F.col("source") != "src3", F.col("source")))
    rows = source_mix.measured(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.size == words(texts[r.doc_id]) for r in rows)
    want = {r[0]: r[1:] for r in brute(rows, 20)}
    got = source_mix.mixture(docs).collect()
    assert len(got) == len(want)
    wrong = [r.doc_id for r in got if (r.source_size, r.copies) != (want[r.doc_id][0], want[r.doc_id][2]) or abs(r.target - want[r.doc_id][1]) > 1e-6]
    assert not wrong
    again = source_mix.mixture(docs.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_odd_rows(spark, documents):
    docs = documents([None, "", "a b", "a b", (None, "c"), "w " * 5000]).withColumn("size", F.lit("x")).withColumn("key", F.lit(0))
    got = source_mix.mixture(docs).collect()
    assert len(got) == 6 and all(r.copies <= 3 for r in got)
    assert source_mix.mixture(docs.limit(0)).collect() == []
    mixed = source_mix.mixed(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in got)


def test_the_mix_keeps_columns_of_any_name(spark, documents):
    names = ["_key", "_copy", "epochs", "cutoff", "target", "of", "source_size", "row", "from", "key", "copy", "copies", "rest", "slice"]
    docs = documents(["a b", "c d e", None, "f"]).selectExpr("*", *[f"concat('{n}', doc_id) as {n}" for n in names])
    got = source_mix.mixed(docs)
    assert got.columns == docs.columns
    want = {r.doc_id: r for r in docs.collect()}
    assert got.count() and all(r == want[r.doc_id] for r in got.collect())


@pytest.mark.parametrize("ids", [[None], [5], [None, 5, 6]])
def test_equal_rows_are_taken_in_part(spark, documents, ids):
    """Thousands of rows of one id and text: as many as the target asks for, by both ways to the mix."""
    rows = [(ids[i % len(ids)], "one two three four") for i in range(3000)] + [(100_000 + i, "a b c") for i in range(1000)]
    docs = documents(rows).withColumn("source", F.when(F.col("doc_id") < 100_000, "hot").when(F.col("doc_id").isNull(), "hot").otherwise("other")).repartition(7)
    out = source_mix.mixture(docs).collect()
    assert len(out) == len(rows) and all(0 <= r.copies <= 3 for r in out)
    for s in ("hot", "other"):
        taken, target = sum(r.copies * r.size for r in out if r.source == s), next(r.target for r in out if r.source == s)
        assert abs(taken - target) <= 2
    texts = source_mix.mixed(docs).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in texts} == {s: sum(r.copies for r in out if r.source == s) for s in ("hot", "other")}
