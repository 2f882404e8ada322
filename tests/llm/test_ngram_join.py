import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql.classic.dataframe import DataFrame

from vigilake.llm import ngram_join
from vigilake.llm.components import components
from vigilake.llm.shared import saved


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if i == j or a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted(((i, len(shingles(t)), find(i) if i is not None else None) for i, t in rows), key=str)


def result(docs):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.joined(docs).collect()), key=str)


def near_copies(seed, n):
    """Copies of few texts with edits of every strength, a common passage, short and empty texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=30)
    bases = [rng.choices(vocabulary, k=rng.choice([3, 6, 20, 80])) for _ in range(6)]
    out = []
    for _ in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.2:
            w = [*passage, *w]
        out.append(rng.choice([" ", "\n", "\t "]).join(w) if rng.random() > 0.05 else rng.choice([None, "", " ", "X"]))
    return out


def test_components_equal_brute_force(spark, documents):
    for seed, n in ((1, 150), (2, 60)):
        rows = list(enumerate(near_copies(seed, n)))
        assert result(documents(rows).selectExpr("*", "1 as n", "2 as hash")) == brute(rows)


def test_long_lists_and_stars(spark, documents, monkeypatch):
    """Near copies of one text that are too far from each other, in lists above the length of small ones."""
    monkeypatch.setattr(ngram_join, "HOT_LEAST", 8)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for p in rng.sample(range(5, 115), 2):
            w[p] = f"own{i}-{p}"
        rows.append((100 + i, " ".join(w)))
    rows += [(500, " ".join(base)), (501, "È 1 2 3 4 5"), (502, "È 1 2 3 4 5"), (None, "È 1 2 3 4 5"), (503, "word " * 30_000)]
    assert result(documents(rows)) == brute(rows)


def test_real_table_and_empty_table(spark, documents):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert result(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert result(docs.limit(0)) == []
    assert result(documents([(7, "a b c"), (7, "a b c"), (3, "a b c")])) == brute([(7, "a b c"), (7, "a b c"), (3, "a b c")])


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 60)), st.lists(st.sets(st.integers(0, 60)), min_size=1, max_size=12))
def test_divide_skip_equals_counting(query, sets):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    got = ngram_join.divide_skip(np.array(sorted(query), np.uint64), arrays, (4, 5))
    assert got.tolist() == [bool(query & s) and 5 * len(query & s) >= 4 * len(query | s) for s in sets]


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(30)] + [(5, 5), (2000, 1999)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {i: 0 for i in range(41)} | {1000 + i: 1000 for i in range(30)} | {1999: 1999, 2000: 1999}
    assert components(spark.createDataFrame([], "x long, y long")).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 3000), max_size=900), st.sets(st.integers(0, 3000), max_size=900))
def test_signatures_bound_the_overlap(x, y):
    a, b = (ngram_join.mix(np.array(sorted(s), np.uint64)) for s in (x, y))
    cells = [np.frombuffer(ngram_join.signature(s), np.uint8).reshape(1, -1) for s in (a, b)]
    assert ngram_join.overlap_bound(*cells)[0] >= len(x & y)


def test_one_id_with_different_texts(spark, documents):
    rows = [(5, "a b c d e f"), (5, "p q r s t u"), (3, "a b c d e f"), (9, "p q r s t u"), (9, "p q r s t u"), (12, "alone"), (12, "other"), (12, "other"), (None, "alone"), (None, "alone")]
    assert result(documents(rows)) == brute(rows)
    docs = documents(rows).selectExpr("*", "1 as _first", "2 as first", "3 as row", "map('a', 1) as m", "4 as id", "5 as hash")
    kept = ngram_join.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, "a b c d e f"), (12, "alone"), (12, "other"), (None, "alone"), (None, "alone")], key=str)


def test_lists_go_on_from_batch_to_batch(spark, documents, monkeypatch):
    monkeypatch.setattr(ngram_join, "ROWS", 5)
    monkeypatch.setattr(ngram_join, "HOT_LEAST", 10**9)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    monkeypatch.setattr(ngram_join, "small_batches", lambda s: s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7"))
    rows = list(enumerate(near_copies(7, 120)))
    assert result(documents(rows)) == brute(rows)


def test_long_lists_of_many_components_are_cut_into_blocks(spark, documents, monkeypatch):
    """Texts made of common sentences in other choices: they share lists and reach nothing, but for some copies."""
    for name, value in (("BLOCK", 16), ("HOT_LEAST", 3), ("FEW", 2)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(11)
    sentences = [" ".join(f"s{i}w{j}" for j in range(12)) for i in range(14)]
    rows = [(i, " ".join(rng.sample(sentences, 5))) for i in range(130)]
    rows += [(1000 + i, rows[i][1].rsplit(" ", 2)[0]) for i in range(0, 60, 7)]
    assert result(documents(rows)) == brute(rows)
    assert len({r[2] for r in brute(rows)}) > 80


def test_a_passage_that_many_unlike_documents_share(spark, documents):
    n = 30_000
    passage = " ".join(f"common{i}" for i in range(40))
    docs = spark.range(n).selectExpr("id as doc_id", f"concat('own', id, ' {passage} ', 'end', id, ' ', uuid(), ' ', uuid(), ' ', uuid(), ' ', uuid(), ' ', uuid(), ' ', uuid(), ' ', uuid(), ' ', uuid(), ' ', uuid(), ' ', uuid()) as text")
    got = ngram_join.joined(saved(docs, "test")).selectExpr("count(distinct component_id) as c", "min(n_shingles) as n").first()
    assert tuple(got) == (n, 48)


def test_no_rows_of_shingles_come_to_the_driver(spark, documents, monkeypatch):
    """Common shingles come as bytes, a row a task, and no table of documents or pairs is broadcast."""
    monkeypatch.setattr(ngram_join, "HOT_LEAST", 3)
    monkeypatch.setattr(ngram_join, "FEW", 0)
    rows, plans = [], []
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda df: rows.append(out := collect(df)) or out)
    monkeypatch.setattr(ngram_join, "saved", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or saved(df, name))
    text = " ".join(f"w{i}" for i in range(5_000))
    docs = documents([(i, f"{text} x{i}") for i in range(8)])
    got = result(docs.coalesce(1))
    assert got == [(i, 4_997, 0) for i in range(8)]
    assert max(len(r) for r in rows if r and "often" in r[0]) <= 8
    assert not [r for r in rows if len(r) > 2_048]
    assert plans and not [p for p in plans if "BroadcastHashJoin" in p]


def test_of_many_common_shingles_the_most_frequent_are_taken(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_MOST", 1_000)
    told = spark.range(5_000).selectExpr("xxhash64(id) AS a", "CASE WHEN id < 400 THEN 1000 + id WHEN id < 3000 THEN 64 ELSE 16 END AS n").repartition(7)
    key, often = ngram_join._most_common(told)
    n = {r.a: r.n for r in told.collect()}
    taken = [n[int(k)] for k in key.view(np.int64)]
    assert (key[1:] > key[:-1]).all() and often.tolist() == [int(x).bit_length() - 1 for x in taken]
    assert sum(x >= 1000 for x in taken) == 400 and min(taken) == 64 and 850 < len(taken) < 1_150
    monkeypatch.setattr(ngram_join, "HOT_MOST", 5_000)
    assert len(ngram_join._most_common(told)[0]) == 5_000
    assert len(ngram_join._most_common(told.where("n < 0"))[0]) == 0
