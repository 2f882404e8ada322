import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from vigilake.llm import toxicity
from vigilake.llm.shared import hash_runs, mix


def test_isotonic_is_monotone_and_fits():
    rng = np.random.default_rng(0)
    raw = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-3 * raw))).astype(float)
    x, p = toxicity.isotonic(raw, y)
    assert (np.diff(p) >= -1e-12).all() and (np.diff(x) >= 0).all()
    got = np.interp(raw, x, p)
    assert abs(got.mean() - y.mean()) < 0.02 and ((got > 0.5) == (raw > 0)).mean() > 0.85


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    raw = toxicity.boosted(x, y).raw(x)
    assert ((raw > 0) == (y > 0)).mean() > 0.95


def test_features_of_odd_texts():
    key = toxicity._keys(("rude",))
    lexicon = toxicity.Lexicon(key, np.array([4.0]))
    f = dict(zip(toxicity.FEATURES, toxicity.features(pa.array(["you are RUDE"]), lexicon)[0], strict=True))
    assert f["near"] == 2 and f["best"] == 4 and f["shouts"] > 0 and f["second"] == pytest.approx(100 / 3)
    f = dict(zip(toxicity.FEATURES, toxicity.features(pa.array(["st.u.pid id1ot"]), lexicon)[0], strict=True))
    assert f["obfuscation"] == 100
    x = toxicity.features(pa.array(["", None, " ", "x" * 100_000, "é", "a\n" * 50_000]), lexicon)
    assert np.isfinite(x).all() and (x[0] == x[1]).all()
    one = toxicity.features(pa.array(["ab you cd", "RUDE thing", "é " * 9]), lexicon)
    assert (one[1] == toxicity.features(pa.array(["RUDE thing"]), lexicon)[0]).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.scored(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).toPandas()
    said, true = got.score >= 0.5, got.toxic == 1
    assert (said & true).sum() >= 0.85 * true.sum()
    assert (said & ~true).sum() <= 0.01 * (~true).sum() + 1


def test_held_out_labels_are_not_read(spark, documents):
    docs = documents([(i, f"word{i} you idiot" if i % 3 == 0 else f"word{i} nice day") for i in range(120)])
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.scored(docs, toxicity.fit(docs, x)).collect())) for x in (labels, turned))
    assert a == b


def test_odd_tables(spark, documents):
    docs = documents([None, "", "same", "same", (None, "text")]).withColumn("score", F.lit("x")).withColumn("toxic", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, none)
    assert [r.score for r in toxicity.scored(docs, model).collect()] == [0.0] * 5
    assert toxicity.scored(docs.limit(0), model).collect() == []
    some = spark.createDataFrame([(0, 1, 1), (1, None, None), (None, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.scored(docs, toxicity.fit(docs, some)).count() == 5
    assert toxicity.clean(docs, model).columns == docs.columns
    small = docs.withColumn("doc_id", F.col("doc_id").cast("int"))
    assert sorted((r.doc_id, r.score) for r in toxicity.scored(small.where("doc_id is not null"), model).collect()) == [(i, 0.0) for i in range(4)]


def plain_features(text, lexicon):
    """FEATURES of a text by plain Python; only the hash of a word is the operator's."""
    raw = (text or "").encode()
    low = pc.utf8_lower(pa.scalar(text or "")).as_py().encode()
    odds = dict(zip(lexicon.key.tolist(), lexicon.odds.tolist(), strict=True))

    def key(word):
        return int(hash_runs(np.frombuffer(word, np.uint8), np.ones(len(word), bool), np.array([0]), np.array([len(word)]))[0])

    def stem(word, k):
        return int(mix(np.array([key(word[:k])], np.uint64) + np.uint64(k))[0])

    words = re.findall(rb"[A-Za-z\x80-\xff]+", low)
    whole = [odds.get(key(w)) for w in words]
    stems = [max((odds[s] for k in toxicity.STEMS if len(w) > k and (s := stem(w, k)) in odds), default=None) for w in words]
    rude = [w.decode("utf-8", "replace") in toxicity.INSULTS for w in words]
    you = [i for i, w in enumerate(words) if w.decode("utf-8", "replace") in toxicity.SECOND]
    hits = [i for i in range(len(words)) if whole[i] is not None or stems[i] is not None or rude[i]]
    found = [v for v in [*whole, *stems] if v is not None]
    per = 100 / max(len(words), 1)
    tokens = re.findall(rb"[^\t\n\x0b\x0c\r ]+", raw)
    each = 100 / max(len(tokens), 1)
    capitals = [len(re.findall(rb"[A-Z]", t)) for t in tokens]
    letters, size = max(len(re.findall(rb"[A-Za-z\x80-\xff]", raw)), 1), max(len(raw), 1)
    n_whole, n_stem = sum(v is not None for v in whole), sum(v is not None for v in stems)
    return [
        math.log1p(len(words)), sum(rude) * per, math.log1p(n_whole), n_whole * per, math.log1p(n_stem), n_stem * per, max([0.0, *found]), math.log1p(sum(found)), len(you) * per,
        min([50, *(abs(h - y) for h in hits for y in you)]), sum(capitals) / letters, sum(c >= 3 and c >= 0.6 * len(t) for c, t in zip(capitals, tokens, strict=True)) * each,
        len(re.findall(rb"[!-/:-@\[-`{-~]", raw)) / size, len(re.findall(rb"[!?]", raw)) / size,
        sum(bool(re.search(rb"[A-Za-z\x80-\xff][0-9!-/:-@\[-`{-~][A-Za-z\x80-\xff]", t)) for t in tokens) * each, len(re.findall(rb"[0-9]", raw)) / size,
    ]


def plain_score(model, x):
    """The trees walked node by node, and the knots on either side."""
    raw = model.trees.start
    for feature, cut, leaf in zip(model.trees.feature, model.trees.cut, model.trees.leaf, strict=True):
        node = 0
        for _ in range(model.trees.depth):
            node = 2 * node + (2 if x[feature[node]] > cut[node] else 1)
        raw += leaf[node - (2**model.trees.depth - 1)]
    at, p = model.knots
    if raw <= at[0] or raw >= at[-1]:
        return p[0] if raw <= at[0] else p[-1]
    i = max(k for k in range(len(at)) if at[k] <= raw)
    return p[i] if at[i] == raw else p[i] + (p[i + 1] - p[i]) * (raw - at[i]) / (at[i + 1] - at[i])


def test_scores_equal_plain_python(spark):
    """Every document of a small data set: features from its text alone, whatever lies beside it, and the walk through the trees."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    assert model.trees is not None and len(model.lexicon.key)
    rows = docs.orderBy("doc_id").limit(300).collect()
    texts = [r.text for r in rows] + ["a", "!b", "c1", "2d", "!", "", None, "x!", "y", "YOU idiot! st.u.pid É"]
    got = toxicity.features(pa.array(texts), model.lexicon)
    for t, x in zip(texts, got, strict=True):
        assert x.tolist() == pytest.approx(plain_features(t, model.lexicon)), t
    scores = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    for r, x in zip(rows, got, strict=False):
        assert scores[r.doc_id] == pytest.approx(min(max(plain_score(model, x), 0), 1))
