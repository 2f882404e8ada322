import math
import os
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vigilake.llm import lm_scoring


def split(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def brute(train, texts):
    """The same model with dictionaries."""
    pair, word = Counter(), Counter()
    for t in train:
        w = split(t)
        word.update(w)
        pair.update(zip(["<s>", *w], w, strict=False))
    n, v = sum(word.values()), len(word)
    high = lm_scoring.discounts([sum(c == k for c in pair.values()) for k in range(1, 5)])
    cc, total, seen = Counter(b for _, b in pair), Counter(), defaultdict(lambda: [0, 0, 0])
    low = lm_scoring.discounts([sum(c == k for c in cc.values()) for k in range(1, 5)])
    for (a, _), c in pair.items():
        total[a] += c
        seen[a][min(c, 3) - 1] += 1
    types = len(pair)
    left = sum(low[min(c, 3)] for c in cc.values()) / types

    def lower(w):
        return max(cc[w] - low[min(cc[w], 3)], 0) / types + left / (v + 1)

    def prob(a, b):
        if not total[a]:
            return lower(b)
        c = pair[a, b]
        return max(c - high[min(c, 3)], 0) / total[a] + sum(d * s for d, s in zip(high[1:], seen[a], strict=True)) / total[a] * lower(b)

    out = []
    for t in texts:
        w = split(t)
        out.append((len(w), sum(word[x] > 0 for x in w), sum(math.log10((word[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), sum(math.log10(prob(a, b)) for a, b in zip(["<s>", *w], w, strict=False))))
    # Over all words and one unknown, each context's probabilities sum to 1.
    for a in list(total)[:5]:
        assert sum(prob(a, b) for b in word) + prob(a, "<never>") == pytest.approx(1)
    return n, out


def same(docs, train, texts):
    model = lm_scoring.train(train)
    n, want = brute([r.text for r in train.collect()], texts.values())
    assert model.total == n
    got = {r.doc_id: r for r in lm_scoring.scored(docs, model).collect()}
    for i, w in zip(texts, want, strict=True):
        r = got[i]
        assert (r.n_tokens, r.n_known) == w[:2] and r.base_score == pytest.approx(w[2]) and r.score == pytest.approx(w[3])
        assert r.perplexity == pytest.approx(10 ** (-w[3] / w[0]))


def test_scores_equal_dictionaries(spark, documents):
    texts = ["a b c a b d", "A B\nc", None, "", "unseen words b", "a", "a b c a b d", "é È é", "long " * 30_000, "x y " * 3]
    docs = documents(texts).selectExpr("*", "1 as part", "2 as piece")
    same(docs, docs.where("doc_id <> 4"), dict(enumerate(texts)))
    empty = lm_scoring.train(docs.limit(0))
    assert empty.total == 0 and lm_scoring.scored(docs, empty).count() == len(texts)
    assert lm_scoring.scored(docs.limit(0), empty).collect() == []


def test_real_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    train = docs.where(lm_scoring.training(docs.doc_id))
    same(docs, train, {r.doc_id: r.text for r in docs.collect()})


def test_held_out_perplexity_beats_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    seen = lm_scoring.training(docs.doc_id)
    got = lm_scoring.scored(docs.where(~seen), lm_scoring.train(docs.where(seen))).selectExpr("sum(base_score) as base", "sum(score) as own").first()
    assert got.own > got.base


def test_a_missing_range_is_an_error(spark, documents):
    docs = documents([f"w{i} w{i % 7} w{i % 3}" for i in range(60)])
    model = lm_scoring.train(docs)
    assert sum(model.words.values()) == model.size and sum(model.pairs.values()) == model.types
    os.remove(next(Path(model.directory).glob("pairs-*.0.npy")))
    lm_scoring._mapped.cache_clear()
    with pytest.raises(Exception, match="No such file"):
        lm_scoring.scored(docs.repartition(2), model).collect()


def test_more_ranges_than_shuffle_partitions(spark, documents, monkeypatch):
    monkeypatch.setattr(lm_scoring, "RANGE_BYTES", 5)
    texts = ["a b c a b d", "A B\nc", None, "x y z " * 9]
    docs = documents(texts)
    assert lm_scoring.train(docs).parts > 4
    same(docs, docs, dict(enumerate(texts)))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 40), st.integers(1, 9)), min_size=1, max_size=9))
def test_sums_of_pieces(found):
    made = [lm_scoring.squeezed(np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)], np.int64)) for d in found]
    key, n = lm_scoring.summed(made)
    want = Counter()
    for d in found:
        want.update(d)
    assert dict(zip(key.tolist(), n.tolist(), strict=True)) == want and key.tolist() == sorted(want)


def test_an_empty_table(spark, documents):
    docs = documents([(1, "a b"), (2, None)])
    model = lm_scoring.train(docs.limit(0))
    assert model.total == 0 and lm_scoring.scored(docs.limit(0), model).collect() == []
    assert [(r.n_tokens, r.n_known) for r in lm_scoring.scored(docs, model).orderBy("doc_id").collect()] == [(3, 0), (1, 0)]
