import json
import random
import string
import time
from pathlib import Path

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vigilake.llm import token_counts

FILE = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(FILE)
ODD = ["", " ", "  a\n\n b", "aaaaaaaaaaaaaaaaaaaaa", "it's we'll I'D", "½ Ⅷ ²3", "a<|endoftext|>b <|endoftext|>", "\x1c\x1d a\x85b c", "é à 東京 😀👩‍👩‍👧", "_a__b", "x" * 5000, "a\u2003b\u3000\u2028 c\u202f\u1680d\u200bx"]


def library(texts):
    return [len(e.ids) for e in LIB.encode_batch(texts, add_special_tokens=False)]


def test_odd_texts_equal_the_library():
    assert token_counts.text_counts(ODD, FILE, {}) == library(ODD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text("ab' \n1é", max_size=60), max_size=5))
def test_any_texts_equal_the_library(texts):
    assert token_counts.text_counts(texts, FILE, {}) == library(texts)


def test_rows_of_a_table(spark, documents):
    docs = documents([*ODD, None, "same", "same"])
    docs = docs.unionByName(docs.limit(3)).selectExpr("*", "1 as n_tokens")
    got = token_counts.count_tokens(docs, FILE, limit=3).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        n = library([texts[r.doc_id]])[0]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 3)
    assert token_counts.count_tokens(docs.limit(0), FILE).collect() == []


def test_real_texts_equal_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    want = dict(zip(texts, library(list(texts.values())), strict=True))
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, FILE).collect()} == want


def test_long_pretokens_take_time_near_their_length():
    rng = random.Random(4)
    texts = ["".join(rng.choices(string.ascii_letters, k=200_000)), "a" * 200_000, "ab" * 50_000, "".join(rng.choices("aeiouàé", k=50_000)), "-" * 70 + "x" * 65]
    token_counts.merges(FILE)
    start = time.time()
    got = token_counts.text_counts(texts, FILE, {})
    assert time.time() - start < 10
    assert got == library(texts)


@settings(max_examples=100, deadline=None)
@given(st.text("abcdeé", min_size=1, max_size=200))
def test_merging_alone_equals_merging_in_rounds(word):
    m = token_counts.merges(FILE)
    data = word.encode()
    if len(data) > 1:
        assert m.count_long(data) == len(LIB.encode(word).ids) == m.count([data])[0]


def test_workers_hold_counts_by_vocabulary(spark, documents, tmp_path):
    docs = documents(["tokenization of words"])
    spec = json.loads(Path(FILE).read_text())
    spec["model"]["merges"] = spec["model"]["merges"][:100]
    (tmp_path / "few.json").write_text(json.dumps(spec))
    for file in (FILE, str(tmp_path / "few.json"), FILE):
        assert token_counts.count_tokens(docs, file).first().n_tokens == len(Tokenizer.from_file(file).encode("tokenization of words", add_special_tokens=False).ids)


def test_long_pretokens_are_not_remembered():
    cache = {}
    texts = ["word " * 3 + "A" * n + " é" * n for n in (3, 64, 65, 300)] + ["語" * 30 + " x"]
    file = public_tokenizers.path("byte_bpe_50k.json")
    assert token_counts.text_counts(texts, file, cache) == library(texts) == token_counts.text_counts(texts, file, cache)
    assert cache and max(len(w.encode()) for w in cache) <= token_counts.LONG
