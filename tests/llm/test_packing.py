import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vigilake.llm import packing

FILE = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(FILE)


def ids(text):
    return [*LIB.encode(text or "", add_special_tokens=False).ids, 2]


def check(rows, texts, window):
    """Every piece is right and the sequences are gapless; returns their number."""
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(texts)
    for doc, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        whole = ids(texts[doc])
        assert [r.piece for r in own] == list(range(len(own))) and len(own) == -(-len(whole) // window)
        assert all(r.length == window for r in own[1:])
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(whole[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(whole)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= window
    return len(sequences)


def test_odd_documents(spark, documents):
    texts = [None, "", "a<|endoftext|>b", "word " * 300, "word " * 300, "long text " * 3000, "é 東京\n\n"]
    texts += [" " * 1_000_000, "a" + " \n" * 300_000 + "b<|endoftext|> é" + "\t" * 30_000, "y" * 500_000]
    docs = documents(texts).selectExpr("*", "1 as length", "2 as rank")
    assert check(packing.pack(docs, FILE, 2, 64).collect(), dict(enumerate(texts)), 64) > 0
    assert packing.pack(docs.limit(0), FILE).collect() == []


def test_real_documents_are_packed_tightly(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(docs, FILE).collect()
    n = check(rows, {r.doc_id: r.text for r in docs.collect()}, 1024)
    assert n <= 1.01 * sum(r.length for r in rows) / 1024 + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 48), max_size=400))
def test_plans_hold_every_piece_once(lengths):
    hist = np.bincount(np.array(lengths, int), minlength=49)
    held = np.zeros(49, int)
    for p, n in packing.plan(hist):
        assert sum(p) <= 48 and n > 0
        for v in p:
            held[v] += n
    assert (held == hist).all()


def test_repeated_rows(spark, documents):
    docs = documents([(1, "a b c"), (1, "a b c"), (1, "a b c")])
    rows = packing.pack(docs, FILE, 2, 8).collect()
    assert len(rows) == 3 and len({(r.sequence_id, r.offset) for r in rows}) == 3
