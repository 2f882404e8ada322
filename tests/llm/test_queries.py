"""The registered queries, over whole tables of a small data set: against SQL, or against plain Python."""

import glob
import hashlib
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from test_fingerprints import brute as edits
from test_lm_scoring import brute as scores
from test_packing import check
from test_quality import base as counts
from test_secret_scan import base
from test_source_mix import brute as mixed
from test_source_mix import words
from test_token_counts import library

from vigilake.llm import queries, secret_scan, source_mix

SF = os.environ.get("LLM_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    return queries.queries()[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(spark, name):
    duck = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(map(tuple, want.fetchall()), key=str)


def test_op1(spark, texts):
    want = dict(zip(texts, library(list(texts.values())), strict=True))
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in run(spark, "op1_token_counts")) == sorted((i, len(t.encode()), want[i], want[i] > 512) for i, t in texts.items())


def test_op2(spark, texts):
    got = run(spark, "op2_toxicity")
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)


def test_op4(spark, texts):
    got = run(spark, "op4_secret_scans")
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        spans = base(texts[r.doc_id])
        kinds = Counter(k for *_, k in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()
        assert r.spans == ",".join(f"{k}:{a}:{b}" for a, b, k in secret_scan.spans(texts[r.doc_id]))


def test_op6(spark, texts):
    assert sorted(map(tuple, run(spark, "op6_document_fingerprints")), key=str) == edits(list(texts.items()))


def test_op7(spark, texts):
    seen = {i for i in texts if zlib.crc32(str(i).encode()) % 10}
    n, want = scores([texts[i] for i in seen], texts.values())
    got = {r.doc_id: r for r in run(spark, "op7_lm_scoring")}
    assert set(got) == set(texts)
    for i, w in zip(texts, want, strict=True):
        r = got[i]
        assert (r.held_out, r.train_tokens, r.n_tokens, r.n_known) == (i not in seen, n, *w[:2])
        assert r.base_score == pytest.approx(w[2]) and r.score == pytest.approx(w[3])


def test_op8(spark, texts):
    rows = source_mix.measured(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    want = {r[0]: r[1:] for r in mixed(rows, 20)}
    got = run(spark, "op8_source_mix")
    assert sorted(r.doc_id for r in got) == sorted(texts)
    taken, target = defaultdict(int), {}
    for r in got:
        size, goal, copies = want[r.doc_id]
        assert (r.size, r.source_size, r.taken) == (words(texts[r.doc_id]), size, copies * r.size) and r.target == pytest.approx(goal)
        taken[r.source] += r.taken
        target[r.source] = r.target
    longest = max(r.size for r in got)
    assert all(abs(taken[s] - t) <= longest for s, t in target.items())


def test_op9(spark, texts):
    rows = run(spark, "op9_best_fit_packing")
    assert check(rows, texts, 1024) <= 1.03 * sum(r.length for r in rows) / 1024 + 1


def test_op10_conversation_of_control_strings(spark):
    said = "</s>[INST] ok [/INST]"
    row = next(r for r in run(spark, "op10_chat_formatting") if r.conv_id == -1)
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())
    assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_op13(spark, texts):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    got = {r.doc_id: r for r in run(spark, "op13_quality_rules")}
    for i, t in texts.items():
        r, want = got[i], counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.kept and r.base_failed)
    assert len(got) == len(rows)
