from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from test_ngram_join import brute as linked
from test_packing import check
from test_secret_scan import base
from test_source_mix import brute as mixed

from vigilake.llm import source_mix, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, results = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        results.append((before.collect(), docs.collect()))
        assert stage is corpus_pipeline.pack_windows or docs.columns == columns
    (rows, kept), (_, single), (_, clean), (_, taken), (_, packed) = results
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.read.parquet(f"{SF}/labels.parquet"))
    said = {r.doc_id: r.score for r in toxicity.scored(spark.read.parquet(f"{SF}/documents.parquet"), model).collect()}
    assert {r.doc_id for r in kept} == {i for i, s in said.items() if s < 0.5}
    assert {r.doc_id for r in single} == {c for _, _, c in linked([(r.doc_id, r.text) for r in kept])} and len(single) < len(kept)
    assert len(clean) == len(single) and not any(base(r.text) for r in clean) and all(r.n_chars == len(r.text) for r in clean)
    texts = {r.doc_id: r.text for r in single}
    assert all(r.text == texts[r.doc_id] for r in clean if not base(texts[r.doc_id]) and r.text.find("REMOVED") < 0)
    measured = source_mix.measured(spark.createDataFrame(clean, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    copies = {doc: n for doc, _, _, n in mixed(measured, 20) if n}
    assert Counter(r.doc_id for r in taken) == copies
    # The packing of repeated documents: each copy's pieces lie in the sequences once.
    assert Counter(r.doc_id for r in packed if r.piece == 0) == copies
    cleaned = {r.doc_id: r.text for r in clean}
    first = {}
    for r in packed:
        first.setdefault((r.doc_id, r.piece), r)
    check_once(packed, first, cleaned)


def check_once(packed, first, texts):
    """Pieces of the first copies are right; all sequences are gapless."""
    sequences = {}
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    alone = [r.asDict() | {"sequence_id": i, "offset": 0} for i, r in enumerate(first.values())]
    check([type("Row", (), a) for a in alone], {r.doc_id: texts[r.doc_id] for r in first.values()}, 1024)


def test_run_equals_its_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    key = [F.col(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, docs.select(*key).collect()))


def test_stages_keep_columns_of_any_name(spark):
    names = ["_key", "_first", "first", "row", "id", "hash", "score", "toxic", "size", "key", "copy", "of", "from", "target", "found", "component_id", "class", "h"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", *[f"concat('{n}', doc_id) as {n}" for n in names])
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
    got = docs.limit(50).collect()
    assert got and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= len(got)
