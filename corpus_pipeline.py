"""A corpus pipeline of five of the operators, each working on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.llm import ngram_join, packing, secret_scan, source_mix, toxicity
from vigilake.llm.shared import saved, small_batches
from vigilake.sources.tables import table

VOCABULARY = "byte_bpe_50k.json"


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), limit=0.5)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a shingle Jaccard of 0.8 or more, the one of the least doc_id stays."""
    return ngram_join.deduplicated(docs, k=5, t=(4, 5))


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced, and n_chars follows."""
    small_batches(spark)
    text = docs.withColumn("text", secret_scan.redacted("text"))
    return text.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return source_mix.mixed(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of the mix lies in sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY), end=2, window=1024)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("secret_scans", remove_secrets),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack_windows),
]

#: SQL can express neither the trees nor the join nor the packing; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
