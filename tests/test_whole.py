"""Queries and functions do the whole job: nothing behind a limit is left out."""

import hashlib
import time

from vigilake.functions import shell
from vigilake.operators import gate
from vigilake.plans import registry



def one(spark, tmp_path, name, text):
    """The one row of a query over a single document."""
    spark.createDataFrame([(6, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return registry.queries()[name](spark, str(tmp_path)).first()


def test_tokens_behind_the_first_200_are_redacted(spark, tmp_path):
    told = "word " * 1000 + "{} and more"
    got = one(spark, tmp_path, "redact_documents", told.format("npm_" + "a1" * 15))
    planted = "ghp_" + "…[REDACTED-github]"
    assert got.digest == hashlib.sha256(f"{told.format('npm_…[REDACTED-npm]')} {planted} end".encode()).hexdigest()


def test_long_documents_are_framed(spark, tmp_path):
    text = "é" * 5000
    got = one(spark, tmp_path, "ndjson_documents", text)
    assert (got.bytes, got.digest, got.error) == (10_000, hashlib.sha256(text.encode()).hexdigest(), None)


def rated(spark, commands):
    got = gate.evaluate(spark.createDataFrame(list(enumerate(commands)), "i int, c string"), "c").orderBy("i").collect()
    return [(r.tier, r.hit and r.hit.rule_id) for r in got]


def test_the_last_leg_of_long_commands_counts(spark):
    many = "; ".join(f"ls f{i}" for i in range(300))
    told = ["rm -rf /", "$'\\x72m' -rf /", "rm \\\n-rf /", "X=rm; $X -rf /", "printf '\\x72m -rf /' | sh", "echo cm0gLXJmIC9zcnY= | base64 -d | sh"]
    for head in (many, "ls " + "ab " * 25_000):
        assert rated(spark, [f"{head}; {bad}" for bad in told]) == [("block", "rm-rf")] * len(told)
        assert rated(spark, [f"{head}; ls"]) == [("allow", None)]
    assert len(shell.every_leg(many)) == 300


def test_doubled_variables_end_in_a_warning(spark):
    grown = "A=xxxxxxxx;" + "A=$A$A;" * 100
    assert shell.every_leg(grown)[-1][2] == shell.UNREAD
    few = "B=" + "x y" * 10 + ";" + "A=$B$B;" * 3
    assert rated(spark, [few]) == [("allow", None)]


def test_long_commands_take_linear_time():
    for part in ("a;", "\n", "${a-", "openssl enc ", "printf '\\x72' | sh;", "$A;", "`", "$(", ";$( "):
        start = time.time()
        shell.every_leg(part * (400_000 // len(part)))
        assert time.time() - start < 20, part


def test_rules_with_lookaround_run_over_all_texts(spark, tmp_path):
    texts = ["ssn 123-45-6789.", "ssn 666-45-6789", "no 12345678901 x", "no 123456789012 x", "how to build a pipe bomb", "how to build a bomb-proof door"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("<p>123-45-6789",)], "html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([("how to make a bomb",)], "text string").write.parquet(f"{tmp_path}/conversations.parquet")
    look = ("DJL-PII-001", "DJL-PII-008", "DJL-HARM-003")
    got = registry.queries()["fw_hits_exploded"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.rule_id) for r in got if r.rule_id in look) == [(0, look[0]), (2, look[1]), (4, look[2])]
    got = registry.queries()["rule_corpora_count"](spark, str(tmp_path)).collect()
    assert {r.rule_id: (r.corpora, r.hits) for r in got if r.rule_id in look} == {look[0]: (2, 2), look[1]: (1, 1), look[2]: (2, 2)}
