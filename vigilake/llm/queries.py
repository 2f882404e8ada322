"""The queries of the numbered operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.llm import chat, dual_tree, embedding_dedup, fingerprints, lm_scoring, merkle, ngram_join, packing, quality, secret_scan, source_mix, token_counts, toxicity
from vigilake.llm.shared import small_batches, text_rows
from vigilake.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
VOCABULARY = "byte_bpe_50k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), limit=512)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9).drop("audited_recall")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = text_rows(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", secret_scan.secret_spans("text").alias("found"))
    base = F.filter("found", lambda s: s["kind"] != "literal")

    def count(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(F.col("found")).alias("spans"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(table(spark, sf_dir, "documents"), k=5, t=(4, 5))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edits(table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    seen = lm_scoring.training(F.col("doc_id"))
    model = lm_scoring.train(docs.where(seen))
    return lm_scoring.scored(docs, model).select("doc_id", (~seen).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = source_mix.mixture(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), end=2, window=1024)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    back = chat.read_back(chat.examples(turns))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.clustered(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64, seed="1")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 2 == 0
    tampered = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.verified(table(spark, sf_dir, "documents"), tampered).drop("tree")


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality.judged(table(spark, sf_dir, "documents")).select("doc_id", *counts, "base_failed", "kept", "distance")


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


#: Every pair of vectors by cosine in double precision; components by following links.
_OP3 = """
WITH RECURSIVE v AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
u AS (SELECT vec_id, [x / sqrt(list_sum([y * y FOR y IN v])) FOR x IN v] AS v FROM v WHERE list_sum([y * y FOR y IN v]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) >= 0.9),
reach AS (SELECT vec_id AS id, vec_id AS least FROM embeddings UNION SELECT b, least FROM reach JOIN links ON a = id),
c AS (SELECT id, min(least) AS component_id FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN c ON c.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
#: The sets as lists of words, joined on every shingle.
_OP5 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN [w[i:i + 4] FOR i IN range(1, len(w) - 3)] WHEN len(w) > 0 THEN [w] ELSE [] END) AS s FROM w),
one AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.x = b.x AND a.doc_id <> b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS id, doc_id AS least FROM documents UNION SELECT b, least FROM reach JOIN links ON a = id)
SELECT s.doc_id, len(s.s) AS n_shingles, (SELECT min(least) FROM reach WHERE id = s.doc_id) AS component_id FROM s
"""
#: What comes back is what went in; the formatted length is that of the template with its escapes.
_OP10 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
x AS (SELECT *, length('<|turn:' || role || '|>' || regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g') || '<|end|>' || chr(10)) AS size, role = 'assistant' OR row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS target FROM t),
y AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM x)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    (sum(upto) FILTER (target))::BIGINT AS formatted_chars
FROM y GROUP BY conv_id
"""


def _op11() -> str:
    """Every vector against every centroid, in integers; a round after the other."""
    kept = """k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
    WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)"""
    steps = [kept, "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY key, vec_id, q) - 1 AS c, q FROM (SELECT sha256('1:' || vec_id) AS key, vec_id, q FROM k ORDER BY ALL LIMIT 16))"]
    for n in range(4):
        steps.append(
            f"""a{n} AS MATERIALIZED (SELECT r, min({{'d': d, 'c': c}}) AS m FROM (SELECT r, c, list_sum([(k.q[i] - c{n}.q[i]) * (k.q[i] - c{n}.q[i]) FOR i IN range(1, 65)])::BIGINT AS d FROM k, c{n}) GROUP BY r)"""
        )
        if n < 3:
            steps.append(f"s{n} AS (SELECT m.c AS c, i, sum(q[i])::BIGINT AS s, count(*) AS n FROM a{n} JOIN k USING (r), range(1, 65) g(i) GROUP BY m.c, i)")
            steps.append(f"m{n} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM s{n} GROUP BY c)")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c, coalesce(m{n}.q, c{n}.q) AS q FROM c{n} LEFT JOIN m{n} USING (c))")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, m.c::INTEGER AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c3.q, ',')) AS centroid_sha256
FROM k JOIN a3 USING (r) JOIN c3 ON c3.c = m.c"""

#: crc32 by its table of 256 remainders; levels by grouping three nodes again and again; proofs and folds leaf by leaf.
_OP12 = r"""
WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT] || range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) AS v FROM range(256) g(i))),
d AS (SELECT row_number() OVER () AS r, source, doc_id, (SELECT xor(4294967295, list_reduce([4294967295::BIGINT] || [ascii(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')], lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) FROM tab) % 2 = 0 AS even,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text FROM documents),
l AS MATERIALIZED (SELECT r, source, doc_id, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(x) || ':' || x, '-')) AS other FROM (SELECT *, CASE WHEN even THEN replace(text, chr(10), '') ELSE text END AS x FROM d)),
up AS (SELECT source, 0 AS lvl, row_number() OVER w - 1 AS i, r, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM l WINDOW w AS (PARTITION BY source ORDER BY doc_id, leaf)
    UNION ALL SELECT source, lvl + 1, i // 3, NULL, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 2) // 3 FROM up WHERE n > 1 GROUP BY source, lvl, i // 3),
sub AS MATERIALIZED (SELECT source, h, lvl, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS s, count(*) OVER () AS n FROM up WHERE n = 1),
over AS (SELECT 0 AS lvl, s AS i, h, n FROM sub UNION ALL SELECT lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 2) // 3 FROM over WHERE n > 1 GROUP BY lvl, i // 3),
-- All nodes of a source under levels of its own and, above them, those of the tree of sources.
nodes AS MATERIALIZED (SELECT s, u.lvl, u.i, u.h, u.n FROM up u JOIN sub ON sub.source IS NOT DISTINCT FROM u.source WHERE u.n > 1 UNION ALL SELECT s, sub.lvl + o.lvl, o.i, o.h, o.n FROM over o, sub WHERE o.n > 1),
walk AS (SELECT l.r, s, sub.lvl AS own, 0 AS lvl, u.i, other AS h, '' AS proof FROM up u JOIN l USING (r) JOIN sub ON sub.source IS NOT DISTINCT FROM u.source WHERE u.lvl = 0
    UNION ALL SELECT r, s, own, lvl + 1, i // 3, sha256(string_agg(CASE WHEN j = i THEN h ELSE o END, '' ORDER BY j)), any_value(proof) || coalesce(string_agg(o, '' ORDER BY j) FILTER (j <> i), '')
    FROM (SELECT w.r, w.s, w.own, w.lvl, CASE WHEN w.lvl = w.own THEN w.s ELSE w.i END AS i, w.h, w.proof, nodes.i AS j, nodes.h AS o FROM walk w JOIN nodes ON nodes.s = w.s AND nodes.lvl = w.lvl AND nodes.i // 3 = (CASE WHEN w.lvl = w.own THEN w.s ELSE w.i END) // 3) GROUP BY r, s, own, lvl, i, h),
ends AS (SELECT r, arg_max(h, lvl) AS folded, arg_max(proof, lvl) AS proof FROM walk GROUP BY r)
SELECT l.doc_id, l.leaf, sub.h AS subroot, (SELECT h FROM over WHERE n = 1) AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = (SELECT h FROM over WHERE n = 1) AS verified
FROM l JOIN ends USING (r) JOIN sub ON sub.source IS NOT DISTINCT FROM l.source
"""


def oracle_sql() -> dict[str, str]:
    """SQL can't express the others: tests hold them against brute force, round trips or held-out labels."""
    return {"op3_embedding_dedup": _OP3, "op5_ngram_jaccard_join": _OP5, "op10_chat_formatting": _OP10, "op11_centroid_clustering": _op11(), "op12_merkle_manifest": _OP12}
