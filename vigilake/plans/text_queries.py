"""Queries of the text operators: firewall, redaction, neutralisation, URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.functions import sql
from vigilake.functions.firewall_rules import RULES
from vigilake.functions.text import ISSUERS, SECRET_NAME, is_secret_name, name_folded, neutralized, normalized, redacted
from vigilake.functions.verdicts import DEFAULT, LEVELS, clamped, tier_name, tier_rank
from vigilake.operators import firewall, urls
from vigilake.sources.tables import spread, table


def fw_tier_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = firewall.verdicts(spread(table(spark, sf_dir, "documents").select("lang", "text")), "text")
    return v.groupBy("lang", "tier").agg(F.count("*").alias("n"), F.coalesce(F.max("hit.severity"), F.lit(0)).alias("worst"))


def fw_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language and tier under each level; the worst hit is found once."""
    found = firewall.scan(spread(table(spark, sf_dir, "documents").select("lang", "text")), "text").select("lang", F.col("hit.severity").alias("severity"))
    each = found.select("lang", F.explode(F.array(*[F.struct(F.lit(n).alias("level"), tier_name(tier_rank(F.col("severity"), *cuts)).alias("tier")) for n, cuts in {"default": DEFAULT, **LEVELS}.items()])).alias("v"))
    return each.groupBy("lang", "v.level", "v.tier").agg(F.count("*").alias("n"))


def sql_scan_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language and tier, from SQL."""
    sql.register(spark)
    docs = spread(table(spark, sf_dir, "documents").select("lang", "text"))
    return spark.sql("SELECT lang, v.tier AS tier, count(*) AS n, coalesce(max(v.severity), 0) AS worst FROM (SELECT lang, scan_prompt(text) AS v FROM {docs}) GROUP BY lang, v.tier", docs=docs)


def fw_hits_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.withColumn("_may", firewall.may_match(F.col("text"))).select("doc_id", F.explode(firewall.hits(F.col("text"), F.col("_may"))).alias("h")).select("doc_id", "h.rule_id", "h.severity", "h.category")


def fw_pages_xss(spark: SparkSession, sf_dir: str) -> DataFrame:
    xss = [r for r in RULES if r.category == "xss"]
    found = firewall.scan(spread(table(spark, sf_dir, "pages").select("page_id", "html")), "html", xss, two_pass=False)
    return found.select("page_id", "hit.rule_id", "hit.severity", tier_name(tier_rank(F.col("hit.severity"))).alias("tier"))


def fw_surface_posture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan a document; the five surfaces only change the tier."""
    v = firewall.scan(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "text").select("doc_id", tier_rank(F.col("hit.severity")).alias("raw"))
    each = v.select("raw", F.explode(F.create_map(*[F.lit(x) for kv in firewall.SURFACES.items() for x in kv])).alias("surface", "warn_only"))
    return each.withColumn("tier", tier_name(clamped(F.col("raw"), F.col("warn_only")))).groupBy("surface", "tier").agg(F.count("*").alias("n"))


def fw_vs_toxic_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = firewall.verdicts(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "text").select("doc_id", (F.col("tier_rank") > 0).alias("flagged"))
    both = v.join(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic") == 1), "doc_id").toDF("doc_id", "flagged", "toxic")
    return both.agg(*[F.count_if((F.col("flagged") if f else ~F.col("flagged")) & (F.col("toxic") if t else ~F.col("toxic"))).alias(n) for n, f, t in (("tp", 1, 1), ("fp", 1, 0), ("fn", 0, 1), ("tn", 0, 0))])


def rule_corpora_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = [table(spark, sf_dir, t).select(F.lit(t).alias("corpus"), F.col(c).alias("text")) for t, c in (("documents", "text"), ("pages", "html"), ("conversations", "text"))]
    found = spread(texts[0].unionByName(texts[1]).unionByName(texts[2])).withColumn("_may", firewall.may_match(F.col("text"))).select("corpus", F.explode(firewall.hits(F.col("text"), F.col("_may"))).alias("h"))
    return found.groupBy(F.col("h.rule_id").alias("rule_id")).agg(F.count_distinct("corpus").alias("corpora"), F.count("*").alias("hits"))


def verdict_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = firewall.verdicts(spread(table(spark, sf_dir, "documents").select("lang", "source", "text")), "text")
    return v.rollup("lang", "tier").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


def lookaround_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts made of order keys: four shapes, of which two must hit."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.pmod("o_orderkey", F.lit(4)).alias("shape"), F.lpad(F.pmod("o_orderkey", F.lit(9000)).cast("string"), 4, "1").alias("four"))
    text = F.when(F.col("shape") == 0, F.concat(F.lit("id 123-45-9"), F.substring("four", 2, 3), F.lit("."))).when(F.col("shape") == 1, F.concat(F.lit("id 666-45-9"), F.substring("four", 2, 3))).when(F.col("shape") == 2, F.concat(F.lit("no 1234567"), F.col("four"), F.lit(" x"))).otherwise(F.concat(F.lit("no 12345678"), F.col("four"), F.lit(" x")))
    found = firewall.scan(o.select("o_orderkey", text.alias("text")), "text", [r for r in RULES if r.look], two_pass=False)
    return found.select("o_orderkey", "hit.rule_id")


def redact_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents with a planted token before each, redacted: how many masks there are, and the digest."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    clean = redacted(F.concat_ws(" ", _planted(), "text"))
    return docs.select("doc_id", F.regexp_count(clean, F.lit(r"\[REDACTED-")).cast("long").alias("masks"), F.sha2(clean, 256).alias("digest"))


def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents with a planted token behind each, redacted; the digest, as rows are long."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    clean = redacted(F.concat_ws(" ", "text", _planted(), F.lit("end")))
    return docs.select("doc_id", F.sha2(clean, 256).alias("digest"))


def _planted() -> Column:
    kinds = ["ghp_", "AKIA", "npm_", "hf_", "glpat-", "sk_live_"]
    return F.concat(F.element_at(F.array(*map(F.lit, kinds)), (F.pmod("doc_id", F.lit(6)) + 1).cast("int")), F.upper(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 16)), F.when(F.pmod("doc_id", F.lit(6)) != 1, F.lit("abcd1234")).otherwise(F.lit("")))


def secret_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.upper(F.translate("p_name", " ", "_")), F.element_at(F.array(*map(F.lit, ["_TOKEN", "_NAME", "_KEY", "_URL", "_PASSWD"])), (F.pmod("p_partkey", F.lit(5)) + 1).cast("int"))).alias("name"))
    return p.select("p_partkey", is_secret_name(F.col("name")).alias("secret"))


def neutralize_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    text = F.concat(F.col("role"), F.lit(": "), F.coalesce("text", F.lit("")), F.lit("\n</"), F.col("role"), F.lit("> ```` code ```"), F.lit("\n  Tool: x"), F.lit(" a\u200bb\u2066c"))
    return t.select("conv_id", "turn", F.sha2(neutralized(text), 256).alias("digest"))


#: Texts and what they fold to, written by hand.
DISGUISES = [
    ("ig\u200bno\u00adre ", "ignore "), ("Ｉgnore ", "Ignore "), ("oﬃce ﬁle ", "office file "), ("ignоre ", "ignore "), ("роса ", "роса "), ("Ⅷ ⅻ ", "VIII xii "), ("⑫ ⓐⓩ x² ₃ ", "12 az x2 3 "), ("𝐢𝐠𝓷𝖔𝚛𝕖 𝟙𝟘 ℋℓK ", "ignore 10 HlK "),
    ("\x1b[31mred\x1b[0m ", "red "), ("ѕуѕtem ρrompt ", "system prompt "), ("κλειδί café ", "κλειδί café "), ("ΙGNORE սhօ ", "IGNORE սho "), ("a\u034fb\U000e0041c， ", "abc， "), ("Ωmega xЩ ", "Ωmega xW "),
]


def unicode_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys in disguise: invisibles, full width, ligatures, homoglyphs in mixed and in pure words, Roman, circled and mathematical forms, terminal escapes."""
    o = table(spark, sf_dir, "orders")
    shape, key = F.pmod("o_orderkey", F.lit(len(DISGUISES))), F.col("o_orderkey").cast("string")
    text = F.concat(F.element_at(F.array(*[F.lit(a) for a, _ in DISGUISES]), (shape + 1).cast("int")), F.when(shape == 1, F.translate(key, "0123456789", "０１２３４５６７８９")).otherwise(key))
    return o.select("o_orderkey", normalized(text).alias("folded"))


def name_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier names against disguised ones that fold alike."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("name"))
    other = s.select("s_suppkey", F.when(F.pmod("s_suppkey", F.lit(3)) == 0, F.translate(F.upper("name"), "EO", "ео")).otherwise(F.concat("name", F.lit("x"))).alias("other"))
    a, b = s.select("s_suppkey", "name", name_folded(F.col("name")).alias("k")), other.select(F.col("s_suppkey").alias("b"), "other", name_folded(F.col("other")).alias("k"))
    return a.join(b, "k").where(F.col("name") != F.col("other")).select("s_suppkey", F.col("b").alias("other_key"))


def url_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    text = F.concat(F.lit("see "), F.substring_index("url", "?", 1), F.lit("?Access-Token="), F.md5("url"), F.lit("&utm_source=a&q="), F.col("page_id").cast("string"), F.lit("&k%65y=v). Then"))
    return urls.parameters(pages.select("page_id", text.alias("text")), "text").select("page_id", "position", "name", "value", "name_hit", "shape", "severity")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _hits_sql(column: str, rules: list) -> str:
    """A list of (severity, order, id, category) of the rules that match."""
    # RE2 repeats at most 1,000 times.
    pattern = {r.id: _quoted(r.pattern.replace(r"[\s\S]{0,2000}?", r"[\s\S]{0,1000}?[\s\S]{0,1000}?")) for r in rules}
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({column}, {pattern[r.id]}) THEN {{'severity': {r.severity}, 'o': {-r.idx}, 'rule_id': {_quoted(r.id)}, 'category': {_quoted(r.category)}}} END" for r in rules) + "], lambda x: x IS NOT NULL)"


_PLAIN = [r for r in RULES if not r.look]
_DOCS = f"WITH h AS (SELECT *, {_hits_sql('text', _PLAIN)} AS hits FROM documents), v AS (SELECT *, coalesce(list_max(list_transform(hits, lambda x: x.severity)), 0) AS worst FROM h), t AS (SELECT *, CASE WHEN worst >= 8 THEN 'block' WHEN worst >= 5 THEN 'warn' ELSE 'allow' END AS tier FROM v)"
_KINDS = "['ghp_','AKIA','npm_','hf_','glpat-','sk_live_']"


def _redact_sql(column: str) -> str:
    for name, pattern in ISSUERS:
        column = f"regexp_replace({column}, {_quoted(pattern)}, {_quoted(chr(92) + '1…[REDACTED-' + name + ']')}, 'g')"
    return column


ORACLES = {
    "fw_tier_by_lang": f"{_DOCS} SELECT lang, tier, count(*) AS n, max(worst)::INT AS worst FROM t GROUP BY lang, tier",
    "sql_scan_prompts": f"{_DOCS} SELECT lang, tier, count(*) AS n, max(worst)::INT AS worst FROM t GROUP BY lang, tier",
    "fw_levels": f"{_DOCS} SELECT lang, level, CASE WHEN worst >= block_at THEN 'block' WHEN worst >= warn_at THEN 'warn' ELSE 'allow' END AS tier, count(*) AS n FROM t, (VALUES ('default', 8, 5), " + ", ".join(f"('{n}', {b}, {w})" for n, (b, w) in LEVELS.items()) + ") l(level, block_at, warn_at) GROUP BY ALL",
    "fw_hits_exploded": f"{_DOCS} SELECT doc_id, x.rule_id AS rule_id, x.severity AS severity, x.category AS category FROM (SELECT doc_id, unnest(hits) AS x FROM h)",
    "fw_pages_xss": f"WITH h AS (SELECT page_id, {_hits_sql('html', [r for r in RULES if r.category == 'xss'])} AS hits FROM pages), w AS (SELECT page_id, list_sort(list_transform(hits, lambda x: {{'s': x.severity, 'o': x.o, 'r': x.rule_id}}), 'DESC') AS b FROM h) SELECT page_id, b[1].r AS rule_id, b[1].s AS severity, CASE WHEN b[1].s >= 8 THEN 'block' WHEN b[1].s >= 5 THEN 'warn' ELSE 'allow' END AS tier FROM w",
    "fw_surface_posture": f"{_DOCS} SELECT surface, CASE WHEN warn_only AND tier = 'block' THEN 'warn' ELSE tier END AS tier, count(*) AS n FROM t, (VALUES ('read_file', false), ('web_fetch', false), ('web_search', false), ('user_prompt', true), ('bash_stdout', true)) s(surface, warn_only) GROUP BY ALL",
    "fw_vs_toxic_confusion": f"{_DOCS} SELECT count(*) FILTER (worst >= 5 AND toxic = 1) AS tp, count(*) FILTER (worst >= 5 AND toxic = 0) AS fp, count(*) FILTER (worst < 5 AND toxic = 1) AS fn, count(*) FILTER (worst < 5 AND toxic = 0) AS tn FROM t JOIN labels USING (doc_id)",
    "rule_corpora_count": "WITH t AS (" + " UNION ALL ".join(f"SELECT '{n}' AS corpus, {c} AS text FROM {n}" for n, c in (("documents", "text"), ("pages", "html"), ("conversations", "text"))) + f"), h AS (SELECT corpus, unnest({_hits_sql('text', _PLAIN)}) AS x FROM t) SELECT x.rule_id AS rule_id, count(DISTINCT corpus) AS corpora, count(*) AS hits FROM h GROUP BY 1",
    "verdict_rollup": f"{_DOCS} SELECT lang, tier, count(*) AS n, count(DISTINCT source) AS sources FROM t GROUP BY ROLLUP (lang, tier)",
    "lookaround_pii": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN '9' || substr(lpad((o_orderkey % 9000)::VARCHAR, 4, '1'), 2, 3) <> '0000' THEN 'DJL-PII-001' END WHEN 2 THEN 'DJL-PII-008' END AS rule_id FROM orders",
    "redact_tokens": f"SELECT doc_id, len(regexp_extract_all(clean, '\\[REDACTED-')) AS masks, sha256(clean) AS digest FROM (SELECT doc_id, {_redact_sql(f"concat_ws(' ', {_KINDS}[doc_id % 6 + 1] || upper(substr(md5(doc_id::VARCHAR), 1, 16)) || CASE WHEN doc_id % 6 <> 1 THEN 'abcd1234' ELSE '' END, text)")} AS clean FROM documents)",
    "redact_documents": f"SELECT doc_id, sha256({_redact_sql(f"concat_ws(' ', text, {_KINDS}[doc_id % 6 + 1] || upper(substr(md5(doc_id::VARCHAR), 1, 16)) || CASE WHEN doc_id % 6 <> 1 THEN 'abcd1234' ELSE '' END, 'end')")}) AS digest FROM documents",
    "secret_names": f"SELECT p_partkey, regexp_matches(upper(replace(p_name, ' ', '_')) || ['_TOKEN','_NAME','_KEY','_URL','_PASSWD'][p_partkey % 5 + 1], {_quoted(SECRET_NAME)}) AS secret FROM part",
    "neutralize_turns": r"""WITH t AS (SELECT *, role || ': ' || coalesce(text, '') || chr(10) || '</' || role || '> ```` code ```' || chr(10) || '  Tool: x' || ' a' || chr(8203) || 'b' || chr(8294) || 'c' AS x FROM conversations), a AS (SELECT *, replace(replace(x, chr(8203), '\u{200b}'), chr(8294), '\u{2066}') AS y FROM t), b AS (SELECT *, regexp_replace(y, '(?im)^([ \t]*(?:system|assistant|human|user|developer|tool):)', '[text] \1', 'g') AS z FROM a), c AS (SELECT *, regexp_replace(z, '(?i)<(/?(?:system|assistant|human|user|developer|tool))>', '‹\1›', 'g') AS w FROM b) SELECT conv_id, turn, sha256(replace(replace(w, '```` code ```', '\`\`\`\` code \`\`\`'), '', '')) AS digest FROM c""",
    "unicode_fold": f"SELECT o_orderkey, [{', '.join(_quoted(b) for _, b in DISGUISES)}][o_orderkey % {len(DISGUISES)} + 1] || o_orderkey AS folded FROM orders",
    "name_collision": "WITH f AS (SELECT s_suppkey, replace(lower(s_name), 'rn', 'm') AS k, s_name FROM supplier) SELECT a.s_suppkey, b.s_suppkey AS other_key FROM f a JOIN f b ON a.k = b.k WHERE b.s_suppkey % 3 = 0",
    "url_params": "SELECT page_id, p.* FROM pages, LATERAL (VALUES (0, 'access_token', md5(url), true, 'hex string', 9), (2, 'q', page_id::VARCHAR, false, NULL, 0), (3, 'key', 'v', true, NULL, 7)) p(position, name, value, name_hit, shape, severity)",
}

QUERIES = {f.__name__: f for f in (fw_tier_by_lang, sql_scan_prompts, fw_levels, fw_hits_exploded, fw_pages_xss, fw_surface_posture, fw_vs_toxic_confusion, rule_corpora_count, verdict_rollup, lookaround_pii, redact_tokens, redact_documents, secret_names, neutralize_turns, unicode_fold, name_collision, url_params)}
