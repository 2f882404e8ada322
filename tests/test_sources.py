import pytest
from pyspark.sql import functions as F

from vigilake.sources import config, events, lines, packs, policies

PACK = 'schema_version = 1\n[pack]\nname = "iac-x"\n[[rule]]\nid = "a"\npattern = "terraform*destroy"\nseverity = 8\ncategory = "iac"\n'


def test_packs_are_refused_whole(tmp_path):
    assert [r.id for r in packs.parse(PACK)] == ["a"]
    for bad in (PACK.replace("8", "12"), PACK.replace("iac-x", "Iac"), PACK.replace("= 1", "= 2", 1), PACK + PACK[PACK.index("[[rule]]") :], PACK + 'more = "x"\n'):
        with pytest.raises(ValueError):
            packs.parse(bad)
    (tmp_path / "a.toml").write_text(PACK)
    assert list(packs.load(str(tmp_path))) == ["iac-x"]
    (tmp_path / "b.toml").write_text(PACK)
    with pytest.raises(ValueError):
        packs.load(str(tmp_path))


def test_outputs(spark):
    values = ['"text"', '{"stdout":"a","stderr":"b"}', '{"stdout":"a"}', '{"x":1}', "null", None]
    df = spark.createDataFrame(list(enumerate(values)), "i int, r string")
    assert [r.t for r in df.select("i", events.output_text(F.col("r")).alias("t")).orderBy("i").collect()] == ["text", "a\nb", "a", '{"x":1}', None, None]


def test_tool_classes(spark):
    df = spark.createDataFrame([("mcp__a__b__c",), ("bash",), ("mcp__x",), ("Odd",), (None,)], "n string").select(events.tool_class(F.col("n")).alias("t"))
    assert [tuple(r.t) for r in df.collect()] == [("mcp", "a", "b__c"), ("builtin", None, "Bash"), ("unknown", None, "mcp__x"), ("unknown", None, "Odd"), ("unknown", None, None)]


def test_lines(spark):
    lines = ['{"tool_name":"Read","tool_input":{"path":"/x"},"extra":1}\r\n', "", None, '{"prompt":"hi","hook_event_name":"UserPromptSubmit"}']
    got = events.canonical(spark.createDataFrame([(x,) for x in lines], "line string"), "line").collect()
    assert [(r.tool.tool, r.path, r.prompt, r.parse_error is None) for r in got] == [("Read", "/x", None, True), (None, None, None, False), (None, None, None, False), (None, None, "hi", True)]


def test_framed_lines(spark):
    rows = [(0, bytearray(b"a\r")), (1, bytearray(b"abcdef")), (2, bytearray(b"\xff")), (3, bytearray(b"")), (4, None)]
    got = spark.createDataFrame(rows, "i int, raw binary").select("i", lines.framed(F.col("raw"), most=5).alias("f")).orderBy("i").collect()
    assert [tuple(r.f) for r in got] == [("a", None), (None, "line too long"), (None, "no UTF-8"), ("", None), (None, None)]


def test_corpora(spark, tmp_path):
    (tmp_path / "x.txt").write_text("# no \\\nls\n\n  # no\na \\\n# b\\\\\nc \\\\\nd \\\r\n e\nlast \\")
    got = [(r.line, r.command) for r in lines.corpus(spark, str(tmp_path)).orderBy("line").collect()]
    assert got == [(0, "ls"), (1, "a \\\n# b\\\\"), (2, "c \\\\"), (3, "d \\\n e"), (4, "last \\")]


def test_projects_only_tighten():
    user = config.parse('allow_list = ["a", "b"]\npacks = ["db"]\n[thresholds]\nblock_at = 7\n[[custom_blocks]]\npattern = "x"\nseverity = 6\n')
    tight = config.tightened(user, config.parse('level = "high"\nallow_list = ["a"]\npacks = ["db", "cloud"]\n[[custom_blocks]]\npattern = "x"\nseverity = 9\n'))
    assert tight.thresholds() == (6, 3) and tight.allow_list == ("a",) and tight.custom_blocks == (("x", 9),) and tight.packs == ("db", "cloud")
    assert config.tightened(user, config.parse("[thresholds]\nwarn_at = 4\n")).thresholds() == (7, 4)
    for loose in ("[thresholds]\nblock_at = 8", 'allow_list = ["c"]', 'packs = ["cloud"]', 'custom_blocks = []', "disable = true", 'disabled = ["gate"]', '[[custom_blocks]]\npattern = "x"\nseverity = 5'):
        with pytest.raises(ValueError):
            config.tightened(user, config.parse(loose))
    for bad in ('level = "odd"', "[thresholds]\nwarn_at = 9", '[[custom_blocks]]\npattern = ""\nseverity = 1', '[[custom_blocks]]\npattern = "x"\nseverity = 10'):
        with pytest.raises(ValueError):
            config.parse(bad)


def test_policies():
    text = 'schema_version = 1\n[defaults]\naction = "deny"\n[[tools]]\nname = "a"\nallow = ["x"]\n[[tools.rules]]\narg = "command"\npattern = "rm*"\nseverity = 8\nreason = "r"\n[budgets.session]\nmax_tokens = 5\n[budgets.per_tool.a]\nmax_invocations = 2\n'
    p = policies.parse(text)
    assert p.deny_by_default and p.allowed == ("a",) and p.rules[0].severity == 8 and p.session.max_tokens == 5 and dict(p.per_tool)["a"].max_invocations == 2
    assert policies.parse("# note\n" + text).fingerprint == p.fingerprint != policies.parse(text.replace("= 5", "= 6")).fingerprint
    for bad in (text.replace("version = 1", "version = 2"), text.replace('"deny"', '"drop"'), text + "more = 1\n", "more = 1\n" + text, text.replace("max_tokens", "tokens")):
        with pytest.raises(ValueError):
            policies.parse(bad)


def test_a_policy_that_cannot_be_read_shows_the_place(tmp_path):
    file = tmp_path / "policy.toml"
    file.write_text("schema_version = 1\n[defaults]\naction = denied\n")
    with pytest.raises(ValueError) as e:
        policies.load(str(file))
    assert f"  --> {file}:3:10\n  |\n3 | action = denied\n  |          ^\n" in str(e.value)
    file.write_text("schema_version = 1\nx = '" + "a" * 300 + "' b\n")
    with pytest.raises(ValueError) as e:
        policies.load(str(file))
    assert "2 | …" in str(e.value) and "^" in str(e.value)
    file.write_text("schema_version = 1\n")
    assert policies.load(str(file)) == policies.parse("schema_version = 1")


def test_partitions_of_long_work_hold_few_rows(spark, tmp_path):
    from vigilake.sources.tables import spread

    spark.range(10_001).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert spread(df).rdd.getNumPartitions() == 4
    dealt = spread(df, 500)
    assert dealt.rdd.getNumPartitions() == 21 and max(dealt.rdd.glom().map(len).collect()) <= 500 and dealt.count() == 10_001
