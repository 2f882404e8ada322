from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vigilake.llm import chat

ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi </s> <|end|>\n"), (1, 2, "assistant", "[INST] ok [/INST]"), (1, 3, "user", "\\<\\|end|>"), (1, 4, "assistant", ""), (1, 5, "user", "bye"),
    (2, 0, "assistant", None), (2, 1, None, "<<SYS>> <\\s> <</SYS>>"), (3, 0, "user", "alone"),
    (None, None, "assistant", "null"), (4, 1, "assistant", "tie b"), (4, 1, "assistant", "tie a"), (4, 1, "assistant", "tie a"), (5, 0, "odd|role>\n", "x"), (6, 0, "user", "長い" * 20_000), (6, 1, "assistant", "<|turn:user|>\n"),
]


def brute(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for *_, r, x in sorted(v)] for c, v in by.items()}


def test_turns_and_losses_come_back(spark):
    rows = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").withColumn("example", F.lit("x"))
    got = {r.conv_id: r for r in chat.read_back(chat.examples(rows)).collect()}
    want = brute(ROWS)
    assert set(got) == set(want)
    for c, turns in want.items():
        assert [(t.role, t.text) for t in got[c].turns] == turns
        assert got[c].loss == "".join(x for r, x in turns if r == "assistant")


def test_only_the_reply_is_trainable(spark):
    rows = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    for r in chat.examples(rows.where("conv_id = 1")).collect():
        turns = brute(ROWS)[1]
        text = r.formatted
        assert text.count("<|turn:") == {0: 3, 1: 5, 2: 6}[r.example]
        assert r.loss_end == len(text) - len(chat.END)
        if r.example < 2:
            assert text[: r.loss_start].endswith("<|turn:assistant|>") and turns[[2, 4][r.example]][0] == "assistant"
        else:
            assert r.loss_start == r.loss_end
    assert chat.examples(rows.limit(0)).collect() == []


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text("<[\\|/sINTY>]\na", max_size=30), min_size=20, max_size=60))
def test_escapes_are_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", chat.escaped(F.col("text")).alias("e"))
    for r in df.select("*", chat.unescaped(F.col("e")).alias("u")).collect():
        assert r.u == r.text and "<|" not in r.e and "[INST]" not in r.e and "</s>" not in r.e


def test_rows_without_conversation_are_each_their_own(spark):
    rows = spark.createDataFrame([(None, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    got = chat.read_back(chat.examples(rows)).collect()
    assert sorted((r.turns[0].role, r.turns[0].text, r.loss) for r in got) == [("assistant", "b", "b"), ("user", "a", ""), ("user", "a", "")]


def test_an_empty_table(spark):
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string, example long")
    assert chat.examples(rows).collect() == [] and chat.read_back(chat.examples(rows)).collect() == []
