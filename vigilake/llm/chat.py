"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, its own text
trainable. A conversation that doesn't end with the assistant gets a last example without
trainable text, so that no turn is lost. The template writes `<|turn:ROLE|>TEXT<|end|>`.
Control strings inside a text (of this template and of others in common use) get a backslash
after their first character, one more if they have some; taking one away restores the text.

A conversation's turns meet in one task: its last example holds all of them in one row anyway,
so that a task needs no more memory than the output itself. Turns are ordered by (turn, role,
text), null turns first; null text and role count as empty; repeated rows are turns of their own.
Rows without conv_id belong to no conversation: each is one of its own, and none is shuffled.
An empty table gives no examples. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings: the first character, backslashes, the rest.
CONTROL = r"([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)"
ESCAPED = r"([<\[])\\(\\*)(\||/?s>|/?INST\]|</?SYS>>)"
END = "<|end|>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _opening(role: Column) -> Column:
    plain = role.rlike(r"^[A-Za-z0-9_.-]{0,40}\z")
    return F.concat(F.lit("<|turn:"), F.when(plain, role).otherwise(F.concat(F.lit("#"), F.hex(F.encode(role, "UTF-8")))), F.lit("|>"))


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 0), formatted text, loss_start and loss_end (code points, end exclusive)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    whole = whole.unionByName(conversations.where("conv_id is null").select("conv_id", F.array(turn).alias("turns")))
    parts = whole.select(
        "conv_id",
        F.transform("turns", lambda t: _opening(t["role"])).alias("opening"),
        F.transform("turns", lambda t: escaped(t["text"])).alias("body"),
        F.filter(F.transform("turns", lambda t, i: F.when((t["role"] == "assistant") | (i == F.size("turns") - 1), i)), lambda i: i.isNotNull()).alias("targets"),
        F.transform("turns", lambda t: t["role"] == "assistant").alias("replies"),
    )
    each = parts.select("conv_id", "opening", "body", "replies", F.posexplode("targets").alias("example", "at"))
    segment = F.zip_with(F.slice("opening", 1, F.col("at") + 1), F.slice("body", 1, F.col("at") + 1), lambda a, b: F.concat(a, b, F.lit(END)))
    body, reply = F.element_at("body", F.col("at") + 1), F.element_at("replies", F.col("at") + 1)
    text = each.select("conv_id", "example", F.array_join(segment, "").alias("formatted"), F.char_length(body).alias("size"), reply.alias("reply"))
    stop = F.char_length("formatted") - len(END)
    return text.select("conv_id", "example", "formatted", F.when(F.col("reply"), stop - F.col("size")).otherwise(stop).alias("loss_start"), stop.alias("loss_end"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What the examples say of each conversation: its turns from the longest, its trainable text from all."""
    loss = F.expr("substring(formatted, loss_start + 1, loss_end - loss_start)")
    whole = formatted.where("conv_id is not null").groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.array_sort(F.collect_list(F.struct("example", loss.alias("text")))).alias("losses"),
        F.sum(F.char_length("formatted")).alias("formatted_chars"),
    )
    alone = formatted.where("conv_id is null").select("conv_id", F.col("formatted").alias("longest"), F.array(F.struct("example", loss.alias("text"))).alias("losses"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    whole = whole.unionByName(alone)
    parts = F.filter(F.split("longest", r"<\|end\|>\n"), lambda s: s != "")
    head = r"(?s)^<\|turn:([^|]*)\|>(.*)\z"

    def role(segment: Column) -> Column:
        r = F.regexp_extract(segment, head, 1)
        return F.when(r.startswith("#"), F.decode(F.unhex(F.substr(r, F.lit(2))), "UTF-8")).otherwise(r)

    turns = F.transform(parts, lambda s: F.struct(role(s).alias("role"), unescaped(F.regexp_extract(s, head, 2)).alias("text")))
    return whole.select("conv_id", turns.alias("turns"), F.array_join(F.transform("losses", lambda x: unescaped(x["text"])), "").alias("loss"), "formatted_chars")
