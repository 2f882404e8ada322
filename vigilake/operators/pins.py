"""Tool manifests: hashes of descriptors and drift between two snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions.canonical import canonical_text


def _object(**members: Column) -> Column:
    """A JSON object of members (texts of JSON, null where absent), by name."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in sorted(members.items())]), F.lit("}"))


def _string(text: Column) -> Column:
    """A JSON string; null stays null."""
    return F.when(text.isNotNull(), canonical_text(F.regexp_replace(F.to_json(F.struct(text.alias("x"))), r'(?s)\A\{"x":|\}\z', "")))


def descriptor_hash(name: Column, description: Column, schema: Column) -> Column:
    """sha256 of name, description and input schema as canonical JSON; what is null is left out, a schema that is no JSON counts as a string."""
    return F.sha2(_object(name=_string(name), description=_string(description), inputSchema=canonical_text(schema)), 256)


def manifest_hash(tools: DataFrame, upstream: str = "upstream", identity: bool = False) -> DataFrame:
    """One hash of each upstream's tools, sorted by name; output schemas count too, and the upstream's name where it identifies the manifest."""
    body = _object(name=_string(F.col("name")), description=_string(F.col("description")), inputSchema=canonical_text(F.col("input_schema")), outputSchema=canonical_text(F.col("output_schema")))
    each = tools.select(upstream, F.struct("name", body.alias("body")).alias("tool"))
    listed = each.groupBy(upstream).agg(F.array_join(F.transform(F.array_sort(F.collect_list("tool")), lambda t: t["body"]), ",").alias("listed"))
    whole = _object(tools=F.concat(F.lit("["), F.col("listed"), F.lit("]")), **({"upstream": _string(F.col(upstream).cast("string"))} if identity else {}))
    return listed.select(upstream, F.sha2(whole, 256).alias("tools_hash"))


def drift(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Added, removed and modified tools; both sides have the keys and hash."""
    old, new = before.withColumnRenamed("hash", "old_hash"), after.withColumnRenamed("hash", "new_hash")
    both = old.join(new, keys, "full_outer")
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "modified")
    return both.withColumn("change", change).where("change is not null")


def pinned(pins: DataFrame, seen: DataFrame) -> DataFrame:
    """Of each seen upstream: recorded (first time), matched or mismatch; a pin given in advance is compared case-insensitively."""
    p = pins.select("upstream", F.lower("tools_hash").alias("pin"), "preseeded")
    verdict = F.when(F.col("pin").isNull(), "recorded").when(F.col("pin") == F.col("tools_hash"), "matched").when(F.col("preseeded"), "preseed_mismatch").otherwise("mismatch")
    return seen.join(p, "upstream", "left").select("upstream", "tools_hash", verdict.alias("verdict"))


def tool_changes(before: Column, after: Column) -> Column:
    """(name, change) of the tools that were added, removed or modified between two maps of name to digest, by name."""
    # One pass over both by hash: to look each name up walks the whole map.
    change = F.map_zip_with(before, after, lambda _, b, a: F.when(a.isNull(), "removed").when(b.isNull(), "added").when(b != a, "modified"))
    told = F.filter(F.map_entries(change), lambda e: e["value"].isNotNull())
    return F.array_sort(F.transform(told, lambda e: F.struct(e["key"].alias("name"), e["value"].alias("change"))))


def verify_or_record(known: DataFrame, seen: DataFrame, now: int, expected: DataFrame | None = None) -> DataFrame:
    """Of each upstream that is known or seen (tools_hash and tools): verdict, changes, and the pin it has then (tools_hash, tools, first_seen, last_verified).

    What an operator expects (upstream, pin as `sha256:<hex>` in any case) comes first and settles a
    mismatch; then a known pin matches (and is verified anew) or not (and stays), and what is new is
    recorded. verdict is null for known upstreams that weren't seen. Of an upstream that is seen twice, one row counts.
    """
    pin = known.select(F.col("upstream").alias("of"), F.struct("tools_hash", "tools", "first_seen", "last_verified").alias("old"))
    one = seen.groupBy("upstream").agg(F.min_by(F.struct("tools_hash", "tools"), "tools_hash").alias("new"))
    both = one.join(pin, F.col("upstream") == F.col("of"), "full_outer").withColumn("upstream", F.coalesce("upstream", "of")).drop("of")
    if expected is not None:
        want = expected.groupBy(F.col("upstream").alias("of")).agg(F.min(F.lower(F.trim("pin"))).alias("want"))
        both = both.join(want, F.col("upstream") == F.col("of"), "left").drop("of")
    else:
        both = both.withColumn("want", F.lit(None).cast("string"))
    verdict = (
        F.when(F.col("new").isNull(), None)
        .when(F.col("want") != F.concat(F.lit("sha256:"), F.col("new.tools_hash")), "preseed_mismatch")
        .when(F.col("old").isNull(), "recorded")
        .when(F.col("old.tools_hash") == F.col("new.tools_hash"), "matched")
        .otherwise("mismatch")
    )
    both = both.withColumn("verdict", verdict)
    at = F.lit(now).cast("long")
    fresh = F.struct("new.tools_hash", "new.tools", at.alias("first_seen"), at.alias("last_verified"))
    again = F.struct("old.tools_hash", "old.tools", "old.first_seen", at.alias("last_verified"))
    pin_now = F.when(F.col("verdict") == "recorded", fresh).when(F.col("verdict") == "matched", again).otherwise(F.col("old"))
    changes = F.when(F.col("verdict") == "mismatch", tool_changes(F.col("old.tools"), F.col("new.tools")))
    return both.select("upstream", "verdict", changes.alias("changes"), pin_now.alias("pin"))


def _sized(data: Column) -> Column:
    """The bytes behind their number, as eight bytes, least first."""
    return F.concat(_eight(F.octet_length(data)), data)


def _eight(n: Column) -> Column:
    n = n.cast("long")
    return F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(F.lit(255))), 2, "0")) for i in range(8)])


def identity(argv: Column, cwd: Column, tag: str) -> Column:
    """Who an upstream is: the hash of the tag and a zero byte, the arguments and the folder, each with its length, so that no two ways to cut a line agree."""
    args = F.aggregate(argv, F.unhex(F.lit("")), lambda acc, a: F.concat(acc, _sized(F.encode(a, "UTF-8"))))
    return F.sha2(F.concat(F.encode(F.lit(tag), "UTF-8"), F.unhex(F.lit("00")), _eight(F.size(argv)), args, _sized(F.encode(cwd, "UTF-8"))), 256)


#: The version of pin stores that is read, and older ones that are passed over.
STORE, OLDER = 3, (1, 2)


def store_state(exists: Column, version: Column) -> Column:
    """What becomes of a store: empty (none yet), used, ignored (older: all is recorded anew), or unavailable (any other, or broken: fail closed)."""
    return F.when(~exists, "empty").when(version == STORE, "used").when(version.isin(*OLDER), "ignored").otherwise("unavailable")
