"""Audit chains: canonical records, hashes, building and verification.

Building is serial within a log by nature, so logs are the unit of parallelism (shard them by
session and day); a log of any length streams through its task, which holds its head only.
Verification isn't: logs are cut into slices of lines, which are checked apart, and each begins with
what the slices before it hand on (whether a chained line was seen, the last number, the last good
hash), which needs one row a slice. A log of many lines so uses all cores.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigilake.functions.columns import let
from vigilake.functions.verdicts import held

#: Fixed value: what the first record has before it.
GENESIS = "0" * 64


def canonical(*columns: str) -> Column:
    """Compact JSON of the columns in this order; absent is null."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


#: The fields of a record that its hash covers, in this order, and the text ones among them.
HASHED = ("seq", "prev", "timestamp", "event", "decision", "rule_id", "category", "surface", "command", "policy_fingerprint")
RECORD = "seq long, prev string, timestamp long, event string, decision string, rule_id string, category string, surface string, command string, policy_fingerprint string, hash string"
#: Controls that JSON writes as numbers with a letter, which must be a small one.
_LETTERED = ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F")


def chain_hash(record: Column) -> Column:
    """The digest of a record (a struct with the fields of RECORD): compact JSON of HASHED in order, absent as null."""
    text = F.to_json(F.struct(*[record[c].alias(c) for c in HASHED]), {"ignoreNullFields": "false"})
    return F.sha2(let(text, lambda t: F.when(t.rlike(r"\\u00[01][A-F]"), _small_escapes(t)).otherwise(t)), 256)


def _small_escapes(text: Column) -> Column:
    """JSON with the escapes of _LETTERED in small letters: escaped backslashes stand aside meanwhile, so that what begins with one is an escape."""
    aside = (("\x7f", "\x7f0"), ("\\\\", "\x7f1"))
    escapes = [(f"\\u00{code}", f"\\u00{code.lower()}") for code in _LETTERED]
    for old, new in (*aside, *escapes, *((b, a) for a, b in reversed(aside))):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


#: Groups of logs by hash; each is put in order by one task.
BUCKETS = 1 << 12


def _in_order(rows: DataFrame, log: str, order: str, schema: str, step: Callable[[dict, tuple], tuple[tuple, tuple]], begin: Callable[[dict], tuple]) -> DataFrame:
    """Rows made log by log, each in its order: step makes a row's output and the state behind it, begin the state before a log's first row."""
    log_kind = rows.schema[log].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, first = None, (), True
        for b in batches:
            out = []
            for row in b.to_pylist():
                if first or row[log] != now:
                    now, state, first = row[log], begin(row), False
                made, state = step(row, state)
                out.append((row[log], *made))
            columns = list(zip(*out, strict=True)) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, b.schema.field(log).type if t is None else t) for c, t in zip(columns, kinds, strict=True)], names=names)

    kinds = [None, *(pa.int64() if f.split()[1] == "long" else pa.string() for f in schema.split(", "))]
    names = [log, *(f.split()[0] for f in schema.split(", "))]
    # Sorted by ranges first; the one task of a log puts packs of rows in order, not rows. Logs share packs by bucket, so that small ones don't take one each.
    bucket = F.pmod(F.xxhash64(log), F.lit(BUCKETS)).cast("int")
    sorted_ = rows.withColumn("_bucket", bucket).repartitionByRange("_bucket", log, order).sortWithinPartitions("_bucket", log, order)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for n, b in enumerate(batches):
            buckets = b.column("_bucket").to_pylist()
            cuts = [0, *(i for i in range(1, len(buckets)) if buckets[i] != buckets[i - 1]), len(buckets)]
            packs = []
            for at, end in pairwise(cuts):
                if end > at:
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                        w.write_batch(b.slice(at, end - at))
                    packs.append((buckets[at], part, n, sink.getvalue().to_pybytes()))
            columns = list(zip(*packs, strict=True)) if packs else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["_bucket", "_part", "_n", "_pack"])

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for b in batches:
            for pack in b.column("_pack"):
                rest += pa.ipc.open_stream(pack.as_buffer()).read_all().to_batches()
                # Small buckets have packs of a few rows.
                if sum(r.num_rows for r in rest) >= 4096:
                    yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
                    rest = []
        if rest:
            yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]

    packs = sorted_.mapInArrow(packed, "_bucket int, _part int, _n long, _pack binary")
    in_order = packs.repartition("_bucket").sortWithinPartitions("_bucket", "_part", "_n")
    return in_order.mapInArrow(lambda batches: each(unpacked(batches)), f"{log} {log_kind}, {schema}")


def recorded(records: DataFrame, log: str, order: str) -> DataFrame:
    """log, line and value (a JSON line with seq, prev and hash) of every record, each log chained in its order; records have the fields of RECORD but these three."""
    fields = HASHED[2:]
    compact = json.JSONEncoder(separators=(",", ":"), ensure_ascii=False).encode

    def step(row: dict, state: tuple) -> tuple[tuple, tuple]:
        seq, prev = state
        text = compact({"seq": seq, "prev": prev} | {k: row[k] for k in fields})
        head = hashlib.sha256(text.encode()).hexdigest()
        # The hash is the last field of the same text.
        return (seq, f'{text[:-1]},"hash":"{head}"}}'), (seq + 1, head)

    return _in_order(records.select(log, order, *[c for c in fields if c not in (log, order)]), log, order, "line long, value string", step, lambda row: (1, GENESIS))


#: Lines of a slice.
SLICE = 1 << 17


def _carried(rows: DataFrame, log: str, slice_lines: int, **handed: Column) -> DataFrame:
    """Adds _slice, and what the slices before hand on: of each aggregate, its last value that isn't null."""
    # Dealt by slice before they are counted: the aggregates sort rows, which would be all of a log in the task that made it.
    cut = rows.withColumn("_slice", F.expr(f"line div {slice_lines}L")).repartition(log, "_slice")
    ends = cut.groupBy(log, "_slice").agg(*[c.alias(n) for n, c in handed.items()])
    earlier = Window.partitionBy(log).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(F.col(log).alias("_log"), F.col("_slice").alias("_at"), *[F.last(n, ignorenulls=True).over(earlier).alias(n) for n in handed])
    return cut.join(before, F.col(log).eqNullSafe(F.col("_log")) & (F.col("_slice") == F.col("_at"))).drop("_log", "_at")


def defects(lines: DataFrame, log: str, slice_lines: int = SLICE) -> DataFrame:
    """kind (chained, legacy, or unreadable) and defects of every line that isn't blank: of log, line and value.

    Links are held against what earlier lines record, so that one damaged line is one defect:
    malformed (an unreadable line behind the first chained one), missing_seq, sequence_gap,
    bad_prev, bad_hash, broken_link, hash_mismatch. Lines with neither seq nor hash are legacy.
    """
    corrupt = "_corrupt_record"
    v = F.from_json("value", f"{RECORD}, {corrupt} string", {"columnNameOfCorruptRecord": corrupt})
    out = lines.where(~F.col("value").rlike(r"^\s*\z")).select(log, "line", v.alias("v"))
    unreadable = F.col("v").isNull() | F.col(f"v.{corrupt}").isNotNull()
    chained = ~unreadable & (F.col("v.seq").isNotNull() | F.col("v.hash").isNotNull())
    out = out.withColumn("kind", F.when(unreadable, "unreadable").when(chained, "chained").otherwise("legacy"))
    sixty_four = r"^[0-9a-fA-F]{64}\z"
    prev_ok, hash_ok = (F.coalesce(F.col(f"v.{c}").rlike(sixty_four), F.lit(False)) for c in ("prev", "hash"))
    counted = (F.col("kind") == "chained") & F.col("v.seq").isNotNull()
    is_chained = F.when(F.col("kind") == "chained", F.lit(1))
    number, good = F.when(counted, F.col("v.seq")), F.when(counted & prev_ok & hash_ok, F.col("v.hash"))
    out = _carried(out, log, slice_lines, _seen_before=F.max(is_chained), _seq_before=F.max_by(number, F.when(number.isNotNull(), F.col("line"))), _hash_before=F.max_by(good, F.when(good.isNotNull(), F.col("line"))))
    before = Window.partitionBy(log, "_slice").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("_seen", F.coalesce(F.max(is_chained).over(before), "_seen_before", F.lit(0)) > 0)
    out = out.withColumn("_seq", F.coalesce(F.coalesce(F.last(number, ignorenulls=True).over(before), "_seq_before") + 1, F.lit(1)))
    out = out.withColumn("_hash", F.coalesce(F.last(good, ignorenulls=True).over(before), "_hash_before", F.lit(GENESIS)))
    # Held: digests cost the most here, and a filter on the defects would have them worked out again.
    found = F.array_compact(
        F.array(
            F.when((F.col("kind") == "unreadable") & F.col("_seen"), "malformed"),
            F.when((F.col("kind") == "chained") & F.col("v.seq").isNull(), "missing_seq"),
            F.when(counted & (F.col("v.seq") != F.col("_seq")), "sequence_gap"),
            F.when(counted & ~prev_ok, "bad_prev"),
            F.when(counted & prev_ok & ~hash_ok, "bad_hash"),
            F.when(counted & prev_ok & hash_ok & (F.col("v.prev") != F.col("_hash")), "broken_link"),
            F.when(counted & prev_ok & hash_ok & (chain_hash(F.col("v")) != F.col("v.hash")), "hash_mismatch"),
        )
    )
    return held(out, "defects", found).select(log, "line", "kind", "defects")


def record_hash(prev: Column, body: Column) -> Column:
    return F.sha2(F.concat(prev, body), 256)


def chained(records: DataFrame, log: str, order: str, body: str, heads: DataFrame | None = None) -> DataFrame:
    """log, line, seq (from 1), prev, hash and body of every record, each log in its order; heads (log, last_seq, head_hash) are the sidecars of logs that go on."""
    begin = records.select(F.col(log), F.col(order).alias("_order"), F.col(body).alias("_body"))
    if heads is not None:
        known = heads.select(F.col(log).alias("_log"), F.col("last_seq").cast("long"), "head_hash")
        begin = begin.join(known, F.col(log).eqNullSafe(F.col("_log")), "left").drop("_log")
    else:
        begin = begin.withColumn("last_seq", F.lit(0).cast("long")).withColumn("head_hash", F.lit(GENESIS))

    def step(row: dict, state: tuple) -> tuple[tuple, tuple]:
        seq, prev = state
        head = hashlib.sha256((prev + (row["_body"] or "")).encode()).hexdigest()
        return (seq, seq, prev, head, row["_body"]), (seq + 1, head)

    return _in_order(begin, log, "_order", "line long, seq long, prev string, hash string, body string", step, lambda row: ((row["last_seq"] or 0) + 1, row["head_hash"] or GENESIS))


def verified(lines: DataFrame, log: str, body: str = "body", slice_lines: int = SLICE) -> DataFrame:
    """Adds defect to every line: the first of hash_mismatch, broken_link, sequence_gap that applies, or null; lines without seq are older ones."""
    out = _carried(lines, log, slice_lines, _last=F.max_by(F.struct("seq", "hash"), "line"))
    before = F.lag(F.struct("seq", "hash")).over(Window.partitionBy(log, "_slice").orderBy("line"))
    out = out.withColumn("_last", F.coalesce(before, "_last")).withColumn("_seq", F.col("_last.seq")).withColumn("_hash", F.col("_last.hash"))
    fresh = F.col("_seq").isNull()
    defect = (
        F.when(F.col("seq").isNull(), F.lit(None).cast("string"))
        .when(record_hash(F.col("prev"), F.col(body)) != F.col("hash"), "hash_mismatch")
        .when(~fresh & (F.col("seq") != F.col("_seq") + 1), "sequence_gap")
        .when(F.col("prev") != F.when(fresh, F.lit(GENESIS)).otherwise(F.col("_hash")), "broken_link")
    )
    return out.withColumn("defect", defect).drop("_seq", "_hash", "_last", "_slice")


def against_sidecar(lines: DataFrame, log: str, sidecar: DataFrame) -> DataFrame:
    """Of each log: intact, truncated, extended or head_mismatch, by its last line and the sidecar's last_seq and head_hash."""
    last = lines.where("seq is not null").groupBy(log).agg(F.max(F.struct("line", "seq", "hash")).alias("last"))
    state = F.when(F.col("last_seq").isNull(), "no_sidecar").when(F.coalesce(F.col("last.seq"), F.lit(0)) < F.col("last_seq"), "truncated").when(F.col("last.seq") > F.col("last_seq"), "extended").when(F.col("last.hash") != F.col("head_hash"), "head_mismatch").otherwise("intact")
    both = sidecar.select(F.col(log).alias("_log"), "last_seq", "head_hash").join(last, F.col(log).eqNullSafe(F.col("_log")), "full_outer")
    return both.select(F.coalesce(log, "_log").alias(log), state.alias("state"))


def healed(lines: DataFrame, log: str) -> DataFrame:
    """The sidecar of each log as its last well-formed line has it; the state before the first record where none is."""
    good = F.col("seq").isNotNull() & F.coalesce(F.col("hash").rlike(r"^[0-9a-fA-F]{64}\z"), F.lit(False))
    last = F.max(F.when(good, F.struct("line", "seq", "hash")))
    return lines.groupBy(log).agg(last.alias("last")).select(log, F.coalesce("last.seq", F.lit(0)).cast("long").alias("last_seq"), F.coalesce("last.hash", F.lit(GENESIS)).alias("head_hash"))


def sidecars(lines: DataFrame, log: str) -> DataFrame:
    """log, last_seq and head_hash of chained lines."""
    return lines.groupBy(log).agg(F.max("seq").alias("last_seq"), F.max_by("hash", "seq").alias("head_hash"))


def append(lines: DataFrame, path: str) -> None:
    """JSON lines added to a log folder."""
    lines.write.mode("append").json(path)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The lines of JSON logs with file and line (in file order, from 1); a line that can't be read has nulls, so that it counts as damaged.

    A file may be read in splits: rows within one keep their order, splits follow by where they begin.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"), "value")
    earlier = Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    splits = raw.groupBy("file", "_at").count().withColumn("_before", F.coalesce(F.sum("count").over(earlier), F.lit(0))).drop("count")
    line = F.row_number().over(Window.partitionBy("file", "_at").orderBy("_id")) + F.col("_before")
    return raw.join(splits, ["file", "_at"]).withColumn("line", line.cast("long")).select("file", "line", F.from_json("value", schema).alias("v")).select("file", "line", "v.*")
