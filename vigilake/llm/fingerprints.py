"""Canonical exact digests.

A text is normalised (NFKC), case-folded and its white space folded; the 128-bit xxhash of what
remains is its fingerprint. Where several documents share a digest their canonical bytes are
compared; should different bytes ever share one, the fingerprint gets a suffix by their order.

The comparison moves only texts whose digest occurs twice: a bitmap of fixed size, built
by Spark's bitmap aggregate, tells each task which of its texts may be among them (others that
hit the same bit do no harm), and min and max of the canonical text are combined before the
shuffle, so that a large group of copies costs one row a task.

Neighbours (the next document by descending doc_id) meet by ranges of doc_id cut at quantiles:
each range is sorted by itself and gets the first row of the next range besides. Texts move once.
Null text is empty; a null doc_id is the least; rows of equal doc_id follow by text, descending;
repeated rows have equal fingerprints.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm.shared import Marks, small_batches, text_rows

#: Collisions of 128-bit digests that the driver is ready to hold.
COLLISIONS = 10_000


def canonical(text: str) -> str:
    if text.isascii():
        return " ".join(text.lower().split())
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).split())


def digest(canon: str) -> str:
    return xxhash.xxh3_128_hexdigest(canon.encode("utf-8", "surrogatepass"))


def collisions(docs: DataFrame) -> dict[tuple[str, str], int]:
    """Numbers of the canonical texts whose digest another text has too; normally empty."""
    small_batches(docs.sparkSession)
    text = text_rows(docs)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([digest(canonical(t)) for t in b.column("text").to_pylist()], pa.string())], ["digest"])

    twice = text.mapInArrow(digests, "digest string").groupBy("digest").count().where("count > 1")
    marks = Marks(twice.select(F.conv(F.right("digest", F.lit(8)), 16, 10).cast("long").alias("key")), "key")
    if marks.empty:
        return {}

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            canons = [canonical(t) for t in b.column("text").to_pylist()]
            found = [digest(c) for c in canons]
            hit = marks.hit(np.array([int(d[-8:], 16) for d in found], np.int64))
            out = [x for x, h in zip(zip(found, canons, strict=True), hit, strict=True) if h]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], ["digest", "canon"])

    maybe = text.mapInArrow(repeated, "digest string, canon string")
    differ = maybe.groupBy("digest").agg(F.min("canon").alias("least"), F.max("canon").alias("most")).where("least <> most").select("digest").limit(COLLISIONS + 1)
    clashing = [r.digest for r in differ.collect()]
    if len(clashing) > COLLISIONS:
        raise ValueError("more collisions than a 128-bit hash has")
    if not clashing:
        return {}
    found: dict[str, list[str]] = {}
    for r in maybe.where(F.col("digest").isin(clashing)).distinct().orderBy("digest", "canon").collect():
        found.setdefault(r.digest, []).append(r.canon)
    return {(d, c): i for d, cs in found.items() for i, c in enumerate(cs) if i}


def fingerprint(text: str, clashes: dict[tuple[str, str], int]) -> str:
    d = digest(c := canonical(text))
    return f"{d}-{clashes[d, c]}" if (d, c) in clashes else d


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, of whatever type, and fingerprint of every document."""
    clashes = collisions(docs)

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([fingerprint(t, clashes) for t in b.column("text").to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return text_rows(docs, "doc_id").mapInArrow(printed, f"doc_id {kind}, fingerprint string")


_LEAST = -(1 << 63)


def with_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text (the last third of its code points
    replaced by the beginning of the next document), and whether they and the next document's agree."""
    spark = docs.sparkSession
    clashes = collisions(docs)
    rows = text_rows(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id")
    ids = rows.select(F.coalesce("doc_id", F.lit(_LEAST)).alias("id"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = ids.agg(F.percentile_approx("id", F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(50 * parts)).alias("q")).first().q if parts > 1 else []
    cuts = np.unique(np.array(cuts or [], np.int64))
    # Range k holds the ids above cut k - 1, up to cut k. What follows its least is the most of the next lower range that has rows.
    place = ids.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array(np.searchsorted(cuts, b.column("id").to_numpy()).astype(np.int32)), b.column("id")], ["part", "id"]) for b in bs), "part int, id long")
    most = dict(sorted((r.part, r.most) for r in place.groupBy("part").agg(F.max("id").alias("most")).collect()))
    held = list(most)
    goes = {most[p]: held[(i + 1) % len(held)] for i, p in enumerate(held)}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column("id").to_numpy()
            part = np.searchsorted(cuts, own).astype(np.int32)
            first = np.flatnonzero(np.isin(own, list(goes)))
            take = pa.array(np.concatenate([np.arange(len(own)), first]))
            part = np.concatenate([part, np.array([goes[int(i)] for i in own[first]], np.int32)])
            extra = np.concatenate([np.zeros(len(own), np.int8), np.ones(len(first), np.int8)])
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(extra), *(b.column(c).take(take) for c in ("id", "doc_id", "text"))], ["part", "extra", "id", "doc_id", "text"])

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None

        def row(this: tuple, following: tuple) -> tuple:
            text, after = this[3], following[3]
            n = len(text)
            new = text[: n - n // 3] + after[: n // 3]
            mark, changed = this[4], fingerprint(new, clashes)
            return this[2], n, hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), mark, changed, float(mark == changed), float(mark == following[4])

        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for b in batches:
            out = []
            for part, extra, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("part", "extra", "doc_id", "text")), strict=True):
                now = (part, extra, doc_id, text, fingerprint(text, clashes))
                if last is not None and last[0] == part and not last[1]:
                    out.append(row(last, now))
                last = now
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    dealt_rows = rows.withColumn("id", F.coalesce("doc_id", F.lit(_LEAST))).mapInArrow(dealt, "part int, extra byte, id long, doc_id long, text string")
    ranged = dealt_rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "extra", F.desc("id"), F.desc("text"))
    return ranged.mapInArrow(edited, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
