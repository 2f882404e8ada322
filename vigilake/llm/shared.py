"""What the operators of this folder share: session settings, saved tables, text arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.sources.tables import shared_dir

#: Rows and bytes of an Arrow batch, so that long texts don't fill a worker.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
#: Bytes of text that the array functions below take at a time.
BLOCK_BYTES = 1 << 20

_U = np.uint64


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def saved(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: cuts lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def grown(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the corpus, sorted and merged: a broadcast goes through the driver, and by its files' size Spark would send a table that takes many times as much there."""
    return df.hint("merge")


def text_rows(docs: DataFrame, *keep: str) -> DataFrame:
    """The named columns and the text; null text is empty."""
    return docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("text"))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20240229))
    r = rng.integers(0, 2**64, 256, np.uint64)
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    lower = np.arange(256)
    lower[65:91] += 32
    return r[lower], space, rng.integers(0, 2**63, 1, np.uint64) * _U(2) + _U(1), r


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """Powers of an odd number modulo 2^64."""
    global _powers
    if len(_powers) < n:
        base = _tables()[2]
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.repeat(base, max(n, 4096))]), dtype=np.uint64)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (one more for the end); null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    a = pc.fill_null(col.cast(pa.large_string()), "")
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def blocks(off: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about `size` bytes; a longer text is a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, cut at the texts' borders; for each text its first run's number."""
    if not len(inside):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    own = off[:-1][off[1:] > off[:-1]]
    first[own] = inside[own]
    ends = off[1:][off[1:] > off[:-1]] - 1
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def hash_runs(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each run's bytes, A-Z as a-z if folded. It depends on the bytes alone, not on place or machine."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    r = _tables()[0 if fold else 3]
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size)[:-1]])
    pos = np.arange(int(size.sum())) - np.repeat(at, size)
    return mix(np.add.reduceat(r[data[inside]] * powers(int(size.max()))[pos], at) + size.astype(np.uint64))


def spaces() -> np.ndarray:
    """Of each byte, whether it is one of the six ASCII white spaces."""
    return _tables()[1]


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of other than the six ASCII white spaces), and each text's first word's number."""
    inside = ~_tables()[1][data]
    starts, ends, first = runs(inside, off)
    return hash_runs(data, inside, starts, ends), first


#: Bits of the maps below: 8 MB at most come to the driver and go to the tasks, whatever the input.
MARK_BITS = 1 << 26


class Marks:
    """A bitmap of fixed size over 64-bit keys: what is in a set surely hits it, others rarely do.

    Tasks use it to leave out rows before a shuffle that an exact join drops anyway.
    """

    def __init__(self, keys: DataFrame, column: str) -> None:
        width = 1 << 15  # bits in Spark's bitmaps, whose buckets count from 1 for numbers from 1
        bit = F.col(column).bitwiseAND(F.lit(MARK_BITS - 1)) + 1
        found = keys.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
        bits = np.zeros(MARK_BITS // 8, np.uint8)
        for r in found:
            at = (r.bucket - 1) * (width // 8)
            bits[at : at + width // 8] |= np.frombuffer(r.bits, np.uint8)
        self.empty = not found
        self._spread = keys.sparkSession.sparkContext.broadcast(bits)

    def hit(self, keys: np.ndarray) -> np.ndarray:
        at = keys.astype(np.int64) & np.int64(MARK_BITS - 1)
        return (self._spread.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
