"""Merkle manifests of a dataset: a tree of digests for each source, a tree over their roots, and a proof for each row.

A leaf is the sha256 of a row's columns, computed where the row lies; only digests move. Leaves are
dealt out by ranges of (tree, order), so that the place of a leaf in its tree is its place in its
range moved by the counts of the ranges before; no tree, however large, meets in one task. Aligned
blocks of FANOUT ** DEPTH digests are one row each. A block is a matrix of 64-byte digests: runs
of FANOUT rows, reshaped to one row, are hashed level by level, and the siblings of every node follow
from its index. The roots of blocks are the nodes of the next tier, until each tree has one node;
the same is done with the trees' roots. Then paths (the siblings left and right of each level) go
down again, tier by tier, to the leaves, where proofs are digested and presented digests folded.

The last run of a level may hold fewer nodes, even one, which is hashed alone while its tree has more
nodes at that level. A tree of one leaf has it as its root. Null columns are `-`; equal orders are
taken by digest, so equal rows have equal proofs up to their places. An empty table has no rows
(and no root). Columns that aren't named are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vigilake.llm.shared import saved, small_batches

#: A block goes up DEPTH levels and so holds FANOUT ** DEPTH digests.
FANOUT, DEPTH = 3, 6
#: Hexadecimal digits of a digest.
WIDTH = 64


def field(c: Column) -> Column:
    """`-` for null, else the count of UTF-8 bytes, a colon and the value."""
    text = c.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def placed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Adds index (the place in its tree) and n (the leaves of the tree) to rows of tree, digest and more."""
    spark = leaves.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Equal rows are told apart by where they lie, else a third of all rows could be one range.
    by = ["tree", *order, "digest", "salt"]
    dealt = leaves.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    dealt = saved(dealt.drop("salt").withColumn("at", F.monotonically_increasing_id()), "merkle-dealt").withColumn("range", F.shiftright("at", 33))
    spans = dealt.groupBy("tree", "range").agg(F.min("at").alias("low"), F.count("*").alias("rows"))
    own = Window.partitionBy("tree")
    spans = spans.withColumn("upto", F.sum("rows").over(own.orderBy("range"))).withColumn("n", F.sum("rows").over(own))
    spans = spans.select(F.col("tree").alias("of"), F.col("range").alias("in"), (F.col("upto") - F.col("rows") - F.col("low")).alias("move"), "n")
    both = dealt.join(spans, F.col("tree").eqNullSafe(F.col("of")) & (F.col("range") == F.col("in")))
    return both.withColumn("index", F.col("at") + F.col("move")).drop("at", "range", "of", "in", "move")


def _blocks(nodes: DataFrame, depth: int, tier: int, *more: str) -> DataFrame:
    """A row for each aligned block: tree, block, n and its nodes in order."""
    size = FANOUT**depth
    node = F.struct((F.col("index") % size).alias("place"), "digest", *more)
    whole = nodes.groupBy("tree", "n", F.expr(f"index div {size}").alias("block")).agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    return saved(whole, f"merkle-tier{tier}")


def _levels(n: int, depth: int) -> int:
    """The levels that a block of a tree of n nodes goes up."""
    return next(k for k in range(depth + 1) if k == depth or FANOUT**k >= n)


def _hashed(rows: np.ndarray) -> list[bytes]:
    return [hashlib.sha256(r).hexdigest().encode() for r in rows]


def raised(leaves: np.ndarray, levels: int) -> list[np.ndarray]:
    """The matrices of digests (one a row) of a block, level by level, the leaves first."""
    out = [np.ascontiguousarray(leaves)]
    for _ in range(levels):
        m = out[-1]
        whole = len(m) // FANOUT * FANOUT
        up = _hashed(m[:whole].reshape(-1, FANOUT * WIDTH)) + ([hashlib.sha256(m[whole:].tobytes()).hexdigest().encode()] if whole < len(m) else [])
        out.append(np.frombuffer(b"".join(up), np.uint8).reshape(-1, WIDTH))
    return out


def siblings(m: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Of each row, the digests of its run on the left and on the right."""
    data, i = m.tobytes(), np.arange(len(m))
    low = i // FANOUT * FANOUT
    high = np.minimum(low + FANOUT, len(m))
    cut = lambda a, b: [data[x * WIDTH : y * WIDTH] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    return cut(low, i), cut(i + 1, high)


def _matrix(digests: pa.Array) -> np.ndarray:
    return np.frombuffer("".join(digests.to_pylist()).encode(), np.uint8).reshape(-1, WIDTH)


def _rows(batch: pa.RecordBatch, depth: int) -> Iterator[tuple[int, pa.StructArray, list[np.ndarray]]]:
    """The number of each row, its nodes and their levels."""
    for i in range(batch.num_rows):
        nodes = batch["nodes"][i].values
        yield i, nodes, raised(_matrix(nodes.field("digest")), _levels(batch["n"][i].as_py(), depth))


def _roots(blocks: DataFrame, depth: int) -> DataFrame:
    """The nodes of the next tier: tree, n, index and digest."""
    schema = T.StructType([blocks.schema["tree"], *(T.StructField(c, T.LongType()) for c in ("n", "index")), T.StructField("digest", T.StringType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            up = [levels[-1][0].tobytes().decode() for _, _, levels in _rows(b, depth)]
            n = pa.array([-(-x // FANOUT**depth) for x in b["n"].to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b["tree"], n, b["block"], pa.array(up, pa.string())], names=schema.names)

    return blocks.mapInArrow(each, schema)


def _paths(blocks: DataFrame, above: DataFrame, depth: int, *more: str) -> DataFrame:
    """tree, index, digest, left, right, top and more of every node: the siblings at every level up to the root, and what the paths above hand down."""
    fields = blocks.schema["nodes"].dataType.elementType
    handed = [f for f in above.schema.fields if f.name not in ("tree", "index", "left", "right", "digest", *more)]
    lists = [T.StructField(c, T.ArrayType(T.StringType())) for c in ("left", "right")]
    schema = T.StructType([blocks.schema["tree"], T.StructField("index", T.LongType()), T.StructField("digest", T.StringType()), *(fields[c] for c in more), *lists, *handed])
    met = _met(blocks, above)
    same = ["tree", *(f.name for f in handed)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, nodes, levels in _rows(b, depth):
                size = len(nodes)
                found = [[x.decode() for x in side] for m in levels[:-1] for side in siblings(m)]
                place = [(np.arange(size) // FANOUT**k).tolist() for k in range(len(levels) - 1)]
                sides = [[[found[2 * k + s][place[k][j]] for k in range(len(place))] + tail for j in range(size)] for s, tail in ((0, b["left"][i].as_py()), (1, b["right"][i].as_py()))]
                once = [pa.array([b[c][i].as_py()] * size, b[c].type) for c in same]
                index = pa.array(np.arange(size) + b["block"][i].as_py() * FANOUT**depth)
                yield pa.RecordBatch.from_arrays([once[0], index, nodes.field("digest"), *(nodes.field(c) for c in more), *(pa.array(s, pa.list_(pa.string())) for s in sides), *once[1:]], names=schema.names)

    return met.mapInArrow(each, schema)


def _met(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Blocks with the path of their root."""
    up = above.drop("digest").withColumnRenamed("tree", "of")
    return blocks.join(up, F.col("tree").eqNullSafe(F.col("of")) & (F.col("block") == F.col("index"))).drop("of", "index")


def _climbed(nodes: DataFrame, depth: int, *more: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every tier, and tree and digest of the trees' roots."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    tiers = [_blocks(nodes, depth, 0, *more)]
    while True:
        nodes = saved(_roots(tiers[-1], depth), "merkle-roots")
        most = -(-most // FANOUT**depth)
        if most <= 1:
            return tiers, nodes
        tiers.append(_blocks(nodes, depth, len(tiers)))


def proven(leaves: DataFrame, order: list[str], depth: int = DEPTH) -> DataFrame:
    """tree, the columns of order, leaf, subroot, root, proof_sha256, folded_root and verified of rows of tree, digest, presented and those columns.

    presented is the digest that is held against the tree: it is folded with the siblings of its place.
    """
    small_batches(leaves.sparkSession)
    tiers, subroots = _climbed(placed(leaves, order), depth, "presented", *order)
    # The tree over the trees: its leaves are their roots, in their order.
    over = placed(subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("source"), "digest"), ["source"])
    tops, root = _climbed(over, depth, "source")
    none = F.array().cast("array<string>")
    paths = root.select("tree", F.lit(0).cast("long").alias("index"), none.alias("left"), none.alias("right"), F.col("digest").alias("root"))
    for blocks in reversed(tops[1:]):
        paths = saved(_paths(blocks, paths, depth), "merkle-paths")
    paths = saved(_paths(tops[0], paths, depth, "source"), "merkle-paths").select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("index"), "left", "right", "root", F.col("digest").alias("subroot"))
    for blocks in reversed(tiers[1:]):
        paths = saved(_paths(blocks, paths, depth), "merkle-paths")
    return _verdicts(_met(tiers[0], paths), order, depth)


def _verdicts(met: DataFrame, order: list[str], depth: int) -> DataFrame:
    fields = met.schema["nodes"].dataType.elementType
    text = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    schema = T.StructType([met.schema["tree"], *(fields[c] for c in order), *(T.StructField(c, T.StringType()) for c in text), T.StructField("verified", T.BooleanType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, nodes, levels in _rows(b, depth):
                size = len(nodes)
                sides = [siblings(m) for m in levels[:-1]]
                upper = [(a.encode(), z.encode()) for a, z in zip(b["left"][i].as_py(), b["right"][i].as_py(), strict=True)]
                tail = b"".join(a + z for a, z in upper)
                root = b["root"][i].as_py()
                proofs, folded = [], []
                for j, h in enumerate(nodes.field("presented").to_pylist()):
                    path = [(left[j // FANOUT**k], right[j // FANOUT**k]) for k, (left, right) in enumerate(sides)]
                    proofs.append(hashlib.sha256(b"".join(a + z for a, z in path) + tail).hexdigest())
                    folded.append(reduce(lambda h, s: hashlib.sha256(s[0] + h + s[1]).hexdigest().encode(), [*path, *upper], h.encode()).decode())
                once = [pa.array([b[c][i].as_py()] * size, b[c].type) for c in ("tree", "subroot", "root")]
                same = pa.array([f == root for f in folded])
                yield pa.RecordBatch.from_arrays([once[0], *(nodes.field(c) for c in order), nodes.field("digest"), *once[1:], pa.array(proofs, pa.string()), pa.array(folded, pa.string()), same], names=schema.names)

    return met.mapInArrow(each, schema)


#: The columns of documents that a leaf covers.
COVERED = ("doc_id", "source", "lang", "n_chars", "text")


def leaves(docs: DataFrame, presented: Column) -> DataFrame:
    """tree (the source), doc_id, digest and presented, the digest of the row with that text."""
    whole = leaf(*map(F.col, COVERED))
    other = F.when(presented.eqNullSafe(F.col("text")), whole).otherwise(leaf(*map(F.col, COVERED[:-1]), presented))
    return saved(docs.select(F.col("source").alias("tree"), "doc_id", whole.alias("digest"), other.alias("presented")), "merkle-leaves")


def verified(docs: DataFrame, presented: Column, depth: int = DEPTH) -> DataFrame:
    """The proof of every document, and whether its row with the presented text still folds to the root."""
    return proven(leaves(docs, presented), ["doc_id"], depth)
