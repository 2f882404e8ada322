import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilake.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """The levels of a tree by plain lists."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([leaf(*r) for r in sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))]) for s in order}
    top = climb([trees[s][-1][0] for s in order])
    out = []
    for at, s in enumerate(order):
        for i, r in enumerate(sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))):
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            fold = leaf(r[0], r[1].replace("\n", "") if even and r[1] else r[1], *r[2:])
            proof = ""
            for levels, j in ((trees[s], i), (top, at)):
                for level in levels[:-1]:
                    low = j // 3 * 3
                    left, right = "".join(level[low:j]), "".join(level[j + 1 : low + 3])
                    proof, fold, j = proof + left + right, h(left, fold, right), j // 3
            out.append((r[0], leaf(*r), trees[s][-1][0], top[-1][0], h(proof), fold, fold == top[-1][0]))
    return sorted(out, key=str)


def result(spark, rows, parts=3, **more):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    even = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 2 == 0
    text = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return sorted(map(tuple, merkle.verified(docs, text, **more).drop("tree").collect()), key=str)


def rows(n, sources):
    return [(i, f"text {i}\nof\nlines" if i % 3 else f"é {i}", "en" if i % 5 else None, f"s{i % sources}" if sources else None, i if i % 7 else None) for i in range(n)]


@pytest.mark.parametrize("n, sources", [(1, 1), (2, 1), (3, 0), (4, 2), (28, 5), (200, 40)])
def test_equals_plain_lists(spark, n, sources):
    assert result(spark, rows(n, sources)) == brute(rows(n, sources))


@pytest.mark.parametrize("depth", [1, 2])
def test_more_tiers(spark, depth):
    """Small blocks, so that trees of sources and of roots have several tiers."""
    many = rows(100, 13) + [(1000 + i, "a\nb", "de", "hot", 3) for i in range(82)]
    assert result(spark, many, depth=depth) == brute(many)


def test_a_source_longer_than_a_block(spark):
    many = [(i, f"t{i}\n", "en", "one", 1) for i in range(merkle.FANOUT**merkle.DEPTH * 3 + 1)] + rows(5, 2)
    assert result(spark, many, 5) == brute(many)


def test_nulls_ties_and_repeated_rows(spark):
    many = [(None, None, None, None, None)] * 7 + [(None, "\n", None, "", 0)] * 5 + [(3, "b\n", "x", "s", 1), (3, "a\n", "x", "s", 1), (3, "a\n", "x", "s", 1), (4, "", "", "ÿ", None), (5, "", "", "\U0001f600", None)]
    assert result(spark, many) == brute(many)


def test_empty_table(spark):
    assert result(spark, []) == []


def test_other_columns(spark):
    docs = spark.createDataFrame([(1, "a\n", "en", "s", 2, "x", 5, 6), (2, "b", "en", "s", 2, "x", 5, 6)], SCHEMA + ", tree string, index long, digest long")
    got = merkle.verified(docs, F.replace("text", F.lit("\n"), F.lit(""))).collect()
    assert {(r.doc_id, r.verified) for r in got} == {(1, False), (2, True)}


def test_levels_of_a_block():
    leaves = np.frombuffer("".join(h(str(i)) for i in range(10)).encode(), np.uint8).reshape(-1, 64)
    levels = merkle.raised(leaves, 3)
    assert [len(m) for m in levels] == [10, 4, 2, 1]
    left, right = merkle.siblings(leaves)
    assert left[4] == leaves[3].tobytes() and right[4] == leaves[5].tobytes() and (left[9], right[9]) == (b"", b"")
