"""Quality rules: plain limits, then robust multivariate outliers within a document's language and source.

Counts of each text are taken in Arrow batches (words, lines and windows as 64-bit hashes), kept as a
narrow table and turned into vectors of transformed rates in fixed point, so that all sums over
documents are exact and no result depends on how the rows lie. Of each cell (a language and source)
the minimum-covariance-determinant estimate is sought over all documents that pass the limits, in
concentration steps for all cells at once: distances by the estimate so far, the cut that holds the
share H of them from a fine histogram, and sums of what lies within. Both are aggregations that are
combined before the shuffle, however large a cell is. Three deterministic starts (median and
deviation; correlations of tanh; signs) go STARTED steps, the one of least determinant goes on until
nothing changes, at most STEPS. A last estimate weighs all within the 97.5 % ellipsoid. A document
further away than the cutoff is rejected.

A source with fewer than LEAST passing documents shares a cell with the small sources of its language,
these with all small ones if still too few; a cell that is too small yet gives no verdict, so that its
documents are kept if they pass the limits. Null languages and sources are languages and sources of
their own. Null and empty texts have no words and fail. Repeated rows count each. An empty table gives
no rows. Columns other than doc_id, text, lang and source are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vigilake.llm.shared import blocks, hash_runs, mix, powers, runs, saved, small_batches, spaces, text_rows, utf8

#: Limits of the base rules: least words, and the percentage of words in repeated windows of WINDOW words.
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
#: Documents that a cell needs, the share that an estimate is of, and steps.
LEAST, H, STARTED, STEPS = 100, 0.75, 2, 8
#: Fixed point of vectors; what is added to every variance, as a deviation in the same unit.
UNIT, RIDGE = 1024, 0.03
#: The share of normal vectors beyond the cutoff, and a factor for tails that are longer than those.
TAIL, SLACK = 1e-6, 1.5
#: Tables of cells up to so many rows are broadcast; longer ones are joined by sorting, where Spark splits hot keys at run time.
CELLS_BROADCAST = 50_000
#: Histogram bins for each doubling of a squared distance.
FINE = 256

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_digits", "n_marks")
SYMBOLS, MARKS = b"#*$%&|<>", b"!\"'()+,-./:;=?@[\\]^_`{}~"


def _members(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


def _by_text(hit: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many hits lie in each range."""
    upto = np.concatenate([[0], np.cumsum(hit)])
    return upto[off[1:]] - upto[off[:-1]]


def _seen(key: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a key occurs before among those of the same text, and whether it occurs twice at all."""
    by = np.lexsort((key, of))
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = (key[by][1:] == key[by][:-1]) & (of[by][1:] == of[by][:-1])
    again, twice = np.zeros(len(key), bool), np.zeros(len(key), bool)
    again[by], twice[by] = same[:-1], same[:-1] | same[1:]
    return again, twice


def counted(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of every text."""
    data, off = utf8(texts)
    parts: dict[str, list[np.ndarray]] = {c: [] for c in COUNTS if c != "n_capitals"}
    for i, j in blocks(off):
        for c, v in _counted(data[off[i] : off[j]], off[i : j + 1] - off[i]).items():
            parts[c].append(v)
    out = {c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in parts.items()}
    capitals = pc.fill_null(pc.count_substring_regex(texts, pattern=r"\p{Lu}"), 0)
    return {c: capitals.to_numpy(zero_copy_only=False).astype(np.int64) if c == "n_capitals" else out[c] for c in COUNTS}


def _counted(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    inside = ~spaces()[data]
    starts, ends, first = runs(inside, off)
    n_words = np.diff(first)
    words = hash_runs(data, inside, starts, ends, fold=False)
    # Windows that lie in one text; each marks its words if it occurs twice.
    of = np.repeat(np.arange(len(n_words)), n_words)
    at = np.flatnonzero(of[WINDOW - 1 :] == of[: len(of) - WINDOW + 1]) if len(of) >= WINDOW else np.zeros(0, np.int64)
    window = mix(reduce(np.add, (words[at + k] * powers(WINDOW)[k] for k in range(WINDOW)), np.zeros(len(at), np.uint64)))
    _, twice = _seen(window, of[at])
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, at[twice], 1)
    np.add.at(step, at[twice] + WINDOW, -1)
    # Lines that hold a word.
    line = data != 10
    low, high, first_line = runs(line, off)
    worded = _by_text(inside, np.concatenate([low, high[-1:]])) > 0 if len(low) else np.zeros(0, bool)
    again, _ = _seen(hash_runs(data, line, low, high, fold=False)[worded], np.repeat(np.arange(len(n_words)), np.diff(first_line))[worded])
    repeated = np.zeros(len(low), bool)
    repeated[np.flatnonzero(worded)] = again
    return {
        "n_words": n_words,
        "word_chars": _by_text(inside & ((data & 0xC0) != 0x80), off),
        "n_symbols": _by_text(_members(SYMBOLS)[data], off),
        "n_dup_lines": _by_text(repeated, first_line),
        "n_repeat_words": _by_text(np.cumsum(step[:-1]) > 0, first),
        "n_lines": _by_text(worded, first_line),
        "n_digits": _by_text((data >= 48) & (data <= 57), off),
        "n_marks": _by_text(_members(MARKS)[data], off),
    }


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, COUNTS and base_failed of every document."""
    rows = text_rows(docs, "doc_id", "lang", "source")
    schema = T.StructType([*(rows.schema[c] for c in ("doc_id", "lang", "source")), *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["lang"], b["source"], *(pa.array(v) for v in counted(b["text"]).values())], names=schema.names)

    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.mapInArrow(each, schema).withColumn("base_failed", failed)


def vector() -> list[Column]:
    """The transformed statistics in fixed point: word length as a logarithm and rates, drawn a little to zero, so that short texts don't stand out.

    Rates of characters that mark a kind of text are roots, which tell few from none; digits and
    repeats, which good texts have in places, count as they are.
    """

    def rate(count: str, of: str, few: int) -> Column:
        return F.col(count) / (F.col(of) + few)

    parts = [
        F.log((F.col("word_chars") + 100) / (F.col("n_words") + 20)),
        F.sqrt(rate("n_symbols", "word_chars", 100)),
        F.sqrt(rate("n_capitals", "word_chars", 100)),
        F.sqrt(rate("n_marks", "word_chars", 100)),
        rate("n_digits", "word_chars", 100),
        rate("n_dup_lines", "n_lines", 10),
        rate("n_repeat_words", "n_words", 50),
    ]
    return [F.round(F.lit(UNIT) * p).cast("long") for p in parts]


DIMS = 7
PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]


def _key(c: Column) -> Column:
    return F.when(c.isNull(), "-").otherwise(F.concat(F.char_length(c).cast("string"), F.lit(":"), c))


def _small(table: DataFrame) -> DataFrame:
    """A written table, marked to be broadcast if it has few rows."""
    return F.broadcast(table) if table.count() <= CELLS_BROADCAST else table


def _with_cells(rows: DataFrame) -> DataFrame:
    """Adds cell, null where there are too few documents."""
    n = rows.where("not base_failed").groupBy("lang", "source").count()
    small = F.col("count") < LEAST
    # Sums over the small sources of each language, then over the small languages, a row each.
    by_lang = n.where(small).groupBy("lang").agg(F.sum("count").alias("in_lang"))
    rest = by_lang.where(F.col("in_lang") < LEAST).agg(F.coalesce(F.sum("in_lang"), F.lit(0)).alias("in_all")).first()["in_all"]
    seen = rows.select("lang", "source").distinct().join(n.withColumnRenamed("lang", "l").withColumnRenamed("source", "s"), F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left").drop("l", "s")
    seen = seen.join(by_lang.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l")), "left")
    own, lang = F.concat(F.lit("source "), _key(F.col("lang")), _key(F.col("source"))), F.concat(F.lit("lang "), _key(F.col("lang")))
    cell = F.when(F.col("count") >= LEAST, own).when(F.col("in_lang") >= LEAST, lang).when(F.lit(rest >= LEAST), F.lit("all"))
    cells = _small(saved(seen.select(F.col("lang").alias("l"), F.col("source").alias("s"), cell.alias("cell")), "quality-cells"))
    return rows.join(cells, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))).drop("l", "s")


def _quantile(values: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """Of each group of (keys, value, count), the least value up to which that share of its rows lies; groups are as long as they have values."""
    run = Window.partitionBy(*keys)
    upto = values.withColumn("upto", F.sum("count").over(run.orderBy(value))).withColumn("all", F.sum("count").over(run))
    return upto.where(F.col("upto") >= F.ceil(F.col("all") * share)).groupBy(*keys).agg(F.min(value).alias(value))


def _estimates(sums: DataFrame) -> DataFrame:
    """cell, start, mean, inverse (upper triangle) and logdet from n, s and ss: sums of vectors, and of products by PAIRS."""
    schema = "cell string, start int, mean array<double>, inverse array<double>, logdet double"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n = b["n"].to_numpy()[:, None].astype(float)
            mean = b["s"].flatten().to_numpy().reshape(-1, DIMS) / n
            cov = _square(b["ss"].flatten().to_numpy().reshape(-1, len(PAIRS)) / n) - mean[:, :, None] * mean[:, None, :]
            yield _rows(b, mean, cov)

    return sums.mapInArrow(each, schema)


def _square(upper: np.ndarray) -> np.ndarray:
    out = np.zeros((len(upper), DIMS, DIMS))
    for k, (i, j) in enumerate(PAIRS):
        out[:, i, j] = out[:, j, i] = upper[:, k]
    return out


def _rows(b: pa.RecordBatch, mean: np.ndarray, cov: np.ndarray) -> pa.RecordBatch:
    cov = cov + np.eye(DIMS) * (RIDGE * UNIT) ** 2
    # A start need not be positive: negative axes count as none.
    size, axes = np.linalg.eigh(cov)
    size = np.maximum(size, (RIDGE * UNIT) ** 2)
    inverse = np.einsum("nij,nj,nkj->nik", axes, 1 / size, axes)
    upper = np.stack([inverse[:, i, j] for i, j in PAIRS], axis=1)
    lists = [pa.ListArray.from_arrays(np.arange(len(x) + 1) * x.shape[1], pa.array(x.ravel())) for x in (mean, upper)]
    return pa.RecordBatch.from_arrays([b["cell"], b["start"], *lists, pa.array(np.log(size).sum(1))], names=["cell", "start", "mean", "inverse", "logdet"])


def squared_distance(x: Column, mean: Column, inverse: Column) -> Column:
    gaps = [x[i] - mean[i] for i in range(DIMS)]
    return reduce(Column.__add__, (gaps[i] * gaps[j] * inverse[k] * (1 if i == j else 2) for k, (i, j) in enumerate(PAIRS)))


def _summed(rows: DataFrame, x: Column) -> DataFrame:
    """cell, start, n, s and ss over rows of vectors in fixed point; sums are exact in long (products stay below 2^29, so up to 2^34 rows a cell)."""
    parts = [x[i] for i in range(DIMS)]
    each = [F.sum(p).alias(f"s{i}") for i, p in enumerate(parts)] + [F.sum(parts[i] * parts[j]).alias(f"p{i}_{j}") for i, j in PAIRS]
    out = rows.groupBy("cell", "start").agg(F.count("*").alias("n"), *each)
    return out.select("cell", "start", "n", F.array(*[F.col(f"s{i}").cast("double") for i in range(DIMS)]).alias("s"), F.array(*[F.col(f"p{i}_{j}").cast("double") for i, j in PAIRS]).alias("ss"))


def _starts(rows: DataFrame) -> DataFrame:
    """Three estimates of each cell; rows: cell and x."""
    of = F.explode(F.transform("x", lambda v, i: F.struct(i.alias("i"), F.shiftright(v, 2).alias("v"))))
    values = saved(rows.select("cell", of.alias("c")).select("cell", "c.i", "c.v").groupBy("cell", "i", "v").count(), "mcd-values")
    middle = _quantile(values, ["cell", "i"], "v", 0.5).withColumnRenamed("v", "m")
    gaps = values.join(middle, ["cell", "i"]).select("cell", "i", F.abs(F.col("v") - F.col("m")).alias("g"), "count").groupBy("cell", "i", "g").agg(F.sum("count").alias("count"))
    wide = _quantile(gaps, ["cell", "i"], "g", 0.5)
    # Back in fixed point (values were cut to a quarter of it); the deviation of a normal variate.
    both = middle.join(wide, ["cell", "i"]).select("cell", F.struct("i", (F.col("m") * 4 + 2).cast("double").alias("m"), (F.col("g") * 4 * 1.4826 + RIDGE * UNIT).alias("d")).alias("c"))
    scales = saved(both.groupBy("cell").agg(F.array_sort(F.collect_list("c")).alias("c")).select("cell", F.col("c.m").alias("m"), F.col("c.d").alias("d")), "mcd-scales")
    z = F.transform("x", lambda v, i: (v - F.get("m", i)) / F.get("d", i))
    held = rows.join(scales, "cell").select("cell", z.alias("z"))
    norm = F.sqrt(F.aggregate("z", F.lit(0.0), lambda a, v: a + v * v))
    soft = F.transform("z", lambda v: F.round(F.tanh(v) * UNIT).cast("long"))
    signs = F.transform("z", lambda v: F.round(v / F.greatest("norm", F.lit(1e-9)) * UNIT).cast("long"))
    spread = held.withColumn("norm", norm).select("cell", F.posexplode(F.array(soft, signs)).alias("start", "u"))
    sums = _summed(spread, F.col("u")).join(scales, "cell")
    schema = "cell string, start int, mean array<double>, inverse array<double>, logdet double"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n = b["n"].to_numpy()[:, None].astype(float)
            m, d = (b[c].flatten().to_numpy().reshape(-1, DIMS) for c in ("m", "d"))
            mean = b["s"].flatten().to_numpy().reshape(-1, DIMS) / n
            cov = _square(b["ss"].flatten().to_numpy().reshape(-1, len(PAIRS)) / n) - mean[:, :, None] * mean[:, None, :]
            size = np.sqrt(np.maximum(np.einsum("nii->ni", cov), 1e-9))
            alike = cov / size[:, :, None] / size[:, None, :]
            yield _rows(b, m, alike * d[:, :, None] * d[:, None, :])
            plain = pa.RecordBatch.from_arrays([b["cell"], pa.array(np.full(b.num_rows, 2, np.int32))], names=["cell", "start"]).filter(pc.equal(b["start"], 0))
            first = b["start"].to_numpy() == 0
            if first.any():
                yield _rows(plain, m[first], np.eye(DIMS) * (d[first] ** 2)[:, None, :])

    return saved(sums.mapInArrow(each, schema), "mcd-starts")


def _step(rows: DataFrame, held: DataFrame) -> DataFrame:
    """The estimates of the share H of each cell that lies nearest by the estimates so far."""
    d2 = squared_distance(F.col("x"), F.col("mean"), F.col("inverse"))
    bins = rows.join(held, "cell").select("cell", "start", "x", F.floor(F.log2(F.greatest(d2, F.lit(0.0)) + 2.0**-10) * FINE).alias("bin"))
    cut = saved(_quantile(bins.groupBy("cell", "start", "bin").count(), ["cell", "start"], "bin", H).withColumnRenamed("bin", "cut"), "mcd-cut")
    near = bins.join(cut, ["cell", "start"]).where("bin <= cut")
    return saved(_estimates(_summed(near, F.col("x"))), "mcd-step")


def _chi2(dims: int, share: float) -> float:
    """The quantile of chi square by the cube-root approximation."""
    v = 2 / (9 * dims)
    return dims * (1 - v + NormalDist().inv_cdf(share) * v**0.5) ** 3


def _below(dims: int, x: float) -> float:
    v = 2 / (9 * dims)
    return NormalDist().cdf(((x / dims) ** (1 / 3) - 1 + v) / v**0.5)


def _consistent(share: float) -> float:
    """What a covariance of the nearest share of normal vectors is to be multiplied by."""
    return share / _below(DIMS + 2, _chi2(DIMS, share))


def fitted(rows: DataFrame) -> DataFrame:
    """cell, mean, inverse and logdet of each cell; rows: cell and x of the documents that pass the limits."""
    held = _starts(rows)
    for _ in range(STARTED):
        held = _step(rows, held)
    best = F.min_by(F.struct("start", "mean", "inverse", "logdet"), F.struct("logdet", "start"))
    held = saved(held.groupBy("cell").agg(best.alias("b")).select("cell", "b.*"), "mcd-best")
    for _ in range(STEPS):
        before, held = held, _step(rows, held)
        moved = held.join(before.select("cell", F.col("logdet").alias("was")), "cell").where(F.abs(F.col("logdet") - F.col("was")) > 1e-6)
        if moved.isEmpty():
            break
    d2 = squared_distance(F.col("x"), F.col("mean"), F.col("inverse")) / F.lit(_consistent(H))
    near = rows.join(held, "cell").where(d2 <= _chi2(DIMS, 0.975))
    return saved(_estimates(_summed(near.select("cell", "start", "x"), F.col("x"))), "mcd-last")


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, COUNTS, base_failed, distance (squared, by the cell's estimate; null without one) and kept of every document."""
    small_batches(docs.sparkSession)
    counts = saved(statistics(docs), "quality-counts")
    rows = saved(_with_cells(counts).withColumn("x", F.array(*vector())), "quality-rows")
    models = fitted(rows.where("not base_failed and cell is not null").select("cell", "x"))
    models = _small(models).select(F.col("cell").alias("of"), "mean", "inverse")
    distance = squared_distance(F.col("x"), F.col("mean"), F.col("inverse")) / F.lit(_consistent(0.975))
    out = rows.join(models, F.col("cell") == F.col("of"), "left").withColumn("distance", distance)
    odd = F.coalesce(F.col("distance") > SLACK * _chi2(DIMS, 1 - TAIL), F.lit(False))
    return out.select("doc_id", "lang", "source", *COUNTS, "base_failed", "distance", (~F.col("base_failed") & ~odd).alias("kept"))
