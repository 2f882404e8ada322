import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from vigilake.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base(text):
    """The counts of the plain rules, by plain Python."""
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    within = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(within)


def all_counts(text):
    text = text or ""
    lines = [x for x in text.split("\n") if WORD.search(x)]
    capitals = sum(1 for c in text if c.isupper() and c.isalpha())
    return (*base(text), len(lines), capitals, len(re.findall("[0-9]", text)), sum(chr(c) in text and text.count(chr(c)) for c in quality.MARKS))


def vector(c):
    n, chars, symbols, dup, repeat, lines, capitals, digits, marks = c
    x = [math.log((chars + 100) / (n + 20)), math.sqrt(symbols / (chars + 100)), math.sqrt(capitals / (chars + 100)), math.sqrt(marks / (chars + 100)), digits / (chars + 100), dup / (lines + 10), repeat / (n + 50)]
    return [math.floor(1024 * v + 0.5) for v in x]


def estimate(x):
    mean = x.mean(0)
    return finish(mean, x.T @ x / len(x) - np.outer(mean, mean))


def finish(mean, cov):
    ridge = (quality.RIDGE * quality.UNIT) ** 2
    size, axes = np.linalg.eigh(cov + np.eye(7) * ridge)
    size = np.maximum(size, ridge)
    return mean, axes @ np.diag(1 / size) @ axes.T, np.log(size).sum()


def far(x, est):
    d = x - est[0]
    return np.einsum("ni,ij,nj->n", d, est[1], d)


def at_share(v, share):
    return np.sort(v)[math.ceil(len(v) * share) - 1]


def step(x, est):
    bins = np.floor(np.log2(np.maximum(far(x, est), 0) + 2**-10) * quality.FINE)
    return estimate(x[bins <= at_share(bins, quality.H)])


def mcd(x):
    """The estimate of one cell by plain numpy."""
    x = np.array(x, float)
    v = np.floor(x / 4)
    m = np.array([at_share(c, 0.5) for c in v.T])
    d = np.array([at_share(np.abs(c - k), 0.5) for c, k in zip(v.T, m, strict=True)]) * 4 * 1.4826 + quality.RIDGE * quality.UNIT
    m = m * 4 + 2
    z = (x - m) / d
    starts = []
    for u in (np.tanh(z), z / np.maximum(np.linalg.norm(z, axis=1), 1e-9)[:, None]):
        u = np.floor(np.abs(u) * 1024 + 0.5) * np.sign(u)
        cov = u.T @ u / len(u) - np.outer(u.mean(0), u.mean(0))
        size = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        starts.append(finish(m, cov / np.outer(size, size) * np.outer(d, d)))
    starts.append(finish(m, np.diag(d**2)))
    for _ in range(quality.STARTED):
        starts = [step(x, s) for s in starts]
    best = min(starts, key=lambda s: s[2])
    for _ in range(quality.STEPS):
        best, before = step(x, best), best
        if abs(best[2] - before[2]) <= 1e-6:
            break
    return estimate(x[far(x, best) / quality._consistent(quality.H) <= quality._chi2(7, 0.975)])


def brute(rows):
    """doc_id -> counts, base_failed, distance and kept; rows: (doc_id, text, lang, source), each source a cell of its own."""
    counts = [all_counts(t) for _, t, _, _ in rows]
    failed = [c[0] < 10 or 100 * c[4] > 20 * c[0] for c in counts]
    cells = defaultdict(list)
    for (_, _, lang, source), c, f in zip(rows, counts, failed, strict=True):
        if not f:
            cells[lang, source].append(vector(c))
    models = {k: mcd(v) for k, v in cells.items() if len(v) >= quality.LEAST}
    out = {}
    for (i, _, lang, source), c, f in zip(rows, counts, failed, strict=True):
        m = models.get((lang, source))
        away = None if m is None else far(np.array([vector(c)], float), m)[0] / quality._consistent(0.975)
        out[i] = (*c[:5], f, away, not f and (away is None or away <= quality.SLACK * quality._chi2(7, 1 - quality.TAIL)))
    return out


def prose(rng, n):
    words = ["the", "a", "house", "Meer", "über", "walks", "slowly", "tree", "of", "in", "été", "1984", "rivers", "and"]
    text = " ".join(rng.choice(words) + rng.choice(["", "", "", "", ",", "."]) + str(rng.randrange(9)) * (rng.random() < 0.05) for _ in range(n))
    return text.replace(" the ", "\nthe ") if rng.random() < 0.5 else text


def corpus(n, sources=1, seed=7):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randrange(5, 300)), "en", f"s{i % sources}") for i in range(n)]
    odd = [" | ".join(rng.choice(["x", "yy", "zzz"]) + str(i) for i in range(60)), " ".join(f"A{i}B&&&" for i in range(80)), "SHOUT! " * 12]
    return rows + [(n + i, t, "en", "s0") for i, t in enumerate(odd)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(parts)


def result(spark, rows, **more):
    return {r.doc_id: (*(r[c] for c in BASE), r.base_failed, r.distance, r.kept) for r in quality.judged(frame(spark, rows, **more)).collect()}


ODD = ["", None, " \n\t", "a", "\n\n", "a\na\n a\na \n\n\nb", "x " * 9, "x " * 10, "a b c d e f a b c d e", "é ü\x0bñ\x85z q", "a\rb\ra\r", "#*$%&|<>", "A B C D E F G H I J A b C D E F", "tail\n", "ß́ \U0001f600 \U0001f600x"]


def test_counts_equal_plain_python():
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab  \n#\té") for _ in range(rng.randrange(200))) for _ in range(400)] + ["q r s " * 70000, "z" * 1_500_000]
    got = quality.counted(pa.array(texts))
    for i, t in enumerate(texts):
        assert tuple(int(got[c][i]) for c in BASE) == base(t), t
        assert int(got["n_lines"][i]) == all_counts(t)[5]


def test_equals_plain_estimates(spark):
    rows = corpus(900, 2)
    got, want = result(spark, rows), brute(rows)
    assert set(got) == set(want)
    for i, w in want.items():
        assert got[i][:6] == w[:6] and got[i][7] == w[7]
        assert got[i][6] == pytest.approx(w[6], rel=1e-6)
    assert [got[900 + i][7] for i in range(3)] == [False] * 3
    assert sum(g[7] for g in got.values()) >= 0.97 * sum(not g[5] for g in got.values())


def test_partitions_don_t_matter(spark):
    rows = corpus(300)
    assert result(spark, rows, parts=1) == result(spark, rows, parts=7)


def test_small_sources_share_a_cell_and_too_few_keep_all(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 80), "en", f"s{i % 30}") for i in range(300)] + [(1000, "A1&&& " + " ".join(f"B{i}%%%" for i in range(70)), "en", "s1"), (1001, prose(rng, 50), "fr", None)]
    got = result(spark, rows)
    # 30 sources of 10 documents: one cell of the language; the French one has no cell.
    assert not got[1000][7] and got[1000][6] > 100 and got[1001][6] is None and got[1001][7]
    few = [(i, f"some plain words of a text that is number {i} in its row", "en", "s") for i in range(20)]
    assert all(r[6] is None and r[7] for r in result(spark, few).values())


def test_nulls_copies_and_odd_texts(spark):
    same = "one and the same text that is repeated many times over in this table of ours"
    rows = [(i, same, None, None) for i in range(150)] + [(1000 + i, t, None, None) for i, t in enumerate(ODD)] + [(None, None, "en", "s")]
    got = result(spark, rows)
    assert len(got) == len(rows)
    assert all(got[i][7] and got[i][6] == pytest.approx(0, abs=1e-6) for i in range(150))
    assert not got[1000][7] and not got[1001][7] and got[None][5]


def test_empty_table_and_other_columns(spark):
    assert result(spark, []) == {}
    df = frame(spark, corpus(120)).selectExpr("*", "1 AS cell", "2 AS x", "3 AS start", "4 AS n_words", "5 AS count")
    assert quality.judged(df).count() == 123
