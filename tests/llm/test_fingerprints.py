import hashlib

from vigilake.llm import fingerprints

TEXTS = ["", None, "A  b\n", "a B", "ﬁne", "FINE", "x" * 50_000, "same text", "same text", "é", "é", "日本語 テキスト" * 9]


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    out = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        n = len(t)
        new = t[: n - n // 3] + after[: n // 3]
        fp = [fingerprints.digest(fingerprints.canonical(x)) for x in (t, new, after)]
        out.append((i, n, hashlib.sha256(new.encode()).hexdigest(), fp[0], fp[1], float(fp[0] == fp[1]), float(fp[0] == fp[2])))
    return sorted(out, key=str)


def test_edits_equal_brute_force(spark, documents):
    for rows in ([(i * 7, t) for i, t in enumerate(TEXTS)], [(3, "a"), (None, "bcd"), (3, "a"), (3, "zzz")], [(1, "only one")], []):
        got = fingerprints.with_edits(documents(rows).selectExpr("*", "1 as part")).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows)


def test_real_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, fingerprints.with_edits(docs).collect()), key=str) == brute(rows)


def test_canonical_folds_form_case_and_space():
    assert fingerprints.canonical("ﬁne  Straße ") == fingerprints.canonical("FINE STRASSE")


def test_bytes_are_compared_inside_equal_digests(spark, documents, monkeypatch):
    docs = documents(["one", "two", "two", "three"])
    assert fingerprints.collisions(docs) == {}
    # With digests that collide, the number of the text makes the difference.
    clashes = {("d", "two"): 1}
    monkeypatch.setattr(fingerprints, "digest", lambda c: "d")
    assert fingerprints.fingerprint("two", clashes) == "d-1" and fingerprints.fingerprint("one", clashes) == "d"


def test_ids_of_other_types(spark):
    for kind, ids in (("int", [1, None]), ("string", ["a", None])):
        df = spark.createDataFrame([(i, "Some  Text") for i in ids], f"doc_id {kind}, text string")
        got = fingerprints.fingerprints(df)
        assert got.schema["doc_id"].dataType.simpleString() == kind
        assert {r.doc_id for r in got.collect()} == set(ids) and len({r.fingerprint for r in got.collect()}) == 1
