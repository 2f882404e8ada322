"""Canonical forms written out by hand, and the store over several runs."""

import hashlib
import json
import shutil
import time

import pytest
from pyspark.sql import functions as F

from vigilake.functions import canonical
from vigilake.operators import pins
from vigilake.sources import pin_store, policies


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"b":1, "a":[1.0,2e0,1E3,0.10]}', '{"a":[1.0,2.0,1000.0,0.1],"b":1}'), ('{"a":{"z":null,"y":true}}', '{"a":{"y":true,"z":null}}'), ("1e16", "1e16"), ("1e15", "1000000000000000.0"), ("0.00001", "0.00001"), ("1.5e-5", "0.000015"), ("1e-6", "1e-6"), ("-1.25e-7", "-1.25e-7"),
        ("18446744073709551615", "18446744073709551615"), ("18446744073709551616", "18446744073709552000.0".replace("18446744073709552000.0", "1.8446744073709552e19")), ("-0", "-0.0"), ('"\\u00e9\\/\\u001f\\t\\u007f"', '"é/\\u001f\\t\x7f"'), ('{"a":1,"a":2}', '{"a":2}'), ('{"\\u0000":1.5}', '{"\\u0000":1.5}'), ('{"é":1,"z":2,"Z":3}', '{"Z":3,"z":2,"é":1}'),
    ],
)
def test_canonical_text(text, want):
    assert canonical.canonical(text) == want


@pytest.mark.parametrize("text", ["", "{", "NaN", "[Infinity]", '"\\ud800"', "1e999", "{'a':1}", "[1,]"])
def test_what_is_no_json(text):
    with pytest.raises(ValueError):
        canonical.parsed(text) if "ud800" not in text else canonical.canonical(text).encode()


def test_digests_are_those_of_the_written_form(spark):
    result = '{"tools":[{"name":"b","title":"x","inputSchema":{"type":"object","properties":{"y":{"default":1.50},"x":{}}},"outputSchema":{"o":1}},{"description":"d\\u00e9","name":"a"},{"description":"no name"}],"nextCursor":"c"}'
    want = '{"tools":[{"description":"no name"},{"description":"dé","name":"a"},{"inputSchema":{"properties":{"x":{},"y":{"default":1.5}},"type":"object"},"name":"b","outputSchema":{"o":1}}],"upstream":"run \\"x\\""}'
    got = spark.createDataFrame([('run "x"', result), ("u", "[]"), ("u", "broken"), ("u", None)], "u string, r string").select(canonical.manifest_digests("u", "r").alias("d")).collect()
    assert got[0].d.tools_hash == sha(want) and got[1].d.tools_hash == sha('{"tools":[],"upstream":"u"}') and got[1].d.tools == {} and got[2].d is None and got[3].d is None
    assert got[0].d.tools == {"a": sha('{"description":"dé","name":"a"}'), "b": sha('{"inputSchema":{"properties":{"x":{},"y":{"default":1.5}},"type":"object"},"name":"b"}')}


def test_columns_give_the_same_digests(spark):
    rows = [("t", "d", '{"b":1,"a":2.0}'), ("t", "d", "{broken"), ("t", "d", "{broken too"), ("t", "d", None), ("t", None, None), ('q"\n', "", "[]")]
    df = spark.createDataFrame(rows, "n string, d string, s string").select(pins.descriptor_hash(F.col("n"), F.col("d"), F.col("s")).alias("h"))
    want = ['{"description":"d","inputSchema":{"a":2.0,"b":1},"name":"t"}', '{"description":"d","inputSchema":"{broken","name":"t"}', '{"description":"d","inputSchema":"{broken too","name":"t"}', '{"description":"d","name":"t"}', '{"name":"t"}', '{"description":"","inputSchema":[],"name":"q\\"\\n"}']
    assert [r.h for r in df.collect()] == [sha(w) for w in want]
    tools = spark.createDataFrame([("u", "b", None, "{}", '{"o":1}'), ("u", "a", "x", None, None)], "upstream string, name string, description string, input_schema string, output_schema string")
    listed = '{"tools":[{"description":"x","name":"a"},{"inputSchema":{},"name":"b","outputSchema":{"o":1}}]'
    assert pins.manifest_hash(tools).first().tools_hash == sha(listed + "}")
    assert pins.manifest_hash(tools, identity=True).first().tools_hash == sha(listed + ',"upstream":"u"}')


def test_policy_fingerprints_are_written_out():
    text = 'schema_version = 1\n[[tools]]\nname = "Bash"\n[[tools.rules]]\narg = "command"\nseverity = 9\nreason = "nö"\npattern = "rm*"\n[budgets.per_tool.Read]\nmax_tokens = 5\n'
    want = '{"schema_version":1,"defaults":{"default_action":"allow"},"tools":[{"name":"Bash","allow":[],"deny":[],"rules":[{"arg":"command","pattern":"rm*","severity":9,"reason":"nö"}]}],"budgets":{"session":{"max_tokens":null,"max_tool_invocations":null},"per_tool":{"Read":{"max_tokens":5,"max_invocations":null}}}}'
    assert policies.parse(text).fingerprint == sha(want)
    spelled = text.replace("[[tools]]", '[defaults]\ndefault_action = "allow"\n[[tools]]', 1).replace('name = "Bash"', 'name = "Bash"\nallow = []\ndeny = []') + "[budgets.session]\n"
    assert policies.parse(spelled).fingerprint == sha(want)
    assert policies.parse(spelled.replace('"allow"', '"deny"')).deny_by_default


@pytest.fixture
def manifest(spark):
    def make(**tools_of):
        rows = [(u, json.dumps({"tools": [{"name": n, "description": d} for n, d in tools.items()]})) for u, tools in tools_of.items()]
        df = spark.createDataFrame(rows, "upstream string, result string")
        return df.select("upstream", canonical.manifest_digests("upstream", "result").alias("d")).select("upstream", "d.*")

    return make


def verdicts(df):
    return {r.upstream: (r.verdict, [(c.name, c.change) for c in r.changes or ()]) for r in df.collect()}


def test_a_store_over_several_runs(spark, tmp_path, manifest):
    path = str(tmp_path / "pins")
    first = manifest(a={"x": "1", "y": "2"}, b={"x": "1"})
    assert verdicts(pin_store.verify(spark, path, first, 100)) == {"a": ("recorded", []), "b": ("recorded", [])}
    again = manifest(a={"y": "2", "x": "1"}, b={"x": "other", "z": "1"}, c={})
    assert verdicts(pin_store.verify(spark, path, again, 200)) == {"a": ("matched", []), "b": ("mismatch", [("x", "modified"), ("z", "added")]), "c": ("recorded", [])}
    held = {r.upstream: (r.first_seen, r.last_verified, dict(r.tools) if r.upstream == "b" else None) for r in pin_store.load(spark, path)[0].collect()}
    assert held["a"][:2] == (100, 200) and held["b"][:2] == (100, 100) and held["c"][:2] == (200, 200) and set(held["b"][2]) == {"x"}
    # What an operator expects comes before the store, in any case of letters.
    own = first.where("upstream = 'a'").first().tools_hash
    expected = spark.createDataFrame([("a", f" SHA256:{own.upper()}"), ("b", "sha256:00"), ("d", "sha256:00")], "upstream string, pin string")
    third = manifest(a={"x": "1", "y": "2"}, b={"x": "1"}, d={"x": "1"})
    assert {k: v for k, (v, _) in verdicts(pin_store.verify(spark, path, third, 300, expected)).items()} == {"a": "matched", "b": "preseed_mismatch", "d": "preseed_mismatch"}
    assert {r.upstream for r in pin_store.load(spark, path)[0].collect()} == {"a", "b", "c"}
    assert verdicts(pin_store.verify(spark, path, manifest(b={}), 400)) == {"b": ("mismatch", [("x", "removed")])}


def test_stores_fail_closed(spark, tmp_path, manifest):
    path = str(tmp_path / "pins")
    seen = manifest(a={"x": "1"})
    pin_store.verify(spark, path, seen, 1)
    name = pin_store._records(spark, path)[-1].name
    # A torn snapshot, a format that isn't known, a record that can't be read.
    shutil.move(f"{path}/{name}", f"{path}/kept")
    spark.createDataFrame([], pin_store.PIN).write.parquet(f"{path}/{name}")
    assert verdicts(pin_store.verify(spark, path, seen, 2)) == {"a": ("unavailable", [])}
    shutil.rmtree(f"{path}/{name}")
    assert verdicts(pin_store.verify(spark, path, seen, 2)) == {"a": ("unavailable", [])}
    shutil.move(f"{path}/kept", f"{path}/{name}")
    assert verdicts(pin_store.verify(spark, path, seen, 3)) == {"a": ("matched", [])}
    for version, want in ((9, "unavailable"), (2, "recorded")):
        other = str(tmp_path / f"v{version}")
        spark.createDataFrame([(1, "x", 0, version)], pin_store._CURRENT).write.json(f"{other}/current")
        assert verdicts(pin_store.verify(spark, other, seen, 1)) == {"a": (want, [])}
    (tmp_path / "pins" / "current" / "odd.json").write_text("broken\n")
    assert verdicts(pin_store.verify(spark, path, seen, 4)) == {"a": ("unavailable", [])}


def test_of_two_writers_one_merges_again(spark, tmp_path, manifest, monkeypatch):
    path = str(tmp_path / "pins")
    load, once = pin_store.load, []

    def late(*a):
        out = load(*a)
        if not once:
            once.append(1)
            # Another writer records b between reading and writing, under a name that wins.
            spark.createDataFrame([("b", "h", {"x": "1"}, 5, 5)], pin_store.PIN).write.parquet(f"{path}/pins-000000001-!")
            spark.createDataFrame([(1, "pins-000000001-!", 1, pins.STORE)], pin_store._CURRENT).coalesce(1).write.mode("append").json(f"{path}/current")
        return out

    monkeypatch.setattr(pin_store, "load", late)
    assert verdicts(pin_store.verify(spark, path, manifest(a={"x": "1"}), 9)) == {"a": ("recorded", [])}
    assert sorted(r.upstream for r in load(spark, path)[0].collect()) == ["a", "b"]


def test_tools_of_large_manifests_are_compared_in_one_pass(spark):
    """40,000 tools each: looking up each name in the other map took minutes."""
    n = 40_000
    made = spark.sql(f"SELECT map_from_arrays(transform(sequence(1, {n}), x -> 'tool ' || x), transform(sequence(1, {n}), x -> sha(string(x)))) AS old, map_from_arrays(transform(sequence({n} + 2, 3, -1), x -> 'tool ' || x), transform(sequence({n} + 2, 3, -1), x -> sha(string(if(x % 10 = 0, -x, x))))) AS new")
    made.write.format("noop").mode("overwrite").save()
    start = time.time()
    got = made.repartition(1).select(F.explode(pins.tool_changes(F.col("old"), F.col("new"))).alias("c")).select("c.*").collect()
    assert time.time() - start < 10
    assert [r.name for r in got] == sorted(r.name for r in got)
    said = {r.name: r.change for r in got}
    want = {"tool 1": "removed", "tool 2": "removed", f"tool {n + 1}": "added", f"tool {n + 2}": "added"} | {f"tool {x}": "modified" for x in range(10, n + 1, 10)}
    assert said == want


def test_odd_numbers_are_written_as_before(spark):
    """A manifest with numbers that take an exponent, and one without, have the digests of their canonical texts."""
    tool = '{{"outputSchema":{0},"name":"a","title":"t","inputSchema":{{"b":{0},"a":[1.50]}}}}'
    rows = [("u", '{"tools":[{"name":"b"},' + tool.format(x) + "]}") for x in ("1E2", "1e16", "0.00001", "-0")]
    got = spark.createDataFrame(rows, "u string, r string").coalesce(1).select(canonical.manifest_digests("u", "r").alias("d")).select("d.*").collect()
    for r, x in zip(got, ("100.0", "1e16", "0.00001", "-0.0"), strict=True):
        first = f'"inputSchema":{{"a":[1.5],"b":{x}}},"name":"a"'
        assert r.tools_hash == hashlib.sha256(f'{{"tools":[{{{first},"outputSchema":{x}}},{{"name":"b"}}],"upstream":"u"}}'.encode()).hexdigest()
        assert r.tools["a"] == hashlib.sha256(f"{{{first}}}".encode()).hexdigest()
