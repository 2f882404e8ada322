"""Every registered query with an oracle gives the oracle's rows on sf0.01."""

import glob
import os

import duckdb
import pytest

from vigilake.plans import registry

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        return round(v, 6) if isinstance(v, float) else v

    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    want = want.fetchall()
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want)
    assert want
