"""Every query with a SQL twin must agree with DuckDB on sf0.001 (schema
names, row count and values), the same gate the driver applies at sf0.01."""

import pytest

import __spark_entry__ as E
from conftest import SF0001
from helpers import canon

ORACLE = E.oracle_sql()
QUERIES = E.queries()


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF0001)
    got = canon(sdf.columns, [tuple(r) for r in sdf.collect()])
    res = duck.execute(ORACLE[name])
    want = canon([c[0] for c in res.description], res.fetchall())
    assert got[0] == want[0], f"columns differ: {got[0]} vs {want[0]}"
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_entry_smoke(spark):
    df = E.entry(spark)
    out = df.collect()
    assert df.columns == ["hora", "n", "pico"]
    assert 0 < len(out) <= 24
    assert sum(1 for r in out if r["pico"]) == 1
