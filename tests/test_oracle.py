"""Every binding with SQL gives the same rows as DuckDB, on the smallest tables; the others run."""

import duckdb
import pytest

from tidewell.plans import bindings, composites, depth, desk, lists, parsed, scalars  # noqa: F401

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


def shown(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(bindings.QUERIES))
def test_binding(spark, duck, name):
    df = bindings.QUERIES[name](spark, DIR)
    got = [tuple(shown(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name not in bindings.SQL:
        assert got
        return
    want = duck.sql(bindings.SQL[name])
    cols = sorted(want.columns)
    assert cols == sorted(df.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(got) == sorted(tuple(shown(r[i]) for i in at) for r in want.fetchall())
