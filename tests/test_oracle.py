"""Every transform query against the same question in DuckDB, at the smallest scale."""

import duckdb
import pytest

from scatterwave import queries as core

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query(spark, sf, con, name):
    a, b = core.queries()[name](spark, sf).toPandas(), con.execute(core.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns) and len(a) == len(b)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    for c in cols:
        assert (a[c] == b[c]).all(), c
