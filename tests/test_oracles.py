"""Every query of the engine against its DuckDB oracle on the smallest tables."""

import os

import duckdb
import pytest

from docketry import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(value):
    if isinstance(value, float):
        return f"{value + 0.0:.5f}"
    return "NULL" if value is None else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rows = sorted(tuple(shown(r[c]) for c in names) for r in df.collect())
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    got = duck.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == names
    place = [columns.index(c) for c in names]
    assert rows == sorted(tuple(shown(r[i]) for i in place) for r in got.fetchall())


def test_oracles_have_queries():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) and registry.FLAGSHIP in registry.QUERIES
