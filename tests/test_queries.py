"""Every registered query against its SQL on the small tables."""

import os

import duckdb
import pytest

from tidemark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sql, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    if name in registry.oracle_sql():
        cursor = sql.execute(registry.oracle_sql()[name])
        names = [x[0] for x in cursor.description]
        assert sorted(names) == columns
        assert got == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in cursor.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
