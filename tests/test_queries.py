import os

import duckdb
import pytest

import __spark_entry__
from labelweave.plans import queries as Q


@pytest.fixture(scope="module")
def con(small):
    con = duckdb.connect()
    for name in os.listdir(small):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{small}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, small, con, name):
    found, want = Q.queries()[name](spark, small).toPandas(), con.execute(Q.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(found.columns) == columns
    rows = lambda df: sorted(map(tuple, df[columns].astype(object).values.tolist()), key=str)
    assert rows(found) == rows(want) and len(want)


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() == 25
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
