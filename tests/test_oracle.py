"""Every query against its SQL, at the smallest scale."""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry, queries
from conftest import SF_SMALL
from salesmart.fixtures.oracle import ORACLE_SQL
from salesmart.fixtures.queries import QUERIES
from verify import normal

@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_SMALL}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    mine = [tuple(row) for row in df.collect()]
    # One product may have no clean row at this scale.
    assert mine or name == "flt_product"
    cursor = duck.execute(ORACLE_SQL[name])
    columns = [item[0] for item in cursor.description]
    theirs = cursor.fetchall()
    assert sorted(columns) == sorted(df.columns)
    assert normal(mine, df.columns) == normal(theirs, columns)


def test_entry(spark):
    assert entry(spark).columns == ["year_month", "sales", "profit"]
