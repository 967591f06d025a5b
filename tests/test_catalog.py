"""The registered queries, against their SQL on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check_oracle import TABLES, canonical


@pytest.fixture(scope="module")
def db(folder):
    connection = duckdb.connect()
    for t in TABLES.split():
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, db, folder, name):
    df = queries()[name](spark, folder)
    result = db.execute(oracle_sql()[name])
    want = canonical([d[0] for d in result.description], result.fetchall())
    assert canonical(df.columns, df.collect()) == want


def test_entry(spark):
    assert entry(spark).count() > 0
