"""Every query of the engine against its SQL in DuckDB, over whole tables."""

import os

import duckdb
import pytest

from kmerloom import queries
from tests.conftest import same_rows

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{DATA}/{t}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, duck, name):
    assert same_rows(queries.QUERIES[name](spark, DATA).toPandas(), duck.sql(queries.SQL[name]).df())
