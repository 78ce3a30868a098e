"""Every query with a SQL form gives the same rows in DuckDB."""

import duckdb
import pytest

from quorica.llm.queries import QUERIES
from quorica.llm.sql import STATEMENTS

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "documents embeddings pages labels".split():
        con.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_rows_equal_those_of_sql(spark, duck, name):
    ours = QUERIES[name](spark, SF_DIR).toPandas()
    theirs = duck.execute(STATEMENTS[name]).df()
    columns = sorted(ours.columns)
    assert sorted(theirs.columns) == columns
    order = lambda df: sorted(map(str, df[columns].itertuples(index=False, name=None)))
    left, right = ours[columns].astype(str), theirs[columns].astype(str)
    assert order(left) == order(right)
