"""The operators' queries that SQL can repeat, against DuckDB."""

import duckdb
import pytest

from factledger.llm import queries

from tests.test_catalogue import canonical


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for name_ in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {name_} as select * from '{sf_dir}/{name_}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    want = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(df.collect(), df.columns) == canonical(want.fetchall(), columns)
