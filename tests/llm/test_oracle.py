import duckdb
import pytest
from seqloom.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.sql(queries.ORACLE_SQL[name]), queries.QUERIES[name](spark, SF)
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    places = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == sorted((tuple(r[i] for i in places) for r in want.fetchall()), key=str)
