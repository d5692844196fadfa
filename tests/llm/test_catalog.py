"""The numbered queries' SQL is SQL, and gives their rows."""

import duckdb
import pytest

import __spark_entry__
from corpusloom.llm import queries

DATA = "/root/testdata/sf0.001"


def test_oracles_are_sql():
    for name, sql in __spark_entry__.oracle_sql().items():
        assert isinstance(sql, str), name
        assert len(duckdb.extract_statements(sql)) == 1, name
    assert set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(name, spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    cursor = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    assert sorted(columns) == sorted(df.columns) and rows and sorted(map(str, rows)) == sorted(map(str, cursor.fetchall()))
