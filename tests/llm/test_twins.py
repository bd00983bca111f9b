"""Queries with a SQL twin give the twin's rows on the smallest tables; the others give a row for each input row."""

import duckdb
import pytest

from duelframe.llm import queries

from ..conftest import SF

TABLES = ["documents", "embeddings", "conversations"]


@pytest.fixture(scope="module")
def twin():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def rows_of(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(str(tuple(r[i] for i in at)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_twin(spark, twin, name):
    df = queries.QUERIES[name](spark, SF)
    found = twin.execute(queries.SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, found.fetchall())


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{n}" for n in range(1, 14)} | {"pipeline"}
