"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from lectern.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "conversations", "pages"):
        path = f"{DATA}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def ordered(rows):
    return sorted((tuple(round(x, 7) if isinstance(x, float) else x for x in row) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    found = registry.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    wanted = db.sql(registry.ORACLE_SQL[name])
    assert sorted(wanted.columns) == columns
    assert ordered(found.select(columns).collect()) == ordered(wanted.select(*map(duckdb.ColumnExpression, columns)).fetchall())
