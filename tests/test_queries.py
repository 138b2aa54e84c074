"""Every registered query against its SQL in DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from tidewell.plans import registry

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.001/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and value != value:
        return "null"
    if isinstance(value, float):
        return f"{value:.6g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equal_to_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, f"{DATA}/sf0.001")
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    said = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in said.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in said.fetchall())


def test_every_query_has_sql():
    assert set(registry.ORACLE_SQL) == set(registry.QUERIES)


def test_entry_module():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
