"""Queries of this subpackage against their SQL in DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from tidewell.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equal_to_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    said = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in said.description]
    assert sorted(names) == columns
    assert sorted(map(str, df.select(*columns).toPandas().itertuples(index=False, name=None))) == sorted(str(tuple(r[names.index(c)] for c in columns)) for r in said.fetchall())
