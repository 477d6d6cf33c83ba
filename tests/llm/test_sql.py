"""The subpackage's queries against their SQL in DuckDB."""

import duckdb
import pytest

from civicflow.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    got = registry.queries()[name](spark, SF)
    db = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.sql(registry.oracle_sql()[name])
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    rows = want.fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=key) == sorted((tuple(r[want.columns.index(c)] for c in cols) for r in rows), key=key)
