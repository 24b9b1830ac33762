"""The queries that SQL can express, side by side with DuckDB."""

import duckdb
import pytest

from proselens.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = QUERIES[name](spark, sf_dir)
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = [tuple(r[names.index(c)] for c in got.columns) for r in want.fetchall()]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str) and rows
