"""Every query that SQL can express, side by side with DuckDB, and the others for their shape."""

import math
import os

import duckdb
import pytest

from proselens.plans.oracles import ORACLES
from proselens.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, list | tuple):
        return tuple(plain(y) for y in x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    return x


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    b = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall()), key=str)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) < 2e-5) for p, q in zip(x, y, strict=True)), (x, y)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql(spark, sf_dir, name):
    """Rows for every document or paper; what they hold is tested in test_operators and test_analysis."""
    assert QUERIES[name](spark, sf_dir).select("doc_id").distinct().count() == {"perturbation_score": 200}.get(name, 20)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).count() > 0


def test_imports_without_llm():
    """Nothing but the entry point needs the llm folders."""
    import subprocess
    import sys

    code = "import sys; import importlib.util as u; real = u.find_spec; u.find_spec = lambda n, *a: None if n in ('proselens.llm', 'corpus_pipeline') else real(n, *a); import __spark_entry__ as e; assert 'stylometry_documents' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(__file__))).returncode == 0
