"""Exact neighbours: the cells against all pairs, and what isn't sent."""

import numpy as np
import pytest

from proselens.operators import semantic


def brute(rows, k, skip_self):
    out = []
    ok = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    for q, v in rows:
        if ok(v):
            scored = []
            for i, w in rows:
                if ok(w) and len(w) == len(v) and not (skip_self and i == q):
                    s = 0.0
                    for a, b in zip(v, w):
                        s += a * b
                    scored.append((-s, i))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def vectors(n=400, dim=6, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(8, dim))
    x = centres[r.integers(0, 8, n)] + 0.1 * r.normal(size=(n, dim))
    x[: n // 10] = np.rint(x[: n // 10])  # ties
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    return rows + [(9001, None), (9002, [float("nan")] * dim), (9003, [None] * dim), (9004, [1.0, 0.0]), (9005, [1.0, 0.0, 0.0]), (9006, []), (9007, [0.0] * dim), (9008, [1e6] * dim), (9009, [2.0, 1.0])]


@pytest.mark.parametrize("skip_self", [True, False])
def test_cells_find_what_all_pairs_find(spark, monkeypatch, skip_self):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    want = brute(rows, 4, skip_self)
    asked = df.withColumnRenamed("vec_id", "query_id")
    assert sorted(map(tuple, semantic.knn(asked, df, 4, skip_self=skip_self).collect())) == want
    for name, value in (("QUERY_BYTES", 0), ("QUERY_BLOCK", 50), ("CORPUS_BLOCK", 30), ("STEP", (7, 11))):
        monkeypatch.setattr(semantic, name, value)
    assert sorted(map(tuple, semantic.knn(asked, df, 4, skip_self=skip_self).collect())) == want
    assert semantic.knn(asked, df.limit(0), 4).count() == 0 and semantic.knn(asked.limit(0), df, 4).count() == 0


def test_cells_that_cannot_reach_the_score_are_not_sent(spark, monkeypatch):
    """Queries around one of many clusters leave most of the corpus where it is."""
    r = np.random.default_rng(5)
    centres = np.eye(16) * 10
    x = np.repeat(centres, 200, 0) + 0.05 * r.normal(size=(3200, 16))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    monkeypatch.setattr(semantic, "QUERY_BYTES", 0)
    stats = {}
    got = semantic.knn(df.where("vec_id < 400").withColumnRenamed("vec_id", "query_id"), df, 5, stats=stats).collect()
    sims = x[:400] @ x.T
    assert {(g["query_id"], g["vec_id"]) for g in got} == {(q, int(i)) for q in range(400) for i in np.argsort(-sims[q])[:5]}
    assert stats["corpus_rows"] == 3200 and 0 < stats["rows_sent"] < 0.5 * 3200


def test_fused_products_are_those_of_sql(spark):
    """Each product and sum with one rounding, as DuckDB's list_inner_product; letter counts of which one sum is 0.9796875, just
    at the edge of six places."""
    import math

    import duckdb

    r = np.random.default_rng(7)
    x, y = r.normal(size=(500, 26)) * 10.0 ** r.integers(-8, 8, (500, 26)), r.normal(size=(500, 26))
    x[:100], y[:100] = np.rint(x[:100]) / np.sqrt(7), np.rint(y[:100] * 9) / np.sqrt(11)
    want = []
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        s = 0.0
        for p, q in zip(a, b, strict=True):
            s = math.fma(p, q, s)
        want.append(s)
    assert semantic._products(x, y, True).tolist() == want
    con = duckdb.connect()
    assert [con.execute("SELECT list_inner_product(?::DOUBLE[], ?::DOUBLE[])", [a, b]).fetchone()[0] for a, b in zip(x.tolist(), y.tolist(), strict=True)] == want
    df = lambda v, name: spark.createDataFrame([(k, w) for k, w in enumerate(v.tolist())], f"{name} long, embedding array<double>")
    got = semantic.knn(df(x, "query_id"), df(y, "vec_id"), 500, fused=True).where("query_id = vec_id").orderBy("query_id").collect()
    assert [g["sim"] for g in got] == want


def test_small_corpora_meet_the_queries_where_they_are(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    asked = df.withColumnRenamed("vec_id", "query_id")
    got = {g["query_id"]: tuple(g)[1:] for g in semantic.broadcast_features(asked, ("query_id",), df).collect()}
    want = {g["query_id"]: tuple(g)[1:] for g in semantic.window_features(semantic.knn(asked, df)).collect() if g["query_id"] != 9006}
    assert {q: v for q, v in got.items() if v[0] is not None} == want and len(got) == len(rows)
    monkeypatch.setattr(semantic, "QUERY_BYTES", 100)
    assert semantic.broadcast_features(asked, ("query_id",), df) is None


def test_queries_travel_in_packs(spark, monkeypatch):
    """Where cells rule out little, a query isn't written and sent once for each cell, but with its like."""
    x = np.random.default_rng(11).normal(size=(3000, 24)).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(2)
    kept, keep = {}, semantic.keep

    def counted(df, name):
        out = keep(df, name)
        kept[name] = kept.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(semantic, "keep", counted)
    monkeypatch.setattr(semantic, "QUERY_BYTES", 0)
    got = semantic.knn(df.withColumnRenamed("vec_id", "query_id"), df, 3, skip_self=True).collect()
    sims = x.astype(float) @ x.T.astype(float)
    np.fill_diagonal(sims, -np.inf)
    assert {(g["query_id"], g["rank"], g["vec_id"]) for g in got} == {(q, r + 1, int(i)) for q in range(len(x)) for r, i in enumerate(np.argsort(-sims[q])[:3])}
    assert sum(n for name, n in kept.items() if name != "least") < len(x)


@pytest.mark.parametrize("fused", [True, False])
def test_products_of_floats_lose_nothing(fused):
    """Near ties, sizes beyond what floats can multiply, and rows that have the query's own id."""
    r = np.random.default_rng(13)
    x = np.repeat(r.normal(size=(40, 8)), 10, 0) + 1e-7 * r.normal(size=(400, 8))
    x[:100] *= 10.0 ** r.integers(-30, 30, (100, 1))
    x = x.astype(np.float32)
    q, ids, own = x[::3], np.arange(400)[::3], np.arange(400)
    own[1:8] = 0
    wide = x.astype(float)
    got = None
    for j in range(0, 400, 90):
        got = semantic._better(ids, q, own[j : j + 90], x[j : j + 90], 3, True, got, fused)
    for at, i in enumerate(ids):
        s = semantic._products(np.repeat(wide[i : i + 1], 400, 0), wide, fused)
        best = sorted((-s[j], own[j]) for j in range(400) if own[j] != i)[:3]
        assert [(-v, n) for v, n in zip(got[1][at], got[0][at])] == best
