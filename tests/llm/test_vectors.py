"""Operators on vectors against plain versions in Python's integers, with odd rows."""

import hashlib
import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from proselens.llm import centroids, hard_negatives, topk

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, distance double"


def fine(x):
    return x is not None and all(v is not None and math.isfinite(v) for v in x)


def integers(x, scale):
    return [math.floor(v * scale) if abs(v) < 2**53 else int(v) * scale for v in x]


def odd_rows(dim, n=150, seed=3):
    """(vec_id, vector, label): clustered vectors, copies, ties, repeated and null ids, lengths, nulls, non-finite and huge components."""
    r = random.Random(seed)
    centre = [[r.gauss(0, 0.2) for _ in range(dim)] for _ in range(5)]
    rows = [(k, [v + r.gauss(0, 0.05) for v in centre[k % 5]], k % 4) for k in range(n)]
    rows += [(k + 1000, list(rows[k][1]), k % 4) for k in range(0, 60, 3)]
    rows += [(2000, [0.0] * dim, 1), (2100, [0.0] * dim, 2), (None, [0.1] * dim, 1), (2200, None, 1), (2300, [], 0), (2400, [0.5] * (dim - 1), 2), (2500, [0.4] * (dim - 1), 2), (2600, [0.4] * (dim - 1), 1)]
    rows += [(2700, [float("nan")] + [0.0] * (dim - 1), 1), (2800, [float("-inf")] + [0.0] * (dim - 1), 1), (2900, [None] + [0.0] * (dim - 1), 1), (3000, [0.2] * dim, None)]
    rows += [(100, [0.3] * dim, 1), (100, [-0.3] * dim, 2)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1.0) for r in rows], SCHEMA).repartition(5)


def plain_clusters(rows, k, rounds, dim):
    kept = [(i, integers(x, 64)) for i, x, _ in rows if fine(x) and len(x) == dim]
    key = [(hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None]
    c = [x for _, x in sorted(key)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in enumerate(c)) for _, x in kept]

    for _ in range(rounds):
        got = assign()
        for j in range(len(c)):
            mine = [x for (_, x), (_, g) in zip(kept, got) if g == j]
            if mine:
                c[j] = [sum(v) // len(mine) for v in zip(*mine)]
    return sorted(((i, g, d) for (i, _), (d, g) in zip(kept, assign())), key=str), c


@pytest.mark.parametrize("huge", [[], [(4000, [3.0e6] * 8, 0), (4001, [-1.0e6, 2.0] * 4, 1)]])
def test_clusters(spark, huge):
    rows = odd_rows(8) + huge
    for k, rounds in ((6, 3), (1, 1), (200, 2)):
        got, centres = centroids.cluster(frame(spark, rows), k=k, rounds=rounds, dim=8)
        want, c = plain_clusters(rows, k, rounds, 8)
        assert centres == c
        assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got.collect()), key=str) == want
    out = centroids.describe(*centroids.cluster(frame(spark, rows), k=6, dim=8), "vec_id").collect()
    assert all(r["inertia"] == sum(x["distance"] for x in out) and r["cluster_inertia"] == sum(x["distance"] for x in out if x["cluster"] == r["cluster"]) for r in out)
    empty = frame(spark, rows).limit(0)
    assert centroids.describe(*centroids.cluster(empty, dim=8), "vec_id").count() == 0


def test_annulus_rules_out(monkeypatch):
    """Centroids outside of a vector's annulus are never compared, and the result is that of all comparisons."""
    r = np.random.default_rng(0)
    c = [[int(v) for v in r.integers(-3, 4, 4) * (10 ** (j % 4))] for j in range(40)]
    x = (r.integers(-3, 4, (500, 4)) * 10 ** r.integers(0, 4, (500, 1))).astype(float)
    s = centroids.Centroids(c)
    best, least = s.nearest(x)
    d = ((x[:, None, :] - np.array(c, float)) ** 2).sum(2)
    assert (best == d.argmin(1)).all() and (least == d.min(1)).all()
    with pytest.raises(ValueError):
        list(centroids.by_length(__import__("pyarrow").array([[1e308]]), 64))


def plain_negatives(rows, n_pos, n_neg, every):
    kept = [(i, integers(x, 256), lab) for i, x, lab in rows if fine(x) and i is not None and lab is not None]
    out = []
    for a, (i, x, lab) in enumerate(kept):
        if i % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), j, b) for b, (j, y, _) in enumerate(kept) if b != a and len(x) == len(y))
        for s, j, _ in [t for t in scored if kept[t[2]][2] == lab][:n_pos]:
            hits = [t for t in scored if kept[t[2]][2] != lab and 30 * -s <= 100 * -t[0] <= 90 * -s][:n_neg]
            out += [(i, j, k + 1, t[1], -s, -t[0]) for k, t in enumerate(hits)]
    return sorted(out)


@pytest.mark.parametrize("size", [4 << 20, 2000])
def test_hard_negatives(spark, size, monkeypatch):
    """Chunks and blocks of all rows and of a few, with components that need more than 53 bits in one chunk."""
    monkeypatch.setattr(hard_negatives, "CHUNK", size)
    monkeypatch.setattr(hard_negatives, "BLOCK", size)
    rows = odd_rows(8) + [(5000, [3.0e6, 1.0] * 4, 1), (5001, [2.5e6, 1.0] * 4, 1), (5002, [2.0e6, -1.0] * 4, 2)]
    got = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 50 == 0, positives=3, negatives=4)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, 3, 4, 50)
    assert hard_negatives.mine(frame(spark, rows).limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert hard_negatives.mine(frame(spark, rows), F.lit(None).cast("boolean")).count() == 0


def test_scores_beyond_64_bits_are_errors(spark):
    rows = [(0, [3.0e12, 0.0], 1), (1, [3.0e12, 1.0], 1), (2, [1.0, 1.0], 2)]
    with pytest.raises(Exception, match="fit 64 bits"):
        hard_negatives.mine(frame(spark, rows), F.col("vec_id") == 0).collect()
    # Too large a score that isn't among the results is none.
    rows = [(0, [3.0e12, 0.0], 1), (1, [0.0, 1.0], 1), (2, [-3.0e12, 1.0], 2), (3, [0.0, 2.0], 2), (4, [3.0e12, 0.0], 3)]
    assert [tuple(r) for r in hard_negatives.mine(frame(spark, rows), F.col("vec_id") == 0).collect()] == [(0, 1, 1, 3, 0, 0)]


def test_bit_slices_drop_candidates():
    """The pairs that are left hold an anchor's best, and are few."""
    r = np.random.default_rng(1)
    a, x = r.integers(-120, 120, (20, 64)).astype(float), r.integers(-120, 120, (3000, 64)).astype(float)
    exact = a @ x.T
    low, high = np.full((2, 20), -1e18), np.stack([np.full(20, 1e18), np.quantile(exact, 0.6, 1)])
    slot, anchor, row, score = hard_negatives.sliced(a, x, low, high, np.full((2, 20), -np.inf), 10, np.ones((2, 20, 3000), bool))
    assert (score == exact[anchor, row]).all() and len(score) < 0.02 * 2 * exact.size
    for s in range(2):
        for i in range(20):
            mine = np.sort(score[(slot == s) & (anchor == i)])[::-1][:10]
            assert (mine == np.sort(exact[i][exact[i] <= high[s, i]])[::-1][:10]).all()


def plain_top(rows, k, is_query):
    kept = [(i, integers(x, 1024)) for i, x, _ in rows if fine(x) and i is not None]
    out = []
    for a, (i, x) in enumerate(kept):
        if is_query(i):
            scored = sorted((-sum(p * q for p, q in zip(x, y)), j) for b, (j, y) in enumerate(kept) if b != a and len(x) == len(y))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


def test_top_k_of_every_row(spark):
    """Every query row answers for itself and is found by others of its id; large components, empty vectors and odd rows."""
    rows = odd_rows(8) + [(6000, [3.0e6, 0.0] + [0.0] * 6, 1), (6001, [1.0, 1.0] + [0.0] * 6, 1), (6050, [], 1), (6051, [], 1), (6052, [1.0e30] + [0.0] * 7, 1), (6100, [0.0, 1.0] * 4, 2)]
    # Scores with the largest one don't fit if its first component meets another.
    rows = [(i, x if x is None or i in (6000, 6001, 6052) or len(x) != 8 or i is None else [0.0, *x[1:]], lab) for i, x, lab in rows]
    rows = [r for r in rows if r[0] not in (6000, 6001)]
    for pivots in (None, 3):
        got = topk.search(frame(spark, rows), F.col("vec_id") % 50 == 0, k=4, pivots=pivots)
        assert sorted(map(tuple, got.collect())) == plain_top(rows, 4, lambda i: i % 50 == 0)
    few = [(0, [1.0, 0.0], 1), (0, [0.0, 1.0], 1), (7, [3.0e6, 0.0], 1), (8, [2.0, 5.0], 1)]
    got = topk.search(frame(spark, few), F.col("vec_id") == 0, k=10)
    assert sorted(map(tuple, got.collect())) == plain_top(few, 10, lambda i: i == 0)
    with pytest.raises(Exception, match="fit 64 bits"):
        topk.search(frame(spark, [(0, [3.0e9, 0.0], 1), (1, [3.0e9, 1.0], 1)]), F.col("vec_id") == 0).collect()
