"""Clusters around centroids, assigned by annulus search.

Centroids are sorted by their norms. For a vector x, the distance from the centroid whose norm is nearest to its own is an
upper bound u; by the triangle inequality | |x| - |c| | <= d(x, c), so no centroid outside of the annulus of norms
[|x| - u, |x| + u] is nearer or as near. Binary search gives the annulus; its centroids are compared exactly, those that
tie included, and the bound shrinks while they are. Rounding only widens the annulus.

A round is one scan: workers add up their vectors by cluster, Spark sums the parts, and the driver gets a number for each
cluster, component and 40 bits of a sum, however many vectors there are. Sums are exact at any size.

Defined results: vectors that are null, of another length than ``dim`` or hold null or non-finite components take no
part. Rows without an id never start a centroid, but are assigned. Repeated ids are vectors of their own; of those that
start, the smaller components come first. With fewer vectors than ``k`` there are fewer centroids; without any the
result is empty. Ties go to the smaller number; empty centroids stay. A distance or a sum of them that doesn't fit 64
bits is an error.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, schema_with, ship
from .vectors import by_length, exact_bits, finite, whole

LIMB = 40


class Centroids:
    """Centroids (Python integers) in the order of their norms."""

    def __init__(self, centres: list[list[int]]):
        self.exact = np.array(centres, object).reshape(len(centres), -1)
        self.norm = np.array([float(math.isqrt(sum(v * v for v in c))) for c in centres])
        self.order = np.argsort(self.norm, kind="stable")
        self.sorted = self.norm[self.order]
        self.x = self.exact.astype(float)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of the rows of x; distances are doubles where they are exact."""
        if exact_bits(x, self.x):
            x2, c2 = (x * x).sum(1), (self.x * self.x).sum(1)
            norm = np.sqrt(x2)

            def distance(rows, c):
                return x2[rows] + c2[c] - 2 * (x[rows] * self.x[c]).sum(-1)
        else:
            x = whole(x)
            norm = np.array([float(math.isqrt(sum(v * v for v in r))) for r in x])

            def distance(rows, c):
                return ((x[rows] - self.exact[c]) ** 2).sum(-1)

        every = np.arange(len(x))
        right = np.minimum(np.searchsorted(self.sorted, norm), len(self.order) - 1)
        left = np.maximum(right - 1, 0)
        at = np.where(np.abs(self.sorted[left] - norm) <= np.abs(self.sorted[right] - norm), left, right)
        best = self.order[at]
        least = distance(every, best)

        def reach(rows):
            u = np.sqrt(least[rows].astype(float))
            # One more on each side, as norms of large integers are rounded down.
            return u + 2 + 1e-9 * (u + norm[rows])

        u = reach(every)
        lo, hi = np.searchsorted(self.sorted, norm - u, "left"), np.searchsorted(self.sorted, norm + u, "right")
        for k, c in enumerate(self.order.tolist()):
            rows = np.flatnonzero((lo <= k) & (k < hi) & (at != k))
            rows = rows[np.abs(norm[rows] - self.sorted[k]) <= reach(rows)]
            if not len(rows):
                continue
            d = distance(rows, np.full(len(rows), c))
            nearer = (d < least[rows]) | ((d == least[rows]) & (c < best[rows]))
            least[rows[nearer]], best[rows[nearer]] = d[nearer], c
        return best, least


def _limbs(total: int):
    """(limb, value) with value * 2**(LIMB * limb) adding up to the total."""
    sign, total, k = (-1 if total < 0 else 1), abs(total), 0
    while total:
        yield k, sign * (total & ((1 << LIMB) - 1))
        total >>= LIMB
        k += 1


def _sums(kept: DataFrame, embedding: str, scale: int, centres: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """cluster -> (vectors, sums of their components)."""
    dim = len(centres[0])

    def run(batches):
        search = Centroids(centres)
        n, total = [0] * len(centres), [[0] * dim for _ in centres]
        for b in batches:
            for _, x in by_length(b.column(0), scale):
                best, _ = search.nearest(x)
                small = float(np.abs(x).max(initial=0)) * len(x) < 2.0**53
                for c in np.unique(best).tolist():
                    s = (x[best == c] if small else whole(x[best == c])).sum(0)
                    n[c] += int((best == c).sum())
                    total[c] = [a + int(v) for a, v in zip(total[c], s.tolist(), strict=True)]
        rows = [(c, -1, 0, n[c]) for c in range(len(centres)) if n[c]]
        rows += [(c, j, limb, v) for c in range(len(centres)) for j in range(dim) for limb, v in _limbs(total[c][j])]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["cluster", "j", "limb", "s"])

    got = kept.select(embedding).mapInArrow(run, "cluster int, j int, limb int, s long").groupBy("cluster", "j", "limb").agg(F.sum("s").alias("s")).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in got:
        n, total = out.get(r["cluster"], (0, [0] * dim))
        if r["j"] < 0:
            n += r["s"]
        else:
            total[r["j"]] += r["s"] << (LIMB * r["limb"])
        out[r["cluster"]] = (n, total)
    return out


def first(kept: DataFrame, vec_id: str, embedding: str, scale: int, k: int, seed: str) -> list[list[int]]:
    """The k vectors with the smallest sha256 of seed:vec_id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(vec_id).cast("long").cast("string")), 256)
    got = kept.where(F.col(vec_id).isNotNull()).select(key.alias("key"), F.col(embedding).cast("array<double>").alias("x")).orderBy("key", "x").limit(k).toArrow()
    return [[int(v) for v in x[0].tolist()] for b in got.to_batches() for i in range(b.num_rows) for _, x in by_length(b.column(1).slice(i, 1), scale)]


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dim: int = 64, seed: str = "1", vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """The vectors that take part, with cluster int and distance long (squared) after their columns, and the final centroids."""
    ship(vectors.sparkSession)
    kept = vectors.drop("cluster", "distance").where(finite(embedding) & (F.size(embedding) == dim))
    centres = first(kept, vec_id, embedding, scale, k, seed)
    at, schema = kept.columns.index(embedding), schema_with(kept, ("cluster", "integer"), ("distance", "long"))
    if not centres:
        return kept.sparkSession.createDataFrame([], schema), []
    for _ in range(rounds):
        for c, (n, total) in _sums(kept, embedding, scale, centres).items():
            centres[c] = [v // n for v in total]  # Python's division floors

    def run(batches):
        search = Centroids(centres)
        for b in batches:
            best, least = np.zeros(b.num_rows, np.int32), [0] * b.num_rows
            for rows, x in by_length(b.column(at), scale):
                c, d = search.nearest(x)
                best[rows] = c
                for i, v in zip(rows.tolist(), d.tolist(), strict=True):
                    least[i] = int(v)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best), pa.array(least, pa.int64())], names=schema.names)

    return kept.mapInArrow(run, schema), centres


def describe(assigned: DataFrame, centres: list[list[int]], *columns: str | Column) -> DataFrame:
    """columns, cluster and distance of assigned vectors with the inertia of their cluster and of all, and the hash of the
    cluster's centroid."""
    spark = assigned.sparkSession
    done = materialise(assigned.select(*columns, "cluster", "distance"), "clusters")
    # A row a centroid.
    inertia = {r["cluster"]: r["s"] for r in done.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = sum(inertia.values())
    rows = [(c, inertia[c], total, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centres) if c in inertia]
    info = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(info), "cluster").select(*[c for c in done.columns if c not in ("cluster", "distance")], "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
