"""Exact top-k inner-product search with a pivot-distance index.

Components become integers, floor(1024 x), so scores are exact. Every vector is keyed by its nearest pivot and its
distance from it; a cell holds a pivot's vectors sorted by that distance. For a query q and a vector x of a cell with
pivot p, |d(q, p) - d(x, p)| <= d(q, x) by the triangle inequality, and q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2, so
annuli of a cell are bounded from above by their distance from the query's own. First each query searches the cell of its
nearest pivot, annuli in order of their bounds, which gives it a k-th score to beat. Then it visits the cells of which
some annulus can reach that score, expanding annuli until the bound falls below it. Bounds are widened by more than the
rounding error and ties are searched, so the result is exact.

Pivots are picked from a random sample of at most SAMPLE vectors, and there are more of them the more vectors there are;
every vector is indexed. Vectors of each length have pivots of their own, the zero vector if none of the sample has that
length. A cell of more than CELL vectors is cut by hash into cells of the same pivot, the queries that visit a pivot are
cut into blocks of about QUERIES, and a vector is sent once for each block that visits its pivot, so that a task's input
is bounded however vectors cluster.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows without an id. A
query is compared with the vectors of its own length; empty vectors score 0. Ties go to the smaller vec_id. Repeated ids are
rows of their own: each query row is a query, and only its own row isn't its candidate. Scores are exact whatever the size
of components; one that doesn't fit 64 bits is an error only if it is among the results. A component over 2**500, which only
a vector of doubles can hold, is an error.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship
from .vectors import by_length, finite, whole

SCALE = 1024
#: Of n vectors, the number of pivots is the root of n over 8, but in these bounds.
PIVOTS = 32, 512
SAMPLE = 4096
CELL = 16_384
QUERIES = 4096
#: Doubles hold all sums of products below this exactly; above it, products are those of 64-bit integers, and above 2**62
#: of Python's.
EXACT = 2**53
#: Stands for scores that don't fit.
BEYOND = 2**63 - 1
#: Vectors between two looks at the bounds.
ANNULUS = 512


def _pivots(sample: np.ndarray, k: int) -> np.ndarray:
    """Farthest-first seeds, moved to their members' means twice."""
    if not len(sample):
        return np.zeros((1, 0))
    at = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(at) < min(k, len(sample)) and far.max() > 0:
        at.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[at[-1]]) ** 2).sum(1))
    p = sample[at].astype(float)
    for _ in range(2):
        near = _distances(sample, p).argmin(1)
        p = np.stack([sample[near == i].mean(0) if (near == i).any() else p[i] for i in range(len(p))])
    return p


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x.astype(float) ** 2).sum(1)[:, None] + (p**2).sum(1) - 2 * x.astype(float) @ p.T, 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of doubles, all of one length."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), len(rows[0]) // 8 if rows else 0)


def _top(ids: np.ndarray, rows: np.ndarray, scores: np.ndarray, k: int):
    order = np.lexsort((rows, ids, -scores))[:k]
    return ids[order], rows[order], scores[order]


def _products(x: np.ndarray, q: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products of the rows of x with q; largest is a bound of what they can be. What doesn't fit is BEYOND."""
    if largest < EXACT / 2:
        return np.rint(x @ q).astype(np.int64)
    if largest < 2.0**61:
        return x.astype(np.int64) @ q.astype(np.int64)
    got = whole(x).dot(whole(q)) if x.shape[1] else np.zeros(len(x), object)
    return np.array([min(max(int(v), -BEYOND), BEYOND) for v in got], np.int64)


class Cell:
    """A pivot's vectors by distance, in annuli of ANNULUS vectors."""

    def __init__(self, ids, rows, x, dist, pivot):
        order = np.argsort(dist, kind="stable")
        self.ids, self.rows, self.x, self.dist, self.pivot = ids[order], rows[order], x[order], dist[order], pivot
        self.begin = np.arange(0, len(ids), ANNULUS)
        self.lo = self.dist[self.begin]
        self.hi = self.dist[np.minimum(self.begin + ANNULUS, len(ids)) - 1]
        norm = (self.x**2).sum(1)
        self.norm = np.maximum.reduceat(norm, self.begin)
        self.component = float(np.abs(self.x).max(initial=0))

    def search(self, own: int, q: np.ndarray, k: int, least: int | None):
        """(ids, rows, scores): the best k of this cell, but row ``own``, that score least at the least."""
        ids, rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        # No partial sum is larger than the product of the lengths, and integers must themselves fit.
        largest = max(float(np.sqrt((q**2).sum()) * np.sqrt(self.norm.max())) * (1 + 1e-9), float(np.abs(q).max(initial=0)), self.component)
        d = float(np.sqrt(((q - self.pivot) ** 2).sum()))
        bound = upper_bound(float((q**2).sum()), d, self.lo, self.hi, self.norm)
        for a in np.argsort(-bound, kind="stable"):
            # Only what beats or ties with the score to beat matters.
            floor = scores[-1] if len(scores) == k else least
            if floor is not None and bound[a] + abs(float(floor)) * 1e-15 < floor:
                break
            s = slice(self.begin[a], self.begin[a] + ANNULUS)
            got = _products(self.x[s], q, largest)
            keep = self.rows[s] != own
            if floor is not None:
                keep &= got >= floor
            if keep.any():
                ids, rows, scores = _top(np.concatenate((ids, self.ids[s][keep])), np.concatenate((rows, self.rows[s][keep])), np.concatenate((scores, got[keep])), k)
        return ids, rows, scores


def upper_bound(q2: float, d, lo, hi, norm):
    """No vector with pivot distance in [lo, hi] and squared length up to norm scores more; d is the query's pivot distance.
    Rounding errors are relative to the squared lengths and far below 1e-9 of them."""
    gap = np.maximum(np.maximum(lo - d, d - hi) - 1e-3 - 1e-6 * (d + hi), 0)
    return (q2 + norm - gap**2) / 2 + 1 + 1e-9 * (q2 + norm)


def search(vectors: DataFrame, queries, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", pivots: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows of vectors for which the condition queries holds."""
    spark = vectors.sparkSession
    ship(spark)
    used = vectors.where(finite(embedding) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.coalesce(queries, F.lit(False)).alias("is_query"), F.col(embedding).alias("x"))
    n = used.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = [x for b in used.select("x").sample(min(1.0, 1.2 * SAMPLE / n), 1).limit(SAMPLE).toArrow().to_batches() for _, m in by_length(b.column(0), SCALE) for x in m]
    k_pivots = pivots or int(min(max(n**0.5 / 8, PIVOTS[0]), PIVOTS[1]))
    sizes = Counter(len(x) for x in sample)
    # A length with a share of the sample has that share of the pivots.
    centres = {dim: _pivots(np.array([x for x in sample if len(x) == dim]), max(1, k_pivots * m // len(sample))) for dim, m in sizes.items()}
    shared = spark.sparkContext.broadcast(centres)

    def pivots_of(dim: int) -> np.ndarray:
        return shared.value.get(dim, np.zeros((1, dim)))

    def index(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for rows, x in by_length(b.column(2), SCALE):
                if np.abs(x).max(initial=0) > 2.0**500:
                    raise ValueError("a component's square is no double")
                d = _distances(x, pivots_of(x.shape[1]))
                near = d.argmin(1)
                s = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [s.column(0), s.column(1), pa.array(row + np.arange(len(x))), pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(x)), near]), pa.array((x**2).sum(1)), pa.array([r.tobytes() for r in x], pa.binary())],
                    names=["vec_id", "is_query", "row", "dim", "pivot", "dist", "norm", "x"],
                )
                row += len(x)

    # Rows get their numbers as they are written.
    keyed = materialise(used.mapInArrow(index, "vec_id long, is_query boolean, row long, dim int, pivot int, dist double, norm double, x binary"), "vectors")
    # A row a pivot: how large its list is and the span of its annuli.
    table = {(r["dim"], r["pivot"]): r.asDict() for r in keyed.groupBy("dim", "pivot").agg(F.count("*").alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.max("norm").alias("norm"), F.count_if("is_query").alias("queries")).collect()}
    by_dim: dict[int, list] = {}
    for (dim, p), r in table.items():
        by_dim.setdefault(dim, []).append((p, r["lo"], r["hi"], r["norm"]))
    info = spark.sparkContext.broadcast(by_dim)
    asked = materialise(keyed.where("is_query").select("row", F.col("vec_id").alias("query_id"), "x", "dim", "pivot"), "queries")
    found = "query long, vec_id long, row long, score long"

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [], [])
        if left.num_rows and right.num_rows:
            centre = pivots_of(left.column("dim")[0].as_py())[left.column("pivot")[0].as_py()]
            c = Cell(left.column("vec_id").to_numpy(), left.column("row").to_numpy(), _matrix(left.column("x")), left.column("dist").to_numpy(), centre)
            for q, x, s in zip(right.column("row").to_pylist(), _matrix(right.column("x")), right.column("least").to_pylist(), strict=True):
                ids, rows, scores = c.search(q, x, k, s)
                for col, y in zip(out, ([q] * len(ids), ids, rows, scores), strict=True):
                    col.extend(y)
        return pa.table({n: pa.array(np.array(c, np.int64)) for n, c in zip(("query", "vec_id", "row", "score"), out, strict=True)})

    def visit(visits: DataFrame) -> DataFrame:
        """Results of (row, least, dim, pivot), a row for each pivot that a query visits."""
        at = ["dim", "pivot"]
        # How many queries visit each pivot: a row a pivot, from which come the blocks that its vectors are sent to.
        plan = {(r["dim"], r["pivot"]): max(1, -(-r["n"] // QUERIES)) for r in visits.groupBy(*at).agg(F.count("*").alias("n")).collect()}
        if not plan:
            return spark.createDataFrame([], found)
        sent = F.broadcast(spark.createDataFrame([(*key, -(-table[key]["n"] // CELL), b) for key, b in plan.items()], "dim int, pivot int, of int, blocks int"))
        cells = keyed.join(sent, at).select(*at, F.pmod(F.xxhash64("row"), "of").cast("int").alias("cut"), "vec_id", "row", "dist", "x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        mine = visits.join(asked.select("row", "x"), "row").join(sent, at).withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), "blocks").cast("int"))
        mine = mine.select("row", "x", "least", *at, "block", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("cut"))
        key = [*at, "cut", "block"]
        return cells.groupBy(*key).cogroup(mine.groupBy(*key)).applyInArrow(meet, found)

    home = visit(asked.select("row", F.lit(None).cast("long").alias("least"), "dim", "pivot"))
    best = materialise(_rank(home, k).drop("rank"), "home")
    least = best.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("least")).select(F.col("query").alias("row"), "least")

    def reach(batches):
        """The other pivots whose annuli may hold something for the query."""
        for b in batches:
            at, to = [], []
            of = b.column(2).to_numpy()
            for dim in np.unique(of).tolist():
                rows = np.flatnonzero(of == dim)
                s = b.take(pa.array(rows))
                x, cells = _matrix(s.column(1)), info.value[dim]
                d, q2, own, floor = _distances(x, pivots_of(dim)), (x**2).sum(1), s.column(3).to_numpy(), np.where(np.asarray(s.column(4).is_null()), -np.inf, np.asarray(s.column(4).fill_null(0)).astype(float))
                for p, lo, hi, norm in cells:
                    # One more, as a score of over 53 bits isn't exact as a double.
                    hit = np.flatnonzero((own != p) & (upper_bound(q2, d[:, p], lo, hi, norm) + np.abs(np.where(np.isfinite(floor), floor, 0)) * 1e-15 >= floor))
                    at.append(rows[hit])
                    to.append(np.full(len(hit), p, np.int32))
            if at:
                i = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays([b.column(0).take(i), b.column(4).take(i), b.column(2).take(i), pa.array(np.concatenate(to))], names=["row", "least", "dim", "pivot"])

    # Visits are ids: a query's vector is joined as it goes to a cell.
    wider = asked.join(least, "row", "left").select("row", "x", "dim", "pivot", "least").mapInArrow(reach, "row long, least long, dim int, pivot int")
    away = visit(materialise(wider, "visits"))
    score = F.when(F.abs("score") == BEYOND, F.raise_error(F.lit("a score doesn't fit 64 bits")).cast("long")).otherwise(F.col("score"))
    out = _rank(best.unionByName(away), k).join(asked.select(F.col("row").alias("query"), "query_id"), "query")
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score"))


def _rank(df: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
