"""Exact nearest neighbours by inner product, and the paraphrase features made from them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .. import constants as C
from ..functions import numbers as N
from ..functions import text as T
from ..session import keep, ship
from ..workers import held
from .language_model import attempt

#: Bytes of queries that are broadcast at most; more meet the corpus cell by cell in a shuffle.
QUERY_BYTES = 2 << 20
#: Queries and vectors of the corpus that meet in a task at most, bytes of either, fewest rows that are set apart for more
#: tasks, and the steps in which they are compared.
QUERY_BLOCK, CORPUS_BLOCK = 65_536, 65_536
BLOCK_BYTES, FEW = 32 << 20, 4096
STEP = 512, 4096
#: Vectors of one cell that travel as one row.
PACK = 1024
#: Pairs whose inner products are worked out to the last place at a time.
PAIRS = 1 << 16
#: Cells are around pivots, which come from a sample of the corpus.
PIVOTS, SAMPLE = 256, 4096


def prefixed(text: Column, kind: str) -> Column:
    """A text as embedders that tell queries from passages want it; kind is "query" or "passage"."""
    return F.concat(F.lit(f"{kind}: "), text)


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """The default embedder: counts of hashed words, to unit length. A stand-in for a trained one. A batch's words are counted
    at once; counts and the sums of their squares are whole numbers, so the vectors are N.unit's to the last bit."""
    ship()

    @F.arrow_udf("array<double>")
    def run(tokens: pa.Array) -> pa.Array:
        n = np.asarray(tokens.value_lengths().fill_null(0), np.int64)
        v = np.bincount(np.repeat(np.arange(len(n)), n) * dim + np.asarray(tokens.flatten(), np.int64), minlength=len(n) * dim).reshape(len(n), dim).astype(float)
        size = np.sqrt((v * v).sum(1))[:, None]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * dim), pa.array((v / np.where(size == 0, 1.0, size)).ravel()), mask=tokens.is_null() if tokens.null_count else None)

    return run(F.transform(T.words(F.lower(text)), lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int")))


#: Makes (key, embedding[, alert]) of (table, key, text column).
Embedder = Callable[[DataFrame, tuple[str, ...], str], DataFrame]


def hashed_embedder(dim: int = 64) -> Embedder:
    """The embedder of hashed_embedding."""
    return lambda df, key, text: df.select(*key, hashed_embedding(F.coalesce(F.col(text), F.lit("")), dim).alias("embedding"))


def python_embedder(load: Callable[[], Callable[[list[str]], list]], kind: str | None = "query", batch: int = 32) -> Embedder:
    """An embedder from a model in Python. load makes, once a worker process (see workers.held), a function of texts that
    gives of each its vector, or (token vectors, mask), of which the mean of the unmasked is taken; vectors get unit length.
    Texts are prefixed by kind, unless it is None. If the model fails on a batch, its texts are tried one by one; those on
    which it fails have no embedding and an alert."""
    name = f"embedder-{uuid.uuid4().hex}"

    def embed(df: DataFrame, key: tuple[str, ...], text: str) -> DataFrame:
        ship(df.sparkSession)
        shown = F.coalesce(F.col(text), F.lit(""))
        own = df.select(*key, (prefixed(shown, kind) if kind else shown).alias("t_"))
        schema = StructType([*own.drop("t_").schema.fields, StructField("embedding", ArrayType(DoubleType())), StructField("alert", StringType())])

        def run(batches):
            def of(texts):
                got = [_pooled(r) for r in held(name, load)(texts)]
                if len(got) != len(texts):
                    raise ValueError("not one vector a text")
                return got

            for b in batches:
                for s in range(0, b.num_rows, batch):
                    x = b.slice(s, batch)
                    got, why = attempt(of, x.column(len(key)).to_pylist())
                    vectors = [r if w is None else None for r, w in zip(got, why, strict=True)]
                    alerts = [None if w is None else f"semantic failed, zeros: {w}" for w in why]
                    yield pa.RecordBatch.from_arrays([*x.columns[: len(key)], pa.array(vectors, pa.list_(pa.float64())), pa.array(alerts, pa.string())], names=[f.name for f in schema])

        return own.mapInArrow(run, schema)

    return embed


def _pooled(r) -> list[float]:
    """A text's vector, or the mean of its token vectors that aren't masked, to unit length."""
    if isinstance(r, tuple):
        vectors, mask = np.asarray(r[0], float), np.asarray(r[1]).astype(bool)
        if not mask.any():
            raise ValueError("no token to pool")
        v = vectors[mask].mean(0)
    else:
        v = np.asarray(r, float)
    if v.ndim != 1 or not np.isfinite(v).all():
        raise ValueError("not a vector of numbers")
    n = float(np.sqrt(v @ v))
    return (v / n if n else v).tolist()


def token_vector_embedder(vectors: str, mask: str) -> Embedder:
    """An embedder of tables that hold their texts' token vectors and masks in columns: their mean, to unit length."""
    return lambda df, key, text: df.select(*key, N.unit(N.mean_pool(F.col(vectors), F.col(mask))).alias("embedding"))


def content_key(text: Column) -> Column:
    """By what precomputed vectors are found: the hash of the text."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def precomputed(vectors: DataFrame, text_key: str = "text_key", embedding: str = "embedding") -> Embedder:
    """An embedder that looks texts up in a table (content_key of the text, embedding); texts that it lacks have an alert."""

    def embed(df: DataFrame, key: tuple[str, ...], text: str) -> DataFrame:
        known = vectors.select(F.col(text_key).alias("h_"), F.col(embedding).alias("embedding"))
        x = df.select(*key, content_key(F.col(text)).alias("h_")).join(known, "h_", "left")
        return x.select(*key, "embedding", F.when(F.col("embedding").isNull(), F.lit("semantic failed, zeros: no vector of this text")).alias("alert"))

    return embed


def once_each(embedder: Embedder) -> Embedder:
    """An embedder that embeds each different text once, however many rows have it."""

    def embed(df: DataFrame, key: tuple[str, ...], text: str) -> DataFrame:
        rows = df.select(*key, content_key(F.col(text)).alias("h_"), F.coalesce(F.col(text), F.lit("")).alias("t_"))
        each = embedder(rows.groupBy("h_").agg(F.first("t_").alias("t_")), ("h_",), "t_")
        return rows.drop("t_").join(each, "h_", "left").drop("h_")

    return embed


def knn(queries: DataFrame, corpus: DataFrame, k: int = 5, query_id: str = "query_id", vec_id: str = "vec_id", embedding: str = "embedding", skip_self: bool = False, stats: dict | None = None, fused: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, sim): the k largest inner products of each query, ties to the smaller vec_id.

    Few queries (QUERY_BYTES) are broadcast, and each partition of the corpus is searched as it is scanned. More meet the
    corpus in cells: each vector belongs to its nearest pivot p, and q.x = q.p + q.(x - p) <= q.p + |q| |x - p|, so a cell's
    radius bounds what it can give to a query. Each query first visits the cell of its best pivot, and then, with the
    k-th score found there, only those that can reach it. Tiles of queries meet tiles of cells; cells that no query of a
    tile can use aren't sent to it. Tiles have a size, whatever clusters. A matrix product of a tile, of floats where
    vectors are floats, finds what may be near enough, and those products are worked out to the last place. stats gets the
    rows of the corpus and those sent.

    Vectors are compared with those of their own length alone. Null vectors, those with components that are null or not
    finite and rows without an id take no part. Few vectors or none give fewer than k rows. Products are summed in the order of the components, as
    SQL does it; fused, each is multiplied and added with one rounding, as DuckDB does it (of floats it is the same)."""
    spark = corpus.sparkSession
    ship(spark)
    fine = lambda df, i, name: df.select(F.col(i).cast("long").alias(name), F.transform(embedding, lambda x: x.cast("double")).alias("v")).where(_usable("v") & F.col(name).isNotNull())
    asked, have = fine(queries, query_id, "q"), fine(corpus, vec_id, "vec_id")
    if asked.agg(F.coalesce(F.sum(8 * F.size("v") + 16), F.lit(0))).first()[0] <= QUERY_BYTES:
        out = _scan(asked, have, k, skip_self, fused)
    else:
        out = _cells(asked, have, k, skip_self, {} if stats is None else stats, fused)
    return _ranked(out, k).select("query_id", "rank", "vec_id", "sim")


def _usable(v: str) -> Column:
    return F.col(v).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


_FOUND = "query_id long, vec_id long, sim double"


def _scan(asked: DataFrame, have: DataFrame, k: int, skip_self: bool, fused: bool) -> DataFrame:
    rows = asked.toArrow().combine_chunks()
    shared = asked.sparkSession.sparkContext.broadcast({m.shape[1]: (rows.column("q").to_numpy()[at], m) for at, m in _by_length(rows.column("v"))})

    def run(batches):
        best: dict = {}
        for b in batches:
            for at, x in _by_length(b.column(1)):
                ids, m = shared.value.get(x.shape[1], (np.zeros(0, np.int64), None))
                own = b.column(0).to_numpy()[at]
                for i in range(0, len(ids), STEP[0]):
                    for j in range(0, len(x), STEP[1]):
                        best[x.shape[1], i] = _better(ids[i : i + STEP[0]], m[i : i + STEP[0]], own[j : j + STEP[1]], x[j : j + STEP[1]], k, skip_self, best.get((x.shape[1], i)), fused)
        for (dim, i), found in best.items():
            yield _found(shared.value[dim][0][i : i + STEP[0]], *found)

    return have.mapInArrow(run, _FOUND)


def _pivots(sample: np.ndarray, k: int) -> np.ndarray:
    """Vectors far from each other, moved to the means of those nearest to them."""
    at, far = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(at) < min(k, len(sample)) and far.max() > 0:
        at.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[at[-1]]) ** 2).sum(1))
    p = sample[at]
    for _ in range(2):
        near = _distance(sample, p).argmin(1)
        p = np.stack([sample[near == i].mean(0) if (near == i).any() else p[i] for i in range(len(p))])
    return p


def _distance(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (p**2).sum(1) - 2 * x @ p.T, 0))


def _tiles(cells: dict[tuple[int, int], int], most: Callable[[int], int]) -> tuple[dict[tuple[int, int], tuple[int, int]], int]:
    """{(dim, cell): (tile, cuts)} of the cells' rows, and the number of tiles: whole cells of one dim share a tile of up to
    most(dim) rows, and larger ones are cut into tiles of their own."""
    out, count, room, last = {}, 0, 0, None
    for (dim, cell), n in sorted(cells.items()):
        cuts = -(-n // most(dim))
        if cuts == 1 and dim == last and n <= room:
            out[dim, cell], room = (count - 1, 1), room - n
        else:
            out[dim, cell], room, last = (count, cuts), most(dim) - n if cuts == 1 else 0, dim
            count += cuts
    return out, count


def _packs(cell: np.ndarray, ids: np.ndarray, x: np.ndarray):
    """(rows, cell, ids, vectors) of up to PACK rows of one cell, ids and vectors as bytes. Components take four bytes where
    that loses nothing, else eight."""
    order = np.argsort(cell, kind="stable")
    begin = np.flatnonzero(np.diff(cell[order], prepend=-1))
    for s, e in zip(begin, [*begin[1:], len(order)], strict=True):
        for i in range(s, e, PACK):
            at = order[i : min(i + PACK, e)]
            with np.errstate(all="ignore"):
                small = x[at].astype(np.float32)
            yield at, int(cell[at[0]]), ids[at].tobytes(), (small if (small == x[at]).all() else x[at]).tobytes()


def _unpacked(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows of t in the order of cells, ends of their packs, ids, vectors): the vectors are doubles if any are."""
    cell = t.column("cell").to_numpy()
    order = np.argsort(cell, kind="stable")
    dim, packs, ids = t.column("dim")[0].as_py(), t.column("v").take(pa.array(order)).to_pylist(), t.column("ids").take(pa.array(order)).to_pylist()
    n = np.array([len(b) // 8 for b in ids])
    wide = any(len(b) > 4 * dim * m for b, m in zip(packs, n.tolist(), strict=True))
    v = [np.frombuffer(b, np.float32 if len(b) == 4 * dim * m else np.float64).reshape(m, dim) for b, m in zip(packs, n.tolist(), strict=True)]
    return order, np.cumsum(n), np.frombuffer(b"".join(ids), np.int64), np.concatenate([p.astype(np.float64) for p in v] if wide else v)


def _cells(asked: DataFrame, have: DataFrame, k: int, skip_self: bool, stats: dict, fused: bool) -> DataFrame:
    spark = have.sparkSession
    n = have.count()
    sample: dict[int, list] = {}
    for b in have.select("v").sample(min(1.0, 1.2 * SAMPLE / max(n, 1)), 1).limit(SAMPLE).toArrow().to_batches():
        for _, m in _by_length(b.column(0)):
            sample.setdefault(m.shape[1], []).append(m)
    pivots = {dim: _pivots(np.concatenate(ms), max(1, min(PIVOTS, int(n**0.5 / 4) + 1))) for dim, ms in sample.items()}
    shared = spark.sparkContext.broadcast(pivots)

    def of(dim: int) -> np.ndarray:
        return shared.value.get(dim, np.zeros((1, dim)))

    def index(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            for at, x in _by_length(b.column(1)):
                d = _distance(x, of(x.shape[1]))
                near, norm = d.argmin(1), np.sqrt((x**2).sum(1))
                rows = [(x.shape[1], cell, len(r), d[r, cell].max(), norm[r].max(), i, v) for r, cell, i, v in _packs(near, ids[at], x)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary()), strict=True)], names=["dim", "cell", "n", "dist", "norm", "ids", "v"])

    keyed = keep(have.mapInArrow(index, "dim int, cell int, n long, dist double, norm double, ids binary, v binary"), "cells")
    # A row a pivot.
    table = {(r["dim"], r["cell"]): r for r in keyed.groupBy("dim", "cell").agg(F.sum("n").alias("n"), F.max("dist").alias("radius"), F.max("norm").alias("norm")).collect()}
    stats |= {"corpus_rows": n, "rows_sent": 0, "cells": len(table)}
    if not table:
        return spark.createDataFrame([], _FOUND)
    cores = spark.sparkContext.defaultParallelism

    def most(block: int, rows: int) -> Callable[[int], int]:
        """Rows of a tile: some six pairs of tiles a core, if there are rows enough."""
        return lambda dim: max(1, min(block, BLOCK_BYTES // (8 * max(dim, 1)), max(FEW, -(-rows // int((6 * cores) ** 0.5 + 1)))))

    plan, tiles = _tiles({key: r["n"] for key, r in table.items()}, most(CORPUS_BLOCK, n))
    cells: dict[int, list] = {}
    for (dim, p), r in sorted(table.items()):
        cells.setdefault(dim, []).append((p, r["radius"], r["norm"], *plan[dim, p]))
    info = spark.sparkContext.broadcast({dim: tuple(np.array(c) for c in zip(*rows, strict=True)) for dim, rows in cells.items()})

    def bounds(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each cell can give to each of the queries x at most, and their products with the cells' pivots."""
        p, radius, norm = info.value[x.shape[1]][:3]
        length = np.sqrt((x**2).sum(1))[:, None]
        score = x @ of(x.shape[1])[p].T
        bound = np.minimum(score + length * radius, length * norm)
        return bound + 1e-9 * (np.abs(score) + length * (radius + norm)) + 1e-300, score

    def visit(rows: DataFrame, first: bool) -> DataFrame:
        """What (q, v, least) find: first, without a score to beat, in the cell with the best pivot; then in all that can reach
        the score. Packs of queries with one best pivot travel to each tile of which one of them needs a cell, and of the tiles
        those cells."""

        def route(batches):
            for b in batches:
                ids, floor = b.column(0).to_numpy(), np.asarray(b.column(2).fill_null(-np.inf)).astype(float)
                for at, x in _by_length(b.column(1)):
                    if x.shape[1] not in info.value:
                        continue
                    p, _, _, tile, cuts = info.value[x.shape[1]]
                    bound, score = bounds(x)
                    rows = []
                    for r, own, i, v in _packs(score.argmax(1), ids[at], x):
                        need = np.arange(len(p)) == own if first else (bound[r] >= floor[at[r]][:, None]).any(0)
                        if need.any():
                            to = np.unique(np.concatenate([np.arange(t, t + c) for t, c in zip(tile[need], cuts[need], strict=True)]))
                            rows.append((x.shape[1], p[own], len(r), i, v, floor[at[r]].tobytes(), p[need].tolist(), to.tolist()))
                    if rows:
                        types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["dim", "cell", "n", "ids", "v", "least", "need", "tiles"])

        packs = keep(rows.mapInArrow(route, "dim int, cell int, n long, ids binary, v binary, least binary, need array<int>, tiles array<int>"), "queries")
        # A row a pivot.
        homes = {(r["dim"], r["cell"]): r["n"] for r in packs.groupBy("dim", "cell").agg(F.sum("n").alias("n")).collect()}
        if not homes:
            return spark.createDataFrame([], _FOUND)
        qplan, qtiles = _tiles(homes, most(QUERY_BLOCK, sum(homes.values())))
        dealt = lambda df, plan, name: df.join(F.broadcast(spark.createDataFrame([(*key, *to) for key, to in plan.items()], "dim int, cell int, at_ int, cuts_ int")), ["dim", "cell"]).withColumn(name, F.col("at_") + F.pmod(F.xxhash64("ids"), "cuts_").cast("int")).drop("at_", "cuts_")
        left, right = dealt(packs, qplan, "qtile"), dealt(keyed, plan, "tile")
        # A row for each tile of queries and pivot.
        needs = keep(left.select("dim", "qtile", F.explode("need").alias("cell")).distinct(), "needs")
        sizes = spark.createDataFrame([(*key, r["n"]) for key, r in table.items()], "dim int, cell int, n long")
        stats["rows_sent"] += needs.join(sizes, ["dim", "cell"]).agg(F.sum("n")).first()[0]
        left = left.select("qtile", F.explode("tiles").alias("tile"), "dim", "cell", "ids", "v", "least")
        right = right.join(needs, ["dim", "cell"]).select("qtile", "tile", "dim", "cell", "ids", "v")

        def meet(x: pa.Table, y: pa.Table) -> pa.Table:
            out = []
            if x.num_rows and y.num_rows:
                order, upto, ids, m = _unpacked(x)
                home = np.repeat(x.column("cell").to_numpy()[order], np.diff(upto, prepend=0))
                least = np.frombuffer(b"".join(x.column("least").take(pa.array(order)).to_pylist()), float)
                order, ends, own, v = _unpacked(y)
                p = info.value[m.shape[1]][0]
                # Where each cell of the tile stands among all, and where its vectors are.
                known, last = np.unique(y.column("cell").to_numpy()[order][::-1], return_index=True)
                ends = ends[len(order) - 1 - last]
                place, begin = np.searchsorted(p, known), np.concatenate(([0], ends[:-1]))
                if m.dtype != v.dtype:
                    m, v = m.astype(float), v.astype(float)
                size = np.sqrt(np.einsum("ij,ij->i", v, v, dtype=float))
                for i in range(0, len(ids), STEP[0]):
                    s = slice(i, i + STEP[0])
                    q, part, floor = ids[s], m[s], least[s]
                    vec, sims, bar = np.zeros((len(q), k), np.int64), np.full((len(q), k), np.nan), floor.copy()
                    bound = bounds(part.astype(float))[0][:, place]
                    if first:
                        bound = np.where(known == home[s][:, None], bound, np.nan)
                    for c in np.argsort(-np.fmax(bound, -np.inf).max(0), kind="stable"):
                        for j in range(begin[c], ends[c], STEP[1]):
                            r = np.flatnonzero(bound[:, c] >= bar)
                            if not len(r):
                                break
                            to = slice(j, min(j + STEP[1], ends[c]))
                            vec[r], sims[r] = _better(q[r], part[r], own[to], v[to], k, skip_self, (vec[r], sims[r]), fused, floor[r], size[to].max())
                            bar[r] = np.fmax(floor[r], sims[r, -1])
                    # What is below the score to beat stays here.
                    out.append(_found(q, vec, np.where(sims >= floor[:, None], sims, np.nan)))
            return pa.Table.from_batches(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})

        key, parts = ["qtile", "tile"], max(cores, min(2048, 2 * (max(qtiles, tiles) if first else qtiles * tiles)))
        return left.repartition(parts, *key).groupBy(*key).cogroup(right.repartition(parts, *key).groupBy(*key)).applyInArrow(meet, _FOUND)

    home = _ranked(visit(asked.withColumn("least", F.lit(None).cast("double")), True), k)
    least = keep(home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("sim")).alias("least")), "least")
    return visit(asked.join(least, asked["q"] == least["query_id"], "left").select("q", "v", "least"), False)


def _by_length(column: pa.Array):
    """(rows, matrix) for each length of a column's vectors."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten()).astype(float)
    begin = np.cumsum(size) - size
    for dim in np.unique(size).tolist():
        at = np.flatnonzero(size == dim)
        yield at, flat[(begin[at][:, None] + np.arange(dim)).ravel()].reshape(len(at), dim)


def _better(ids, m, own, v, k: int, skip_self: bool, best, fused: bool, floor=None, longest: float | None = None):
    """The k best (vec_ids, sims) a query of best and the vectors v; sims that aren't finite aren't any, and those below
    floor may be left out. m and v are doubles or floats; longest is the largest length of v, if that is known."""
    dim, kind = m.shape[1], np.finfo(np.result_type(m, v))
    lengths = lambda x: np.sqrt(np.einsum("ij,ij->i", x, x, dtype=float))
    with np.errstate(all="ignore"):
        rough = m @ v.T
        # Sums in whatever order differ by less than this; where lengths overflow, everything is worked out.
        size = lengths(m) * (lengths(v).max(initial=0.0) if longest is None else longest)
        slack = np.where(2 * size < kind.max, 4 * (dim + 2) * (float(kind.eps) * size + float(kind.tiny)), np.inf)
        kth = np.full(len(ids), -np.inf) if best is None else np.where(np.isnan(best[1][:, -1]), -np.inf, best[1][:, -1])
        kth = kth if floor is None else np.maximum(kth, floor)

        def reach(kth):
            near = np.where(np.isnan(kth - slack), -np.inf, kth - slack)
            return ~(rough < np.nextafter(near.astype(rough.dtype), rough.dtype.type(-np.inf))[:, None])

        hit = reach(kth)
        if np.count_nonzero(hit) > 4 * k * len(ids):
            # A query's own rows may be among its best.
            more = min(k + (np.unique(own, return_counts=True)[1].max(initial=0) if skip_self else 0), rough.shape[1])
            hit = reach(np.maximum(kth, np.partition(np.where(np.isnan(rough), -np.inf, rough), -more, 1)[:, -more] - slack)) if more < rough.shape[1] else hit
        at, col = np.divmod(np.flatnonzero(hit), max(rough.shape[1], 1))
    if skip_self:
        other = own[col] != ids[at]
        at, col = at[other], col[other]
    sims = np.empty(len(at))
    for s in range(0, len(at), PAIRS):
        sims[s : s + PAIRS] = _products(m[at[s : s + PAIRS]].astype(float), v[col[s : s + PAIRS]].astype(float), fused)
    vec = own[col]
    out, scores = (np.zeros((len(ids), k), np.int64), np.full((len(ids), k), np.nan)) if best is None else (best[0].copy(), best[1].copy())
    # Only rows of which something was found change.
    new = np.unique(at)
    at, vec, sims = np.concatenate((np.repeat(new, k), at)), np.concatenate((out[new].ravel(), vec)), np.concatenate((scores[new].ravel(), sims))
    scores[new] = np.nan
    fine = np.isfinite(sims)
    at, vec, sims = at[fine], vec[fine], sims[fine]
    order = np.lexsort((vec, -sims, at))
    at, vec, sims = at[order], vec[order], sims[order]
    nth = np.arange(len(at)) - np.searchsorted(at, at)
    first = nth < k
    out[at[first], nth[first]], scores[at[first], nth[first]] = vec[first], sims[first]
    return out, scores


def _products(x: np.ndarray, y: np.ndarray, fused: bool) -> np.ndarray:
    """Inner products row by row, summed in the order of the components, so that ties are ties everywhere."""
    total = np.zeros(len(x))
    with np.errstate(all="ignore"):
        for a, b in zip(np.ascontiguousarray(x.T), np.ascontiguousarray(y.T), strict=True):
            total = _fma(a, b, total) if fused else total + a * b
    return total


def _split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = 134217729.0 * x
    high = t - (t - x)
    return high, x - high


def _two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def _fma(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """a b + c rounded once (Boldo and Melquiond: error-free sums, the last but one rounded to odd)."""
    p = a * b
    (ah, al), (bh, bl) = _split(a), _split(b)
    e = al * bl - (((p - ah * bh) - al * bh) - ah * bl)
    if not e.any():
        return p + c
    th, tl = _two_sum(c, e)
    vh, vl = _two_sum(p, th)
    z, r = _two_sum(tl, vl)
    bits = z.view(np.int64)
    bits += np.where((r != 0) & ((bits & 1) == 0), np.where((r > 0) == (z > 0), 1, -1), 0)
    out = vh + z
    # Too large to be split.
    return np.where(np.isfinite(out), out, p + c)


def _found(ids, vec, sims) -> pa.RecordBatch:
    ok = np.isfinite(sims).ravel()
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, vec.shape[1])[ok]), pa.array(vec.ravel()[ok]), pa.array(sims.ravel()[ok])], names=["query_id", "vec_id", "sim"])


def window_features(neighbours: DataFrame, key: str = "query_id", tau: float = C.TAU_SEMANTIC) -> DataFrame:
    """(key, max_sim, mean_top3, above_tau, nn_id): over the neighbours that there are."""
    g = neighbours.groupBy(key).agg(
        F.max(F.when(F.col("rank") == 1, F.col("sim"))).alias("max_sim"), F.avg(F.when(F.col("rank") <= 3, F.col("sim"))).alias("mean_top3"), F.max(F.when(F.col("rank") == 1, F.col("vec_id"))).alias("nn_id")
    )
    return g.select(key, "max_sim", "mean_top3", (F.col("max_sim") >= tau).cast("int").alias("above_tau"), "nn_id")


def broadcast_features(queries: DataFrame, key: tuple[str, ...], corpus: DataFrame, k: int = 5, tau: float = C.TAU_SEMANTIC, vec_id: str = "vec_id", embedding: str = "embedding", fused: bool = False) -> DataFrame | None:
    """window_features of each row of queries (key, embedding, ...) in place of its embedding, null where it has no neighbour,
    with nothing shuffled: the corpus is broadcast. None if it has over QUERY_BYTES."""
    ship(corpus.sparkSession)
    have = corpus.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(embedding, lambda x: x.cast("double")).alias("v")).where(_usable("v"))
    if have.agg(F.coalesce(F.sum(8 * F.size("v") + 16), F.lit(0))).first()[0] > QUERY_BYTES:
        return None
    rows = have.toArrow().combine_chunks()
    shared = corpus.sparkSession.sparkContext.broadcast({x.shape[1]: (rows.column("vec_id").to_numpy()[at], x) for at, x in _by_length(rows.column("v"))})
    other = [c for c in queries.columns if c not in (*key, embedding)]
    asked = queries.select(*key, *other, F.transform(embedding, lambda x: x.cast("double")).alias("v")).withColumn("v", F.when(_usable("v"), F.col("v")).otherwise(F.array().cast("array<double>")))
    schema = StructType([*asked.drop("v").schema.fields, StructField("max_sim", DoubleType()), StructField("mean_top3", DoubleType()), StructField("above_tau", IntegerType()), StructField("nn_id", LongType())])

    def run(batches):
        for b in batches:
            vec, sims = np.zeros((b.num_rows, k), np.int64), np.full((b.num_rows, k), np.nan)
            for at, x in _by_length(b.column(b.num_columns - 1)):
                ids, v = shared.value.get(x.shape[1], (None, None))
                for i in range(0, len(at) if ids is not None and x.shape[1] else 0, STEP[0]):
                    best, s = None, slice(i, i + STEP[0])
                    for j in range(0, len(ids), STEP[1]):
                        best = _better(at[s], x[s], ids[j : j + STEP[1]], v[j : j + STEP[1]], k, False, best, fused)
                    vec[at[s]], sims[at[s]] = best
            top, n = sims[:, :3], np.isfinite(sims[:, :3]).sum(1)
            total = np.zeros(b.num_rows)
            for c in range(top.shape[1]):
                total = total + np.where(c < n, top[:, c], 0.0)
            none = n == 0
            made = [pa.array(sims[:, 0], mask=none), pa.array(total / np.maximum(n, 1), mask=none), pa.array((sims[:, 0] >= tau).astype(np.int32), mask=none), pa.array(vec[:, 0], mask=none)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=schema.names)

    return asked.mapInArrow(run, schema)


def document_features(windows: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, coverage, max_sim, top3_mean, frac_above_tau, num_windows)."""
    share = F.avg(F.col("above_tau").cast("double"))
    return windows.groupBy(doc_id).agg(share.alias("coverage"), F.max("max_sim").alias("max_sim"), F.avg("mean_top3").alias("top3_mean"), share.alias("frac_above_tau"), F.count("*").alias("num_windows"))


def attach_meta(neighbours: DataFrame, meta: DataFrame, vec_id: str = "vec_id") -> DataFrame:
    """neighbours with the columns of meta, null where it has no row."""
    return neighbours.join(meta, vec_id, "left")
