"""Hard-negative mining by bit-sliced integer products.

Components become integers, x = sum of 2**p * b_p over its bit-planes b_p in two's complement, so a score a.x is the sum of
2**p * (a.b_p). Planes are taken most significant first. After plane p the rest of every component is between 0 and
2**p - 1, so with R = 2**p - 1 the score lies between S + R * (sum of a's negative components) and S + R * (sum of its
positive ones). A candidate goes as soon as its interval misses the window that an anchor's positive allows, or lies
below the k-th lower end of those sure to be in it, or below what earlier blocks found. After the last plane the interval
is the score.

Anchors travel in blocks and all rows in chunks; each chunk meets each block once, in a task of its own, so neither a hot label nor
a hot vector makes a task larger. First a share of the chunks is searched; its k-th scores are then to be beaten by
the others, which so return little. Positives are found first, then negatives.

Defined results: rows without label or id, and vectors that are null or hold null or non-finite components take no part.
Vectors of other lengths are not compared (each length is mined by itself; empty vectors score 0). Repeated ids are rows of
their own: each anchor row is one anchor, and only the anchor's own row isn't its candidate. Ties go to the smaller vec_id.
An anchor without positives, and a positive without negatives in its window, give no row. Scores are exact whatever the
size of components; one that doesn't fit 64 bits is an error if it is among the results.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, ship
from .vectors import by_length, exact_bits, finite, whole

SCALE = 256
#: Rows of a chunk (fewer if they are long) and anchors of a block, by bytes.
CHUNK, BLOCK = 4 << 20, 4 << 20
#: One chunk of so many is searched before the others.
FIRST = 8
#: Anchors and rows of one step of products.
STEP = 128, 4096
#: What stands for scores that don't fit.
BEYOND = 2**63 - 1
_PACKED = "dim int, chunk long, ids binary, rids binary, labels binary, flags binary, x binary"
_ANCHORS = "dim int, block long, ids binary, rids binary, labels binary, x binary, low binary, high binary, has binary, least binary"


def _packer(size: int, scale: int) -> Callable:
    """Arrow batches of (vec_id, label, is anchor, embedding) into chunks of one length each; a row's number is its chunk and place."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 20
        held: dict[int, list] = {}

        def flush(dim, columns):
            nonlocal number
            n = len(columns[0])
            packed = [columns[0], (number << 20) + np.arange(n), *columns[1:]]
            row = [pa.array([dim], pa.int32()), pa.array([number], pa.int64()), *(pa.array([c.tobytes()], pa.binary()) for c in packed)]
            number += 1
            return pa.RecordBatch.from_arrays(row, names=["dim", "chunk", "ids", "rids", "labels", "flags", "x"])

        for b in batches:
            more = [b.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            for rows, x in by_length(b.column(3), scale):
                dim = x.shape[1]
                most = min(max(1, size // (8 * max(dim, 1))), 1 << 20)
                held.setdefault(dim, []).append([*(c[rows] for c in more), x])
                while sum(len(c[0]) for c in held[dim]) >= most:
                    whole_ = [np.concatenate(c) for c in zip(*held[dim], strict=True)]
                    yield flush(dim, [c[:most] for c in whole_])
                    held[dim] = [[c[most:] for c in whole_]]
        for dim, parts_ in held.items():
            columns = [np.concatenate(c) for c in zip(*parts_, strict=True)]
            if len(columns[0]):
                yield flush(dim, columns)

    return run


class Rows:
    """An unpacked chunk or block."""

    def __init__(self, row: dict):
        self.ids, self.rids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "rids", "labels"))
        self.x = np.frombuffer(row["x"], np.float64).reshape(len(self.ids), row["dim"])


def sliced(a: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, k: int, allowed: np.ndarray):
    """Scores of the pairs that may be among an anchor's k best. a: anchors, x: rows (integers, held as doubles); low,
    high, least: windows of scores and what is to be reached, (slots, anchors); allowed: (slots, anchors, rows).
    Returns (slot, anchor, row, score) arrays."""
    alive = allowed.copy()
    if not exact_bits(a, x):
        return _plain(whole(a), whole(x), low, high, alive)
    columns = np.arange(len(x))
    minus, plus = np.minimum(a, 0).sum(1)[:, None], np.maximum(a, 0).sum(1)[:, None]
    bits = max(int(np.abs(x).max(initial=0)).bit_length(), 1)
    rest = x.astype(np.int64)
    # The sign's plane weighs -2**bits.
    s = -(2.0**bits) * (a @ (rest < 0).T.astype(float))
    for p in range(bits - 1, -1, -1):
        s += 2.0**p * (a @ (rest >> p & 1).T.astype(float))
        r = 2.0**p - 1
        lo, hi = s + r * minus, s + r * plus
        for i in range(len(alive)):
            w = alive[i]
            w &= (hi >= low[i][:, None]) & (lo <= high[i][:, None])
            sure = np.where(w & (lo >= low[i][:, None]) & (hi <= high[i][:, None]), lo, -np.inf)
            kth = np.partition(sure, -k, 1)[:, -k] if sure.shape[1] >= k else np.full(len(a), -np.inf)
            w &= hi >= np.maximum(kth, least[i])[:, None]
        used = alive.any((0, 1))
        if not used.any():
            return (np.zeros(0, np.int64),) * 4
        if used.mean() < 0.7:
            columns, rest, s, alive = columns[used], rest[used], s[:, used], alive[:, :, used]
        if p and alive.any(0).mean() < 0.05:
            return _pairs(a, columns, rest, s, p, low, high, least, alive)
    slot, anchor, row = np.nonzero(alive)
    return slot, anchor, columns[row], s[anchor, row].astype(np.int64)


def _pairs(a, columns, rest, s, p, low, high, least, alive):
    """The planes below p for the few pairs left."""
    anchor, row = np.nonzero(alive.any(0))
    score, minus, plus = s[anchor, row], np.minimum(a, 0).sum(1)[anchor], np.maximum(a, 0).sum(1)[anchor]
    slots = alive[:, anchor, row]
    for q in range(p - 1, -1, -1):
        score = score + 2.0**q * np.einsum("ij,ij->i", a[anchor], (rest[row] >> q & 1).astype(float))
        r = 2.0**q - 1
        lo, hi = score + r * minus, score + r * plus
        slots &= (hi >= np.maximum(low, least)[:, anchor]) & (lo <= high[:, anchor])
        keep = slots.any(0)
        anchor, row, score, minus, plus, slots = anchor[keep], row[keep], score[keep], minus[keep], plus[keep], slots[:, keep]
    slot, at = np.nonzero(slots)
    return slot, anchor[at], columns[row[at]], score[at].astype(np.int64)


def _plain(a, x, low, high, alive):
    """The same planes in Python's integers, for components beyond exact doubles."""
    bits = max((abs(int(v)).bit_length() for v in x.ravel()), default=0) + 1
    s = np.array([[0] * len(x) for _ in a], object).reshape(len(a), len(x))
    for p in range(bits, -1, -1):
        plane = np.array([(-1 if p == bits else 1) * (int(v) >> p & 1) for v in x.ravel()], object).reshape(x.shape)
        if x.shape[1]:
            s = s + a.dot(plane.T) * (1 << p)
    for i in range(len(alive)):
        for j in range(len(a)):
            least, most = int(low[i][j]), int(high[i][j])
            # The ends stand for no bound.
            alive[i, j] &= np.array([(least <= v or least < -BEYOND) and (v <= most or most == BEYOND) for v in s[j]], bool)
    slot, anchor, row = np.nonzero(alive)
    return slot, anchor, row, s[anchor, row]


def _search(rows: Rows, anchors: Rows, same: bool, k: int, low: np.ndarray, high: np.ndarray, has: np.ndarray, least: np.ndarray):
    """(slot, anchor's place, row's place, score) of the k best rows of a chunk for each slot of each anchor. Scores beyond
    64 bits are given as the nearest that fits."""
    for i in range(0, len(anchors.ids), STEP[0]):
        at = np.arange(i, min(i + STEP[0], len(anchors.ids)))
        best: dict[tuple[int, int], list] = {}
        floor = least[:, at].copy()
        for j in range(0, len(rows.ids), STEP[1]):
            to = np.arange(j, min(j + STEP[1], len(rows.ids)))
            ok = ((anchors.labels[at][:, None] == rows.labels[to]) == same) & (anchors.rids[at][:, None] != rows.rids[to])
            slot, anchor, row, score = sliced(anchors.x[at], rows.x[to], low[:, at], high[:, at], floor, k, ok & has[:, at][:, :, None])
            if not len(slot):
                continue
            score = np.array([min(max(int(v), -BEYOND), BEYOND) for v in score], np.int64) if score.dtype == object else score
            order = np.lexsort((rows.ids[to[row]], -score, anchor, slot))
            key = (slot * len(at) + anchor)[order]
            cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            for u, v in zip(cut[:-1], cut[1:], strict=True):
                o = order[u : min(v, u + k)]
                pair = int(slot[o[0]]), int(anchor[o[0]])
                new = sorted([*best.get(pair, []), *zip((-score[o]).tolist(), rows.ids[to[row[o]]].tolist(), to[row[o]].tolist(), strict=True)])[:k]
                best[pair] = new
                if len(new) == k:
                    floor[pair] = max(floor[pair], float(-new[-1][0]))
        for (slot, anchor), found in best.items():
            for s, _, row in found:
                yield slot, int(at[anchor]), row, -s


_FOUND = "rid long, slot int, row long, row_id long, score long"


def _meet(chunks: DataFrame, blocks: DataFrame, same: bool, k: int) -> DataFrame:
    """The k best rows of each chunk for each slot of each anchor. The keys that are sent around are a number a chunk and
    a number a block."""
    left = chunks.join(F.broadcast(blocks.select("dim", F.col("block").alias("to"))), "dim")
    right = blocks.join(F.broadcast(chunks.select("dim", F.col("chunk").alias("to"))), "dim")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if a.num_rows and b.num_rows:
            chunk, block = a.to_pylist()[0], b.to_pylist()[0]
            rows, anchors = Rows(chunk), Rows(block)
            low, high, has, least = (np.frombuffer(block[c], kind).reshape(-1, len(anchors.ids)) for c, kind in (("low", np.int64), ("high", np.int64), ("has", bool), ("least", np.float64)))
            for slot, i, j, score in _search(rows, anchors, same, k, low, high, has, least):
                for column, v in zip(out, (int(anchors.rids[i]), slot, int(rows.rids[j]), int(rows.ids[j]), score), strict=True):
                    column.append(v)
        return pa.table([pa.array(c, pa.int32() if n == 1 else pa.int64()) for n, c in enumerate(out)], names=["rid", "slot", "row", "row_id", "score"])

    return left.groupBy("dim", "to", "chunk").cogroup(right.groupBy("dim", "block", "to")).applyInArrow(run, _FOUND)


def _blocks(anchors: DataFrame, name: str) -> DataFrame:
    """Rows (dim, block, rid, vec_id, label, x, low, high, has, least: arrays with a value a slot) packed by block."""

    def run(t: pa.Table) -> pa.Table:
        def column(c, kind):
            return np.array(t.column(c).to_pylist(), kind)

        slots = [np.ascontiguousarray(column(c, kind).T).tobytes() for c, kind in (("low", np.int64), ("high", np.int64), ("has", bool), ("least", np.float64))]
        row = [t.column("dim")[0].as_py(), t.column("block")[0].as_py(), *(column(c, np.int64).tobytes() for c in ("vec_id", "rid", "label")), b"".join(t.column("x").to_pylist()), *slots]
        return pa.table([pa.array([v]) for v in row[:2]] + [pa.array([v], pa.binary()) for v in row[2:]], names=["dim", "block", "ids", "rids", "labels", "x", "low", "high", "has", "least"]).cast(pa.schema([("dim", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in ("ids", "rids", "labels", "x", "low", "high", "has", "least"))]))

    return materialise(anchors.groupBy("dim", "block").applyInArrow(run, _ANCHORS), name)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("rid", "slot").orderBy(F.desc("score"), "row_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _rounds(chunks: DataFrame, anchors: DataFrame, same: bool, k: int, name: str) -> DataFrame:
    """(rid, slot, row, row_id, score, rank) of the k best rows for each slot of each anchor: of a share of the chunks first, then
    of the others with the scores to beat."""
    part = F.pmod(F.xxhash64("chunk"), F.lit(FIRST)) == 0
    best = materialise(_top(_meet(chunks.where(part), _blocks(anchors, f"{name}-a"), same, k), k).drop("rank"), f"{name}-first")
    reached = best.groupBy("rid", "slot").agg(F.min("score").alias("s"), F.count("*").alias("n")).where(F.col("n") >= k)
    reached = reached.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.col("s").cast("double")))).alias("reached"))
    slots = F.transform("least", lambda x, i: F.coalesce(F.element_at("reached", i), x))
    better = anchors.join(reached, "rid", "left").withColumn("least", slots).drop("reached")
    rest = _meet(chunks.where(~part), _blocks(better, f"{name}-b"), same, k)
    return materialise(_top(best.unionByName(rest), k), name)


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row for which the condition
    anchors holds and each of its first positives of the same label, the first rows of other labels whose scores are
    between low and high hundredths of the positive's."""
    spark = vectors.sparkSession
    ship(spark)
    used = vectors.where(finite(embedding) & F.col(vec_id).isNotNull() & F.col(label).isNotNull())
    used = used.select(F.col(vec_id).cast("long"), F.col(label).cast("long"), F.coalesce(anchors, F.lit(False)), embedding)
    chunks = materialise(used.mapInArrow(_packer(CHUNK, scale), _PACKED), "chunks")

    def unpack(batches):
        for b in batches:
            for row in b.to_pylist():
                r = Rows(row)
                at = np.flatnonzero(np.frombuffer(row["flags"], bool))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row["dim"], np.int32)), pa.array(r.rids[at]), pa.array(r.ids[at]), pa.array(r.labels[at]), pa.array([r.x[i].tobytes() for i in at], pa.binary())], names=["dim", "rid", "vec_id", "label", "x"])

    rows = materialise(chunks.mapInArrow(unpack, "dim int, rid long, vec_id long, label long, x binary"), "anchors")
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not sizes:
        return spark.createDataFrame([], out)
    # How many blocks the anchors of each length are dealt to.
    of = F.create_map(*(F.lit(v) for dim, n in sizes.items() for v in (dim, max(1, round(n * 8 * max(dim, 1) / BLOCK)))))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rid"), F.element_at(of, F.col("dim"))).cast("long"))
    chunks = chunks.drop("flags")
    none = F.array(F.lit(float("-inf")))
    found = _rounds(chunks, rows.select("*", F.array(F.lit(-BEYOND - 1)).alias("low"), F.array(F.lit(BEYOND)).alias("high"), F.array(F.lit(True)).alias("has"), none.alias("least")), True, positives, "positives")
    fits = F.when(F.col("score") == BEYOND, F.raise_error(F.lit("a positive's score doesn't fit 64 bits")).cast("long")).otherwise(F.col("score"))
    slots = F.array_sort(F.collect_list(F.struct("rank", "row_id", fits.alias("score"))))
    listed = materialise(found.groupBy("rid").agg(slots.alias("p")).join(rows, "rid"), "listed")
    score = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.get("p", i)["score"])

    def hundredths(v: Column, n: int) -> Column:
        return v.cast("decimal(20,0)") * F.lit(n) / F.lit(100)

    windows = listed.withColumns(
        {
            "low": F.transform(score, lambda v: F.coalesce(F.ceil(hundredths(v, low)).cast("long"), F.lit(0))),
            "high": F.transform(score, lambda v: F.coalesce(F.floor(hundredths(v, high)).cast("long"), F.lit(0))),
            # Below 0 the window is empty.
            "has": F.transform(score, lambda v: F.coalesce(v >= 0, F.lit(False))),
            "least": F.transform(score, lambda v: F.lit(float("-inf"))),
        }
    ).drop("p")
    got = _rounds(chunks, windows, False, negatives, "negatives")
    own = listed.select("rid", F.col("vec_id").alias("anchor_id"), "p")
    positive = F.get("p", F.col("slot"))
    return got.join(own, "rid").select("anchor_id", positive["row_id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("row_id").alias("negative_id"), positive["score"].alias("positive_score"), F.col("score").alias("negative_score"))
