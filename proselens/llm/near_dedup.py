"""Near-duplicate detection: MinHash signatures, a multi-index Hamming join, links confirmed on full shingle sets.

A document's set holds its distinct WIDTH-word shingles (64-bit hashes). Of a set, CHUNKS x ROWS MinHash values are
kept to 16 bits each. The signature is split into CHUNKS chunks; each chunk is indexed once for every position left
out, which enumerates all values within one wrong position. By the pigeonhole principle all pairs of signatures that
differ in at most 2 * CHUNKS - 1 positions meet under some key. A pair of similarity 0.75 differs in a quarter of the
positions on average, and misses all keys with a probability under 1e-5. A key stands for ROWS - 1 values, 80 bits of
which a 64-bit hash is taken, so that unlike documents don't meet by chance even among 10**11.

Documents with equal sets are one node from the start. Nodes under one key are chained to the key's smallest node,
first inside a batch and then across batches, so a key of any size costs a row a node. The resulting groups are cut
into blocks of bounded size; in a task, two blocks meet, full sets are intersected and exactly the pairs with
100 * intersection >= 75 * union are kept, of which a spanning forest leaves the task. Of a group of several blocks, the
first block meets each of the others; then only what is outside of the group's largest component so far meets the rest,
block by block, so that a group of g near copies of one text costs g sets, not their pairs. Components of those links
are the result.

Defined results: null texts and texts without words have no set and are linked with nothing. Rows with a null doc_id
take no part: their component is null and they are kept. Repeated rows get the same result each. Rows of one doc_id
with different texts share their links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, lean, materialise, parts, release, ship
from .components import components
from .words import BASES, Words, mix, slices, spans

WIDTH = 5
CHUNKS, ROWS = 16, 6
SHARE = 75
CHUNK = 1_000_000
#: Nodes whose sets a task holds at a time; groups beyond it meet block by block.
BLOCK = 1024
#: Shingles of a block at most, but for one text that has more: 8 bytes each, twice while they are counted.
SHINGLES = 4_000_000
#: A list of so many large groups (of four numbers each) may be broadcast.
FEW_GROUPS = 100_000
#: A shingle that more nodes of a task hold is counted by a matrix product, others by listing pairs.
DENSE = 48
_RNG = np.random.default_rng(20240607)
_A = _RNG.integers(0, 1 << 63, CHUNKS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_C = _RNG.integers(0, 1 << 63, CHUNKS * ROWS, np.uint64)


def shingle_sets(w: Words, width: int = WIDTH):
    """The sorted distinct shingle hashes of each text of a batch."""
    h = w.hashes()
    n = np.diff(w.doc)
    at = np.arange(len(h))
    end = np.minimum(at + width, np.repeat(w.doc[1:], n))
    whole = np.repeat(n, n)
    # Texts shorter than a shingle are one, of their own length.
    ok = np.where(whole < width, at == np.repeat(w.doc[:-1], n), end - at == width)
    at, end = at[ok], end[ok]
    keys = mix(spans(h, at, end, BASES[2]) + (end - at).astype(np.uint64)) if len(at) else np.zeros(0, np.uint64)
    cut = np.searchsorted(at, w.doc)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield np.unique(keys[a:b])


def signature(s: np.ndarray) -> bytes:
    """16 bits of each MinHash value."""
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 1024):
        np.minimum(least, (s[k : k + 1024, None] * _A + _C).min(0), out=least)
    return (mix(least) & np.uint64(0xFFFF)).astype("<u2").tobytes()


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """All keys of signatures (rows of u16): hashes of chunk number, left-out position and the chunk's other values."""
    x = signatures.reshape(-1, CHUNKS, ROWS).astype(np.uint64)
    out = np.zeros((len(x), CHUNKS, ROWS), np.uint64)
    for e in range(ROWS):
        low, high = (np.arange(CHUNKS, dtype=np.uint64) * np.uint64(ROWS) + np.uint64(e + 1))[None, :].repeat(len(x), 0), np.zeros((len(x), CHUNKS), np.uint64)
        for i, k in enumerate(k for k in range(ROWS) if k != e):
            if i < 3:
                low = (low << np.uint64(16)) | x[:, :, k]
            else:
                high = (high << np.uint64(16)) | x[:, :, k]
        out[:, :, e] = mix(low ^ mix(high))
    return out.reshape(len(x), -1)


def _signed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_hash, signature) of every document; the last two null without words or id."""

    def run(batches):
        for b in batches:
            for x in slices(b, 1, CHUNK):
                ids, n, digest, sig = x.column(0).to_pylist(), [], [], []
                for d, s in zip(ids, shingle_sets(Words(x.column(1), True)), strict=True):
                    n.append(len(s))
                    ok = len(s) and d is not None
                    digest.append(xxhash.xxh3_128_digest(s.tobytes()) if ok else None)
                    sig.append(signature(s) if ok else None)
                yield pa.RecordBatch.from_arrays([x.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "set_hash", "signature"])

    return docs.mapInArrow(lean(run), "doc_id long, n_shingles long, set_hash binary, signature binary")


def _stars(key: np.ndarray, node: np.ndarray):
    """(distinct keys, smallest node of each, edges node -> that node)."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    lead = node[first][np.cumsum(first) - 1]
    e = np.stack((node, lead), 1)[node != lead]
    return key[first], node[first], np.unique(e, axis=0) if len(e) else e


def candidates(nodes: DataFrame, n_parts: int) -> DataFrame:
    """Edges (a, b) that connect all of (node, signature) that share a key."""

    def index(batches):
        for b in batches:
            for k in range(0, b.num_rows, 8192):
                x = b.slice(k, 8192)
                keys = chunk_keys(np.frombuffer(b"".join(x.column(1).to_pylist()), "<u2").reshape(x.num_rows, -1))
                key, node, edges = _stars(keys.ravel(), np.repeat(x.column(0).to_numpy(), keys.shape[1]))
                part = (mix(key) % np.uint64(n_parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cut = np.searchsorted(part[order], np.arange(n_parts + 1))
                own = np.array_split(edges, n_parts)
                rows = [(p, key[o].tobytes(), node[o].tobytes(), own[p].tobytes()) for p in range(n_parts) if len(o := order[cut[p] : cut[p + 1]]) or len(own[p])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["part", "keys", "nodes", "edges"])

    def meet(t: pa.Table) -> pa.Table:
        read = lambda c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind)
        edges = np.concatenate((_stars(read("keys", np.uint64), read("nodes", np.int64))[2].reshape(-1, 2), read("edges", np.int64).reshape(-1, 2)))
        return pa.table({"a": edges[:, 0], "b": edges[:, 1]})

    return nodes.mapInArrow(lean(index), "part int, keys binary, nodes binary, edges binary").groupBy("part").applyInArrow(meet, "a long, b long")


def links(sets: list[np.ndarray], share: int = SHARE) -> np.ndarray:
    """All pairs i < j of sets with 100 * intersection >= share * union, by exact counts."""
    m, n = len(sets), np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), n)
    order = np.lexsort((owner, flat))
    flat, owner = flat[order], owner[order]
    begin = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    f = np.diff(np.concatenate((begin, [len(flat)])))
    count = np.zeros(m * m, np.float32)
    for k in range(2, DENSE + 1):
        at = begin[f == k]
        i, j = np.triu_indices(k, 1)
        step = max(1, 2_000_000 // len(i))
        for s in range(0, len(at), step):
            o = owner[at[s : s + step, None] + np.arange(k)]
            count += np.bincount((o[:, i] * m + o[:, j]).ravel(), minlength=m * m).astype(np.float32)
    count = count.reshape(m, m)
    many = np.flatnonzero(f > DENSE)
    for s in range(0, len(many), 2048):
        some = many[s : s + 2048]
        x = np.zeros((m, len(some)), np.float32)
        x[owner[np.repeat(begin[some] - np.cumsum(f[some]) + f[some], f[some]) + np.arange(f[some].sum())], np.repeat(np.arange(len(some)), f[some])] = 1
        count += x @ x.T
    i, j = np.nonzero(np.triu(count, 1))
    both = count[i, j].astype(np.int64)
    ok = 100 * both >= share * (n[i] + n[j] - both)
    return np.stack((i[ok], j[ok]), 1)


def forest(pairs: np.ndarray, nodes: np.ndarray) -> list[tuple[int, int]]:
    """Edges (node, root) that connect what pairs (places in nodes) connect."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    for i, j in pairs.tolist():
        a, b = root(int(nodes[i])), root(int(nodes[j]))
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(x, r) for x in list(up) if (r := root(x)) != x]


def _task(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def compared(docs: DataFrame, placed: DataFrame, share: int = SHARE) -> DataFrame:
    """Edges (a, b) of a forest over the exact links between the members of each task; docs are (doc_id, text), placed
    (doc_id, g, tasks), a document going to each of its tasks of g."""

    def build(batches):
        names = ["g", "lo", "hi", "node", "shingles"]
        for b in batches:
            for x in slices(b, 1, CHUNK // 2):
                rows = []
                for d, s, g, tasks in zip(x.column(0).to_pylist(), shingle_sets(Words(x.column(1), True)), *(x.column(k).to_pylist() for k in (2, 3)), strict=True):
                    s = s.tobytes()
                    rows += [(g, t["lo"], t["hi"], d, s) for t in tasks]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=names)

    def meet(t: pa.Table) -> pa.Table:
        nodes, sets = t.column("node").to_numpy(), [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
        edges = forest(links(sets, share), nodes)
        if len(sets) > BLOCK // 2:
            release()
        return pa.table({"a": pa.array([x for x, _ in edges], pa.int64()), "b": pa.array([x for _, x in edges], pa.int64())})

    # The groups grow with the corpus: both sides are shuffled at any size.
    rows = docs.join(placed.where(F.size("tasks") > 0).hint("merge"), "doc_id").select("doc_id", "text", "g", "tasks").mapInArrow(lean(build), "g long, lo int, hi int, node long, shingles binary")
    return rows.groupBy("g", "lo", "hi").applyInArrow(meet, "a long, b long")


def confirmed(docs: DataFrame, groups: DataFrame, share: int = SHARE) -> DataFrame:
    """(node, component) by exact links within groups (node, component, n_shingles); docs are (doc_id, text). Blocks hold
    so many members, or so many shingles of them, that a task's memory is bounded for texts of any length."""

    def blocks_of(members: Column, shingles: Column) -> Column:
        return F.ceil(F.greatest(members / BLOCK, shingles / SHINGLES)).cast("int")

    sized = groups.join(groups.groupBy("component").agg(blocks_of(F.count("*"), F.sum("n_shingles")).alias("size")), "component")
    about = sized.agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"), F.max("size").alias("most")).first()
    # Small groups share tasks; of larger ones, block 0 meets each other block.
    bins, n = max(1, -(-about["n"] // BLOCK), -(-(about["shingles"] or 0) // SHINGLES)), F.col("size")
    mine = F.pmod(F.xxhash64("node"), n).cast("int")
    one, zero = F.lit(-1), F.lit(0)
    tasks = F.when(n == 1, F.array(_task(one, one))).when(mine == 0, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: _task(zero, k))).otherwise(F.array(_task(zero, mine)))
    placed = sized.select(F.col("node").alias("doc_id"), F.when(n > 1, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(bins))).alias("g"), tasks.alias("tasks"))
    first = compared(docs, placed, share)
    if (about["most"] or 0) <= 1:
        return components(first)
    linked = materialise(components(first), "linked")
    # What isn't in a group's largest component yet meets all that it hasn't met.
    large = sized.where(F.col("size") > 1).select("node", F.col("component").alias("g"), "n_shingles")
    now = large.join(linked, "node", "left").select("g", "node", F.coalesce("component", "node").alias("c"), "n_shingles")
    counts = now.groupBy("g", "c").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    best = counts.groupBy("g").agg(F.max(F.struct("n", "c", "w")).alias("m"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    best = best.select("g", F.col("m.c").alias("main"), blocks_of(F.col("m.n"), F.col("m.w")).alias("of_main"), blocks_of(F.col("n") - F.col("m.n"), F.col("w") - F.col("m.w")).alias("of_rest"))
    best = materialise(best.where("of_rest > 0"), "large")
    # Few groups are this large; the list of them is only sent to all tasks if it is short.
    at = now.join(F.broadcast(best) if best.count() <= FEW_GROUPS else best.hint("merge"), "g")
    rest, of_rest, of_main = F.col("c") != F.col("main"), F.col("of_rest"), F.col("of_main")
    block = F.when(rest, F.pmod(F.xxhash64("node"), of_rest)).otherwise(of_rest + F.pmod(F.xxhash64("node"), of_main)).cast("int")
    every = F.when(rest, F.sequence(zero, of_rest + of_main - 1)).otherwise(F.sequence(zero, of_rest - 1))
    tasks = F.transform(F.filter(every, lambda k: k != block), lambda k: _task(F.least(k, block), F.greatest(k, block)))
    second = compared(docs, at.select(F.col("node").alias("doc_id"), "g", tasks.alias("tasks")), share)
    return components(second.unionByName(linked.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: int = SHARE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row a document."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = materialise(_signed(docs), "signed")
    # A table of its own: the join below then deals out both sides by set_hash itself, and the side with all copies of a
    # text can be split.
    reps = materialise(signed.where(F.col("set_hash").isNotNull()).groupBy("set_hash").agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles")), "sets")
    edges = candidates(reps.select("node", "signature"), 2 * parts(spark))
    groups = materialise(components(edges).join(reps.select("node", "n_shingles").hint("merge"), "node"), "groups")
    linked = materialise(confirmed(docs, groups, share), "linked")
    drop(groups)
    node = reps.select("set_hash", "node").join(linked, "node", "left").select("set_hash", F.coalesce("component", "node").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "set_hash").join(node.hint("merge"), "set_hash", "left")
    # Rows of one id, if it has several, share the smallest of their components.
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def survivors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: int = SHARE) -> DataFrame:
    """docs without those that aren't kept, all columns unchanged."""
    gone = deduplicate(docs, doc_id, text, share).where(~F.col("kept")).select(F.col("doc_id").alias("gone_")).distinct()
    return docs.join(gone.hint("merge"), docs[doc_id].cast("long") == gone["gone_"], "left_anti")
