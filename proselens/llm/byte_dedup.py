"""Exact removal of repeated byte strings by run-length indexes.

A passage is any string of WINDOW bytes within one document; each byte under a passage that also starts elsewhere goes.

Routing: of the hashes of all GRAM-byte strings, a window holds a smallest one, the same wherever the window occurs. The
smallest ones of short windows are a sample that holds the smallest of every long one; blocks of documents send each of
the sample once to be counted over the corpus. A passage that contains one which is alone, for reasons that lie within the passage,
occurs once. What is left is cut into stretches of passages with the same smallest hash, and stretches go to the part of that hash, a
stretch once a block.

Index: a part builds run-length indexes of its stretches (run_index: the runs of the Burrows-Wheeler transform, with
samples at their ends) and streams the matching statistics of the stretches from the samples: a place with a match of a
whole window elsewhere begins a repeat. Of equal stretches two are indexed, as more tell nothing new. The bits go back to the
blocks, which kept the places.

Hot hashes: one that occurs more than HOT times would bring together stretches without bound (a line in a third of all
documents has as many neighbourhoods). Their passages are instead spread over all parts by their own 96-bit fingerprints,
each once a block, and counted; that is exact as well, and no part grows.

Defined results: null and empty texts have no bytes; repeated rows are repeats of each other. Texts shorter than a window
lose nothing. Passages may begin and end within a character, so what is kept is binary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from .common import materialise, parts, schema_with
from .run_index import RunIndex
from .text_blocks import Blocks, by_part, column
from .words import BASES, mix, spans

WINDOW = 200
BLOCK = 4_000_000
#: Occurrences of a hash, up to which its stretches meet in one index.
HOT = 1024
#: Bytes of stretches in one index (a hash's stretches stay together).
INDEX = 1 << 18
_STEP = 1 << 17
_LOW = np.uint64(0xFFFFFFFF)


class Sizes:
    """window; gram: bytes of a hash; sparse: hashes of which one is sampled at least."""

    def __init__(self, window: int):
        self.window, self.gram, self.sparse = window, max(1, window * 4 // 25), max(1, window * 6 // 25)
        self.wide = window - self.gram + 1
        #: A short window within a long one begins at most so far behind it.
        self.slack = self.wide - self.sparse


def _smallest(v: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of width values."""
    have = 1
    while have * 2 <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return np.minimum(v[: len(v) - (width - have)], v[width - have :])


class Bytes:
    """The texts of a block as bytes, with hashes and samples. offsets: where documents begin and end."""

    def __init__(self, texts: pa.ChunkedArray, sizes: Sizes):
        texts = texts.cast(pa.large_string()).fill_null("").combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.chunk(0) if texts.num_chunks else pa.array([], pa.large_string())
        self.offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        raw = texts.buffers()[2]
        first, last = int(self.offsets[0]), int(self.offsets[-1])
        self.data = np.frombuffer(raw, np.uint8)[first:last] if raw is not None and last > first else np.zeros(0, np.uint8)
        self.offsets = self.offsets - first
        self.sizes = sizes

    def _valid(self, length: int, n: int) -> np.ndarray:
        """The first n places, where true if a document of a window or more has length bytes from there."""
        ok = np.zeros(len(self.data) + 1, bool)
        for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True):
            if b - a >= self.sizes.window:
                ok[a : b - length + 1] = True
        return ok[:n]

    def order(self) -> np.ndarray:
        """Of each place its hash's upper half and, for ties, the place: later ones first."""
        n, g = len(self.data) - self.sizes.gram + 1, self.sizes.gram
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.empty(n, np.uint64)
        for k in range(0, n, _STEP):
            m = min(_STEP, n - k)
            at = np.arange(m)
            out[k : k + m] = mix(spans(self.data[k : k + m + g - 1].astype(np.uint64) + np.uint64(1), at, at + g, BASES[0]))
        self.hash = out
        return (out & ~_LOW) | (_LOW - np.arange(n, dtype=np.uint64))

    def sample(self, order: np.ndarray):
        """(place, first and last short window that choose it) of the sample."""
        s = self.sizes
        if len(order) < s.sparse:
            return (np.zeros(0, np.int64),) * 3
        small = _smallest(order, s.sparse)
        at = np.flatnonzero(self._valid(s.sparse + s.gram - 1, len(small)))
        place = (_LOW - (small[at] & _LOW)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(at) else np.zeros(0, np.int64)
        last = np.concatenate((first[1:], [len(at)]))[: len(first)] - 1
        return place[first], at[first], at[last]


def _sent(name: np.ndarray, n_parts: int):
    unique, count = np.unique(name, return_counts=True)
    return unique, (unique % np.uint64(n_parts)).astype(np.int64), np.minimum(count, 65535).astype(np.uint16)


def _bits(flags: list[np.ndarray]) -> pa.Array:
    return pa.array([np.packbits(f).tobytes() for f in flags], pa.binary())


def _row(rows: list[tuple], schema: dict) -> pa.Table:
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), schema.values(), strict=True)], names=list(schema)) if rows else pa.table({c: pa.array([], k) for c, k in schema.items()})


#: What a block keeps of its suspects and sends of them, a row a part. Stretches: a their text, b their lengths and keys, n how often
#: each occurs (1, or 2 for more). Passages of hot hashes: a and b their fingerprints. size and at: what the block needs to find the places.
_SUSPECTS = {"part": pa.int32(), "block": pa.int64(), "a": pa.binary(), "b": pa.binary(), "n": pa.binary(), "size": pa.binary(), "at": pa.binary()}


def indexed(texts: list[bytes], count: np.ndarray, key: np.ndarray, window: int) -> list[np.ndarray]:
    """For each text, at which places a window begins that also begins at another place, of the text itself or another;
    texts that occur twice are elsewhere as well."""
    out: list = [None] * len(texts)
    order = np.argsort(key, kind="stable")
    size = np.array([len(t) for t in texts], np.int64)[order]
    cut, total = [0], 0
    for k in range(len(order)):
        # Texts with one key stay together.
        if total >= INDEX and key[order[k]] != key[order[k - 1]]:
            cut.append(k)
            total = 0
        total += int(size[k])
    for a, b in zip(cut, [*cut[1:], len(order)], strict=True):
        mine = order[a:b]
        twice = mine[count[mine] > 1]
        index = RunIndex([texts[i] for i in mine] + [texts[i] for i in twice])
        long = index.matching_statistics() >= window
        for i, begin in zip(mine.tolist(), index.begin.tolist(), strict=False):
            out[i] = long[begin : begin + len(texts[i]) - window + 1]
    return out


def repeated(blocks: Blocks, text: str, window: int) -> DataFrame:
    """(block, part, size, at, bits): a block's suspect passages and, in other rows, which of them are repeats."""
    n_parts, sizes = 2 * parts(blocks.spark), Sizes(window)

    def low(name):
        return (mix(name) >> np.uint64(32)).astype(np.uint32)

    def names(block, t):
        x = Bytes(t.column(text), sizes)
        place, _, _ = x.sample(x.order())
        if len(place):
            unique, part, count = _sent(x.hash[place], n_parts)
            rows = [(p, block, low(unique[o]).tobytes(), count[o].tobytes()) for p, o in by_part(part, n_parts)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["part", "block", "keys", "n"])

    def counted(t: pa.Table) -> pa.Table:
        keys, cut = column(t, "keys", np.uint32)
        n, _ = column(t, "n", np.uint16)
        _, of = np.unique(keys, return_inverse=True)
        total = np.bincount(of, n)[of]
        ends = list(zip(cut[:-1], cut[1:], strict=True))
        return pa.table({"block": t.column("block"), "part": t.column("part"), "bits": _bits([np.concatenate((total[a:b] >= 2, total[a:b] > HOT)) for a, b in ends])})

    flags = blocks.emit(names, "part int, block long, keys binary, n binary").groupBy("part").applyInArrow(counted, "block long, part int, bits binary")

    def suspects(block, t, answers):
        x = Bytes(t.column(text), sizes)
        order = x.order()
        place, first, last = x.sample(order)
        if not len(place):
            return _row([], _SUSPECTS)
        unique, part, _ = _sent(x.hash[place], n_parts)
        twice, hot = np.zeros(len(unique), bool), np.zeros(len(unique), bool)
        bits = dict(zip(answers.column("part").to_pylist(), answers.column("bits").to_pylist(), strict=True))
        for p, o in by_part(part, n_parts):
            both = np.unpackbits(np.frombuffer(bits[p], np.uint8))
            twice[o], hot[o] = both[: len(o)].astype(bool), both[len(o) : 2 * len(o)].astype(bool)
        code = np.searchsorted(unique, x.hash[place])
        # A passage with a short window that chooses a hash which is alone occurs once.
        alone = ~twice[code]
        step = np.zeros(len(x.data) + 2, np.int32)
        np.add.at(step, np.maximum(first[alone] - sizes.slack, 0), 1)
        np.add.at(step, last[alone] + 1, -1)
        wide = _smallest(order, sizes.wide)
        at = np.flatnonzero((np.cumsum(step)[: len(wide)] == 0) & x._valid(window, len(wide)))
        if not len(at):
            return _row([], _SUSPECTS)
        chosen = (_LOW - (wide[at] & _LOW)).astype(np.int64)
        key = x.hash[chosen]
        is_hot = hot[np.searchsorted(unique, key)]
        rows = _stretches(x, block, at[~is_hot], chosen[~is_hot], key[~is_hot])
        rows += _fingerprints(x, block, at[is_hot])
        return _row(rows, _SUSPECTS)

    def _stretches(x: Bytes, block, at, chosen, key):
        if not len(at):
            return []
        first = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (at[1:] != at[:-1] + 1))))
        last = np.concatenate((first[1:], [len(at)])) - 1
        raw = x.data.tobytes()
        found: dict[bytes, list[int]] = {}
        keys: list[int] = []
        for a, b, k in zip(at[first].tolist(), (at[last] + window).tolist(), key[first].tolist(), strict=True):
            seen = found.setdefault(raw[a:b], [])
            if not seen:
                keys.append(k)
            seen.append(a)
        texts, places, key = list(found), list(found.values()), np.array(keys, np.uint64)
        rows = []
        for p, o in by_part((key % np.uint64(n_parts)).astype(np.int64), n_parts):
            # Like texts next to each other.
            o = o[np.argsort(key[o], kind="stable")]
            own = [places[i] for i in o.tolist()]
            length, n = np.array([len(texts[i]) for i in o.tolist()], np.uint32), np.array([len(s) for s in own], np.uint32)
            packed = pa.compress(b"".join([texts[i] for i in o.tolist()]), codec="zstd", asbytes=True)
            rows.append((p, block, packed, length.tobytes() + low(key[o]).tobytes(), np.minimum(n, 2).astype(np.uint8).tobytes(), length.tobytes() + n.tobytes(), np.concatenate([np.array(s, np.uint32) for s in own]).tobytes()))
        return rows

    def _fingerprints(x: Bytes, block, at):
        if not len(at):
            return []
        y = x.data.astype(np.uint64) + np.uint64(1)
        a, b = mix(spans(y, at, at + window, BASES[1])), (mix(spans(y, at, at + window, BASES[2])) >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((b, a))
        a, b, at = a[order], b[order], at[order]
        begin = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        size = np.diff(np.concatenate((begin, [len(a)])))
        rows = []
        for p, o in by_part((a[begin] % np.uint64(n_parts)).astype(np.int64), n_parts):
            places = np.repeat(begin[o] - np.cumsum(size[o]) + size[o], size[o]) + np.arange(size[o].sum())
            rows.append((n_parts + p, block, a[begin[o]].tobytes(), b[begin[o]].tobytes(), np.minimum(size[o], 2).astype(np.uint8).tobytes(), size[o].astype(np.uint32).tobytes(), at[places].astype(np.uint32).tobytes()))
        return rows

    def verified(t: pa.Table) -> pa.Table:
        find = _index_part if t.column("part")[0].as_py() < n_parts else _count_part
        return pa.table({"block": t.column("block"), "part": t.column("part"), "bits": _bits(find(t))})

    def _index_part(t: pa.Table) -> list[np.ndarray]:
        number: dict[bytes, int] = {}
        count: list[int] = []
        keys: list[int] = []
        rows: list[list[int]] = []
        for a, b, n in zip(*(t.column(c).to_pylist() for c in "abn"), strict=True):
            length, key = np.frombuffer(b, np.uint32).reshape(2, -1)
            raw = pa.decompress(a, decompressed_size=int(length.sum()), codec="zstd", asbytes=True)
            end = np.cumsum(length).tolist()
            mine = []
            for i, j, k, m in zip([0, *end[:-1]], end, key.tolist(), n, strict=True):
                one = number.setdefault(raw[i:j], len(number))
                if one == len(count):
                    count.append(0)
                    keys.append(k)
                count[one] += m
                mine.append(one)
            rows.append(mine)
        flags = indexed(list(number), np.array(count), np.array(keys, np.uint32), window)
        return [np.concatenate([flags[i] for i in mine]) for mine in rows]

    def _count_part(t: pa.Table) -> list[np.ndarray]:
        a, cut = column(t, "a", np.uint64)
        b, _ = column(t, "b", np.uint32)
        n, _ = column(t, "n", np.uint8)
        order = np.lexsort((b, a))
        first = np.ones(len(a), bool)
        first[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        of = np.zeros(len(a), np.int64)
        of[order] = np.cumsum(first) - 1
        twice = (np.bincount(of, n) >= 2)[of]
        return [twice[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]

    schema = "part int, block long, a binary, b binary, n binary, size binary, at binary"
    found = materialise(blocks.answer(flags, suspects, schema), "suspects")
    bits = found.select("part", "block", "a", "b", "n").groupBy("part").applyInArrow(verified, "block long, part int, bits binary")
    none = F.lit(None).cast("binary")
    return found.select("block", "part", "size", "at", none.alias("bits")).unionByName(bits.select("block", "part", none.alias("size"), none.alias("at"), "bits"))


def _starts(answers: pa.Table, window: int, n_parts: int) -> np.ndarray:
    """Where repeats begin, from a block's rows of ``repeated``."""
    bits = {r["part"]: r["bits"] for r in answers.select(["part", "bits"]).to_pylist() if r["bits"] is not None}
    out = [np.zeros(0, np.int64)]
    for part, size, at in zip(*(answers.column(c).to_pylist() for c in ("part", "size", "at")), strict=True):
        if size is None:
            continue
        flags = np.unpackbits(np.frombuffer(bits[part], np.uint8)).astype(bool)
        at = np.frombuffer(at, np.uint32).astype(np.int64)
        if part >= n_parts:
            size = np.frombuffer(size, np.uint32).astype(np.int64)
            out.append(at[np.repeat(flags[: len(size)], size)])
            continue
        length, n = np.frombuffer(size, np.uint32).reshape(2, -1).astype(np.int64)
        i = j = 0
        for m, k in zip((length - window + 1).tolist(), n.tolist(), strict=True):
            hits = np.flatnonzero(flags[i : i + m])
            if len(hits):
                out.append((at[j : j + k][:, None] + hits).ravel())
            i, j = i + m, j + k
    return np.concatenate(out)


def deduplicate(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs without ``text``, with n_bytes, n_removed, the removed spans (byte places, end exclusive, in order) and the
    bytes that are kept."""
    docs = docs.drop(*({"n_bytes", "n_removed", "removed", "kept"} - {text}))
    blocks, n_parts = Blocks(docs, text, BLOCK), 2 * parts(docs.sparkSession)
    span = StructType().add("begin", LongType()).add("end", LongType())
    schema = schema_with(docs.drop(text), ("n_bytes", "long"), ("n_removed", "long"), ("removed", ArrayType(span)), ("kept", BinaryType()))
    sizes = Sizes(window)

    def remove(block, t, answers):
        x = Bytes(t.column(text), sizes)
        starts = _starts(answers, window, n_parts)
        step = np.zeros(len(x.data) + 1, np.int32)
        np.add.at(step, starts, 1)
        np.add.at(step, starts + window, -1)
        gone = np.cumsum(step)[:-1] > 0
        counts, removed, runs, kept = [], [], [], []
        raw = x.data.tobytes()
        for a, b in zip(x.offsets[:-1].tolist(), x.offsets[1:].tolist(), strict=True):
            mask = gone[a:b]
            edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8))).reshape(-1, 2).tolist()
            counts.append(b - a)
            removed.append(int(mask.sum()))
            runs.append([{"begin": i, "end": j} for i, j in edge])
            ends = [0, *(v for e in edge for v in e), b - a]
            kept.append(b"".join([raw[a + i : a + j] for i, j in zip(ends[::2], ends[1::2], strict=True)]))
        spans_ = pa.array(runs, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
        return pa.table([*t.drop_columns([text]).columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), spans_, pa.array(kept, pa.binary())], names=schema.names)

    return blocks.answer(repeated(blocks, text, window), remove, schema)


def digest(docs: DataFrame) -> DataFrame:
    """What op12 returns of every document."""
    out = deduplicate(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
