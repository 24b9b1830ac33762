"""Byte-level BPE: ranked merges folded over byte arrays of distinct words, and decoding by concatenated pieces.

Encoding: a scan cuts each text into the pattern's matches and numbers the distinct ones of a block of documents. All
distinct words of the block, as arrays of byte ids, are folded together: in each round every word that still has a pair
with a rank merges the one with the smallest rank, the first of equals. A document's ids are its words' ids in order.
Nothing is shuffled. Decoding looks up every id's bytes and concatenates the pieces.

The rank map holds every pair of tokens whose bytes together are a token. It is a sparse two-dimensional table stored
by row displacement: entry (a, b) lies at offset[a] + b and carries a as a check. Its size is fixed by the vocabulary,
some MB, and it is broadcast.

A word of more than LONG_WORD bytes, which would take the block through as many rounds, is merged by the same rule with
a heap.

Defined results: null and empty texts have no ids and decode to no bytes. No special tokens exist; their strings are
ordinary text.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, schema_with, ship
from .words import slices

LONG_WORD = 256
#: Words folded together: as many as keep the arrays of a round in the cache.
SIDE_BY_SIDE = 16_384
BLOCK = 2_000_000
NONE = (1 << 31) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """Rank by (left id, right id) of every pair whose bytes together have one."""
    out = {}
    for word, r in ranks.items():
        for k in range(1, len(word)):
            a, b = ranks.get(word[:k]), ranks.get(word[k:])
            if a is not None and b is not None:
                out[a, b] = r
    return out


def displaced(pairs: dict[tuple[int, int], int], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offset of each row, row of each table entry or -1, its value): no two rows' entries meet."""
    rows: dict[int, list[tuple[int, int]]] = {}
    for (a, b), r in pairs.items():
        rows.setdefault(a, []).append((b, r))
    # Fullest rows first, each at the first of a fixed sequence of places where it fits; at this load that takes few tries.
    size = 4 * len(pairs) + 2 * n
    row, value, offset, places = np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(n, np.int32), np.random.default_rng(0)
    for a in sorted(rows, key=lambda a: (-len(rows[a]), a)):
        b = np.array([x for x, _ in rows[a]])
        at = 0
        while (row[at + b] >= 0).any():
            at = int(places.integers(size - n))
        offset[a] = at
        row[at + b], value[at + b] = a, [r for _, r in rows[a]]
    return offset, row, value


class Vocabulary:
    """What encoding and decoding need of a rank file."""

    def __init__(self, path: str):
        ranks = load_ranks(path)
        n = max(ranks.values()) + 1
        self.byte_ids = np.array([ranks[bytes([k])] for k in range(256)], np.int32)
        self.pairs = pair_ranks(ranks)
        self.offset, self.row, self.value = displaced(self.pairs, n)
        pieces = [b""] * n
        for w, r in ranks.items():
            pieces[r] = w
        self.piece_size = np.array([len(x) for x in pieces], np.int32)
        self.piece_at = (np.cumsum(self.piece_size) - self.piece_size).astype(np.int32)
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def fold(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, offsets of the words)."""
        got = [self._fold(words[k : k + SIDE_BY_SIDE]) for k in range(0, len(words), SIDE_BY_SIDE)] or [self._fold([])]
        return np.concatenate([x for x, _ in got]), np.concatenate(([0], np.cumsum(np.concatenate([n for _, n in got]))))

    def _fold(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids a word): words are merged side by side, a round merging one pair of each."""
        lengths = np.zeros(len(words), np.int64)
        out: list = [None] * len(words)
        for k, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[k] = merge_long(w, self.pairs, self.byte_ids.tolist())
                lengths[k] = len(out[k])
        rest = np.flatnonzero(lengths == 0)
        raw = words if len(rest) == len(words) else [words[k] for k in rest]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ids = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        number, done = rest, []
        # Finished words are set aside, so that a round costs what is still being merged.
        while len(number):
            begin = np.cumsum(sizes) - sizes
            r = np.full(len(ids), NONE, np.int32)
            if len(ids) > 1:
                x = self.offset[ids[:-1]] + ids[1:]
                np.copyto(r[:-1], self.value[x], where=self.row[x] == ids[:-1])
                r[begin[1:] - 1] = NONE
            best = np.minimum.reduceat(r, begin)
            live = best != NONE
            # The leftmost place of the smallest rank of each word.
            hit = np.flatnonzero(r == np.repeat(np.where(live, best, -1), sizes))
            first = np.ones(len(hit), bool)
            of = np.searchsorted(begin, hit, "right")
            first[1:] = of[1:] != of[:-1]
            at = hit[first]
            ids[at] = best[live]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            if not live.all():
                stop = np.repeat(~live, sizes)
                done.append((number[~live], sizes[~live], ids[stop]))
                keep &= ~stop
            ids, sizes, number = ids[keep], sizes[live] - 1, number[live]
        for n, s, _ in done:
            lengths[n] = s
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        flat = np.zeros(offsets[-1], np.int32)
        for k, x in enumerate(out):
            if x is not None:
                flat[offsets[k] : offsets[k + 1]] = x
        for n, s, x in done:
            flat[ranges(offsets[n], s)] = x
        return flat, lengths

    def bytes_of(self, ids: np.ndarray) -> bytes:
        """The pieces of ids, concatenated."""
        size = self.piece_size[ids]
        return self.piece_bytes[ranges(self.piece_at[ids], size)].tobytes()


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0]..begin[0]+size[0]-1, begin[1].., one after another."""
    begin, size = begin.astype(np.int64), size.astype(np.int64)
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())


def merge_long(word: bytes, ranks: dict[tuple[int, int], int], byte_ids: list[int]) -> list[int]:
    """The same merges with a heap: smallest rank first, then leftmost."""
    ids, n = [byte_ids[c] for c in word], len(word)
    nxt, prv = [*range(1, n + 1)], [*range(-1, n - 1)]
    heap = [(r, k, k + 1) for k in range(n - 1) if (r := ranks.get((ids[k], ids[k + 1]))) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        r, i, j = heapq.heappop(heap)
        if not (alive[i] and j < n and alive[j] and nxt[i] == j and ranks.get((ids[i], ids[j])) == r):
            continue
        ids[i], alive[j] = r, False
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        for a, b in ((prv[i], i), (i, nxt[i])):
            if a >= 0 and b < n and (s := ranks.get((ids[a], ids[b]))) is not None:
                heapq.heappush(heap, (s, a, b))
    return [x for x, ok in zip(ids, alive, strict=True) if ok]


def encode(docs: DataFrame, vocabulary: Vocabulary, pattern: str, text: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs without their text and with ``out``, each whole text's ids as little-endian unsigned 32-bit integers. If
    decoded is given, a column of that name has the bytes that the ids decode to, worked out in the same worker."""
    ship(docs.sparkSession)
    docs = docs.drop(*({out, decoded} - {text, None}))
    more = [out] if decoded is None else [out, decoded]
    rest = [c for c in docs.columns if c != text]
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        import regex

        find, v = regex.compile(pattern).findall, shared.value
        for b in batches:
            for x in slices(b, 0, BLOCK):
                number: dict[str, int] = {}
                of, n = [], [0]
                for t in x.column(0).to_pylist():
                    if t:
                        of += [number.setdefault(w, len(number)) for w in find(t)]
                    n.append(len(of))
                flat, offsets = v.fold([w.encode("utf-8", "replace") for w in number])
                at = np.array(of, np.int64)
                size = (offsets[1:] - offsets[:-1])[at] if len(at) else at
                ids = flat[ranges(offsets[at], size)].astype("<u4")
                ends = 4 * np.concatenate(([0], np.cumsum(size)))[n]
                blob = pa.Array.from_buffers(pa.large_binary(), len(n) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
                del of, at, size, number
                back = [] if decoded is None else [pa.array([v.bytes_of(ids[a:b]) for a, b in zip(ends[:-1] // 4, ends[1:] // 4, strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays([*x.columns[1:], blob, *back], names=[*rest, *more])

    return docs.select(text, *rest).mapInArrow(lean(run), schema_with(docs.select(rest), *((c, "binary") for c in more)))


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """encoded with ``out``, the bytes of its ids (null stays null)."""
    ship(encoded.sparkSession)
    encoded = encoded.drop(*({out} - {ids}))
    at = encoded.columns.index(ids)
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        v = shared.value
        for b in batches:
            for k in range(0, b.num_rows, 256):
                x = b.slice(k, 256)
                got = [None if y is None else v.bytes_of(np.frombuffer(y, "<u4")) for y in x.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*x.columns, pa.array(got, pa.binary())], names=[*x.schema.names, out])

    return encoded.mapInArrow(run, schema_with(encoded, (out, "binary")))


def round_trip(docs: DataFrame, vocabulary: Vocabulary, pattern: str, text: str = "text") -> DataFrame:
    """docs without text and with n_tokens, ids_sha256 and decoded_sha256."""
    got = encode(docs, vocabulary, pattern, text, decoded="decoded")
    rest = [c for c in docs.columns if c not in (text, "ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")]
    return got.select(*rest, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
