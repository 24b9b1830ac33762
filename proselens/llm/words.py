"""Word hashes of whole batches of texts, without a Python object a word.

A word is a run of bytes other than the six ASCII white-space bytes. Its hash is a polynomial over its bytes modulo
2**64, mixed afterwards; prefix sums give all words of a batch at once. Such polynomials are equal for certain texts of
1,024 and more symbols whatever the base, so words of over LONG bytes are hashed by xxh3, and runs of words that are
hashed as polynomials over the words' hashes have at most LONG of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_M64 = (1 << 64) - 1
LONG = 64
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0..n-1 and its inverses modulo 2**64 (base is odd)."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        have = tuple(_powers(b, size) for b in (base, inverse))
        _POWERS[base] = have
    return have[0][:n], have[1][:n]


def _powers(b: int, size: int) -> np.ndarray:
    x = np.full(size, b & _M64, np.uint64)
    x[0] = 1
    return np.multiply.accumulate(x)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def spans(x: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of x[begin[i]:end[i]] (u64, unmixed), x being u64 values."""
    p, q = powers(base, len(x) + 1)
    s = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * p[: len(x)], out=s[1:])
    return (s[end] - s[begin]) * q[begin]


class Words:
    """The words of a batch of texts. doc: offsets of documents in the words; begin, end: byte places in data."""

    def __init__(self, texts: pa.Array, lower: bool):
        texts = texts.cast(pa.large_string()) if texts.null_count == 0 else texts.cast(pa.large_string()).fill_null("")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        self.offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        raw = texts.buffers()[2]
        first, last = int(self.offsets[0]), int(self.offsets[-1])
        self.data = np.frombuffer(raw, np.uint8)[first:last] if raw is not None and last > first else np.zeros(0, np.uint8)
        self.offsets = self.offsets - first
        used = _LOWER[self.data] if lower else self.data
        solid = ~_SPACE[self.data]
        # A word ends at a space or where its document ends.
        before = np.concatenate(([False], solid[:-1])) if len(solid) else solid.copy()
        starts = self.offsets[:-1][np.diff(self.offsets) > 0]
        before[starts] = False
        self.begin = np.flatnonzero(solid & ~before)
        after = np.concatenate((solid[1:], [False])) if len(solid) else solid.copy()
        ends = self.offsets[1:][np.diff(self.offsets) > 0]
        after[ends - 1] = False
        self.end = np.flatnonzero(solid & ~after) + 1
        self.doc = np.searchsorted(self.begin, self.offsets)
        self._used = used

    def hashes(self, base: int = BASES[0]) -> np.ndarray:
        """A u64 a word. Worked out in runs of words, so that the powers' table stays in the cache."""
        out, n = np.zeros(len(self.begin), np.uint64), len(self.begin)
        k = 0
        while k < n:
            stop = int(np.searchsorted(self.end, self.begin[k] + (1 << 18)))
            stop = max(stop, k + 1)
            a, b = int(self.begin[k]), int(self.end[stop - 1])
            # +1: a zero byte counts, too.
            out[k:stop] = spans(self._used[a:b].astype(np.uint64) + np.uint64(1), self.begin[k:stop] - a, self.end[k:stop] - a, base)
            k = stop
        size = self.end - self.begin
        for k in np.flatnonzero(size > LONG).tolist():
            out[k] = xxhash.xxh3_64_intdigest(self._used[self.begin[k] : self.end[k]].tobytes(), base & _M64)
        return mix(out + size.astype(np.uint64))

    def text(self, k: int, keep: np.ndarray | None = None) -> bytes:
        """Document k's words, or those that keep (a mask over them) has, joined by one space."""
        a, b = int(self.doc[k]), int(self.doc[k + 1])
        at = np.arange(a, b) if keep is None else np.flatnonzero(keep) + a
        raw = self.data
        return b" ".join([raw[self.begin[i] : self.end[i]].tobytes() for i in at])


def windows(h: np.ndarray, doc: np.ndarray, width: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, mixed u64 hashes) of all runs of width words that lie within a document."""
    assert width <= LONG
    n = np.diff(doc)
    count = np.maximum(n - width + 1, 0)
    at = np.arange(count.sum()) + np.repeat(doc[:-1] - np.concatenate(([0], np.cumsum(count)[:-1])), count)
    return at, mix(spans(h, at, at + width, base)) if len(at) else np.zeros(0, np.uint64)


def slices(batch: pa.RecordBatch, column: int, size: int):
    """The batch in runs of rows whose texts have about size bytes together."""
    if batch.num_rows == 0:
        return
    n = np.array(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    total, begin = np.cumsum(n), 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + size, "right")))
        yield batch.slice(begin, end - begin)
        begin = end
