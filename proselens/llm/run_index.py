"""A run-length index of many short texts: the runs of their Burrows-Wheeler transform and samples at the runs' ends.

Suffixes of all texts are sorted; every text ends in a separator of its own, in the order of the texts, so that no match
crosses texts. The transform's rows fall into runs of one preceding byte. Inside of a run neighbouring rows stay
neighbours when both are extended to the left, so their common prefix grows by one; hence only the rows at the runs' ends
are kept, each with its place in the text and the length of what it shares with the row beyond. From these samples the
matching statistics of the texts (for each place the longest match that starts anywhere else) follow in one pass from left to right:
a sample sets the length, each place after it has one less.

Texts are bytes without 0xFF, as UTF-8 is.
"""

from __future__ import annotations

import numpy as np


def _keys(x: np.ndarray) -> np.ndarray:
    """Of each place the next eight symbols, nothing behind a separator."""
    k = x.astype(np.uint64)
    for step in (1, 2, 4):
        after = np.concatenate((k[step:], np.zeros(step, np.uint64)))[: len(k)]
        # A separator or what stands for nothing behind it is a zero.
        k = (k << np.uint64(8 * step)) | np.where(k & np.uint64(255), after, np.uint64(0))
    return k


def suffixes(keys: np.ndarray) -> np.ndarray:
    """The places in the order of their suffixes, by doubling the length that is sorted; places whose suffixes are settled
    are left alone."""
    n = len(keys)
    order = np.argsort(keys)
    k = keys[order]
    # What ends within the key is settled: equal ones are in the order of their separators.
    ended = np.flatnonzero((k & np.uint64(255)) == 0)
    order[ended] = order[ended][np.lexsort((order[ended], k[ended]))]
    starts = np.concatenate(([True], k[1:] != k[:-1]))
    starts[ended] = True
    at = np.flatnonzero(starts)
    size = np.diff(np.concatenate((at, [n])))
    rank, h = np.empty(n, np.int64), 8
    rank[order] = np.repeat(at, size)
    slots = np.flatnonzero(np.repeat(size > 1, size))
    while len(slots):
        # Only rows whose suffixes are alike so far are sorted again, within their slots.
        places = order[slots]
        key = (rank[places] << 32) | rank[places + h]
        moved = np.argsort(key)
        places, key = places[moved], key[moved]
        order[slots] = places
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.concatenate((at, [len(slots)])))
        rank[places] = np.repeat(slots[at], size)
        slots = slots[np.repeat(size > 1, size)]
        h *= 2
    return order


def shared(keys: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many bytes the suffixes at i and j have in common."""
    out, at = np.zeros(len(i), np.int64), np.arange(len(i))
    while len(at):
        a, b = keys[i[at] + out[at]], keys[j[at] + out[at]]
        # Equal bytes at the front, up to a separator.
        differ = a ^ b
        same = np.zeros(len(at), np.int64)
        for byte in range(8):
            shift = np.uint64(56 - 8 * byte)
            same += (same == byte) & (((differ >> shift) & np.uint64(255)) == 0) & (((a >> shift) & np.uint64(255)) != 0)
        out[at] += same
        at = at[same == 8]
    return out


class RunIndex:
    """heads, tails: places of the suffixes at the first and the last row of each run; with what they share with the row
    before and after. symbols, starts: the runs themselves (a symbol is a byte and one, 0 a text's begin)."""

    def __init__(self, texts: list[bytes]):
        size = np.array([len(t) + 1 for t in texts], np.int64)
        self.begin = np.cumsum(size) - size
        # b"\xff" becomes the separator 0, all other bytes go up by one.
        x = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8) + np.uint8(1)
        self.n = len(x)
        keys = _keys(x)
        rows = suffixes(keys)
        before = np.where(rows > 0, x[rows - 1], 0)
        # Each separator is a run of its own.
        change = (before[1:] != before[:-1]) | (before[1:] == 0)
        self.starts = np.concatenate(([0], np.flatnonzero(change) + 1))
        self.symbols = before[self.starts]
        ends = np.concatenate((self.starts[1:], [self.n])) - 1
        self.heads, self.tails = rows[self.starts], rows[ends]
        above = rows[np.maximum(self.starts - 1, 0)]
        common = shared(keys, self.heads[1:], above[1:])
        self.head_length = np.concatenate(([0], common))
        # What a run's head shares with the row before is what that row, a tail, shares with the row after it.
        self.tail_length = np.concatenate((common, [0]))

    def matching_statistics(self) -> np.ndarray:
        """For each place (a text's places and its separator's, text after text) the length of the longest match elsewhere."""
        best = np.zeros(self.n, np.int64)
        for places, length in ((self.heads, self.head_length), (self.tails, self.tail_length)):
            to = np.zeros(self.n, np.int64)
            to[places] = places + length
            best = np.maximum(best, np.maximum.accumulate(to) - np.arange(self.n))
        return best
