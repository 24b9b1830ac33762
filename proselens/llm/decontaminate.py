"""Benchmark decontamination by greedy string tiling.

Seeds are runs of MIN_MATCH shared tokens (words, A-Z lower-cased). Documents are joined with benchmark items through
their seeds' Karp-Rabin hashes; a pair whose seeds could cover enough of the item is tiled: the longest unmarked common
run is marked in both texts, again and again, until none of MIN_MATCH tokens is left. The share of an item's tokens
that tiles cover doesn't depend on the tiles' order, so reordered passages are caught. A document is contaminated by
the items of which it covers COVERAGE or more.

The benchmark is the small, fixed side. It is broadcast in slices of at most SLICE_WORDS words, its size being counted
first; a larger benchmark takes a pass for every slice, and rows are the same. Items of fewer than MIN_MATCH words match as a whole.

A document with far more pairs of equal places than words, as texts that repeat themselves have, is tiled without listing
them; the tiles are the same.

Defined results: null and empty texts and items match nothing; repeated items and documents each give their own rows.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, lean, ship
from .words import BASES, Words, slices, windows

MIN_MATCH = 5
COVERAGE = 0.75
SLICE_WORDS = 4_000_000
CHUNK = 1_000_000
#: Pairs of equal places a word of a document, beyond which they aren't listed.
HEAVY = 64


def tile(item: np.ndarray, doc: np.ndarray, i: np.ndarray, j: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling from seeds (item[i:i+least] == doc[j:j+least]): tiles (place in item, place in doc, length),
    longest first, ties to the first place in the item and then in the document."""
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    cut = np.flatnonzero((np.diff(j - i) != 0) | (np.diff(i) != 1)) + 1
    begin, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(i)]))
    # The longest first; each is looked at once, and what is left of it goes back.
    heap = [(-(int(b - a) + least - 1), int(i[a]), int(j[a])) for a, b in zip(begin, end, strict=True)]
    heapq.heapify(heap)
    in_item, in_doc, tiles = np.zeros(len(item), bool), np.zeros(len(doc), bool), []
    while heap:
        n, x, y = heapq.heappop(heap)
        n = -n
        marked = in_item[x : x + n] | in_doc[y : y + n]
        if not marked.any():
            # The hashes only led here; the tokens decide.
            if np.array_equal(item[x : x + n], doc[y : y + n]):
                tiles.append((x, y, n))
                in_item[x : x + n] = True
                in_doc[y : y + n] = True
            continue
        # What is still free of it may be a shorter match.
        edges = np.flatnonzero(np.diff(np.concatenate(([True], marked, [True])).astype(np.int8))).reshape(-1, 2)
        for k, e in edges.tolist():
            if e - k >= least:
                heapq.heappush(heap, (k - e, x + k, y + k))
    return tiles


def tile_by_length(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The tiles of ``tile`` without its seeds, for texts that repeat themselves: the longest common run of unmarked tokens
    is found by halving its length, so memory is in proportion to the texts and time to the tiles. Runs are compared by
    dense ranks of their first and last 2**k tokens, which are exact."""
    both = np.unique(np.concatenate((item, doc)), return_inverse=True)[1].astype(np.int64)
    ranks, m = [both], len(item)
    while 2 << len(ranks) - 1 <= min(m, len(doc)):
        r, w = ranks[-1], 1 << len(ranks) - 1
        # Windows over the end of the item mean nothing and are never looked at.
        ranks.append(np.unique(r[: len(r) - w] << 32 | r[w:], return_inverse=True)[1].astype(np.int64))
    taken = [np.zeros(m + 1, np.int64), np.zeros(len(doc) + 1, np.int64)]
    marks = [np.zeros(m, bool), np.zeros(len(doc), bool)]

    def first_common(n: int) -> tuple[int, int] | None:
        k = n.bit_length() - 1
        sides = []
        for at, marked, size in ((0, taken[0], m), (m, taken[1], len(doc))):
            places = np.flatnonzero(marked[n:] == marked[: size + 1 - n])
            sides.append((places, ranks[k][at + places] << 32 | ranks[k][at + places + n - (1 << k)]))
        (x, a), (y, b) = sides
        hit = np.flatnonzero(np.isin(a, b))
        return (int(x[hit[0]]), int(y[np.flatnonzero(b == a[hit[0]])[0]])) if len(hit) else None

    tiles, longest = [], min(m, len(doc))
    while True:
        best, lo = None, least
        while lo <= longest:
            n = (lo + longest) // 2
            if at := first_common(n):
                best, lo = (*at, n), n + 1
            else:
                longest = n - 1
        if best is None:
            return tiles
        x, y, longest = best
        tiles.append(best)
        for side, at in ((0, x), (1, y)):
            marks[side][at : at + longest] = True
            np.cumsum(marks[side], out=taken[side][1:])


class Seeds:
    """The seeds of a slice of the benchmark: hashes in order, with item and place."""

    def __init__(self, items: list[tuple[int, str]], least: int):
        w = Words(pa.array([t or "" for _, t in items], pa.string()), True)
        h = w.hashes()
        self.ids, self.tokens = [x for x, _ in items], [h[a:b] for a, b in zip(w.doc[:-1], w.doc[1:], strict=True)]
        n, self.by = np.diff(w.doc), []
        for width in sorted({min(int(x), least) for x in n if x}):
            at, keys = windows(h, w.doc, width, BASES[1])
            item = np.searchsorted(w.doc, at, "right") - 1
            ok = np.minimum(n[item], least) == width
            at, keys, item = at[ok], keys[ok], item[ok]
            order = np.argsort(keys, kind="stable")
            self.by.append((width, keys[order], item[order], (at - w.doc[item])[order]))

    def pairs(self, w: Words, coverage: float):
        """(document row, item, covered tokens, tiles) of the texts in w."""
        h = w.hashes()
        for width, keys, item, place in self.by:
            at, got = windows(h, w.doc, width, BASES[1])
            lo = np.searchsorted(keys, got)
            hit = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == got)
            if not len(hit):
                continue
            at, got, lo = at[hit], got[hit], lo[hit]
            n = np.searchsorted(keys, got, "right") - lo
            doc = np.searchsorted(w.doc, at, "right") - 1
            # Texts that repeat themselves have more pairs of places than words by far: they don't list them.
            heavy = np.bincount(doc, n, len(w.doc) - 1) > np.maximum(HEAVY * np.diff(w.doc), 100_000)
            for d in np.flatnonzero(heavy).tolist():
                yield from self._heavy(d, h[w.doc[d] : w.doc[d + 1]], np.unique(lo[doc == d]), keys, item, place, width, coverage)
            light = ~heavy[doc]
            at, lo, n, doc = at[light], lo[light], n[light], doc[light]
            if not len(at):
                continue
            # Which items each document could be full of: item places under any seed, counted before the seeds are paired up.
            k = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pair = np.repeat(doc, n) * len(self.ids) + item[k]
            where = np.repeat(at, n)
            order = np.argsort(pair, kind="stable")
            pair, k, where = pair[order], k[order], where[order]
            cut = np.concatenate(([0], np.flatnonzero(np.diff(pair)) + 1, [len(pair)]))
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                d, t = divmod(int(pair[a]), len(self.ids))
                tokens, i = self.tokens[t], place[k[a:b]]
                reach = np.zeros(len(tokens), bool)
                reach[(i[:, None] + np.arange(width)).ravel()] = True
                if reach.sum() < coverage * len(tokens):
                    continue
                mine = h[w.doc[d] : w.doc[d + 1]]
                tiles = tile(tokens, mine, i, where[a:b] - int(w.doc[d]), width)
                covered = sum(x[2] for x in tiles)
                if covered >= coverage * len(tokens):
                    yield d, t, covered, len(tiles)


    def _heavy(self, d: int, mine: np.ndarray, first: np.ndarray, keys, item, place, width: int, coverage: float):
        """pairs() of one document from the distinct seeds that it has (where each begins in keys)."""
        n = np.searchsorted(keys, keys[first], "right") - first
        k = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        order = np.argsort(item[k], kind="stable")
        k = k[order]
        cut = np.concatenate(([0], np.flatnonzero(np.diff(item[k])) + 1, [len(k)]))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            t = int(item[k[a]])
            tokens, reach = self.tokens[t], np.zeros(len(self.tokens[t]), bool)
            for j in range(width):
                reach[place[k[a:b]] + j] = True
            if reach.sum() < coverage * len(tokens):
                continue
            tiles = tile_by_length(tokens, mine, width)
            covered = sum(x[2] for x in tiles)
            if covered >= coverage * len(tokens):
                yield d, t, covered, len(tiles)


def _slices(benchmark: DataFrame, item_id: str, text: str, bound: int) -> list[DataFrame]:
    """The benchmark in slices of about bound words, by hash, after counting its words."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = rows.agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("n")).first()["n"] or 0
    n = -(-words // bound)
    return [rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows for k in range(n)]


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, item_words, covered_words, n_tiles, coverage): every document with every item that it covers."""
    spark = docs.sparkSession
    ship(spark)
    schema = "doc_id long, item_id long, item_words long, covered_words long, n_tiles long, coverage double"
    used = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = []
    for part in _slices(benchmark, item_id, item_text, SLICE_WORDS):
        seeds = spark.sparkContext.broadcast(Seeds([tuple(r) for r in part.collect()], min_match))

        def run(batches, seeds=seeds):
            s = seeds.value
            for b in batches:
                for x in slices(b, 1, CHUNK):
                    ids = x.column(0).to_pylist()
                    rows = [(ids[d], s.ids[t], len(s.tokens[t]), c, n, c / len(s.tokens[t])) for d, t, c, n in s.pairs(Words(x.column(1), True), coverage)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["doc_id", "item_id", "item_words", "covered_words", "n_tiles", "coverage"])

        out.append(used.mapInArrow(lean(run), schema))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """docs without the contaminated ones, all columns kept; no shuffle, as each row decides for itself."""
    spark = docs.sparkSession
    ship(spark)
    at = docs.columns.index(text)
    for part in _slices(benchmark, item_id, item_text, SLICE_WORDS):
        seeds = spark.sparkContext.broadcast(Seeds([tuple(r) for r in part.collect()], min_match))

        def run(batches, seeds=seeds):
            for b in batches:
                for x in slices(b, at, CHUNK):
                    bad = {d for d, *_ in seeds.value.pairs(Words(x.column(at), True), coverage)}
                    yield x.take(pa.array([k for k in range(x.num_rows) if k not in bad], pa.int64())) if bad else x

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs
