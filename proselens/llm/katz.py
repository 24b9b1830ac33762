"""A Katz back-off language model over words: Good-Turing discounted bigram and unigram counts with exactly normalised
back-off weights.

P(w | h) = d(c(h, w)) c(h, w) / c(h) if the pair was seen, else a(h) P(w); P(w) = d(c(w)) c(w) / N if the word was seen,
else the mass that discounting leaves, which all unknown words share as one event. a(h) is the mass that h's seen pairs
leave, divided by the unigram mass of all words not seen after h, so each context sums to one. Counts over GT_MAX aren't
discounted. Where the counts of counts give no discount between 0 and 1 for some count, that count is discounted by half
a count instead. A context without left-over mass (all its counts are high) gets one more in its denominator, which is
the mass of its unseen words.

Documents begin in the context of their start and end with an end token. Words are A-Z lower-cased; a word is known by a
64-bit hash.

Tables are partitioned by key. Counts travel block by block (see text_blocks): a block's distinct words go to the
partitions of the unigram table, which number them and send count and number back; its distinct pairs then go to the
partitions of the bigram table, packed, which send back the sums that the back-off weights need and those pair counts
that the block doesn't know from its own documents. Scoring is then local to the block. A frequent word's pairs are
spread by their second word.

Defined results: null and empty texts are the end token alone. Without training documents every token is unknown and
unknown tokens have probability 1, so scores are 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, parts, ship
from .text_blocks import Blocks, by_part
from .words import Words, mix

BLOCK = 8_000_000
GT_MAX = 5
#: A first word this frequent has its pairs dealt out over HOT_SPREAD partitions.
HOT, HOT_SPREAD = 100_000, 64
_END = np.uint64(0x5851F42D4C957F2D)
#: The number of the start context; words are numbered from 1.
START = 0


def discounts(n: list[int]) -> np.ndarray:
    """d(0..GT_MAX) from the counts of counts n[1..GT_MAX + 1]; d(0) is unused."""
    d = np.ones(GT_MAX + 1)
    a = (GT_MAX + 1) * n[GT_MAX + 1] / n[1] if n[1] else 1.0
    for c in range(1, GT_MAX + 1):
        x = (((c + 1) * n[c + 1] / (c * n[c]) - a) / (1 - a)) if n[c] and a != 1 else -1.0
        d[c] = x if 0 < x < 1 else (c - 0.5) / c
    return d


def _zip(x: np.ndarray) -> bytes:
    """Numbers as bytes that compress: planes of equal significance side by side."""
    if not len(x):
        return b""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T), "zstd", asbytes=True)


def _unzip(b: bytes, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    raw = pa.decompress(b, n * size, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).ravel()


def _columns(t: pa.Table, names: dict[str, type]) -> tuple[list[np.ndarray], np.ndarray]:
    """Zipped columns of all rows, one row's after the other, and the rows' offsets (from column n)."""
    n = t.column("n").to_numpy()
    out = []
    for c, kind in names.items():
        rows = [_unzip(x, k, kind) for x, k in zip(t.column(c).to_pylist(), n.tolist(), strict=True)]
        out.append(np.concatenate(rows) if rows else np.zeros(0, kind))
    return out, np.concatenate(([0], np.cumsum(n)))


class _Tokens:
    """A block's tokens: word hashes with an end after each document."""

    def __init__(self, t: pa.Table):
        w = Words(t.column("text"), True)
        h = w.hashes()
        n = np.diff(w.doc)
        self.doc = w.doc + np.arange(len(w.doc))
        hashes = np.full(len(h) + len(n), _END, np.uint64)
        at = np.arange(len(h)) + np.repeat(np.arange(len(n)), n)
        hashes[at] = h
        self.train = ~t.column("held_out").to_numpy().astype(bool)
        self.of = np.repeat(np.arange(len(n)), n + 1)
        # Distinct words in hash order; tokens as places in it.
        self.unique, self.at = np.unique(hashes, return_inverse=True)
        self.counts = np.bincount(self.at, self.train[self.of], len(self.unique)).astype(np.int64)


#: Counts of a block fit 32 bits, those of the corpus don't; c2 is a word's count in the corpus.
_WORDS = {"key": np.uint64, "count": np.uint32}
_PAIRS = {"first": np.uint32, "second": np.uint32, "count": np.uint32, "c2": np.uint64}
_SUMS = ("many", "mass", *(f"m{k}" for k in range(1, GT_MAX + 1)))


def _table(rows: list[tuple], kinds: dict) -> pa.Table:
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(kinds.items())})


def _batches(t: pa.Table):
    return t.to_batches() if t.num_rows else []


class Model:
    """Counts over the training documents of docs (doc_id, text, held_out), and scores of all of them."""

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        ship(spark)
        self.n_parts = 2 * parts(spark)
        self.blocks = Blocks(docs, "text", BLOCK)
        self.unigrams = materialise(self._count_words(), "unigrams")
        totals = self.unigrams.groupBy("part").agg(*(F.first(c).alias(c) for c in ("tokens", "distinct", "coc"))).agg(F.sum("tokens").alias("n"), F.sum("distinct").alias("v"), F.array(*(F.sum(F.col("coc")[k]) for k in range(GT_MAX + 2))).alias("coc")).first()
        self.tokens, self.distinct = int(totals["n"] or 0), int(totals["v"] or 0)
        coc = [int(x or 0) for x in totals["coc"]]
        self.uni = _Unigram(self.tokens, discounts(coc), coc)
        self.bigrams = materialise(self._count_pairs(), "bigrams")
        pairs = self.bigrams.groupBy("part").agg(F.first("coc").alias("coc")).agg(F.array(*(F.sum(F.col("coc")[k]) for k in range(GT_MAX + 2))).alias("coc")).first()
        self.pair_discounts = discounts([int(x or 0) for x in pairs["coc"]])

    def _count_words(self) -> DataFrame:
        n_parts = self.n_parts
        sent = {"part": pa.int32(), "block": pa.int64(), "n": pa.int64(), "key": pa.binary(), "count": pa.binary()}

        def words(block, t):
            x = _Tokens(t)
            rows = [(p, block, len(o), _zip(x.unique[o]), _zip(x.counts[o].astype(np.uint32))) for p, o in by_part((mix(x.unique) % np.uint64(n_parts)).astype(np.int64), n_parts)]
            yield from _batches(_table(rows, sent))

        def number(t: pa.Table) -> pa.Table:
            (key, count), cut = _columns(t, _WORDS)
            part = t.column("part")[0].as_py()
            unique, of = np.unique(key, return_inverse=True)
            c = np.bincount(of, count).astype(np.int64)
            # Numbers of other partitions lie in between; frequent words get small ones.
            rank = np.empty(len(c), np.int64)
            rank[np.argsort(-c, kind="stable")] = np.arange(len(c))
            ids = (rank * n_parts + part + 1)[of].astype(np.uint32)
            counts = c[of].astype(np.uint64)
            if len(c) and int(rank.max()) * n_parts + part + 1 > 0xFFFFFFFF - HOT_SPREAD:
                raise ValueError("over 2**32 distinct words: use more key partitions")
            coc = np.bincount(np.minimum(c[c > 0], GT_MAX + 2), minlength=GT_MAX + 3)[: GT_MAX + 2].tolist()
            total, seen = int(c.sum()), int((c > 0).sum())
            rows = [(block, part, int(b - a), _zip(ids[a:b]), _zip(counts[a:b]), total, seen, coc) for block, a, b in zip(t.column("block").to_pylist(), cut[:-1], cut[1:], strict=True)]
            return _table(rows, {"block": pa.int64(), "part": pa.int32(), "n": pa.int64(), "id": pa.binary(), "count": pa.binary(), "tokens": pa.int64(), "distinct": pa.int64(), "coc": pa.list_(pa.int64())})

        keyed = self.blocks.emit(words, "part int, block long, n long, key binary, count binary")
        return keyed.groupBy("part").applyInArrow(number, "block long, part int, n long, id binary, count binary, tokens long, distinct long, coc array<long>")

    def _count_pairs(self) -> DataFrame:
        n_parts, uni = self.n_parts, self.uni
        sent = {"part": pa.int32(), "block": pa.int64(), "n": pa.int64(), "first": pa.binary(), "second": pa.binary(), "count": pa.binary(), "c2": pa.binary()}

        def pairs(block, t, answers):
            x = _Numbered(t, answers, n_parts)
            rows = []
            for p, o in x.dealt(n_parts):
                first, second = x.first[o].astype(np.uint32), x.second[o].astype(np.uint32)
                step = np.diff(first, prepend=np.uint32(0))
                rows.append((p, block, len(o), _zip(step), _zip(second), _zip(x.pair_counts[o].astype(np.uint32)), _zip(x.count_of_second[o].astype(np.uint64))))
            return _table(rows, sent)

        def total(t: pa.Table) -> pa.Table:
            (step, second, count, c2), cut = _columns(t, _PAIRS)
            first = np.concatenate([np.cumsum(step[a:b], dtype=np.uint32) for a, b in zip(cut[:-1], cut[1:], strict=True)])
            unique, at, of = np.unique(first.astype(np.uint64) << np.uint64(32) | second, return_index=True, return_inverse=True)
            c = np.bincount(of, count).astype(np.int64)
            # For every first word: its pairs by count, the counts over GT_MAX together, and the unigram mass of its seen seconds.
            head = (unique >> np.uint64(32)).astype(np.uint32)
            heads, hof = np.unique(head, return_inverse=True)
            sums = [np.bincount(hof, c * (c > GT_MAX), len(heads)), np.bincount(hof, uni.p(c2[at]) * (c > 0), len(heads))] + [np.bincount(hof, c == k, len(heads)) for k in range(1, GT_MAX + 1)]
            coc = np.bincount(np.minimum(c[c > 0], GT_MAX + 2), minlength=GT_MAX + 3)[: GT_MAX + 2].tolist()
            part, rows = t.column("part")[0].as_py(), []
            for block, a, b in zip(t.column("block").to_pylist(), cut[:-1], cut[1:], strict=True):
                mine = c[of[a:b]]
                other = np.flatnonzero(mine != count[a:b])
                own = np.searchsorted(heads, np.unique(first[a:b]))
                rows.append((block, part, len(other), _zip(other.astype(np.uint32)), _zip(mine[other]), len(own), _zip(sums[0][own].astype(np.int64)), _zip(sums[1][own]), *(_zip(s[own].astype(np.uint32)) for s in sums[2:]), coc))
            kinds = {"block": pa.int64(), "part": pa.int32(), "n": pa.int64(), "place": pa.binary(), "count": pa.binary(), "heads": pa.int64(), **{c: pa.binary() for c in _SUMS}, "coc": pa.list_(pa.int64())}
            return _table(rows, kinds)

        keyed = self.blocks.answer(self.unigrams.select("block", "part", "n", "id", "count"), pairs, "part int, block long, n long, first binary, second binary, count binary, c2 binary")
        return keyed.groupBy("part").applyInArrow(total, "block long, part int, n long, place binary, count binary, heads long, " + "".join(f"{c} binary, " for c in _SUMS) + "coc array<long>")

    def scores(self) -> DataFrame:
        """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
        n_parts, uni, d, n, v = self.n_parts, self.uni, self.pair_discounts, self.tokens, self.distinct
        kinds = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}

        def score(block, t, answers):
            is_pair = answers.column("kind").to_numpy() == 1
            x = _Numbered(t, answers.filter(pa.array(~is_pair)), n_parts)
            c = x.pair_counts.copy()
            got = {r["part"]: r for r in answers.filter(pa.array(is_pair)).to_pylist()}
            heads, hof = np.unique(x.first, return_inverse=True)
            sums = np.zeros((len(_SUMS), len(heads)))
            for p, o in x.dealt(n_parts):
                r = got[p]
                c[o[_unzip(r["place"], r["n"], np.uint32)]] = _unzip(r["count"], r["n"], np.int64)
                own = np.searchsorted(heads, np.unique(x.first[o]))
                for k, s in enumerate(_SUMS):
                    sums[k, own] += _unzip(r[s], r["heads"], np.int64 if s == "many" else np.float64 if s == "mass" else np.uint32)
            context = np.zeros(len(heads))
            context[hof] = x.count_of_first
            mass = sums[0] + sum(k * d[k] * sums[1 + k] for k in range(1, GT_MAX + 1))
            # One more in the denominator where nothing would be left.
            bottom = np.where((context - mass) <= 1e-9 * np.maximum(context, 1), context + 1, context)
            left = np.where(context > 0, 1 - mass / np.maximum(bottom, 1e-300), 1.0)
            rest = np.where(context > 0, 1 - sums[1], 1.0)
            alpha = left / np.maximum(rest, 1e-300)
            p2 = uni.p(x.count_of_second)
            seen = c > 0
            p = np.where(seen, np.where(c <= GT_MAX, d[np.minimum(c, GT_MAX)], 1.0) * c / np.maximum(bottom[hof], 1e-300), alpha[hof] * p2)
            log = np.log10(np.maximum(p, 1e-300))[x.pair_at]
            counts = x.word_counts[x.tokens.at]
            base = np.log10((counts + 1.0) / (n + (v + 1)))
            add = lambda y: np.add.reduceat(y, x.tokens.doc[:-1]) if t.num_rows else y
            return pa.table([t.column("doc_id").cast(pa.int64()), t.column("held_out"), pa.array(np.diff(x.tokens.doc)), pa.array(add((counts > 0).astype(np.int64))), pa.array(np.full(t.num_rows, n)), pa.array(add(base)), pa.array(add(log))], names=list(kinds))

        nothing = lambda *names: [F.lit(None).cast("binary").alias(c) for c in names]
        one = self.unigrams.select("block", "part", "n", "id", "count", F.lit(0).alias("kind"), *nothing("place"), F.lit(0).cast("long").alias("heads"), *nothing(*_SUMS))
        two = self.bigrams.select("block", "part", "n", *nothing("id"), "count", F.lit(1).alias("kind"), "place", "heads", *_SUMS)
        return self.blocks.answer(one.unionByName(two), score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


class _Unigram:
    """Discounted unigram probabilities by count."""

    def __init__(self, tokens: int, d: np.ndarray, coc: list[int]):
        self.d, self.n = d, tokens
        low = sum(k * coc[k] for k in range(1, GT_MAX + 1))
        kept = tokens - low + sum(k * d[k] * coc[k] for k in range(1, GT_MAX + 1))
        if tokens and kept >= tokens:
            self.n = tokens + 1
        self.unknown = 1 - kept / self.n if tokens else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        c = c.astype(np.int64)
        return np.where(c > 0, np.where(c <= GT_MAX, self.d[np.minimum(c, GT_MAX)], 1.0) * c / max(self.n, 1), self.unknown)


class _Numbered:
    """A block's tokens with the numbers and counts of their words, and its distinct pairs in order."""

    def __init__(self, t: pa.Table, answers: pa.Table, n_parts: int):
        x = self.tokens = _Tokens(t)
        got = {p: (n, i, c) for p, n, i, c in zip(*(answers.column(k).to_pylist() for k in ("part", "n", "id", "count")), strict=True)}
        ids, counts = np.zeros(len(x.unique), np.int64), np.zeros(len(x.unique), np.int64)
        for p, o in by_part((mix(x.unique) % np.uint64(n_parts)).astype(np.int64), n_parts):
            n, i, c = got[p]
            ids[o], counts[o] = _unzip(i, n, np.uint32), _unzip(c, n, np.uint64)
        self.word_counts = counts
        second = ids[x.at]
        first = np.concatenate(([START], second[:-1])) if len(second) else second
        first[x.doc[:-1]] = START
        seen, at = np.unique(first << 32 | second, return_inverse=True)
        order = np.argsort(ids)
        ordered = ids[order]

        def count_of(y: np.ndarray) -> np.ndarray:
            k = np.minimum(np.searchsorted(ordered, y), len(ordered) - 1)
            return np.where(ordered[k] == y, counts[order[k]], 0)

        # The start occurs as often as there are training documents, each of which has one end.
        end = counts[np.searchsorted(x.unique, _END)]
        of_first = lambda y: np.where(y == START, end, count_of(y))
        # Of a frequent first word, the sums of all its partitions are wanted: a pair that never occurs asks each.
        heads = np.unique(seen >> 32)
        heads = heads[of_first(heads) >= HOT]
        asked = (heads[:, None] << 32 | np.arange((1 << 32) - HOT_SPREAD, 1 << 32)).ravel()
        pairs = np.sort(np.concatenate((seen, asked)))
        where = np.searchsorted(pairs, seen)
        self.pair_at = where[at]
        self.first, self.second = pairs >> 32, pairs & 0xFFFFFFFF
        self.pair_counts = np.bincount(self.pair_at, x.train[x.of], len(pairs)).astype(np.int64)
        self.count_of_first, self.count_of_second = of_first(self.first), count_of(self.second)

    def dealt(self, n_parts: int):
        """Pairs by partition: by first word, and by second word as well if the first is frequent."""
        spread = np.where(self.count_of_first >= HOT, self.second % HOT_SPREAD + 1, 0)
        key = mix(self.first.astype(np.uint64) * np.uint64(HOT_SPREAD + 1) + spread.astype(np.uint64))
        return by_part((key % np.uint64(n_parts)).astype(np.int64), n_parts)


def score(docs: DataFrame, held_out, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of all docs by a model of those that aren't held out."""
    used = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return Model(used).scores()
