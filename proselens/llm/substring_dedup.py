"""Exact substring deduplication by recompression.

Names are given to words, then, in every round, to runs of one symbol and to pairs of symbols. A name is the hash of what
it stands for, so it is the same all over the corpus without any table of names; of the pairs, every symbol is left or
right by one bit of its name, and each left symbol followed by a right one becomes a pair. Which symbols arise inside a
passage is settled by the passage alone, except near its ends. For every symbol its reach is kept: the words that its
rise depends on. Equal passages hold the same symbols wherever the reach lies inside.

Revealing: a WINDOW-word passage that occurs twice has all its interior high-level symbols twice in the corpus, so only
windows whose interior symbols are all shared remain. Verifying: those windows' 96-bit fingerprints over all word
hashes are counted over the corpus; windows found twice are repeats. A block sends each fingerprint once and gets a bit
back; the places stay with the block, so a passage that is everywhere costs as much as any. No window is given up for
being frequent.

Each word under a repeated window is removed; windows are judged on the input. Defined results: null and empty texts
have no words; kept words are joined by one space. Repeated rows are repeats of each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, parts, schema_with
from .text_blocks import Blocks, by_part, column
from .words import BASES, Words, mix, spans

WINDOW = 35
#: More rounds make fewer symbols, but after five their reach is as long as a window.
ROUNDS = 4
BLOCK = 4_000_000


def _hull(begin, end, i, j):
    return np.minimum(begin[i], begin[j]), np.maximum(end[i], end[j])


def recompress(h: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first word of the reach, end of the reach) of the symbols left after the rounds. The reach of a symbol that
    depends on where its document begins or ends goes one word beyond."""
    n = len(h)
    name, lo, hi = h, np.arange(n), np.arange(1, n + 1)
    of = np.repeat(np.arange(len(doc) - 1), np.diff(doc))
    for r in range(rounds):
        if not len(name):
            break
        salt = np.uint64((r + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        starts = np.concatenate(([True], of[1:] != of[:-1]))
        ends = np.concatenate((starts[1:], [True]))
        # Runs, where texts have them. A run's length depends on the neighbours being others.
        first = starts | np.concatenate(([True], name[1:] != name[:-1]))
        at = np.flatnonzero(first)
        size = np.diff(np.concatenate((at, [len(name)])))
        last = at + size - 1
        new = np.where(size == 1, name[at], mix(name[at] ^ mix(size.astype(np.uint64) + salt)))
        lo2 = np.where(starts[at], lo[at] - 1, lo[np.maximum(at - 1, 0)])
        hi2 = np.where(ends[last], hi[last] + 1, hi[np.minimum(last + 1, len(name) - 1)])
        name, lo, hi, of = new, lo2, hi2, of[at]
        starts = np.concatenate(([True], of[1:] != of[:-1]))
        ends = np.concatenate((starts[1:], [True]))
        right = (mix(name ^ salt) >> np.uint64(17) & np.uint64(1)).astype(bool)
        after = np.concatenate((right[1:], [False])) & ~ends
        pair = ~right & after
        second = np.concatenate(([False], pair[:-1]))
        nxt, prv = np.minimum(np.arange(len(name)) + 1, len(name) - 1), np.maximum(np.arange(len(name)) - 1, 0)
        # Left ones look at what follows, right ones at what precedes.
        other = np.where(right, prv, nxt)
        lo2, hi2 = _hull(lo, hi, np.arange(len(name)), other)
        lo2 = np.where(right & starts, lo - 1, np.where(~right & ends, lo, lo2))
        hi2 = np.where(~right & ends, hi + 1, np.where(right & starts, hi, hi2))
        new = np.where(pair, mix(name * np.uint64(3) + mix(name[nxt] ^ salt)), name)
        keep = ~second
        name, lo, hi, of = new[keep], lo2[keep], hi2[keep], of[keep]
    return name, lo, hi


def _words(t: pa.Table, text: str) -> tuple[Words, np.ndarray]:
    w = Words(t.column(text), False)
    return w, w.hashes(BASES[0])


#: What a block keeps of its suspect windows, a row a key partition: distinct fingerprints, how often each occurs (1 or 2
#: for more), and the places of all.
_SUSPECTS = {"part": pa.int32(), "block": pa.int64(), "a": pa.binary(), "b": pa.binary(), "n": pa.binary(), "size": pa.binary(), "at": pa.binary()}


def repeated(blocks: Blocks, text: str, window: int, rounds: int) -> DataFrame:
    """(block, part, size, at, bits): a block's suspect windows and, in other rows, which of them are repeats."""
    n_parts = 2 * parts(blocks.spark)

    def low(name):
        return (mix(name) >> np.uint64(32)).astype(np.uint32)

    def sent(name):
        """The names of a block as they travel: part, then 32 bits, each once with 1 or 2 for how often."""
        unique, count = np.unique(name, return_counts=True)
        return unique, (unique % np.uint64(n_parts)).astype(np.int64), np.minimum(count, 2).astype(np.uint8)

    def names(block, t):
        w, h = _words(t, text)
        unique, part, count = sent(recompress(h, w.doc, rounds)[0])
        rows = [(p, block, low(unique[o]).tobytes(), count[o].tobytes()) for p, o in by_part(part, n_parts)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["part", "block", "keys", "n"])

    def shared(t: pa.Table) -> pa.Table:
        keys, cut = column(t, "keys", np.uint32)
        n, _ = column(t, "n", np.uint8)
        _, of = np.unique(keys, return_inverse=True)
        twice = (np.bincount(of, n) >= 2)[of]
        return pa.table({"block": t.column("block"), "part": t.column("part"), "bits": _bits(twice, cut)})

    flags = blocks.emit(names, "part int, block long, keys binary, n binary").groupBy("part").applyInArrow(shared, "block long, part int, bits binary")

    def suspects(block, t, answers):
        w, h = _words(t, text)
        name, lo, hi = recompress(h, w.doc, rounds)
        unique, part, _ = sent(name)
        is_shared = np.zeros(len(unique), bool)
        bits = dict(zip(answers.column("part").to_pylist(), answers.column("bits").to_pylist(), strict=True))
        for p, o in by_part(part, n_parts):
            is_shared[o] = np.unpackbits(np.frombuffer(bits[p], np.uint8))[: len(o)].astype(bool)
        alone = ~is_shared[np.searchsorted(unique, name)]
        # A symbol that is alone rules out all windows that its reach lies in.
        bad = alone & (hi - lo <= window)
        step = np.zeros(len(h) + 2, np.int64)
        np.add.at(step, np.maximum(hi[bad] - window, 0), 1)
        np.add.at(step, np.maximum(lo[bad] + 1, 0), -1)
        ruled_out = np.cumsum(step)[: len(h)] > 0
        count = np.maximum(np.diff(w.doc) - window + 1, 0)
        at = np.arange(count.sum()) + np.repeat(w.doc[:-1] - np.cumsum(count) + count, count)
        at = at[~ruled_out[at]]
        if not len(at):
            return pa.table({c: pa.array([], k) for c, k in _SUSPECTS.items()})
        h2 = w.hashes(BASES[3])
        a, b = mix(spans(h, at, at + window, BASES[1])), (mix(spans(h2, at, at + window, BASES[2])) >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((b, a))
        a, b, at = a[order], b[order], at[order]
        first = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        begin = np.flatnonzero(first)
        size = np.diff(np.concatenate((begin, [len(a)])))
        rows = []
        for p, o in by_part((a[begin] % np.uint64(n_parts)).astype(np.int64), n_parts):
            places = np.repeat(begin[o] - np.cumsum(size[o]) + size[o], size[o]) + np.arange(size[o].sum())
            rows.append((p, block, a[begin[o]].tobytes(), b[begin[o]].tobytes(), np.minimum(size[o], 2).astype(np.uint8).tobytes(), size[o].astype(np.uint32).tobytes(), at[places].astype(np.uint32).tobytes()))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _SUSPECTS.values(), strict=True)], names=list(_SUSPECTS))

    def verified(t: pa.Table) -> pa.Table:
        a, cut = column(t, "a", np.uint64)
        b, _ = column(t, "b", np.uint32)
        n, _ = column(t, "n", np.uint8)
        order = np.lexsort((b, a))
        first = np.ones(len(a), bool)
        first[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        of = np.zeros(len(a), np.int64)
        of[order] = np.cumsum(first) - 1
        return pa.table({"block": t.column("block"), "part": t.column("part"), "bits": _bits((np.bincount(of, n) >= 2)[of], cut)})

    schema = "part int, block long, a binary, b binary, n binary, size binary, at binary"
    found = materialise(blocks.answer(flags, suspects, schema), "suspects")
    bits = found.select("part", "block", "a", "b", "n").groupBy("part").applyInArrow(verified, "block long, part int, bits binary")
    none = F.lit(None).cast("binary")
    return found.select("block", "part", "size", "at", none.alias("bits")).unionByName(bits.select("block", "part", none.alias("size"), none.alias("at"), "bits"))


def _bits(flags: np.ndarray, cut: np.ndarray) -> pa.Array:
    return pa.array([np.packbits(flags[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())


def _starts(answers: pa.Table) -> np.ndarray:
    """The places of repeats among a block's rows of ``repeated``."""
    bits = {r["part"]: r["bits"] for r in answers.select(["part", "bits"]).to_pylist() if r["bits"] is not None}
    out = [np.zeros(0, np.int64)]
    for part, size, at in zip(*(answers.column(c).to_pylist() for c in ("part", "size", "at")), strict=True):
        if size is not None:
            size = np.frombuffer(size, np.uint32).astype(np.int64)
            twice = np.unpackbits(np.frombuffer(bits[part], np.uint8))[: len(size)].astype(bool)
            out.append(np.frombuffer(at, np.uint32)[np.repeat(twice, size)].astype(np.int64))
    return np.concatenate(out)


def deduplicate(docs: DataFrame, text: str = "text", window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """docs with the words under repeated windows taken out of ``text`` (null: empty), n_words and n_removed. A document
    that loses nothing keeps its text as it is, white space included; ``kept_text`` always has its words joined by one space."""
    docs = docs.drop("n_words", "n_removed", "kept_text")
    blocks = Blocks(docs, text, BLOCK)
    schema = schema_with(docs, ("n_words", "long"), ("n_removed", "long"), ("kept_text", "string"))
    names = schema.names

    def remove(block, t, answers):
        w = Words(t.column(text), False)
        n = len(w.begin)
        starts = _starts(answers)
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, starts, 1)
        np.add.at(step, np.minimum(starts + window, n), -1)
        keep = np.cumsum(step)[:n] == 0
        counts, removed, joined, texts = [], [], [], []
        old = t.column(text).to_pylist()
        for k in range(t.num_rows):
            mask = keep[w.doc[k] : w.doc[k + 1]]
            lost = len(mask) - int(mask.sum())
            # bytes.split() cuts at the same six bytes as Words.
            all_words = (old[k] or "").encode().split()
            kept = b" ".join([x for x, ok in zip(all_words, mask.tolist(), strict=True) if ok] if lost else all_words).decode()
            counts.append(len(mask))
            removed.append(lost)
            joined.append(kept)
            texts.append(kept if lost else old[k])
        at = t.schema.names.index(text)
        t = t.set_column(at, t.schema.field(at), pa.array(texts, t.schema.field(at).type))
        return pa.table([*t.columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(joined, pa.string())], names=names)

    return blocks.answer(repeated(blocks, text, window, rounds), remove, schema)


def digest(docs: DataFrame) -> DataFrame:
    """What op4 returns of every document."""
    out = deduplicate(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
