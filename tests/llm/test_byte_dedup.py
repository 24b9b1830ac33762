"""Repeated byte strings by run-length indexes, against every window of a small corpus."""

import random
from collections import Counter

import numpy as np
import pytest

from proselens.llm import byte_dedup
from proselens.llm.run_index import RunIndex


def test_matching_statistics():
    r = random.Random(0)
    for trial in range(150):
        texts = [bytes(r.choice(b"ab\x00\xf5") for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 8))]
        texts += texts[:2] if trial % 3 == 0 else []
        index = RunIndex(texts)
        got = index.matching_statistics()
        places = [(u, int(b) + j, u[j:]) for u, b in zip(texts, index.begin) for j in range(len(u))]
        for _, at, mine in places:
            want = max((next((n for n, (p, q) in enumerate(zip(mine, other)) if p != q), min(len(mine), len(other))) for _, there, other in places if there != at), default=0)
            assert got[at] == want


def test_runs_grow_with_what_is_new():
    """Copies add text but hardly any runs, beyond those of their separators."""
    r = random.Random(1)
    text = bytes(r.choice(b"abcdefgh ") for _ in range(3000))
    one, many = RunIndex([text]), RunIndex([text] * 20)
    assert many.n == 20 * one.n and len(many.starts) < len(one.starts) + 100


def plain(texts, window):
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i + 1 : i + window + 1] = True
        edges = np.flatnonzero(np.diff(gone.astype(int))).tolist()
        out.append((len(t), int(gone.sum()), list(zip(edges[::2], edges[1::2], strict=True)), bytes(b for b, g in zip(t, gone[1:]) if not g)))
    return out


def corpus():
    r = random.Random(4)

    def prose(n):
        return "".join(r.choice("abcdefé 日\n") for _ in range(n))

    line, page = prose(230), prose(700)
    out = [prose(r.choice((0, 5, 199, 200, 201, 400, 900))) for _ in range(60)]
    out += [prose(r.randint(0, 90)) + line + prose(r.randint(0, 90)) for _ in range(50)]  # a hot line
    out += [page[:k] + "X" + page[k:] for k in range(0, 700, 40)] + [page, page]  # near copies
    out += ["ab" * 400, "a" * 1500, "a" * 199, page[:300] + page[:300], "", "é" * 260]  # periods, one's own repeats
    return out


@pytest.mark.parametrize(("window", "hot"), [(200, 1024), (200, 3), (50, 8), (3, 1024), (1, 2)])
def test_against_every_window(spark, monkeypatch, window, hot):
    monkeypatch.setattr(byte_dedup, "HOT", hot)
    monkeypatch.setattr(byte_dedup, "BLOCK", 20_000)
    texts = corpus() if window > 3 else [t[:40] for t in corpus()]
    rows = [(k, t, "x", 1) for k, t in enumerate([*texts, None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_bytes int").repartition(5)
    got = {r["doc_id"]: r for r in byte_dedup.deduplicate(docs, window=window).collect()}
    want = plain([(t or "").encode() for _, t, *_ in rows], window)
    assert len(got) == len(rows)
    for k, (n, gone, runs, kept) in enumerate(want):
        r = got[k]
        assert (r["n_bytes"], r["n_removed"], [(s["begin"], s["end"]) for s in r["removed"]], bytes(r["kept"])) == (n, gone, runs, kept), k
    assert any(r["n_removed"] for r in got.values())


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (1, "x" * 250), (1, "x" * 250), (None, "y" * 150)], "doc_id long, text string")
    got = byte_dedup.digest(docs).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got) == [(0, 150, 0, 0), (1, 0, 0, 0), (1, 250, 250, 1), (1, 250, 250, 1)]
    assert byte_dedup.digest(docs.limit(0)).count() == 0


def test_indexes_by_key(monkeypatch):
    """Small indexes, cut between keys, find what one index of all finds."""
    r = random.Random(2)
    texts = list({bytes(r.choice(b"ab") for _ in range(r.randint(5, 30))) for _ in range(200)})
    key = np.array([t[0] for t in texts], np.uint32)
    monkeypatch.setattr(byte_dedup, "INDEX", 100)
    got = byte_dedup.indexed(texts, np.ones(len(texts), int), key, 5)
    by_key = [Counter(t[i : i + 5] for t, k in zip(texts, key) if k == own for i in range(len(t) - 4)) for own in key]
    assert all(g.tolist() == [c[t[i : i + 5]] > 1 for i in range(len(t) - 4)] for g, t, c in zip(got, texts, by_key))
