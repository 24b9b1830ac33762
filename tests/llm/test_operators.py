"""Each operator against a brute-force version or an exact round trip, with null, empty, long, repeated and clashing input."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from proselens.llm import byte_bpe, decontaminate, html_extract, katz, language_id, near_dedup, substring_dedup, token_files, topk, warc
from proselens.llm.components import components
from proselens.llm.words import BASES, Words, spans, windows

DOCS = "doc_id long, text string"


def texts(seed=0, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß'") for _ in range(r.randint(1, 7))) for _ in range(300)] + ["the", "of", "%%%", "!!", "12", "A.B"]
    out = [" ".join(r.choice(vocabulary) for _ in range(r.choice((1, 3, 4, 5, 30, 80, 150)))) for _ in range(n)]
    for k in range(0, n, 3):  # near copies, copies and shared passages
        w = out[k].split()
        if len(w) > 40:
            i = r.randrange(len(w))
            out.append(" ".join([*w[:i], "changed", *w[i + 1 :]]))
            out.append("before it \t" + "\n".join(w[:40]) + " after")
    out += [out[4], out[4], "", "  \n ", None, "x" * 3000, "a a a a " * 50, "naïve ﬁ 日本語 wide <|endoftext|> \x0b tab"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = list(enumerate(texts()))
    # Repeated rows, extra columns that clash with the operators' own names.
    rows = [(k, t, "en", f"s{k % 3}", 7) for k, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, ids string, n_words long").repartition(3)


def test_words_are_bytes_split():
    t = [x for x in texts(1)]
    w = Words(pa.array(t, pa.string()), True)
    want = [x for s in t for x in (s or "").encode().lower().split()]
    assert [w.data[a:b].tobytes().lower() for a, b in zip(w.begin, w.end)] == want
    names: dict = {}
    assert all(names.setdefault(x, h) == h for x, h in zip(want, w.hashes().tolist())) and len(set(names.values())) == len(names)
    assert len(Words(pa.array([], pa.string()), False).hashes()) == 0


def test_bpe_is_tiktoken(spark, docs):
    import tiktoken

    v = byte_bpe.Vocabulary(P.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    source = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in byte_bpe.round_trip(docs, v, P.PATTERN).collect():
        ids = enc.encode_ordinary(source[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(source[r["doc_id"]].encode()).hexdigest()
    assert byte_bpe.round_trip(docs.limit(0), v, P.PATTERN).count() == 0
    assert v.fold([])[0].tolist() == []


def test_token_files(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    at = 0
    got = {r["doc_id"]: r for r in token_files.round_trip(docs, P.path("word_bpe_49k.json")).collect()}
    for r in docs.orderBy("doc_id").collect():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        g = got[r["doc_id"]]
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes())), r
        at += len(ids)
    assert token_files.round_trip(docs.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_token_files_null_and_repeated_ids(spark):
    """Every row has its own place; null ids come first, and an id that fills most ranges is dealt out over them."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = [(None, "first one"), (None, None)] + [(5, f"repeated row {k % 40}") for k in range(300)] + [(k, f"Row {k}, it's 1st") for k in range(9)] + [(3, "x " * 5000)]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    got = sorted(token_files.round_trip(df, P.path("word_bpe_49k.json")).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0)) and ids[:2] == [None, None]
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)]).tolist()[:-1]
    crc = lambda x: zlib.crc32(np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == Counter((d, crc(x)) for d, x in rows)
    cuts = token_files.bounds(df, "doc_id", 8)
    assert len(cuts) == 7 and (cuts == 5).sum() > 4
    parts = {r["part"] for r in token_files.encode(df, P.path("word_bpe_49k.json"), 1, cuts=cuts).where("doc_id = 5").collect()}
    assert len(parts) > 4


def test_encoder_is_the_library():
    from tokenizers import Tokenizer

    spec = open(P.path("word_bpe_49k.json"), encoding="utf-8").read()
    t, c = Tokenizer.from_str(spec), token_files.Encoder(spec)
    some = [*texts(7), "It's 3rd; don't I'LL", "''s \"'t 've're x'llm 12a3''d × a×b ÷", "\u00a0no\u2028break\u1680 ", "\x1c\x1d \x00 x", "İSTANBUL ǅ ẞ Σας", "e\u0301 caf\u00e9"]
    for k in range(0, len(some), 7):
        ids, at = c.encode(pa.array(some[k : k + 7], pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [t.encode(x or "", add_special_tokens=False).ids for x in some[k : k + 7]]


@pytest.mark.parametrize("high", [1, 200, 256, 70_000, 1 << 24])
def test_random_access(high):
    r = np.random.default_rng(high)
    ids = r.integers(0, high, 1000).astype(np.uint32)
    f = token_files.TokenFile(token_files.write_file(np.arange(3), np.array([0, 990, 10]), ids, 5))
    assert f.first == 5 and [f.token(i) for i in range(1000)] == ids.tolist()
    assert all(f.tokens(a, b).tolist() == ids[a:b].tolist() for a, b in ((0, 0), (0, 1000), (63, 65), (128, 700), (999, 1000)))
    assert f.document(0).tolist() == [] and f.document(2).tolist() == ids[990:].tolist()
    with pytest.raises(IndexError):
        f.token(1000)


def test_substring_dedup(spark, docs):
    repeated = docs.unionByName(docs.where("doc_id = 30"))
    rows = [(r["doc_id"], (r["text"] or "").encode().split()) for r in repeated.collect()]
    n = Counter(tuple(w[k : k + 35]) for _, w in rows for k in range(len(w) - 34))
    want = Counter()
    for d, w in rows:
        gone = {k + i for k in range(len(w) - 34) if n[tuple(w[k : k + 35])] > 1 for i in range(35)}
        want[d, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()] += 1
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.deduplicate(repeated).collect())
    assert got == want and any(k[2] for k in want)
    assert substring_dedup.deduplicate(docs.limit(0)).count() == 0


def test_recompression_is_consistent():
    r = random.Random(3)
    core = [r.randrange(40) for _ in range(60)]
    for _ in range(20):
        sides = [[r.randrange(40) for _ in range(r.randrange(30))] for _ in range(4)]
        out = []
        for k in (0, 2):
            h = np.array([*sides[k], *core, *sides[k + 1]], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            name, lo, hi = substring_dedup.recompress(h, np.array([0, len(h)]))
            a = len(sides[k])
            out.append({(x, i - a, j - a) for x, i, j in zip(name.tolist(), lo, hi) if i >= a and j <= a + 60})
        assert out[0] == out[1] != set()


def test_near_duplicates(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and root(a) != root(b):
                up[max(root(a), root(b))] = min(root(a), root(b))
    got = near_dedup.deduplicate(docs.unionByName(docs.where("doc_id = 3"))).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        d = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[d]), root(d), root(d) == d)
    assert near_dedup.survivors(docs).count() == sum(root(d) == d for d in sets)
    odd = near_dedup.deduplicate(spark.createDataFrame([(None, "a b c d e f"), (1, None)], DOCS)).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in odd} == {(None, None, True), (1, 1, True)}


def test_links_count_both_ways():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 90, 80).astype(np.uint64)) for _ in range(70)]
    want = {(a, b) for a in range(70) for b in range(a + 1, 70) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 50 * len(np.union1d(sets[a], sets[b]))}
    assert {tuple(x) for x in near_dedup.links(sets, 50).tolist()} == want and want


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 102), (102, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102), 100)}


def test_decontamination(spark):
    items = [(1, "one two three four five six seven eight nine ten"), (2, "alpha beta gamma"), (3, ""), (4, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(1, "x six seven eight nine TEN y one two three four five z"), (2, "one two three four five only"), (3, "so alpha\nBeta gamma here"), (4, None), (5, "alpha beta"), (5, "alpha beta gamma " * 3)], DOCS)
    got = {(r["doc_id"], r["item_id"]): (r["covered_words"], r["n_tiles"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 1): (10, 2), (3, 2): (3, 1), (5, 2): (3, 1)}
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, bench).collect()) == [2, 4, 5]
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_tiling_against_brute_force():
    r = random.Random(5)
    for _ in range(50):
        a, b = ([r.randrange(6) for _ in range(n)] for n in (25, 60))
        i, j = (np.array(x) for x in zip(*[(x, y) for x in range(23) for y in range(58) if a[x : x + 3] == b[y : y + 3]])) if any(a[x : x + 3] == b[y : y + 3] for x in range(23) for y in range(58)) else (np.array([]), np.array([]))
        if not len(i):
            continue
        got = decontaminate.tile(np.array(a), np.array(b), i, j, 3)
        used_a, used_b, want = set(), set(), []
        while True:
            best = max(((n, -x, -y) for x in range(25) for y in range(60) if (n := next((k for k in range(min(25 - x, 60 - y) + 1) if k == min(25 - x, 60 - y) or a[x + k] != b[y + k] or x + k in used_a or y + k in used_b))) >= 3), default=None)
            if best is None:
                break
            n, x, y = best[0], -best[1], -best[2]
            want.append((x, y, n))
            used_a |= set(range(x, x + n))
            used_b |= set(range(y, y + n))
        assert sum(t[2] for t in got) == sum(t[2] for t in want)


def test_katz(spark):
    rows = [(k, t) for k, t in enumerate(texts(2, 40))]
    docs = spark.createDataFrame([(k, t, k % 7 == 2) for k, t in rows], "doc_id long, text string, held boolean")
    got = {r["doc_id"]: r for r in katz.score(docs, F.col("held")).collect()}
    toks = {k: [*(t or "").encode().lower().split(), b"\n"] for k, t in rows}
    train = [k for k in toks if k % 7 != 2]
    u = Counter(w for k in train for w in toks[k])
    b = Counter((h, w) for k in train for h, w in zip([b"", *toks[k]], toks[k], strict=False))
    du, db = (katz.discounts([0, *(list(c.values()).count(k) for k in range(1, 7))]) for c in (u, b))
    disc = lambda c, d: (d[c] if c <= 5 else 1) * c
    n = sum(u.values())
    p1 = {w: disc(c, du) / n for w, c in u.items()}
    unknown, seen = 1 - sum(p1.values()), {}
    for (h, w), c in b.items():
        seen.setdefault(h, {})[w] = c

    def p(w, h):
        if h not in seen:
            return p1.get(w, unknown)
        c, kept = sum(seen[h].values()), sum(disc(x, db) for x in seen[h].values())
        bottom = c + 1 if c - kept <= 1e-9 * c else c
        return disc(seen[h][w], db) / bottom if w in seen[h] else (1 - kept / bottom) / (1 - sum(p1[x] for x in seen[h])) * p1.get(w, unknown)

    for k, ws in toks.items():
        want = sum(np.log10(p(w, h)) for h, w in zip([b"", *ws], ws, strict=False))
        assert abs(got[k]["score"] - want) < 1e-6 * max(1, abs(want)) and got[k]["n_tokens"] == len(ws) and got[k]["train_tokens"] == n
        assert abs(got[k]["base_score"] - sum(np.log10((u[w] + 1) / (n + len(u) + 1)) for w in ws)) < 1e-6 * len(ws)
    h = max(seen, key=lambda x: len(seen[x]))
    assert abs(sum(p(w, h) for w in u) + p("?", h) - 1) < 1e-9
    none = katz.score(docs, F.lit(True)).where("doc_id = 1").first()
    assert none["score"] == 0 and none["train_tokens"] == 0 and none["n_known"] == 0


def test_katz_counts_over_32_bits(spark):
    """A corpus of which each block stands for 2**30 equal ones: counts of words and pairs in the corpus pass 2**32."""
    times, real = 1 << 30, katz.Blocks

    class Many:
        def __init__(self, *a):
            self.blocks = real(*a)

        def emit(self, f, schema):
            def many(block, t):
                for b in f(block, t):
                    c = [katz._zip(katz._unzip(x, n, np.uint32) * np.uint32(times)) for x, n in zip(b.column("count").to_pylist(), b.column("n").to_pylist(), strict=True)]
                    yield b.set_column(b.schema.get_field_index("count"), "count", pa.array(c, pa.binary()))

            return self.blocks.emit(many, schema)

        def answer(self, answers, f, schema):
            def many(block, t, a):
                b = f(block, t, a)
                if "c2" not in b.column_names:
                    return b
                c = [katz._zip(katz._unzip(x, n, np.uint32) * np.uint32(times)) for x, n in zip(b.column("count").to_pylist(), b.column("n").to_pylist(), strict=True)]
                return b.set_column(b.schema.get_field_index("count"), "count", pa.array(c, pa.binary()))

            return self.blocks.answer(answers, many, schema)

    rows = [(k, "hot x hot y hot z" if k < 3 else "hot unseen y hot hot", k == 3) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    try:
        # Every document is a block of its own, so that a block's counts times 2**30 fit 32 bits.
        katz.Blocks, size, katz.BLOCK = Many, katz.BLOCK, 1
        got = {r["doc_id"]: r for r in katz.Model(docs).scores().collect()}
    finally:
        katz.Blocks, katz.BLOCK = real, size
    n, v = 21 * times, 5
    c = {"hot": 9 * times, "x": 3 * times, "y": 3 * times, "z": 3 * times, "end": 3 * times, "unseen": 0}
    assert got[0]["train_tokens"] == n
    for k, words in ((0, "hot x hot y hot z end"), (3, "hot unseen y hot hot end")):
        assert got[k]["base_score"] == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in words.split()), abs=1e-9)
    # hot is followed by x, y and z a third of the times each; all else of the first text is certain.
    assert got[0]["score"] == pytest.approx(3 * np.log10(1 / 3), abs=1e-6)
    # Unseen continuations share what is left, about one count of 2**30 or more; no word is impossible.
    assert -100 < got[3]["score"] < 0


def test_language(spark):
    words = {"xx": "alo belo mira soto ".split(), "yy": "kruz tschik blomf warg ".split()}
    r = random.Random(4)
    rows = [(k, " ".join(r.choice(words[g]) for _ in range(20)), g if k % 5 else None) for k, g in enumerate(["xx", "yy"] * 20)]
    rows += [(100, None, "xx"), (101, "12 !!", "yy"), (102, "", None), (103, "kruz " * 30000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {x["doc_id"]: x for x in language_id.identify(docs, F.col("doc_id") % 3 == 1).collect()}
    assert all(got[k]["lang_pred"] == ("xx", "yy")[k % 2] and 0.5 < got[k]["score"] <= 1 for k in range(40))
    assert all((got[k]["lang_pred"], got[k]["score"]) == ("und", 0.0) for k in (100, 101, 102)) and got[103]["lang_pred"] == "yy"
    assert language_id.predict(docs, language_id.train(docs.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_topk(spark):
    r = np.random.default_rng(2)
    v = np.concatenate((r.normal(size=(200, 8)), np.repeat(r.normal(size=(1, 8)), 30, 0)))
    rows = [(k, [float(x) for x in y]) for k, y in enumerate(v)] + [(300, None), (310, [1.0, float("nan")] * 4), (320, [1.0, None] * 4), (330, []), (None, [0.5] * 8), (340, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = np.floor(1024 * v).astype(np.int64)
    want = {(a, k + 1, b, int(q[a] @ q[b])) for a in range(0, 230, 10) for k, b in enumerate(sorted((b for b in range(230) if b != a), key=lambda b: (-int(q[a] @ q[b]), b))[:10])}
    assert {tuple(x) for x in topk.search(df, F.col("vec_id") % 10 == 0).collect()} == want
    few = topk.search(df.where("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert sorted(x["rank"] for x in few) == [1, 2, 3] and topk.search(df.limit(0), F.lit(True)).count() == 0


def test_topk_ties_across_pivots(spark):
    r = np.random.default_rng(5)
    # A zero vector scores 0 with all; few different components make many ties.
    v = np.concatenate((np.zeros((1, 3)), r.integers(-2, 3, size=(399, 3)).astype(float)))
    ids = [-1 if k == 7 else k for k in r.permutation(400).tolist()]
    df = spark.createDataFrame([(k, [float(x) for x in y]) for k, y in zip(ids, v, strict=True)], "vec_id long, embedding array<double>")
    q = np.floor(1024 * v).astype(np.int64)
    chosen = {ids[0], *ids[1:400:25], -1}
    want = set()
    for a in chosen:
        s = q @ q[ids.index(a)]
        best = sorted((b for b in range(400) if ids[b] != a), key=lambda b: (-int(s[b]), ids[b]))[:10]
        want |= {(a, k + 1, ids[b], int(s[b])) for k, b in enumerate(best)}
    assert {tuple(x) for x in topk.search(df, F.col("vec_id").isin(*chosen)).collect()} == want


def test_topk_lengths_and_large_components(spark):
    """Each length is searched among its own, and sums over 53 bits are exact."""
    r = np.random.default_rng(8)
    v = [*r.integers(-3, 4, size=(60, 2)).tolist(), *r.integers(-3, 4, size=(40, 5)).tolist(), *(r.integers(-(2**28), 2**28, size=(40, 5)) // 1024 * 2).tolist(), [2.0**20, 0.0, 0.0, 0.0, 0.0], [7.0]]
    df = spark.createDataFrame([(k, [float(y) for y in x], "clash", 0) for k, x in enumerate(v)], "vec_id long, embedding array<double>, pivot string, least int").repartition(3)
    big = [[int(np.floor(1024 * float(y))) for y in x] for x in v]
    fine = range(len(v))
    want = set()
    for a in fine:
        if a % 3 == 0 or a == len(v) - 1:
            others = [(-sum(x * y for x, y in zip(big[a], big[b])), b) for b in fine if b != a and len(v[b]) == len(v[a])]
            want |= {(a, i + 1, b, -s) for i, (s, b) in enumerate(sorted(others)[:4])}
    assert any(abs(x[3]) > 2**54 for x in want)
    assert {tuple(x) for x in topk.search(df, (F.col("vec_id") % 3 == 0) | (F.col("vec_id") == len(v) - 1), k=4, pivots=6).collect()} == want


def test_warc(spark, tmp_path):
    bodies = ["<p>a</p>", "<p>a</p>", None, "", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n", "é" * 5000]
    pages = spark.createDataFrame([(k, f"http://x/{k} y" if k else None, b, "clash") for k, b in enumerate(bodies)], "page_id long, url string, html string, owner string")
    got = {r["page_id"]: r for r in warc.round_trip(pages, path=f"file://{tmp_path}/w").collect()}
    for k, b in enumerate(bodies):
        raw = (b or "").encode()
        last = max(j for j, c in enumerate(bodies) if (c or "") == (b or ""))
        assert (got[k]["payload_bytes"], got[k]["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (got[k]["record_type"], got[k]["refers_to"]) == (("response", None) if last == k else ("revisit", last))
    one = warc.assemble(warc.read(spark, f"file://{tmp_path}/w")).where("metadata.page_id = 4").first()
    assert one["response"]["payload"].decode() == bodies[4] and one["request"]["concurrent_to"] == one["capture_id"]
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_repeated_rows(spark, tmp_path):
    """Every row is a capture, whatever repeats; a revisit's record names the record of the page that it tells of."""
    rows = [(1, "u", "a"), (1, "u", "a"), (1, "u", "b"), (2, "v", "c"), (3, "w", "a"), (3, "w", "a"), (3, "x", "a"), (None, "n", "a"), (None, None, None), (None, None, None), (9, "y", "tiny"), (9, "y", "tiny")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages, path=f"file://{tmp_path}/w").collect())
    want = Counter([(1, 1, "revisit", 3)] * 2 + [(1, 1, "response", None), (2, 1, "response", None), (3, 1, "response", None), (3, 1, "revisit", 3), (3, 1, "revisit", 3), (None, 1, "revisit", 3), (None, 0, "response", None), (None, 0, "revisit", None), (9, 4, "response", None), (9, 4, "revisit", 9)])
    assert got == want
    records = warc.read(spark, f"file://{tmp_path}/w").collect()
    assert len({r["record_id"] for r in records}) == len(records) == 3 * len(rows)
    page = {r["concurrent_to"]: r["page_id"] for r in records if r["record_type"] == "metadata"}
    assert {(r["page_id"], page[next(x["refers_to"] for x in records if x["record_id"] == r["concurrent_to"])]) for r in records if r["original_page_id"]} == {(1, 3), (3, 3), (None, 3), (9, 9)}
    small = warc.round_trip(pages, min_bytes=2).collect()
    assert sum(r["record_type"] == "revisit" for r in small) == 1 and len(small) == len(rows)


HTML = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script><style>p{}</style></head><body><header>Site</header><nav><ul><li>Menu</ul></nav>
<div class="cookie-notice">We use cookies.</div><article><h1>Head &amp; line</h1><p>First <b>bold
 text.<br>Still first.<p>Second &eacute;.<div class="ad-box">Buy now</div><section id="comments"><p>Nice post!</p></section></article><aside>More</aside><form><p>Name</p></form><footer>&copy; us</footer>"""


def test_html(spark):
    assert html_extract.extract(HTML) == "Head & line\nFirst bold text. Still first.\nSecond é."
    plain = "<html><body><div class=menu><a>Home</a></div><div class=post><h2>Short</h2>" + "<p>A long paragraph, with many words; and marks. It goes on.</p>" * 3 + "</div><div class=footer>x</div></body></html>"
    assert html_extract.extract(plain).split("\n")[0] == "Short" and html_extract.extract(plain).count("\n") == 3
    for x in (None, "", "   ", "<", "<p", "</p></div>", "<!-- ", "<script>", "&#0; &bad; <p>" + "<div>" * 3000):
        html_extract.extract(x)
    got = html_extract.extract_pages(spark.createDataFrame([(1, HTML, "x"), (2, None, "y")], "page_id long, html string, text string")).collect()
    assert {(r["page_id"], r["n_chars"]) for r in got} == {(1, 51), (2, 0)} and got[0].asDict().keys() == {"page_id", "text", "n_chars"}


def test_html_scores_choose_the_region():
    p = "<p>A long paragraph, with many words; and marks. It goes on.</p>"
    teaser = f"<html><body><article><h3>Teaser</h3><p>Read it.</p></article><div class=post><h2>Head</h2>{p * 4}</div></body></html>"
    assert html_extract.extract(teaser).split("\n") == ["Head", *[p[3:-4]] * 4]
    links = "<ul>" + "".join(f"<li><a href=/{k}>Story {k}</a></li>" for k in range(9)) + "</ul>"
    assert html_extract.extract(f"<body><article><h1>Head</h1>{p * 4}<div>The end</div>{links}</article></body>").split("\n") == ["Head", *[p[3:-4]] * 4, "The end"]
    several = "<body><div>Top</div>" + f"<article><h2>One</h2>{p * 2}</article>" * 3 + "<div>Bottom</div></body>"
    assert html_extract.extract(several).split("\n") == ["One", *[p[3:-4]] * 2] * 3


def test_html_wrappers_with_role_words():
    p = "<p>A long paragraph, with many words; and marks. It goes on.</p>"
    text, article = "\n".join(["Head", *[p[3:-4]] * 3]), f"<article><h1>Head</h1>{p * 3}</article>"
    minor = "<div id=comments><article><p>Nice post!</p></article></div><div class='related posts'><article><p>Read on.</p></article></div><div class=sidebar><p>About us.</p></div>"
    for names in ("page has-sidebar", "layout no-sidebar", "content-with-header", "post share", "main-form", "with-comments", "page comments"):
        assert html_extract.extract(f"<body><div class='{names}'>{article}{minor}</div></body>") == text, names
        if names != "page comments":
            assert html_extract.extract(f"<body><div id='{names.replace(' ', '-')}'><div><h1>Head</h1>{p * 3}</div>{minor}</div></body>") == text, names
    long = "<div id=comments>" + "<p>A comment, longer than all else; on and on it goes, and on.</p>" * 9 + "</div>"
    assert html_extract.extract(f"<body><div class='page has-sidebar'>{article}</div>{long}</body>") == text


def test_polynomial_windows():
    h = np.arange(20, dtype=np.uint64) % np.uint64(5)
    at, keys = windows(h, np.array([0, 12, 20]), 5, BASES[0])
    assert len(at) == 12 and len(set(keys.tolist())) == 5
    assert spans(h, np.array([0]), np.array([5]), BASES[1])[0] == spans(h, np.array([5]), np.array([10]), BASES[1])[0]
    assert re.fullmatch(r"\d+", str(keys[0]))


def test_long_words_have_hashes_of_their_own():
    """Polynomials modulo 2**64 are equal for the two Thue-Morse words of 2,048 letters, whatever the base."""
    a = "".join("ab"[k.bit_count() % 2] for k in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    w = Words(pa.array([f"{a} {b}"]), False)
    for base in BASES:
        assert len(set(w.hashes(base).tolist())) == 2
    with pytest.raises(AssertionError):
        windows(np.arange(200, dtype=np.uint64), np.array([0, 200]), 100, BASES[0])


def test_common_passage_travels_once_a_block(spark, monkeypatch):
    """A passage in every document: what goes to the partition that counts a window is a row a block, without places."""
    monkeypatch.setattr(substring_dedup, "BLOCK", 2000)
    p = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(k, " ".join(f"own{k}_{i} {p} end{k}_{i}" for i in range(3))) for k in range(80)], DOCS)
    got = substring_dedup.deduplicate(docs).collect()
    assert all((r["n_words"], r["n_removed"], r["kept_text"]) == (126, 120, " ".join(f"own{r['doc_id']}_{i} end{r['doc_id']}_{i}" for i in range(3))) for r in got)


@pytest.mark.parametrize(("name", "most"), [("BLOCK", 16), ("SHINGLES", 16 * 190)])
def test_giant_group_sends_each_set_twice(spark, monkeypatch, name, most):
    """Near copies of one text in a group of many blocks, by members or by shingles: sets sent grow with the group, not
    with its square; links outside of the largest component are found as well."""
    monkeypatch.setattr(near_dedup, name, most)
    sent, real = [], near_dedup.compared
    monkeypatch.setattr(near_dedup, "compared", lambda d, placed, share: (sent.append(placed.select(F.sum(F.size("tasks"))).first()[0]), real(d, placed, share))[1])
    r = random.Random(6)
    base = [f"b{k}" for k in range(200)]
    rows = [(k, " ".join(base[:i] + [f"x{k}"] + base[i + 1 :])) for k, i in enumerate(r.randrange(200) for _ in range(200))]
    # A second family within the group by force: 20 texts that are linked with each other alone.
    rows += [(k, " ".join(f"c{j}" for j in range(100)) + f" y{k}") for k in range(500, 520)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {x["node"]: x["component"] for x in near_dedup.confirmed(docs, spark.createDataFrame([(k, 0, len(t.split()) - 4) for k, t in rows], "node long, component long, n_shingles long")).collect()}
    assert got == {**dict.fromkeys(range(200), 0), **dict.fromkeys(range(500, 520), 500)}
    assert len(sent) == 2 and sum(sent) <= 4 * len(rows) + 20 * 15


def test_long_texts_fill_blocks_by_their_shingles(spark, monkeypatch):
    """Texts of many shingles: no task holds more than two blocks of them."""
    monkeypatch.setattr(near_dedup, "SHINGLES", 20_000)
    held, real = [], near_dedup.compared

    def noted(d, placed, share):
        each = placed.select("doc_id", "g", F.explode("tasks").alias("t")).join(d.select("doc_id", F.size(F.split("text", " ")).alias("n")), "doc_id")
        held.append(each.groupBy("g", "t").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0])
        return real(d, placed, share)

    monkeypatch.setattr(near_dedup, "compared", noted)
    r = random.Random(8)
    rows = []
    for k in range(40):
        base = [f"w{r.randrange(10**9)}" for _ in range(3000)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([*base[:1500], "other", *base[1501:]]))]
    got = near_dedup.deduplicate(spark.createDataFrame(rows, DOCS)).collect()
    assert all(x["component_id"] == x["doc_id"] // 2 * 2 for x in got) and len(got) == 80
    assert max(held) < 3 * 20_000


def test_recall_of_keys():
    """Pairs at a similarity of 0.75 and a little more share a key."""
    r = np.random.default_rng(0)
    for _ in range(300):
        s = r.integers(0, 1 << 63, 140, np.uint64)
        a, b = np.unique(s[:120]), np.unique(s[20:])  # 100 of 140 would be 0.714; 5 more are shared
        b = np.unique(np.concatenate((b, s[:5])))
        assert len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.75
        keys = near_dedup.chunk_keys(np.stack([np.frombuffer(near_dedup.signature(x), "<u2") for x in (a, b)]))
        assert np.intersect1d(keys[0], keys[1]).size


def test_html_names_that_are_no_roles():
    p = "<p>A long paragraph, with many words; and marks. It goes on.</p>"
    for names in ("class='content header-image'", "id=form-follows-function", "class=side-effects", "class='article post related-work'", "class=share-prices"):
        got = html_extract.extract(f"<body><nav>Menu</nav><div><h1>Head</h1>{p * 5}<section {names}>{p * 2}</section></div></body>")
        assert got.count("A long paragraph") == 7, names
    for names in ("class=discussion-thread", "class=user-reactions", "id=commentList", "class='box ad-slot'", "class=relatedPosts", "hidden", "style='display: none'", "class=site-footer"):
        got = html_extract.extract(f"<body><div><h1>Head</h1>{p * 5}<div {names}><p>Not the story, but some words of others.</p></div></div></body>")
        assert "Not the story" not in got and got.count("A long paragraph") == 5, names


def test_html_attributes():
    p = "<p>A long paragraph, with many words; and marks. It goes on.</p>"
    odd = "<p title=it's>First, with some words and marks.</p><p data-x='a > b' hidden>Unseen.</p><p alt=\"x>y\">Second, with some words and marks.</p><p>Sum of <math><mi>x</mi>+<mn>1</mn></math>.</p>"
    assert html_extract.extract(f"<body><article><h1>Head</h1>{p * 2}{odd}</article></body>").split("\n")[3:] == ["First, with some words and marks.", "Second, with some words and marks.", "Sum of x+1."]


def test_html_scores_decide(monkeypatch):
    p = "<p>A long paragraph, with many words; and marks. It goes on.</p>"
    page = f"<body><div><h1>Head</h1>{p * 3}</div></body>"
    assert html_extract.extract(page)
    monkeypatch.setattr(html_extract, "_smooth", lambda x: x * 0)
    assert html_extract.extract(page) == ""


@pytest.mark.parametrize("piece", ["<div>word, ", "<b>word, ", "<div>word, </b>", "<ul><li>word, ", "<a href=x>word "])
def test_html_deep_nesting(piece):
    import time
    import tracemalloc

    begin = time.process_time()
    html_extract.extract(f"<body>{piece * 100_000}</body>")
    assert time.process_time() - begin < 15
    tracemalloc.start()
    html_extract.extract(f"<body>{piece * 100_000}</body>")
    assert tracemalloc.get_traced_memory()[1] < 200_000_000
    tracemalloc.stop()


def test_tiles_without_seeds():
    r = random.Random(9)
    for high in (2, 3, 6):
        for _ in range(25):
            a, b = (np.array([r.randrange(high) for _ in range(n)], np.uint64) for n in (r.randrange(3, 40), r.randrange(3, 80)))
            seeds = [(x, y) for x in range(len(a) - 2) for y in range(len(b) - 2) if (a[x : x + 3] == b[y : y + 3]).all()]
            want = decontaminate.tile(a, b, *(np.array(x) for x in zip(*seeds)), 3) if seeds else []
            assert decontaminate.tile_by_length(a, b, 3) == want


def test_repetitive_texts(spark):
    """Equal words by the thousand: the pairs of places, millions, are never listed."""
    import time
    import tracemalloc

    items = [(1, "la " * 800), (2, "la " * 400 + "lo " * 400), (3, "one two three four five six")]
    texts = ["la " * 8000, "la " * 500 + "lo " * 500, "la " * 350 + "other words of one two three four five six", "la lo " * 3000]
    tracemalloc.start()
    begin = time.process_time()
    seeds = decontaminate.Seeds(items, 5)
    got = {(d, t): (c, n) for d, t, c, n in seeds.pairs(Words(pa.array(texts), True), 0.75)}
    assert got == {(0, 0): (800, 1), (1, 1): (800, 1), (2, 2): (6, 1)}
    assert time.process_time() - begin < 5 and tracemalloc.get_traced_memory()[1] < 200_000_000
    tracemalloc.stop()


def test_language_by_hand(spark):
    """Posteriors and margins of naive Bayes, worked out gram by gram."""
    rows = [(0, "abba abc", "x"), (1, "cab", "x"), (2, "zyx zzy", "y"), (3, "Abc zy", None), (4, "ΩΨΩ", None), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.predict(docs, language_id.train(docs), margin="over").collect()}
    counts = {g: Counter(int(x) for _, t, k in rows if k == g for o in language_id.grams(language_id.letters_of(t)) for x in o) for g in "xy"}
    prior = {"x": np.log(2 / 3), "y": np.log(1 / 3)}
    for d, t, _ in rows[:5]:
        own = [int(x) for o in language_id.grams(language_id.letters_of(t)) for x in o]
        lp = {g: sum(np.log((counts[g][x] + 0.5) / (sum(counts[g].values()) + 0.5 * language_id.BUCKETS)) for x in own) for g in "xy"}
        best = max("xy", key=lambda g: prior[g] + lp[g])
        z = {g: np.exp(prior[g] + lp[g] - prior[best] - lp[best]) for g in "xy"}
        assert got[d]["lang_pred"] == best and abs(got[d]["score"] - 1 / sum(z.values())) < 1e-4
        assert abs(got[d]["over"] - (lp[best] / len(own) + np.log(language_id.BUCKETS))) < 1e-4
    assert got[5]["lang_pred"] == "und" and got[5]["over"] == 0.0


def test_near_duplicates_of_a_whole_table(spark, sf_dir):
    """Components of a driver table against all pairs: no link is lost."""
    rows = [(r["doc_id"], (r["text"] or "").encode().lower().split()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    sets = {d: {hash(tuple(w[k : k + 5])) for k in range(max(1, len(w) - 4))} if w else set() for d, w in rows}
    having: dict = {}
    for d, s in sets.items():
        for x in s:
            having.setdefault(x, []).append(d)
    both = Counter((a, b) for ds in having.values() for i, a in enumerate(ds) for b in ds[i + 1 :])
    least = {d: d for d in sets}
    links = [(a, b) for (a, b), n in both.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    for _ in range(50):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert links
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    assert got == least


def plain_ratios(paths, lines):
    """html_extract.judge by hand: one block at a time, in Python's own numbers."""
    import math

    marks = [sum(c in ".,;:!?…。，、！？；：¿¡" for c in t) for t in lines]
    kernel = [math.exp(-0.5 * k * k) for k in range(-3, 4)]
    kernel = [k / sum(kernel) for k in kernel]

    def ratio(own):
        return [max(own[i], sum(x for x, p in zip(own, paths) if p == paths[i]) / paths.count(paths[i])) for i in range(len(own))]

    def smooth(x):
        return [sum(w * x[min(max(i + d, 0), len(x) - 1)] for d, w in zip(range(-3, 4), kernel)) for i in range(len(x))]

    chars, points = ratio([len(t) for t in lines]), ratio(marks)
    fused = [a * (1 + b) for a, b in zip(smooth(chars), smooth(points))]
    return [f > sum(fused) / len(fused) / 2 for f in fused]


def test_html_ratios_on_all_pages(spark, sf_dir, monkeypatch):
    """Of every page of the table the scores are those of a plain version, and random ones change most texts."""
    judged = []
    real = html_extract.judge
    monkeypatch.setattr(html_extract, "judge", lambda paths, lines: judged.append((paths, lines, real(paths, lines)[0].tolist())) or real(paths, lines))
    pages = [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect()]
    got = [html_extract.extract(h) for h in pages]
    assert len(judged) == len(pages) and all(plain_ratios(p, t) == c for p, t, c in judged)
    draw = np.random.default_rng(0)
    monkeypatch.setattr(html_extract, "_smooth", lambda x: draw.random(len(x)))
    assert sum(a != html_extract.extract(h) for a, h in zip(got, pages, strict=True)) > 0.5 * len(pages)


def test_html_edges_of_a_story():
    """Leads, lists, quotes and closing lines stay whatever the story's element is called; what others wrote goes."""
    p = "<p>A long paragraph, with many words; and marks. It goes on.</p>"
    edges = f"<p>Lead line</p><ul><li>one<li>two</ul>{p * 4}<ul><li>first point<li>second point</ul><blockquote>Short quote.</blockquote><div>End.</div>"
    want = ["Lead line", "one", "two", *["A long paragraph, with many words; and marks. It goes on."] * 4, "first point", "second point", "Short quote.", "End."]
    for tag in ("div", "article", "main", "section", "td"):
        assert html_extract.extract(f"<body><nav><a href=x>Home</a></nav><{tag}>{edges}</{tag}><footer>Imprint</footer></body>").split("\n") == want, tag
    other = "<p>Somebody else wrote this, and it is as long as the story; it goes on.</p>" * 3
    for tag in ("div", "article"):
        for name in "article-comments story-comments fb-comments wp-comments responses feedback related-articles related-stories google-ads video-ad cookiebar cookie-policy-banner".split():
            assert html_extract.extract(f"<body><{tag}>{p * 6}<div class={name}>{other}</div></{tag}></body>").split("\n") == want[3:4] * 6, name
    assert html_extract.extract("<body><div id=page><div><h1>Head</h1><p>By someone, today.</p></div><div>" + p * 4 + "</div></div><div><a href=x>one</a> <a href=y>two</a></div></body>").split("\n") == ["Head", "By someone, today.", *want[3:7]]


def test_repeated_seeds_take_little_time():
    """One phrase again and again between other words: runs by the ten thousand, each looked at a few times."""
    import time

    phrase, r = list(range(5)), random.Random(3)
    for times in (60, 200, 500):
        a, b = (np.array([t for k in range(times) for t in (*phrase, r.randrange(10**9), side + k)], np.uint64) for side in (10**10, 2 * 10**10))
        at = np.arange(times) * 7
        i, j = np.repeat(at, times), np.tile(at, times)
        begin = time.process_time()
        tiles = decontaminate.tile(a, b, i, j, 5)
        assert time.process_time() - begin < 20
        assert sorted(tiles) == [(7 * k, 7 * k, 5) for k in range(times)]
