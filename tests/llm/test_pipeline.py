"""The pipeline, stage by stage and as a whole, against brute force on a small corpus; and each query on its table."""

import random
from collections import Counter

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from proselens.llm import byte_bpe, queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, letters, n):
    r = random.Random(seed)
    words = ["".join(r.choice(letters) for _ in range(r.randint(2, 6))) for _ in range(60)]
    return " ".join(r.choice(words) for _ in range(n))


ITEM = "which of these five answers is right the first one or the last of them all"


def corpus():
    own = {k: prose(k, "abcdefg" if k % 2 else "klmnopq", 70) for k in range(20)}
    shared = prose(99, "abcdefg", 40)
    texts = {**own, 3: own[1] + " more", 5: own[1], 7: f"{own[7]} {shared} end", 9: f"{own[9]}\n{shared}", 11: f"{own[11]} {ITEM.upper()} {own[13][:50]}", 20: None, 21: "", 22: "12 !! 34", 23: prose(5, "жщюяэ", 40), 24: "a b"}
    lang = lambda k: None if k in (4, 22, 23, 24) else "xx" if k % 2 else "yy"
    return [(k, t, lang(k), f"s{k % 3}", len(t or "")) for k, t in sorted(texts.items())]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = f"file://{tmp_path_factory.mktemp('corpus')}"
    spark.createDataFrame(corpus(), COLUMNS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def words(t):
    return (t or "").encode().split()


def by_language(rows):
    return [r for r in rows if r[0] not in (20, 21, 22, 23)]


def without_near_copies(rows):
    sets = {}
    for r in rows:
        w = [x.lower() for x in words(r[1])]
        sets[r[0]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    alike = lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    least = {d: d for d in sets}
    for _ in sets:
        least = {d: min(least[e] for e in sets if e == d or alike(d, e)) for d in sets}
    return [r for r in rows if least[r[0]] == r[0]]


def without_repeats(rows):
    n = Counter(tuple(w[k : k + 35]) for r in rows for w in [words(r[1])] for k in range(len(w) - 34))
    out = []
    for d, t, *rest in rows:
        w = words(t)
        gone = {k + i for k in range(len(w) - 34) if n[tuple(w[k : k + 35])] > 1 for i in range(35)}
        t = b" ".join(x for k, x in enumerate(w) if k not in gone).decode() if gone else t
        out.append((d, t, *rest[:2], len(t or "")))
    return out


def without_leaks(rows):
    return [r for r in rows if ITEM not in " ".join((r[1] or "").lower().split())]


BRUTE = (by_language, without_near_copies, without_repeats, without_leaks)


def test_stages_and_run(spark, sf):
    import tiktoken

    rows = corpus()
    for (name, stage), brute in zip(corpus_pipeline.STAGES, BRUTE):
        docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns, name
        before, rows = rows, brute(rows)
        assert sorted(tuple(r) for r in got.collect()) == sorted(rows), name
        assert len(rows) < len(before) or rows != before, name
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = {r[0]: enc.encode_ordinary(r[1] or "") for r in rows}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {d: len(x) for d, x in want.items()} and all(r["round_trip"] for r in got)
    assert all([*memoryview(bytes(r["ids"])).cast("I")] == want[r["doc_id"]] for r in got)


def test_languages_to_keep(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, sf, ("xx",)).collect()}
    assert {1, 7, 19} <= kept and not kept & {0, 2, 4, 18, 23}
    bare = corpus_pipeline.identify_language(spark, docs.withColumn("lang", F.lit(None).cast("string")), sf)
    assert {r["doc_id"] for r in bare.collect()} == {r[0] for r in corpus()} - {20, 21, 22}


@pytest.mark.parametrize("nth", range(4))
def test_stages_on_odd_tables(spark, sf, nth):
    """No rows; nulls in every column; repeated rows and ids; columns with the operators' own names."""
    stage = corpus_pipeline.STAGES[nth][1]
    docs = spark.createDataFrame(corpus(), COLUMNS)
    assert stage(spark, docs.limit(0), sf).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), (None, prose(1, "abc", 60), None, None, None), (1, prose(2, "abc", 60), "xx", None, 1), (1, prose(2, "abc", 60), "xx", None, 1)], COLUMNS)
    odd = odd.withColumns({"kept": F.lit(1), "score": F.lit("x"), "ids": F.lit(2), "kept_text": F.lit("y"), "component_id": F.lit(None).cast("int")})
    got = stage(spark, odd, sf)
    assert got.columns == odd.columns and got.count() >= 2
    assert nth != 1 or got.where("doc_id = 1").count() == 2  # rows of one id are one document
    last = corpus_pipeline.STAGES[4][1](spark, odd, sf)
    assert last.count() == 4 and last.where("NOT round_trip").count() == 0


TABLE = {"op1_html_extraction": "pages", "op10_warc": "pages", "op13_annulus": "embeddings"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_cover_their_tables(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir)
    if name == "op3_topk":
        v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
        assert got.count() == 10 * v.where("vec_id % 100 = 0").count()
    elif name == "op11_hard_negatives":
        v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 100 = 0")
        assert {r["anchor_id"] for r in got.collect()} == {r["vec_id"] for r in v.collect()}
    elif name == "op5_decontamination":
        assert {"doc_id", "item_id"} <= set(got.columns)
    else:
        table = spark.read.parquet(f"{sf_dir}/{TABLE.get(name, 'documents')}.parquet")
        key = table.columns[0]
        assert got.select(key).exceptAll(table.select(key)).count() == 0 and table.select(key).exceptAll(got.select(key)).count() == 0
