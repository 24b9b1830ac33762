"""Tokens are counted in slices of bounded size, so a worker's memory doesn't follow its batch."""

import tracemalloc

import numpy as np
import pyarrow as pa

from proselens.operators import stylometry as S


def test_slices_count_alike(monkeypatch):
    lists = [[f"w{k % 7}ing" for k in range(n)] for n in (0, 3, 90, 0, 1, 60, 200, 2)]
    tokens = pa.array([*lists, None], pa.list_(pa.string()))
    numbers = pa.array([None if x is None else [hash(w) for w in x] for x in tokens.to_pylist()], pa.list_(pa.int64()))
    whole, ratios = S.count_tokens(tokens), S.moving_ratios(numbers, 50)
    for most in (1, 50, 100, 1000):
        monkeypatch.setattr(S, "SLICE", most)
        parts = list(S.slices(tokens))
        assert sum(map(len, parts)) == len(tokens) and all(len(p) == 1 or len(p.flatten()) <= most for p in parts)
        assert pa.concat_arrays([S.count_tokens(p) for p in parts]).to_pylist() == whole.to_pylist()
        assert np.array_equal(np.concatenate([S.moving_ratios(p, 50) for p in S.slices(numbers)]), ratios)


def test_memory_is_that_of_a_slice():
    tokens = pa.ListArray.from_arrays(pa.array(np.arange(0, 2_000_001, 1000), pa.int32()), pa.array([f"w{k % 999}" for k in range(2_000_000)]))
    tracemalloc.start()
    for x in S.slices(tokens):
        S.count_tokens(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20


def test_words_are_looked_for_once(spark):
    """Syllables follow from words but where there are links and addresses, and each sentence's words are looked for once."""
    from pyspark.sql import functions as F

    from proselens.functions import text as T

    texts = ["It is 3.5-7 of a1e2. See https://example.org/area?u=io now! Mail ada.lovelace@example.org today.", "Plain ideas: queue, don't-eye. 12 oars 4a5", "at@ all ://aeio uy", "", None, "zzz", "İİ naïve. Éa"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    x = S.features(df, keep=("doc_id", "text"))
    sub = F.array_join(T.sentences(F.col("text")), " ")
    by_text = 206.835 - 1.015 * F.col("n_words") / F.col("n_sent") - 84.6 * T.syllables(sub) / F.col("n_words")
    rows = x.select("flesch", F.when((F.col("n_words") > 0) & (F.col("n_sent") > 0), by_text).otherwise(0.0).alias("want")).collect()
    assert len(rows) == 7 and all(abs((r["flesch"] or 0.0) - r["want"]) < 1e-9 for r in rows)
    plan = S.features(df, keep=("doc_id",)).select("burst_cv", "ttr", "flesch")._jdf.queryExecution().optimizedPlan().toString()
    words = r"[A-Za-z][A-Za-z'\-]*|"
    assert plan.count(words) == 1


def test_words_are_lowered_and_tagged_batch_by_batch(spark):
    """Words reach the counting as they stand; tags are those of the expression."""
    from pyspark.sql import functions as F

    from proselens.functions import text as T

    words = ["the", "and", "he", "under", "quickly", "walked", "going", "famous", "topic", "native", "table", "only", "bed", "sky", "a", "i", "3.5", "o'al", "ly", "ic"]
    upper = [w.title() for w in words]
    a, b = (S.count_tokens(pa.array([x, [], x[:3] * 30], pa.list_(pa.string()))).to_pylist() for x in (words, [*upper[:9], *words[9:]]))
    assert a == b and a[0]["types"] == 20 and a[2]["types"] == 3
    want = [r["t"].lower() for r in spark.createDataFrame([(k, w) for k, w in enumerate(words)], "k int, w string").orderBy("k").select(T.part_of_speech(F.col("w")).alias("t")).collect()]
    assert [S.C.POS_TAGS[k] for k in S.tags(pa.array(words))] == want


def test_windows_that_one_branch_reads_are_not_written(spark, monkeypatch):
    from proselens.plans import analyze

    kept, keep = [], analyze.keep
    monkeypatch.setattr(analyze, "keep", lambda df, name: (kept.append(name), keep(df, name))[1])
    docs = spark.createDataFrame([(1, "Abstract\n\nOne sentence stands here. Another one follows it. And a third one."), (2, "")], "doc_id long, text string")
    assert analyze.analyse(docs)["documents"].count() == 2
    assert kept == ["blocks", "scored"]
