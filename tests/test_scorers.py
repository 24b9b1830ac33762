"""Scorers and embedders from Python: what they are given, how often they are loaded, and what happens where they fail."""

import math
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from proselens import workers
from proselens.operators import language_model as lm
from proselens.operators import ngrams, semantic
from proselens.plans.analyze import analyse

TEXTS = ["The first document says this. It says that as well. And then it ends here.", "boom goes the second document. It has two sentences.", "The third one is like the first. It ends here, too.", "%%%"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(4)


def logging_model(path, answer):
    """A loader that notes each load, of a model that notes each text; it fails on texts with boom."""

    def load():
        with open(f"{path}/loads-{os.getpid()}", "a") as f:
            f.write("x\n")

        def model(texts):
            if any("boom" in t for t in texts):
                raise RuntimeError("no memory")
            with open(f"{path}/texts-{os.getpid()}", "a") as f:
                f.writelines(t.replace("\n", " ") + "\n" for t in texts)
            return [answer(t) for t in texts]

        return model

    return load


def noted(path, kind):
    return Counter(line for f in path.iterdir() if f.name.startswith(kind) for line in f.read_text().splitlines())


def test_models_are_loaded_once_a_worker(spark, tmp_path):
    score = lm.python_scorer(logging_model(str(tmp_path), lambda t: [(-1.0, 2.0, 3.0)] * len(t.split())))
    df = spark.range(200).select("id", F.concat(F.lit("text number "), "id").alias("t")).repartition(40)
    for _ in range(2):
        got = score(df, ("id",), "t").collect()
    assert len(got) == 600 and {(r["lp"], r["entropy"], r["rank"], r["alert"]) for r in got} == {(-1.0, 2.0, 3.0, None)}
    files = [f for f in tmp_path.iterdir() if f.name.startswith("loads")]
    # 80 tasks; each process that served some loaded the model once.
    assert files and all(f.read_text() == "x\n" for f in files) and len(files) < 20


def test_what_a_worker_holds_is_bounded(monkeypatch):
    class Model:
        def __init__(self, n):
            self.nbytes = n

    monkeypatch.setattr(workers, "_HELD", type(workers._HELD)())
    monkeypatch.setattr(workers, "BOUND", 100)
    for name, n in (("a", 60), ("b", 30), ("a", 60), ("c", 50)):
        workers.held(name, lambda n=n: Model(n))
    # b was used least recently, then a: only c fits.
    assert list(workers._HELD) == ["c"]
    assert workers.held("large", lambda: Model(1000)).nbytes == 1000 and list(workers._HELD) == ["large"]


def test_failing_models_give_zeros_and_alerts(spark, docs, tmp_path):
    corpus = spark.createDataFrame([(k, [1.0 if j == k else 0.1 for j in range(3)]) for k in range(3)], "vec_id long, embedding array<double>")
    paths = [tmp_path / x for x in ("lm", "vec")]
    for p in paths:
        p.mkdir()
    model = lm.python_scorer(logging_model(str(paths[0]), lambda t: [(-math.log(2 + k), 1.5, k + 1) for k, _ in enumerate(t.split())]))
    embedder = semantic.python_embedder(logging_model(str(paths[1]), lambda t: ([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [9.0, 9.0, 9.0]], [1, 1, 0])))
    out = analyse(docs, model=model, corpus=corpus, embedder=embedder)
    w = {r["doc_id"]: r.asDict() for r in out["windows"].collect()}
    assert set(w) == {0, 1, 2, 3}
    n = len(w[0]["text_clean"].split())
    assert w[0]["logprob"] == pytest.approx(-sum(math.log(2 + k) for k in range(n)) / n) and w[0]["mean_entropy"] == 1.5 and w[0]["avg_rank"] == (n + 1) / 2
    # The unmasked token vectors' mean, to unit length, against [1, .1, .1].
    assert w[0]["max_sim"] == pytest.approx(1.1 / math.sqrt(2)) and w[0]["language_model_alert"] is None and w[0]["semantic_alert"] is None
    assert all(w[1][c] == 0 for c in (*lm.FEATURES, "max_sim", "mean_top3", "above_tau"))
    alerts = {(r["doc_id"], r["stage"]): r["message"] for r in out["alerts"].collect()}
    assert "RuntimeError: no memory" in alerts[1, "language_model"] and "RuntimeError: no memory" in alerts[1, "semantic"]
    assert not any((k, s) in alerts for k in (0, 2, 3) for s in ("language_model", "semantic"))
    assert out["documents"].count() == 4
    seen = noted(paths[1], "texts")
    assert seen and all(t.startswith("query: ") for t in seen)
    # All tables were read: no window was embedded again for that.
    out["documents"].collect()
    assert noted(paths[1], "texts") == seen


def test_embedders(spark, tmp_path):
    rows = [(k, f"text {k % 5}") for k in range(50)] + [(50, None), (51, "boom")]
    df = spark.createDataFrame(rows, "id long, t string").repartition(5)
    embed = semantic.once_each(semantic.python_embedder(logging_model(str(tmp_path), lambda t: [float(len(t)), float(t[-1] == "4"), 0.0]), kind=None))
    # An empty text has no last character.
    got = {r["id"]: r for r in embed(df, ("id",), "t").collect()}
    assert len(got) == 52 and got[3]["embedding"] == [1.0, 0.0, 0.0] and got[4]["embedding"] == pytest.approx([6 / math.sqrt(37), 1 / math.sqrt(37), 0.0])
    assert got[51]["embedding"] is None and "no memory" in got[51]["alert"] and "IndexError" in got[50]["alert"]
    assert noted(tmp_path, "texts") == Counter({"": 1} | {f"text {k}": 1 for k in range(5)})
    table = df.select(semantic.content_key(F.col("t")).alias("text_key"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding")).where("t <> 'text 1'").distinct()
    found = {r["id"]: r for r in semantic.precomputed(table)(df, ("id",), "t").collect()}
    assert found[0]["embedding"] == [1.0, 2.0] and found[1]["embedding"] is None and "no vector" in found[1]["alert"] and found[0]["alert"] is None
    tokens = spark.createDataFrame([(1, [[3.0, 0.0], [0.0, 4.0], [7.0, 7.0]], [1, 1, 0]), (2, [[1.0, 1.0]], [0])], "id long, v array<array<double>>, m array<int>")
    pooled = {r["id"]: r["embedding"] for r in semantic.token_vector_embedder("v", "m")(tokens, ("id",), "v").collect()}
    assert pooled[1] == pytest.approx([0.6, 0.8]) and pooled[2] is None


def test_scores_depend_on_context(spark):
    train = spark.createDataFrame([(1, "a b a b a c"), (2, "a b"), (3, "")], "doc_id long, text string")
    k, v = 0.01, 3
    model = ngrams.train(train)
    contexts = {r["context"]: r for r in model.contexts.collect()}
    # After a: b three times, c once; the entropy is over b, c, a and what is unknown.
    z = 4 + k * (v + 1)
    p = [(3 + k) / z, (1 + k) / z, k / z, k / z]
    assert contexts["a"]["entropy"] == pytest.approx(-sum(x * math.log(x) for x in p))
    asked = spark.createDataFrame([(7, "a b"), (8, "a a x"), (9, "zzz b"), (10, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["position"]): r for r in ngrams.scorer(model)(asked, ("doc_id",), "text").collect()}
    assert set(got) == {(7, 0), (7, 1), (8, 0), (8, 1), (8, 2), (9, 0), (9, 1)}
    assert got[7, 1]["lp"] == pytest.approx(math.log(p[0])) and got[7, 1]["rank"] == 1
    assert got[8, 1]["lp"] == pytest.approx(math.log(p[2])) and got[8, 1]["rank"] == 3 and got[8, 1]["entropy"] == pytest.approx(contexts["a"]["entropy"])
    # Behind an unknown token the empty context holds: a 4, b 3, c 1 of 8.
    z1 = 8 + k * (v + 1)
    assert got[9, 1]["lp"] == pytest.approx(math.log((3 + k) / z1)) and got[9, 1]["rank"] == 2
    third = ngrams.scorer(ngrams.train(train, order=3))(asked, ("doc_id",), "text").collect()
    assert len(third) == 7
    one = {(r["doc_id"], r["position"]): r for r in ngrams.scorer(ngrams.train(train, order=1))(asked, ("doc_id",), "text").collect()}
    assert one[8, 2]["rank"] == 4 and one[7, 0]["rank"] == 1 and len({r["entropy"] for r in one.values()}) == 1


def test_frequent_keys_are_broadcast(spark, monkeypatch):
    """With a head of three keys the others meet by a shuffle, and nothing is lost or doubled."""
    text = " ".join(f"w{k % 7} w{k % 3}" for k in range(100))
    df = spark.createDataFrame([(k, text) for k in range(5)] + [(9, "w1 unknown w2")], "doc_id long, text string")
    model = ngrams.train(df.where("doc_id < 5"))
    want = sorted(map(tuple, ngrams.scorer(model)(df, ("doc_id",), "text").collect()))
    monkeypatch.setattr(ngrams, "HEAD", 3)
    assert sorted(map(tuple, ngrams.scorer(model)(df, ("doc_id",), "text").collect())) == want and len(want) == 2005


def test_analysis_with_bigrams(spark, docs):
    out = analyse(docs, model=ngrams.scorer(ngrams.train(docs)))
    w = out["windows"].collect()
    assert all(r["ppl"] > 1 and r["mean_entropy"] > 0 and r["avg_rank"] >= 1 for r in w if len(r["text_clean"]) > 5)
    assert len({round(r["mean_entropy"], 9) for r in w}) > 2
    # A text without a word has no token to score.
    assert [(r["ppl"], r["detectgpt_score"]) for r in w if r["doc_id"] == 3] == [(0.0, 0.0)]


def test_pairs_are_drawn_once(spark):
    """Whether neighbours are swapped is drawn once a pair, and words alone are drawn; odd ends and no words stay."""
    texts = ["", "one", "one two", "one two three", "a , b . c ! d", "x " * 51, None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    made = df.select("id", "text", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).select("id", "text", lm.perturbed(F.col("text"), F.col("id"), F.col("k"), drop=0.0, swap=0.5, draws=lm.md5_draws).alias("t"))
    rows = made.collect()
    assert {r["t"] for r in rows if r["id"] == 0} == {""} and {r["t"] for r in rows if r["id"] == 1} == {"one"} and {r["t"] for r in rows if r["id"] == 2} == {"two one"}
    assert {r["t"] for r in rows if r["id"] == 3} == {"two one three"} and all(r["t"] is None for r in rows if r["id"] == 6)
    assert {r["t"] for r in rows if r["id"] == 4} == {"a , b . c ! d"}
    assert made._jdf.queryExecution().analyzed().toString().count("swap") == 1
