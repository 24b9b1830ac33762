"""Branches of windows: faults are told or fail the job, and features are those of the plain ways to make them."""

import pytest
from pyspark.sql import functions as F

from proselens.functions import numbers as N
from proselens.functions import text as T
from proselens.operators import language_model as lm
from proselens.operators import ngrams, semantic, structure
from proselens.plans import queries
from proselens.plans.analyze import analyse, window_table

WINDOWS = "doc_id long, window_id int, text_raw string, text_clean string"


def broken(*_, **__):
    raise RuntimeError("no model")


@pytest.mark.parametrize("branch", [{"model": broken}, {"corpus": True, "embedder": broken}])
def test_faults_without_alerts_fail(spark, branch):
    """Zeros without a word of why would look like a result."""
    windows = spark.createDataFrame([(1, 0, "a b", "a b")], WINDOWS)
    own = branch | ({"corpus": spark.range(1)} if "corpus" in branch else {})
    with pytest.raises(RuntimeError, match="no model"):
        window_table(windows, style=False, **own)
    notes = []
    window_table(windows, style=False, alerts=notes, **own)
    assert len(notes) == 1 and "no model" in notes[0][1]


@pytest.mark.parametrize("stage", ["model", "scorer"])
def test_strict_analysis_fails(spark, stage):
    docs = spark.createDataFrame([(1, "The cat sat on the mat. It ran away quickly after that.")], "doc_id long, text string")
    assert analyse(docs, **{stage: broken})["alerts"].where("message LIKE '%no model%'").count() == 1
    with pytest.raises(RuntimeError, match="no model"):
        analyse(docs, strict=True, **{stage: broken})


@pytest.mark.parametrize("name", ["all_branches", "window_branches"])
def test_queries_tell_of_faults(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr("proselens.operators.semantic.broadcast_features", broken)
    with pytest.raises(RuntimeError, match="no model"):
        queries.QUERIES[name](spark, sf_dir)


TEXTS = ["", "...", "it's a well-known fact_of 3.5 or 12,000 caf\u00e9s, na\u00efve \u4e2d\u6587 x\u0301y", "One two two, three. " * 40, "A 1 b 2 c 3! " * 30, None]


@pytest.mark.parametrize("draws", [F.xxhash64, lm.md5_draws])
def test_tokens_of_variants_are_those_of_their_texts(spark, draws):
    """Words of variants are counted without writing the variants: a row once for a text and once for all of them."""
    docs = spark.createDataFrame([(k, k % 2, t) for k, t in enumerate(TEXTS)], "doc_id long, window_id int, text string")
    key = ("doc_id", "window_id")
    got = lm.text_tokens(docs, key, variants=3, draws=draws)
    of = lambda k: sorted(map(tuple, got.where(f"a{k}").select("doc_id", "token").collect()))
    plain = lambda text: sorted(map(tuple, docs.select("doc_id", F.explode(T.words(F.lower(text)))).collect()))
    assert of(0) == plain(F.col("text"))
    for k in (1, 2, 3):
        assert of(k) == plain(lm.perturbed(F.col("text"), F.struct(*key), F.lit(k), draws=draws)) != of(0)
    assert got.count() <= 2.1 * len(of(0))


@pytest.mark.parametrize("head", [3, 100])
def test_unigram_features_at_once(spark, monkeypatch, head):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    model = lm.unigrams(lm.tokens(docs.where("doc_id <> 4")))
    plain = lm.unigram_scorer(model)
    want = lm.features(docs, lambda *a: plain(*a), ("doc_id",), variants=2)
    monkeypatch.setattr(ngrams, "HEAD", head)
    fixed = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(want.columns).collect())
    assert fixed(lm.features(docs, plain, ("doc_id",), variants=2)) == fixed(want)


def test_hashed_embedding_is_counted_at_once(spark):
    """The vectors of one expression a component, to the last bit."""
    docs = spark.createDataFrame(list(enumerate(TEXTS[:-1])), "doc_id long, text string")
    tokens = F.transform(T.words(F.lower("text")), lambda w: F.pmod(F.xxhash64(w), F.lit(64)).cast("int"))
    plain = N.unit(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.size(F.filter(tokens, lambda t: t == k)).cast("double")))
    df = docs.select(semantic.hashed_embedding(F.col("text")).alias("made"), plain.alias("want"))
    assert all(r["made"] == r["want"] and len(r["made"]) == 64 for r in df.collect())
    assert spark.sql("SELECT CAST(NULL AS STRING) AS text").select(semantic.hashed_embedding(F.col("text"))).first()[0] is None
    assert "filter(" not in docs.select(semantic.hashed_embedding(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_of_texts_are_made_where_they_stand(spark):
    """The windows of sentences as one section, without a shuffle of texts."""
    texts = ["", None, " ".join(f"Sentence number {k} of it." for k in range(9)), "One. Two! Three? Four.", "Only one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    s = docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sentence_id", "text"))
    want = structure.windows(s.select("*", F.lit(0).alias("section_id"), F.lit("ALL").alias("section_name"), F.col("sentence_id").alias("section_offset"), F.col("text").alias("clean_text")))
    got = structure.windows_of_texts(docs, T.sentences(F.col("text")), section_name="ALL")
    rows = lambda df: sorted(map(str, df.collect()))
    assert got.columns == want.columns and rows(got) == rows(want) and got.count() == 7
    assert "Exchange" not in plan(got)


def test_unigram_scores_shuffle_no_token(spark):
    """Tokens of windows are summed where they stand: none goes through a shuffle with its place."""
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    model = lm.unigrams(lm.tokens(docs))
    assert "posexplode" not in plan(lm.features(docs, lm.unigram_scorer(model), ("doc_id",), variants=0))
