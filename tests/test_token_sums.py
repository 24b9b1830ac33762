"""Sums of tokens: the same however many of the model's tokens are broadcast, and frequent tokens aren't shuffled."""

import pytest

from proselens.operators import language_model as lm
from proselens.operators import ngrams

TEXTS = [(0, "a a b c zz"), (1, "b b b"), (2, "unknown words"), (3, ""), (4, None), (5, "c d e f a 7 7 7")]


@pytest.mark.parametrize("head", [0, 2, 100])
def test_sums(spark, monkeypatch, head):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    model = lm.unigrams(lm.tokens(docs.where("doc_id <> 2")))
    fixed = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(sorted(df.columns)).collect())
    want = fixed(lm.aggregates(lm.score_tokens(lm.tokens(docs), model)))
    score = fixed(lm.perturbation_score(docs, model, variants=2))
    monkeypatch.setattr(ngrams, "HEAD", head)
    assert fixed(lm.aggregates_of_texts(docs, model)) == want and len(want) == 3
    assert fixed(lm.perturbation_score(docs, model, variants=2)) == score and len(score) == 6


def test_frequent_tokens_leave_a_row_a_text(spark):
    """What is shuffled of texts of frequent tokens is a row each, not one a distinct token."""
    docs = spark.range(50).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 200), i -> concat('w', chr(97 + i % 26), chr(97 + i % 7)))) AS text").coalesce(1)
    model = lm.unigrams(lm.tokens(docs))
    for df in (lm.perturbation_score(docs, model, variants=2), lm.aggregates_of_texts(docs, model)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert [line for line in plan.splitlines() if "Aggregate [doc_id" in line] and not [line for line in plan.splitlines() if "Aggregate [doc_id" in line and "token" in line.split("]")[0]]


@pytest.mark.parametrize("head", [0, 3, 100])
@pytest.mark.parametrize("order", [1, 2, 3])
def test_sums_of_ngrams(spark, monkeypatch, head, order):
    """The aggregates of a scorer's tokens, without a row a token: unknown tokens, contexts and both, repeats, empty texts."""
    docs = spark.createDataFrame([*TEXTS, (6, "a q a q a a"), (7, "q q a b")], "doc_id long, text string")
    fixed = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(sorted(df.columns)).collect())
    model = ngrams.train(docs.where("doc_id NOT IN (2, 6, 7)"), order)
    want = fixed(lm.aggregates(ngrams.scorer(model)(docs, ("doc_id",), "text")))
    monkeypatch.setattr(ngrams, "HEAD", head)
    got = ngrams.aggregates_of_texts(model, docs)
    assert fixed(got) == want and len(want) == 6
