"""Operators on small tables, against hand-made cases and plain Python."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from proselens.operators import fusion, layout, semantic, structure
from proselens.operators import language_model as lm
from proselens.plans.analyze import analyse, search_paraphrases, window_table
from proselens.sources import readers, sinks

DOCS = "doc_id long, text string"


def paper(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), DOCS)


def test_only_section_is_front_matter(spark):
    x = structure.assign_sections(structure.blocks(paper(spark, "Abstract\n\nThis is one paragraph of text that says something.")))
    s = structure.sections(x).collect()
    assert [(r["title"], r["section_name"]) for r in s] == [("Abstract", "FRONTMATTER")]


def test_bare_headings_are_one_document_section(spark):
    x = structure.assign_sections(structure.blocks(paper(spark, "Abstract\n\nMethods")))
    assert [(r["title"], r["block_ids"]) for r in structure.sections(x).collect()] == [("Document", [0, 1])]


def test_table_placeholder_and_heading_tail(spark):
    t = "Abstract\nThis tail reads like ordinary text, more than a heading would.\n\na | b | c\nd | e | f"
    b = {r["block_id"]: r for r in structure.blocks(paper(spark, t)).collect()}
    assert [b[k]["block_type"] for k in sorted(b)] == ["HEADING", "PARA", "TABLE"]
    assert b[2]["text"] == "[[TABLE 1 on page 1]]" and b[2]["metadata"]["raw"].startswith("a | b")


def test_pages(spark):
    got = structure.pages(paper(spark, "one\f\f two-\nfold \f\n"), max_pages=2).orderBy("page").collect()
    assert [(r["page"], r["text"]) for r in got] == [(1, "one"), (2, " twofold ")]


def test_smoothing(spark):
    df = spark.createDataFrame([(1, k, 0, p, 0.0, 0.0) for k, p in enumerate((0.2, 0.5, 0.9))], "doc_id long, window_id int, section_id int, p_human double, p_ai double, p_paraphrased_ai double")
    got = [r["p_human"] for r in fusion.smooth(df).orderBy("window_id").collect()]
    assert [round(x, 6) for x in got] == [0.35, 0.533333, 0.7]


@pytest.mark.parametrize(("args", "want"), [((0.5, 0.5, 0, 0, 0, 0), "paraphrased_ai"), ((0, 0, 0, 0.30, 0.78, 0), "paraphrased_ai"), ((0, 0, 0.35, 0, 0, -0.02), "ai"), ((0, 0, 0, 0, 0, 0), "human")])
def test_verdict(spark, args, want):
    p_ai, p_para, c_ai, c_para, sim, dg = (F.lit(float(x)) for x in args)
    assert spark.range(1).select(fusion.verdict(p_ai, p_para, c_ai, c_para, sim, dg).alias("v")).first()["v"] == want


def test_uncovered_sentences(spark):
    """List items in a document with windows are human for sure; without windows with no confidence."""
    text = "- one item that is long enough\n- two items that are long enough"
    docs = paper(spark, text, "A paragraph that has some words in it. And one more sentence here.\n\n" + text)
    t = analyse(docs)
    lists = {r["doc_id"]: r for r in t["sentences"].where("block_type = 'LIST'").collect()}
    assert lists[0]["confidence"] == 0.0 and lists[1]["confidence"] == 1.0 and lists[1]["label"] == "human"
    d = {r["doc_id"]: r for r in t["documents"].collect()}
    assert d[0]["verdict"] == "human" and d[0]["num_windows"] == 0 and d[1]["num_windows"] == 1
    assert t["sections"].count() == 2 and t["alerts"].count() == 6
    out = sinks.payload(t["sentences"].select("doc_id", "sentence_id", "text"), t["windows"].select("doc_id", "window_id"), t["sections"].select("doc_id", "section_id"), t["documents"])
    assert len(json.loads(out.where("doc_id = 1").first()["payload"])["sentences"]) == t["sentences"].where("doc_id = 1").count()
    html = sinks.report_html(t["sentences"]).where("doc_id = 1").first()["html"]
    assert "conic-gradient" in html and html.count("<h3>") == 1 and "• " in html


def test_empty_corpus(spark):
    assert analyse(spark.createDataFrame([], DOCS))["documents"].count() == 0


def test_meta(spark):
    assert fusion.load_meta({"feature_columns": ["a"]})["sigma"] == [1.0] and fusion.load_meta({}) is None
    w = spark.createDataFrame([(1, 0.9, 2.0), (1, 0.5, 4.0)], "doc_id long, max_sim double, x double")
    v = fusion.meta_vector(w, ["num_windows", "coverage", "x_mean", "x_max", "x", "top3_mean"]).first()["features"]
    assert v == [2.0, 0.5, 3.0, 4.0, 3.0, 0.0]


def test_knn_ties_and_few_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None)], "vec_id long, embedding array<float>")
    got = semantic.knn(v.withColumnRenamed("vec_id", "query_id"), v, k=5, skip_self=True).where("query_id = 3").orderBy("rank").collect()
    assert [(r["vec_id"], r["sim"]) for r in got] == [(1, 0.0), (2, 0.0)]
    f = {r["query_id"]: r for r in semantic.window_features(semantic.knn(v.withColumnRenamed("vec_id", "query_id"), v, skip_self=True)).collect()}
    assert f[1]["above_tau"] == 1 and f[1]["nn_id"] == 2 and f[1]["mean_top3"] == 0.5


def test_paraphrase_search(spark):
    corpus = spark.createDataFrame([(1, "the cat sat on the mat today")], "vec_id long, t string").select("vec_id", semantic.hashed_embedding(F.col("t")).alias("embedding"))
    w, d = search_paraphrases(paper(spark, "The cat sat on the mat today.", ""), corpus)
    assert [round(r["max_sim"], 6) for r in w.collect()] == [1.0] and d.first()["coverage"] == 1.0


def test_rank_of_equal_counts(spark):
    toks = lm.tokens(paper(spark, "a a a b b c c d"))
    rank = {r["token"]: r["rank"] for r in lm.unigrams(toks).collect()}
    assert rank == {"a": 1, "b": 2, "c": 2, "d": 4}


def test_perturbation_is_repeatable(spark):
    docs = paper(spark, "the cat sat on the mat and the dog ran to it " * 5, "", None)
    m = lm.unigrams(lm.tokens(docs))
    a, b = ({r["doc_id"]: r["detectgpt_score"] for r in lm.perturbation_score(docs, m).collect()} for _ in range(2))
    assert a == b and a[1] == 0.0 and a[2] == 0.0


def rows(*items):
    return pd.DataFrame([dict(doc_id=1, seq=k, text=t, page=p, x0=float(x0), x1=float(x1), top=float(top), bottom=float(top + 10), font_size=0.0, bold=False, ital=False) for k, (t, p, x0, x1, top) in enumerate(items)])


def test_paragraph_folding():
    got = layout.fold_paragraphs(rows(("A line that is hyphen-", 0, 10, 200, 0), ("ated here.", 0, 10, 200, 12), ("New one.", 0, 10, 200, 80), ("It goes", 0, 10, 200, 92), ("on over the page.", 1, 10, 200, 0)))
    assert list(got["text"]) == ["A line that is hyphenated here.", "New one. It goes on over the page."]
    got = layout.fold_paragraphs(rows(("- first item", 0, 10, 200, 0), ("indented more", 0, 40, 200, 12), ("- second", 0, 10, 200, 24)))
    assert list(got["text"]) == ["- first item indented more", "- second"]


def test_layout_text_and_median(spark):
    got = layout.from_text(paper(spark, "A\n\nB")).orderBy("seq").collect()
    assert [(r["page"], r["top"]) for r in got] == [(0, 0.0), (0, 100.0)]
    assert spark.range(1).select(layout.upper_median(F.array(*(F.lit(float(x)) for x in (8, 14, 10, 12)))).alias("m")).first()["m"] == 12.0


def test_keyword_passes(spark):
    runs = spark.createDataFrame([(1, 0, "KEYWORDS", "alpha, beta; gamma")], "doc_id long, section_id int, label string, text string")
    assert [r["keyword"] for r in layout.keyword_units(runs).orderBy("nth").collect()] == ["alpha", "beta", "gamma"]
    assert [r["keyword"] for r in layout.keyword_units(runs, passes=2).collect()] == ["alpha beta gamma"]


def test_chars_to_lines(spark):
    c = spark.createDataFrame([(1, 0, "b", 5.0, 9.0, 1.0, 3.0, 10.0, "X-Bold"), (1, 0, "a", 1.0, 5.0, 1.2, 3.0, 12.0, "X")], "doc_id long, page int, text string, x0 double, x1 double, top double, bottom double, size double, fontname string")
    r = layout.lines_of_chars(c).first()
    assert (r["text"], r["x0"], r["x1"], r["font_size"], r["bold"], r["ital"]) == ("ab", 1.0, 9.0, 11.0, True, False)


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello\nworld")
    assert readers.text_files(spark, str(tmp_path)).first()["text"] == "hello\nworld"
    df = spark.createDataFrame([("b",), ("a",)], "t string")
    assert [(r["doc_id"], r["text"]) for r in readers.from_frame(df, "t").orderBy("doc_id").collect()] == [(0, "a"), (1, "b")]
    good, bad = readers.pdf_files(spark, str(tmp_path), extract=lambda b, n: 1 / 0)
    assert good.count() == 0 and "ZeroDivisionError" in bad.first()["message"]


def test_streaming(spark, tmp_path):
    from proselens.streaming import stream

    paper(spark, "The cat sat on the mat. It ran away quickly after that.").write.parquet(str(tmp_path / "in"))
    seen = []
    q = stream.analyse_stream(stream.documents(spark, str(tmp_path / "in")), lambda t, k: seen.extend(t["documents"].collect()), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert len(seen) == 1


def test_windows_get_perturbation_scores(spark):
    words = " ".join("abcdefg"[k % 7] * 3 for k in range(60))
    rows = [(1, 0, words), (1, 1, "unknown words"), (2, 0, words), (2, 1, "")]
    windows = spark.createDataFrame(rows, "doc_id long, window_id int, text_clean string").coalesce(1)
    model = spark.createDataFrame([(x * 3, -1.0 - k, k + 1, 0.1) for k, x in enumerate("abcdefg")], "token string, lp double, rank long, p double").coalesce(1)
    got = {(r["doc_id"], r["window_id"]): r["detectgpt_score"] for r in window_table(windows, style=False, model=model).collect()}
    assert len(got) == 4 and got[1, 1] == got[2, 1] == 0 and got[1, 0] != 0 and got[2, 0] != 0 and got[1, 0] != got[2, 0]
