"""Headings, tables, laid-out documents, matching, scorers and the whole analysis, against hand-made cases."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from proselens import cli
from proselens.functions import numbers as N
from proselens.functions import text as T
from proselens.operators import fusion, layout, semantic, structure, stylometry
from proselens.operators import language_model as lm
from proselens.plans.analyze import analyse, analyse_layout, search_paraphrases, views
from proselens.sources import readers, sinks

DOCS = "doc_id long, text string"


def value(spark, f, *xs):
    df = spark.createDataFrame([tuple(xs)], [f"c{k}" for k in range(len(xs))])
    return df.select(f(*(F.col(f"c{k}") for k in range(len(xs)))).alias("x")).first()["x"]


@pytest.mark.parametrize(("line", "want"), [("I went home early", False), ("3rd attempt failed", True), ("II. Early work", True), ("II Early work", False), ("OUR MAIN FINDINGS", True), ("what follows:", True), ("ÉTUDE ÉLARGIE", True), ("Just ordinary words here", False), ("", False)])
def test_heading_rules(spark, line, want):
    assert value(spark, T.looks_like_heading, line) is want


def test_known_headings_in_long_texts(spark):
    assert value(spark, T.known_heading, "the of in " * 60 + "Methods") is True
    assert value(spark, T.known_heading, "methods are described in the following five long paragraphs") is False
    for x, want in (("1) Methods", True), ("4 Introduction", True), ("Results: " + "long " * 50, True), ("xii. references", True), ("nothing known", False)):
        assert value(spark, T.known_with_prefix, x) is want


def test_heading_tails_go_on(spark):
    text = "Abstract\nIntroduction\nMethods\nResults\nDiscussion\nThis is a paragraph of ordinary text that goes on for a while."
    got = [(r["block_type"], r["text"]) for r in structure.blocks(spark.createDataFrame([(1, text)], DOCS)).orderBy("block_id").collect()]
    # A tail that begins with a known heading is one with what stands before it.
    assert got == [("HEADING", text.replace("\n", " "))]
    text = "Abstract\n1. one small thing of some length here\n2. another thing of some length\nThis is a paragraph of ordinary text that goes on for a while."
    got = [(r["block_type"], r["text"]) for r in structure.blocks(spark.createDataFrame([(1, text)], DOCS)).orderBy("block_id").collect()]
    assert got == [("HEADING", "Abstract"), ("LIST", text.split("\n", 1)[1])]
    deep = "\n".join(f"{k}x" + " word" * 3 for k in range(1, 7)) + "\nAnd here at last is the ordinary text of it, which goes on."
    rows = structure.blocks(spark.createDataFrame([(1, deep)], DOCS)).orderBy("block_id").collect()
    assert len(rows) == 1 and rows[0]["block_type"] == "PARA"
    chain = "\n".join(f"Results: part {k}" for k in range(5)) + "\nplain text that goes on for quite some while"
    assert structure.blocks(spark.createDataFrame([(1, chain)], DOCS)).count() == 1


def unit(text, x0, top, page=0, width=100.0, height=10.0):
    return {"text": text, "page": page, "x0": float(x0), "x1": float(x0 + width), "top": float(top), "bottom": float(top + height), "type": "PARA"}


HEAD = [unit("Title & Author(s), Year", 10, 0), unit("Methodology", 150, 0), unit("Key findings", 300, 0), unit("S/N", 480, 0), unit("Observations", 430, 0)]


def test_table_rows_are_told_apart_by_their_middles():
    rows = [u for k in range(3) for u in (unit(f"Paper {k}", 10, 20 + 20 * k), unit(f"Method-", 152, 20 + 20 * k), unit(f"{k}", 155, 20 + 20 * k))]
    got = layout.read_table([*HEAD, *rows])
    assert got["headers"] == ["TITLE_AUTHOR_YEAR", "METHODOLOGY", "KEY_FINDINGS", "LIMITATIONS"]
    assert [r["TITLE_AUTHOR_YEAR"] for r in got["rows"]] == ["Paper 0", "Paper 1", "Paper 2"] and got["rows"][1]["METHODOLOGY"] == "Method 1"


def test_table_ends_pages_and_blanks():
    body = [unit("Paper 0", 10, 30), unit("  ", 10, 60), unit("Paper 1", 10, 30, page=1), unit("A wide paragraph", 10, 60, page=1, width=450), unit("After", 10, 90, page=1)]
    got = layout.read_table([*HEAD, *body])
    assert [r["TITLE_AUTHOR_YEAR"] for r in got["rows"]] == ["Paper 0", "Paper 1"] and got["used"] == set(range(8))
    assert layout.read_table(HEAD) is None and layout.read_table([]) is None and layout.read_table([unit("Methodology", 0, 0)]) is None
    joined = layout.read_table([unit("Title &", 10, 0), unit("Author names", 12, 4), unit("Methodology", 150, 0), unit("Key findings", 300, 0), unit("P", 10, 40)])
    assert joined["headers"][0] == "TITLE_AUTHOR_YEAR"


def test_tables_in_place(spark):
    rows = [(1, s, "RELATED_WORK", k, "PARA", u["text"], u["page"], u["x0"], u["x1"], u["top"], u["bottom"], None, None) for s in (0, 2) for k, u in enumerate([unit("Before it", 10, -240), unit("Near", 10, -120), unit("Nearer", 10, -60), *HEAD, unit("Paper", 10, 30), unit("A wide paragraph", 10, 90, width=450)])]
    rows += [(1, 1, "METHODS", 0, "PARA", "Methodology", 0, 0.0, 1.0, 0.0, 1.0, None, None), (2, 0, "X", 0, "PARA", None, None, None, None, None, None, None, None)]
    units = spark.createDataFrame(rows, layout.UNIT)
    got = layout.repair_tables(units).orderBy("doc_id", "section_id", "nth").collect()
    assert [(r["section_id"], r["type"], r["text"]) for r in got if r["doc_id"] == 1] == [(s, *x) for s in (0, 1, 2) for x in ([("PARA", "Before it"), ("TABLE", None), ("PARA", "A wide paragraph")] if s != 1 else [("PARA", "Methodology")])]
    assert [r["rows"][0]["TITLE_AUTHOR_YEAR"] for r in got if r["type"] == "TABLE"] == ["Paper"] * 2
    # Up to three bands make a header, so what stands close above it goes with it.
    b = layout.to_blocks(layout.repair_tables(units)).orderBy("doc_id", "block_id").collect()
    assert [(r["block_type"], r["text"], r["page"]) for r in b][1] == ("TABLE", "[[TABLE 1 on page ?]]", None) and "KEY_FINDINGS" in b[1]["metadata"]["table_json"]
    assert {(r["title"], r["section_name"]) for r in b} == {("Related Work", "RELATED WORK"), ("Methods", "METHODS")} and len(b) == 7


def laid_out(*lines):
    return [(1, k, t, p, float(x0), float(x1), float(top), float(top + 10), size, bold, False) for k, (t, p, x0, x1, top, size, bold) in enumerate(lines)]


def test_laid_out_documents(spark):
    lines = [("Abstract", 0, 10, 60, 0, 14.0, True), ("We show a thing of interest. It works well.", 0, 200, 500, 60, 10.0, False), ("Keywords: alpha; beta,", 0, 10, 500, 200, 10.0, False), ("gamma", 0, 300, 500, 300, 10.0, False), ("Methods", 1, 10, 60, 0, 14.0, True), ("Our method is described here at length. It has two parts.", 1, 200, 500, 100, 10.0, False)]
    rows = spark.createDataFrame(laid_out(*lines), layout.LAYOUT)
    parsed = layout.parse(rows)
    units = [(r["label"], r["type"], r["text"]) for r in parsed["units"].orderBy("section_id", "nth").collect()]
    assert ("KEYWORDS", "KEYWORD", "beta") in units and units[0] == ("ABSTRACT", "PARA", "Abstract")
    t = parsed["telemetry"].first()
    assert (t["pages"], t["sections"], t["tables_fixed"], t["mode"]) == (2, 3, 0, "L3")
    out = analyse_layout(rows)
    s = out["sentences"].orderBy("sentence_id").collect()
    assert {r["section_name"] for r in s} >= {"ABSTRACT", "METHODS"} and s[0]["bbox_x0"] == 10.0 and s[0]["block_source"] == "parser"
    assert out["documents"].first()["num_windows"] > 0 and set(views(out)) == {"documents", "sections", "windows", "sentences", "alerts"}


def test_heading_and_paragraph_merge_by_type(spark):
    rows = spark.createDataFrame(laid_out(("Methods", 0, 0, 0, 0, 0.0, False), ("Some text that goes on.", 0, 0, 0, 10, 0.0, False)), layout.LAYOUT)
    alike, apart = (layout.merge_paragraphs(layout.heading_candidates(rows), by_type=b).collect() for b in (False, True))
    assert [r["text"] for r in alike] == ["Methods Some text that goes on."] and sorted(r["type"] for r in apart) == ["HEADING_CAND", "PARA"]


def test_pages_by_style(spark):
    rows = [(1, 1, 0, "A Long Title", 18.0, 0), (1, 1, 1, "first line of text here", 10.0, 0), (1, 1, 2, "second line of it", 10.0, 0), (1, 1, 3, "Bold head", 10.7, 2), (1, 1, 4, "and text.", 10.0, 0), (1, 2, 0, "Ends with a stop.", 30.0, 0), (1, 2, 1, "  ", 10.0, 0)]
    got = structure.page_of_styled_lines(spark.createDataFrame(rows, "doc_id long, page int, seq int, text string, size double, flags int")).orderBy("page").collect()
    assert [r["text"] for r in got] == ["A Long Title\n\nfirst line of text here second line of it\n\nBold head\n\nand text.", "Ends with a stop."]


PAGE = {"blocks": [{"type": 0, "bbox": (1, 2, 30, 40), "lines": [{"bbox": (1, 2, 30, 10), "spans": [{"text": "A ", "size": 9, "flags": 0}, {"text": "line", "size": 12, "flags": 16}]}, {"spans": [{"text": " "}]}, {"spans": [{"text": "more"}]}]}, {"type": 1, "bbox": (0, 0, 1, 1)}]}


def test_pages_of_pdf_libraries():
    assert layout.block_spans(PAGE, 3) == [{"seq": 0, "text": "A line\nmore", "page": 3, "x0": 1, "x1": 30, "top": 2.0, "bottom": 14.0, "font_size": 0.0, "bold": False, "ital": False}]
    assert [(r["text"], r["size"], r["flags"]) for r in layout.styled_lines(PAGE)] == [("A line", 12.0, 16), ("more", 0.0, 0)]
    chars = [{"text": t, "x0": x, "x1": x + 5, "top": y, "bottom": y + 10, "size": 10.0, "fontname": f} for t, x, y, f in (("b", 5, 1.2, "X-Bold"), ("a", 0, 1.0, "X"), ("c", 0, 20, None))]
    assert [(r["text"], r["bold"], r["x1"]) for r in readers.char_lines(chars, 0)] == [("ab", True, 10), ("c", False, 5)]
    assert [r["top"] for r in readers.plain_paragraphs("x\n\n \n\ny")] == [0.0, 100.0]


def test_extractors_in_turn(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    seen = lambda data, pages: readers.plain_paragraphs(f"pages {pages}")
    broken, empty = (lambda data, pages: 1 / 0), (lambda data, pages: [])
    rows, errors = readers.pdf_files(spark, str(tmp_path), [broken, empty, seen], max_pages=7)
    assert rows.first()["text"] == "pages 7" and errors.count() == 0
    rows, errors = readers.pdf_files(spark, str(tmp_path), [broken, empty])
    assert rows.count() == 0 and "ZeroDivisionError" in errors.first()["message"] and "no text" in errors.first()["message"]
    assert set(readers.EXTRACTORS) == {"pymupdf", "pdfplumber"}


def test_ids_by_order_over_many_partitions(spark):
    r = random.Random(1)
    xs = [r.randrange(10**9) for _ in range(500)]
    got = readers.from_frame(spark.createDataFrame([(x, f"t{x}") for x in xs], "k long, t string").repartition(7), "t", order="k").orderBy("doc_id").collect()
    assert [(g["doc_id"], g["text"]) for g in got] == [(k, f"t{x}") for k, x in enumerate(sorted(xs))]


def test_matching_of_texts(spark):
    assert value(spark, T.run_of, ["A", "b", "C", "b", "c"], ["B", "c"]) == 1 and value(spark, T.run_of, ["a"], ["b"]) is None and value(spark, T.run_of, ["a"], ["a", "b"]) is None
    assert value(spark, T.contains_text, "Some\n text  here", "TEXT here") is True and value(spark, T.contains_text, "x", " ") is False
    got = value(spark, T.snippets, "one two- three  four five", "One Two- Three four five")
    assert got == ["one two- three four five", "one two-three four five", "one two- three four", "one two- three"]
    assert value(spark, T.snippets, "a b", "") == ["a b"]
    box = lambda *b: dict(zip(("x0", "top", "x1", "bottom"), map(float, b), strict=True))
    assert value(spark, layout.box_union, [pytest.importorskip("pyspark.sql").Row(**box(1, 2, 3, 4)), pytest.importorskip("pyspark.sql").Row(**box(0, 5, 2, 9))]).asDict() == box(0, 2, 3, 9)
    assert value(spark, T.to_double, "1.5") == 1.5 and value(spark, T.to_double, "x") is None
    assert value(spark, T.label, " AI-generated") == "ai" and T.plain_label("Machine ") == "ai" and value(spark, T.label, "other") == "other"
    assert value(spark, layout.nearest_column, 20.0, [10.0, 30.0]) == 0


def test_annotations(spark):
    words = [(1, 1, k, w, float(10 * k), 0.0, float(10 * k + 8), 5.0) for k, w in enumerate("The cat sat on a mat".split())]
    w = spark.createDataFrame(words, "doc_id long, page int, seq int, text string, x0 double, top double, x1 double, bottom double")
    b = spark.createDataFrame([(1, 1, 0, "Elsewhere the\ndog ran", 1.0, 2.0, 3.0, 4.0)], w.schema)
    rows = [(1, 0, 1, "Cat sat on", "cat  sat on", "ai", None), (1, 1, 1, "The dog ran", "the dog ran", "human", None), (1, 2, 1, "nowhere", "nowhere", "human", 7.0), (1, 3, 1, "lost", "lost", "human", None), (1, 4, None, "no page", "x", "human", 7.0)]
    s = spark.createDataFrame([(*r, r[-1], r[-1], r[-1]) for r in rows], "doc_id long, sentence_id int, page int, text string, clean_text string, label string, bbox_x0 double, bbox_y0 double, bbox_x1 double, bbox_y1 double")
    got = {r["sentence_id"]: (r["how"], tuple(r["box"])) for r in sinks.annotations(s, w, b).collect()}
    assert got == {0: ("snippet", (10.0, 0.0, 38.0, 5.0)), 1: ("block", (1.0, 2.0, 3.0, 4.0)), 2: ("box", (7.0, 7.0, 7.0, 7.0))}


def test_index_round_trip(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    sinks.save_index(v, f"file://{tmp_path}/i", spark.createDataFrame([(1, "one")], "vec_id long, name string"))
    vectors, meta = readers.vector_index(spark, f"file://{tmp_path}/i/vectors", f"file://{tmp_path}/i/meta")
    assert vectors.count() == 2 and meta.first()["name"] == "one"
    corpus = spark.createDataFrame([(5, "the cat sat on the mat today")], "vec_id long, t string").select("vec_id", semantic.hashed_embedding(F.col("t")).alias("embedding"))
    w, _ = search_paraphrases(spark.createDataFrame([(1, "The cat sat on the mat today.")], DOCS), corpus, meta=spark.createDataFrame([(5, "a cat")], "vec_id long, title string"))
    assert w.first()["title"] == "a cat"


def test_many_queries_meet_the_corpus_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(1)
    v = r.integers(-3, 4, size=(90, 4)).astype(float)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(90, None)], "vec_id long, embedding array<double>")
    q = df.withColumnRenamed("vec_id", "query_id")
    one = {tuple(x) for x in semantic.knn(q, df, skip_self=True).collect()}
    monkeypatch.setattr(semantic, "QUERY_BLOCK", 20)
    monkeypatch.setattr(semantic, "CORPUS_BLOCK", 17)
    assert {tuple(x) for x in semantic.knn(q, df, skip_self=True).collect()} == one and len(one) == 90 * 5


def test_pooling_and_prefixes(spark):
    got = value(spark, N.mean_pool, [[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])
    assert got == [2.0, 3.0] and value(spark, N.mean_pool, [[1.0]], [0]) is None
    assert value(spark, lambda c: semantic.prefixed(c, "query"), "x") == "query: x"
    assert [round(x, 9) for x in value(spark, N.unit, [3.0, 4.0])] == [0.6, 0.8] and value(spark, N.unit, [0.0, 0.0]) == [0.0, 0.0]


def test_own_splitter_and_tagger(spark):
    docs = spark.createDataFrame([(1, "one part of some length;another part of some length")], DOCS)
    s = structure.sentences(structure.assign_sections(structure.blocks(docs)), splitter=lambda c: F.split(c, ";"))
    assert s.count() == 2
    f = stylometry.features(docs, "text", ("doc_id",), tagger=lambda w: F.when(w == "of", "ADP").otherwise("SYM")).first()
    assert round(f["pos_adp"], 6) == 0.2 and round(f["pos_other"], 6) == 0.8 and f["pos_noun"] == 0


def test_counts_stand_for_tokens(spark):
    docs = spark.createDataFrame([(1, "a b b c c c"), (2, "c c d"), (3, "")], DOCS)
    m = lm.unigrams(lm.tokens(docs))
    a, b = ({r["doc_id"]: [round(r[c], 9) for c in ("logprob", "ppl", "mean_entropy", "surprisal_mean", "surprisal_var", "avg_rank")] for r in x.collect()} for x in (lm.aggregates(lm.score_tokens(lm.tokens(docs), m)), lm.aggregates_of_counts(lm.token_counts(docs), m)))
    assert a == b and set(a) == {1, 2}


def test_perturbation_against_its_texts(spark):
    docs = spark.createDataFrame([(k, " ".join(random.Random(k).choice(["big", "cat", "dog", "ran", "off,", "it's"]) for _ in range(60))) for k in range(4)], DOCS)
    m = lm.unigrams(lm.tokens(docs))
    lp = {r["token"]: r["lp"] for r in m.collect()}
    table = {"big": ["large", "huge", "great", "Big", "vast"], "cat": ["cat"]}
    made = docs.select("doc_id", "text", *(lm.perturbed(F.col("text"), F.col("doc_id"), F.lit(k), synonyms=table).alias(f"v{k}") for k in range(1, 6))).collect()
    mean = lambda t: np.mean([lp[w] for w in map(str.lower, __import__("re").findall(r"[A-Za-z][A-Za-z'\-]*|[0-9]+(?:\.[0-9]+)?", t)) if w in lp])
    got = {r["doc_id"]: r["detectgpt_score"] for r in lm.perturbation_score(docs, m, synonyms=table).collect()}
    assert all(abs(got[r["doc_id"]] - (mean(r["text"]) - np.mean([mean(r[f"v{k}"]) for k in range(1, 6)]))) < 1e-9 for r in made)
    new = {w for r in made for k in range(1, 6) for w in r[f"v{k}"].split()} - {w for r in made for w in __import__("re").findall(r"\w+|[^\w\s]", r["text"])}
    assert new and new <= {"great", "huge", "large"}
    with pytest.raises(ValueError):
        lm.synonym_map({str(k): [] for k in range(lm.MAX_SYNONYMS + 1)})


def fixed(**p):
    return lambda df: df.withColumns({f"p_{k}": F.lit(float(v)) for k, v in p.items()})


PAPER = "Abstract\n\n" + "The cat sat on the mat. It was a fine day out there. " * 6


def test_each_verdict_rule_fires(spark):
    docs = spark.createDataFrame([(1, PAPER)], DOCS)
    verdict = lambda **o: analyse(docs, **o)["documents"].first()
    assert verdict(scorer=fixed(human=0.2, ai=0.1, paraphrased_ai=0.7))["verdict"] == "paraphrased_ai"
    assert verdict(scorer=fixed(human=0.2, ai=0.7, paraphrased_ai=0.1))["verdict"] == "ai"
    assert verdict(scorer=fixed(human=0.6, ai=0.2, paraphrased_ai=0.2))["verdict"] == "human"
    # Sure of a tenth of all windows' labels, but not half of the mass: coverage with similarity or the perturbation score decides.
    low = lambda kind: lambda df: df.withColumns({"p_human": F.lit(0.0), "p_ai": F.lit(0.49 if kind == "ai" else 0.02), "p_paraphrased_ai": F.lit(0.49 if kind == "paraphrased_ai" else 0.02)})
    config = fusion.Config(confidence=0.4)
    corpus = docs.select(F.lit(9).cast("long").alias("vec_id"), semantic.hashed_embedding(F.lit("The cat sat on the mat. It was a fine day out there. The cat sat on the mat.")).alias("embedding"))
    r = verdict(scorer=low("paraphrased_ai"), config=config, corpus=corpus)
    assert r["max_sim"] > 0.78 and r["verdict"] == "paraphrased_ai" and verdict(scorer=low("paraphrased_ai"), config=config)["verdict"] == "human"
    model = lm.unigrams(lm.tokens(docs))
    r = verdict(scorer=low("ai"), config=fusion.Config(confidence=0.4, detectgpt_threshold=10.0), model=model)
    assert r["detectgpt_mean"] != 0 and r["verdict"] == "ai" and verdict(scorer=low("ai"), config=config)["verdict"] == "human"


def test_scorers_that_fail(spark, tmp_path):
    docs = spark.createDataFrame([(1, PAPER), (2, "")], DOCS)
    t = analyse(docs, scorer=lambda df: df.select("no such column"))
    assert [round(t["windows"].first()[f"p_{x}"], 6) for x in ("human", "ai", "paraphrased_ai")] == [0.333333] * 3
    assert {(r["doc_id"], r["stage"]) for r in t["alerts"].where("message like '%uniform%'").collect()} == {(1, "classifier"), (2, "classifier")}
    t = analyse(docs, model=docs.select("text"))
    assert t["windows"].first()["ppl"] == 0.0 and t["alerts"].where("stage = 'language_model' AND message like '%zeros%'").count() == 2
    good, bad = (fusion.python_scorer(lambda f=f: f) for f in (lambda ts: [{"machine": 3.0, "human": 1.0} for _ in ts], lambda ts: 1 / 0))
    w = analyse(docs, scorer=good)["windows"].first()
    assert (w["p_ai"], w["p_human"], w["classifier_alert"]) == (0.75, 0.25, None)
    t = analyse(docs, scorer=bad)
    assert t["windows"].first()["window_label"] == "human" and "ZeroDivisionError" in t["alerts"].where("stage = 'classifier'").first()["message"]
    (tmp_path / "c.json").write_text(json.dumps({"features": ["n_words", "none"], "weights": {"Human-written": [1.0, 5.0], "machine": [0.0, 0.0]}}))
    w = analyse(docs, scorer=fusion.linear_classifier(str(tmp_path / "c.json")))["windows"].first()
    assert w["p_human"] > 0.99 and w["p_paraphrased_ai"] == 0.0
    assert fusion.load_meta_file(str(tmp_path / "none.json")) is None and fusion.load_meta_file(str(tmp_path / "c.json")) is None


def test_meta_probabilities_of_windows(spark):
    w = spark.createDataFrame([(1, 0, 2.0), (1, 1, None), (2, 0, 1.0)], "doc_id long, window_id int, x double")
    features = spark.createDataFrame([(1, 0.5)], "doc_id long, coverage double")
    model = fusion.load_meta({"columns": ["x", "coverage", "num_windows", "other"], "mu": [1.0, 0, 0, 0], "sigma": [0.0, 1, 1, 1], "weights": [[1, 2, 3, 4], [0, 0, 0, 0]], "label_map": {"1": "machine", "0": "human"}})
    got = {(r["doc_id"], r["window_id"]): r for r in fusion.meta_window_probabilities(w, model, features).collect()}
    for key, z in {(1, 0): 1 + 1.0 + 6, (1, 1): -1 + 1.0 + 6, (2, 0): 0 + 0 + 3}.items():
        assert abs(got[key]["p_human"] - np.exp(z) / (1 + np.exp(z))) < 1e-9 and got[key]["p_paraphrased_ai"] == 0.0
    meta = fusion.load_meta({"columns": ["n_words", "p_human"], "weights": [[0.0, 0.0], [9.0, 0.0], [0.0, 0.0]]})
    t = analyse(spark.createDataFrame([(1, PAPER)], DOCS), meta=meta)
    assert t["windows"].first()["window_label"] == "ai" and t["documents"].first()["verdict"] == "ai"


def test_command(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Abstract: We do things.\n\nIntroduction\nIt goes on.")
    cli.main([str(tmp_path / "a.txt"), "--out", str(tmp_path / "o.json"), "--min-conf", "0.1"], spark)
    got = json.loads((tmp_path / "o.json").read_text())
    assert got["mode"] == "L3" and got["telemetry"]["num_pages"] == 1 and got["sections"][0]["units"][0]["type"] == "PARA"
    (tmp_path / "e.txt").write_text(" ")
    with pytest.raises(ValueError):
        cli.sections_of(spark, str(tmp_path / "e.txt"))


def test_moving_ratio_batches():
    assert stylometry.moving_ratios(pa.array([[1, 1]], pa.list_(pa.int64())), 50).tolist() == [0.5]


def test_meta_layers_from_files(spark, tmp_path):
    """Layers from JSON and npz give what numpy gives; files and shapes that don't fit give no model."""
    r = np.random.default_rng(4)
    w0, b0, w1, b1 = r.normal(size=(5, 3)), r.normal(size=5), r.normal(size=(3, 5)), r.normal(size=3)
    np.savez(tmp_path / "m.npz", columns=np.array(["n_words", "ttr", "num_windows"]), mu=np.array([1.0, 0.5, 2.0]), sigma=np.array([2.0, 0.0, 1.0]), w0=w0, b0=b0, w1=w1, b1=b1)
    spec = {"feature_columns": ["n_words", "ttr", "num_windows"], "mean": [1.0, 0.5, 2.0], "std": [2.0, 0.0, 1.0], "label_map": {"1": "ai", "0": "human", "2": "paraphrase"}, "layers": [{"weights": w0.tolist(), "bias": b0.tolist()}, {"weights": w1.tolist(), "bias": b1.tolist()}]}
    (tmp_path / "m.json").write_text(json.dumps(spec))
    (tmp_path / "bad.json").write_text(json.dumps(spec | {"layers": spec["layers"][:1]}))
    x = np.array([[3.0, 0.25, 2.0], [7.0, 1.0, 1.0]])
    out = np.maximum((x - [1.0, 0.5, 2.0]) / [2.0, 1.0, 1.0] @ w0.T + b0, 0) @ w1.T + b1
    want = np.exp(out) / np.exp(out).sum(1, keepdims=True)
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "doc_id long, features array<double>")
    for name in ("m.npz", "m.json"):
        model = fusion.load_meta_file(str(tmp_path / name))
        got = fusion.meta_probabilities(df, model).orderBy("doc_id").collect()
        assert np.allclose([[g[p] for p in fusion.P] for g in got], want)
    assert fusion.load_meta_file(str(tmp_path / "bad.json")) is None and fusion.load_meta_file(str(tmp_path / "none.npz")) is None
    docs = spark.createDataFrame([(1, "One sentence is here. Another one follows it. And a third.")], "doc_id long, text string")
    p = analyse(docs, meta=fusion.load_meta_file(str(tmp_path / "m.json")))["documents"].first()
    assert sum(p[c] for c in fusion.P) == pytest.approx(1.0)
