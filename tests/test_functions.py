"""Column functions against hand-made cases."""

from pyspark.sql import functions as F

from proselens.functions import numbers as N
from proselens.functions import text as T
from proselens.operators import stylometry, structure


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def text(spark, f, x):
    return spark.createDataFrame([(x,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


def test_sentences(spark):
    t = "One two three. Four five six! Seven?"
    assert text(spark, T.sentences, t) == ["One two three.", "Four five six!", "Seven?"]
    assert text(spark, lambda c: T.sentences(c, "literal"), t) == [t]
    assert text(spark, T.sentences, " \n ") == []
    assert text(spark, T.sentences, None) is None


def test_math_and_cleaning(spark):
    assert text(spark, T.clean_sentence, "a $x$ b") == "a b"
    assert text(spark, T.clean_sentence, "a \\(x\n+y\\)  b") == "a b"


def test_headings(spark):
    for x, want in (("literature reviewx", True), ("introductionx", False), ("Introduction", True), ("2. Introduction", True), ("The Methods", True), ("", False), ("   ", False)):
        assert text(spark, T.known_heading, x) is want, x
    assert text(spark, T.known_with_prefix, "2. Introduction") is True
    assert text(spark, T.known_with_prefix, "Results: more") is True
    assert text(spark, T.normal_heading, "IV. The Results & 2 of Discussion") == "results discussion"


def test_canonical_sections(spark):
    for x, want in (("Methods", "METHODS"), ("Summary and Conclusion", "ABSTRACT"), ("2 Methods", "2 METHODS"), ("!!", "SECTION"), ("Findings of it", "RESULTS")):
        assert text(spark, T.canonical_section, x) == want


def test_ontology(spark):
    for x, want in (("2 Related Work", "RELATED_WORK"), ("Fig. 1", None), ("Figure 1 plot", "FIGURE_CAPTION"), ("title", "TITLE"), ("other", None)):
        assert text(spark, T.ontology, x) == want


def test_keywords(spark):
    assert text(spark, T.keywords, "Keywords: alpha, beta; gamma.") == ["alpha", "beta", "gamma"]


def test_list_and_caption_blocks(spark):
    for x, want in (("2019 was", True), ("- item", True), ("1.2) a", True), ("word", False)):
        assert text(spark, structure.is_list_line, x) is want
    kinds = {"Figure 3 Loss curve": "CAPTION", "Abstract": "HEADING", "a | b | c\nd | e | f": "TABLE", "- one\n- two": "LIST", "Just some ordinary text that goes on.": "PARA"}
    for x, want in kinds.items():
        assert text(spark, lambda c: structure.block_type(F.split(c, "\n")), x) == want, x


def test_glue(spark):
    g = lambda xs: spark.createDataFrame([(xs,)], "a array<string>").select(structure.glue(F.col("a")).alias("x")).first()["x"]
    assert g(["abc", "x" * 30, "abcde"]) == ["abc " + "x" * 30 + " abcde"]
    assert g(["abc", "abcdefghi"]) == ["abc abcdefghi"]
    assert g(["x" * 20, "ab", "y" * 20]) == ["x" * 20, "ab " + "y" * 20]
    assert g([]) == []


def test_window_starts(spark):
    want = {0: [], 1: [0], 3: [0], 4: [0, 2], 5: [0, 2], 6: [0, 2, 4], 7: [0, 2, 4]}
    got = spark.createDataFrame([(n,) for n in want], "n int").select("n", structure.window_starts(F.col("n")).alias("s")).collect()
    assert {r["n"]: r["s"] for r in got} == want


def test_style_features(spark):
    r = stylometry.run(spark.createDataFrame([(1, "The cat sat. It ran quickly!"), (2, ""), (3, None)], "doc_id long, text string")).collect()
    assert len(r) == 1
    r = r[0].asDict()
    want = dict(n_sent=2, n_words=6, avg_word_len=3.5, ttr=1.0, mattr=1.0, pos_noun=0.5, pos_det=1 / 6, pos_pron=1 / 6, pos_adv=1 / 6, mean_slen=3.0, burst_cv=0.0, burst_b=-1.0, flesch=105.09, fk_grade=-0.653333, gunning_fog=1.2)
    for k, v in want.items():
        assert abs(r[k] - v) < 1e-5, (k, r[k])


def test_moving_ratio_against_direct():
    import random

    import numpy as np
    import pyarrow as pa

    random.seed(1)
    lists = [[random.randrange(k + 2) for _ in range(n)] for k, n in ((3, 0), (5, 1), (9, 49), (9, 50), (9, 51), (30, 200), (1, 120))]
    direct = [0.0 if not x else (len(set(x)) / len(x) if len(x) <= 50 else np.mean([len(set(x[i : i + 50])) / 50 for i in range(len(x) - 49)])) for x in lists]
    assert np.allclose(stylometry.moving_ratios(pa.array(lists, pa.list_(pa.int64())), 50), direct)


def test_numbers(spark):
    row = spark.createDataFrame([(0.2, 0.3, 0.0)], "a double, b double, z double")
    p = row.select(*N.renormalise(F.col("z"), F.col("z"))).first()
    assert tuple(p) == (0.0, 0.0)
    assert abs(sum(row.select(*N.softmax(F.col("a"), F.col("b"), F.col("z"))).first()) - 1) < 1e-12
    z = row.select(N.z_score(F.array("a", "b"), F.array(F.lit(0.1), F.lit(0.1)), F.array(F.lit(0.0), F.lit(0.1))).alias("x")).first()["x"]
    assert [round(x, 6) for x in z] == [0.1, 2.0]
    assert row.select(N.first_label(F.lit(0.4), F.lit(0.4), F.lit(0.2)).alias("x")).first()["x"] == "human"


def test_softmax_to_the_last_bit(spark):
    """Labels of scores that all but tie hang on the last bit, so it is that of SQL's exp."""
    import math

    xs = [(k * 0.0137 - 2.0, k * 0.0071 - 1.0, 0.5) for k in range(200)] + [(None, 0.5, None)]
    got = spark.createDataFrame(xs, "a double, b double, c double").coalesce(1).select("a", *(p.alias(f"p{i}") for i, p in enumerate(N.softmax(F.col("a"), F.col("b"), F.col("c"))))).collect()
    for x, r in zip(xs[:-1], got[:-1], strict=True):
        e = [math.exp(v - max(x)) for v in x]
        assert [r["p0"], r["p1"], r["p2"]] == [v / (e[0] + e[1] + e[2]) for v in e]
    assert got[-1]["p0"] is None
