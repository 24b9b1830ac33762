"""Pages through the analysis, and text functions whose time grows with the text alone."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from proselens import constants as C
from proselens.functions import text as T
from proselens.operators import structure
from proselens.plans.analyze import analyse
from proselens.sources.readers import from_frame


def timed(spark, column, text, most=10.0):
    df = spark.createDataFrame([(text,)], "t string")
    df.select(column(F.col("t"))).collect()
    begin = time.time()
    out = df.select(column(F.col("t")).alias("x")).first()["x"]
    assert time.time() - begin < most
    return out


def test_long_texts_take_linear_time(spark):
    gap = " " * 1_000_000
    assert timed(spark, T.strip, f"{gap}a{gap}b　 {gap}") == f"a{gap}b"
    assert timed(spark, T.clean_sentence, f"a{gap}b") == "a b"
    openers = "\\( and \\[ and \\begin{equation} " * 30_000
    assert timed(spark, T.strip_math, f"\\(x\\) {openers}") == f"  {openers}"
    assert timed(spark, T.strip_math, "\\(" * 100_000 + "\\)" + "\\[" * 100_000) == " " + "\\[" * 100_000
    pieces = [f"A sentence with number {k}." for k in range(100_000)]
    glued = spark.createDataFrame([(pieces + ["no.", "yes."],)], "p array<string>")
    begin = time.time()
    assert glued.select(structure.glue(F.col("p")).alias("g")).first()["g"] == [*pieces[:-1], f"{pieces[-1]} no. yes."]
    assert time.time() - begin < 20


def test_math_like_one_pattern(spark):
    """Putting openers aside changes nothing: random marks against the pattern over the whole text."""
    r = random.Random(1)
    marks = ["\\(", "\\)", "\\[", "\\]", "$", "$$", "\\begin{equation}", "\\end{equation}", "a", "\n", " b "]
    texts = ["".join(r.choice(marks) for _ in range(r.randint(0, 12))) for _ in range(400)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.strip_math(F.col("t")).alias("x")).collect()
    assert [g["x"] for g in got] == [re.sub(C.MATH, " ", g["t"]) for g in got]


def test_glue_like_a_loop(spark):
    r = random.Random(2)
    cases = [["x" * r.choice((1, 3, 14, 15, 20)) for _ in range(r.randint(0, 8))] for _ in range(200)]

    def plain(pieces):
        done, held = [], []
        for p in pieces:
            held.append(p)
            if len(p) >= C.MIN_SENTENCE_CHARS:
                done, held = [*done, " ".join(held)], []
        if held and done:
            done[-1] = " ".join([done[-1], *held])
        return done or ([" ".join(held)] if held else [])

    got = spark.createDataFrame([(c,) for c in cases], "p array<string>").select("p", structure.glue(F.col("p")).alias("g")).collect()
    assert [g["g"] for g in got] == [plain(g["p"]) for g in got]


PAGED = "Abstract\n\nFirst page of text, which goes on for a while.\n\na\t|b|c\nd|e|f\f \f\fSecond page, still under the same heading as before.\n\n1|2|3\n4|5|6\n\nConclusion\fThird page ends it all, as pages do in the end."


def test_blocks_keep_pages_and_order(spark):
    docs = spark.createDataFrame([(1, PAGED), (2, "One page only, with a sentence."), (3, None)], "doc_id long, text string")
    b = structure.blocks(structure.pages(docs)).orderBy("doc_id", "block_id").collect()
    assert [(x["block_id"], x["page"], x["block_type"]) for x in b if x["doc_id"] == 1] == [(0, 1, "HEADING"), (1, 1, "PARA"), (2, 1, "TABLE"), (3, 2, "PARA"), (4, 2, "TABLE"), (5, 2, "HEADING"), (6, 3, "PARA")]
    assert [x["text"] for x in b if x["block_type"] == "TABLE"] == ["[[TABLE 1 on page 1]]", "[[TABLE 2 on page 2]]"]
    assert {x["page"]: x["block_ids"] for x in structure.page_index(structure.blocks(structure.pages(docs))).where("doc_id = 1").collect()} == {1: [0, 1, 2], 2: [3, 4, 5], 3: [6]}


def test_analysis_of_pages(spark):
    docs = spark.createDataFrame([(1, PAGED), (2, "One page only, with a sentence."), (3, None)], "doc_id long, text string")
    out = analyse(docs, form_feeds=True)
    assert {x["doc_id"] for x in out["documents"].collect()} == {1, 2, 3}
    assert [(x["sentence_id"], x["page"]) for x in out["sentences"].where("doc_id = 1").orderBy("sentence_id").collect()] == [(0, 1), (1, 2), (2, 3)]
    s = out["sections"].where("doc_id = 1").orderBy("section_id").collect()
    assert [(x["title"], x["block_ids"]) for x in s] == [("Abstract", [1, 2, 3, 4]), ("Conclusion", [6])]
    one = analyse(docs, form_feeds=True, max_pages=1)["sentences"]
    assert one.where("page > 1").count() == 0 and one.where("doc_id = 1").count() == 1
    # The same pages as rows of their own; a plain text with form feeds is one page.
    rows = structure.pages(docs)
    assert [x["page"] for x in analyse(rows)["sentences"].where("doc_id = 1").orderBy("sentence_id").collect()] == [1, 2, 3]
    assert {x["page"] for x in analyse(docs)["sentences"].collect()} == {1}


def test_repeated_ids_are_errors(spark):
    docs = spark.createDataFrame([(1, "A sentence of some length."), (1, "Another sentence of some length.")], "doc_id long, text string")
    with pytest.raises(ValueError, match="unique"):
        analyse(docs)
    with pytest.raises(ValueError, match="unique"):
        analyse(docs.withColumn("page", F.lit(2)))


def test_row_numbers_of_many_partitions(spark):
    df = spark.range(500).select(F.concat(F.lit("text "), F.lpad(F.col("id").cast("string"), 4, "0")).alias("t")).repartition(40)
    assert [r["text"] for r in from_frame(df, "t").orderBy("doc_id").collect()] == [f"text {k:04}" for k in range(500)]
