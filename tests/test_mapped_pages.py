"""Pages whose words stand together are mapped and marked without a shuffle."""

from pyspark.sql import functions as F

from proselens.functions import numbers as N
from proselens.plans.queries import QUERIES
from proselens.sources import sinks


def test_running_sums(spark):
    df = spark.createDataFrame([([3, 1, 2],), ([],), (None,), ([5],)], "xs array<int>")
    assert [r["s"] for r in df.select(N.running(F.col("xs")).alias("s")).collect()] == [[0, 3, 4], [], None, [0]]


def test_pages_are_mapped_where_they_stand(spark):
    """page_map of words as rows, of words hyphenated at a line's end, a hyphen alone, none and capitals as well."""
    rows = [(1, p, k, w, float(k), 12.0 * (k // 2)) for p, ws in ((1, ["Well-", "kno-", "wn", "-", None, "End-"]), (2, ["A"])) for k, w in enumerate(ws)]
    words = spark.createDataFrame(rows, "doc_id long, page int, seq int, text string, x0 double, top double").select("*", F.col("x0").alias("x1"), F.col("top").alias("bottom"))
    packed = words.groupBy("doc_id", "page").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text", F.struct("x0", "top", "x1", "bottom").alias("box")))), lambda w: F.struct(w["text"].alias("text"), w["box"].alias("box"))).alias("words"))
    shown = lambda df: sorted((r["page"], r["shown_"], [(w["text"], w["box"], w["at"]) for w in r["w_"]]) for r in df.collect())
    assert shown(sinks.mapped_pages(packed)) == shown(sinks.page_map(words))


def test_annotation_boxes_shuffle_nothing(spark, sf_dir):
    """But for dealing out a small table to all cores."""
    plan = QUERIES["annotation_boxes"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert [line for line in plan.splitlines() if "Exchange" in line and "RoundRobin" not in line] == []
