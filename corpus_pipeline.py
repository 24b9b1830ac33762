"""A training corpus from ``documents``: language, near duplicates, repeated passages, benchmark leaks, tokens.

STAGES lists (name, function) in order; each function takes (spark, docs, sf_dir) and returns a DataFrame, which run()
writes and reads again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselens.llm import byte_bpe, decontaminate, language_id, near_dedup, substring_dedup
from proselens.llm.common import materialise

#: Languages to keep; None keeps all that the model has learned.
LANGUAGES: tuple[str, ...] | None = None
#: A document goes if its grams aren't likelier by this mean logarithm in its language than among evenly mixed grams.
MIN_MARGIN = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str, languages: tuple[str, ...] | None = None) -> DataFrame:
    """Drops documents that are null or have no letter, those in other languages than LANGUAGES, and those that no learned
    language explains: unknown languages and scripts, and letters without order. The model learns from all labelled
    documents; if none is labelled, only the first rule holds."""
    model = language_id.train(docs)
    if not model[0]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    judged = language_id.predict(docs, model, margin="margin_")
    good = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("margin_") > MIN_MARGIN)
    wanted = languages or LANGUAGES
    return judged.where(good & F.col("lang_pred").isin(*wanted) if wanted else good).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates."""
    return near_dedup.survivors(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes all words under repeated windows out of the texts; n_chars follows. No document goes, even if it is left empty."""
    return substring_dedup.deduplicate(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids (little-endian u32), n_tokens and whether the ids decode to the text."""
    vocabulary = byte_bpe.Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    known = docs.select("doc_id", "lang", "source", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"), "text")
    got = byte_bpe.encode(known, vocabulary, public_tokenizers.PATTERN, decoded="decoded")
    return got.select("doc_id", "lang", "source", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_benchmark_leaks),
    ("byte_bpe", tokenise),
]

#: Models, signatures and merges are beyond SQL; tests/llm/test_pipeline.py holds every stage and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
