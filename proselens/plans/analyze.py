"""The whole analysis of a corpus: structure, features, labels and summaries as tables. Blocks and windows are written to
the shared folder, what follows from them is planned lazily."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import fusion, language_model, layout, semantic, structure, stylometry
from ..session import keep
from ..sources import readers

#: Takes windows with style features and adds p_human, p_ai and p_paraphrased_ai.
Scorer = Callable[[DataFrame], DataFrame]

LM_FEATURES = language_model.FEATURES
SEMANTIC_FEATURES = ("max_sim", "mean_top3", "above_tau")
#: Columns in which scorers tell of rows on which they failed, by stage.
ALERTS = {"classifier": "classifier_alert", "language_model": "language_model_alert", "semantic": "semantic_alert"}


def _or_else(alerts: list[tuple[str, str]] | None, stage: str, build: Callable[[], DataFrame], instead: Callable[[], DataFrame], what: str) -> DataFrame:
    """What build makes, or, with an alert, instead if it can't be planned; without a list of alerts nobody would be told,
    so that it fails. Faults while rows are worked out are told by the scorers in columns (see ALERTS); those of built-in
    expressions fail the job."""
    try:
        return build()
    except Exception as e:  # the alert tells of it
        if alerts is None:
            raise
        alerts.append((stage, f"{stage} failed, {what}: {type(e).__name__}: {e}"[:300]))
        return instead()


def window_table(
    windows: DataFrame, *, style: bool = True, model: DataFrame | language_model.TokenScorer | None = None, corpus: DataFrame | None = None, embedder: semantic.Embedder | None = None,
    synonyms: dict[str, list[str]] | None = None, variants: int = 5, alerts: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """windows with the features of every branch that is asked for: style natively in the same pass, language-model,
    perturbation and nearest-neighbour features joined by (doc_id, window_id). model is a token scorer or a table of unigrams;
    the embedder makes vectors of the windows' texts, which are searched among the corpus' (vec_id, embedding). A branch that
    can't be planned has zeros and an alert, and fails where no list of alerts is given; rows on which a scorer fails have
    zeros, and say why in <branch>_alert."""
    key = ("doc_id", "window_id")
    bare = windows
    if style:
        columns = tuple(windows.columns)
        windows = _or_else(alerts, "style", lambda: stylometry.features(bare, "text_raw", columns), lambda: bare, "no features")
    zeros = lambda names: lambda: bare.select(*key, *(F.lit(0.0).alias(n) for n in names))
    lm = neighbours = None
    if model is not None:

        def by_model() -> DataFrame:
            if callable(model):
                return language_model.features(bare, model, key, "text_clean", variants, synonyms)
            return language_model.features_of_texts(bare, model, key, "text_clean", variants, synonyms)

        lm = _or_else(alerts, "language_model", by_model, zeros(LM_FEATURES), "zeros")
    if corpus is not None:

        def by_corpus() -> DataFrame:
            got = (embedder or semantic.hashed_embedder())(bare, key, "text_clean")
            alert = F.col("alert") if "alert" in got.columns else F.lit(None).cast("string")
            made = got.select(*key, "embedding", alert.alias("semantic_alert"))
            x = semantic.broadcast_features(made, key, corpus, fused=True)
            if x is None:
                # Written once: the vectors are both searched and told of.
                q = keep(made.withColumn("query_id", F.xxhash64(*key)), "embedded")
                found = semantic.window_features(semantic.knn(q.where(F.col("embedding").isNotNull()), corpus, fused=True))
                x = q.drop("embedding").join(found, "query_id", "left").drop("query_id")
            return x.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in SEMANTIC_FEATURES})

        neighbours = _or_else(alerts, "semantic", by_corpus, zeros(SEMANTIC_FEATURES), "zeros")
    return fusion.merge_features(windows, lm, neighbours)


def analyse(docs: DataFrame, form_feeds: bool = False, max_pages: int | None = None, **options) -> dict[str, DataFrame]:
    """analyse_blocks of the texts of docs: (doc_id, text), a document a row, each one page; with form_feeds pages are cut at
    them, tidied and numbered. (doc_id, page, text) is a page a row. max_pages leaves out what follows. A document or page
    that stands in two rows is an error, as their blocks would mix."""
    if form_feeds:
        docs = _once(docs, ["doc_id"])
        ids = docs.select("doc_id")
        docs = structure.pages(docs, max_pages=max_pages)
    elif "page" in docs.columns:
        docs = _once(docs, ["doc_id", "page"])
        ids = docs.select("doc_id").distinct()
        docs = docs.where(F.col("page") <= max_pages) if max_pages else docs
    else:
        ids = _once(docs, ["doc_id"]).select("doc_id")
    return analyse_blocks(ids, structure.assign_sections(structure.blocks(docs)), **options)


def _once(docs: DataFrame, key: list[str]) -> DataFrame:
    """docs, if each key stands in one row: ids alone are counted."""
    if docs.groupBy(*key).count().where("count > 1").limit(1).collect():
        raise ValueError(f"{', '.join(key)} isn't unique")
    return docs


def analyse_layout(rows: DataFrame, by_type: bool = False, **options) -> dict[str, DataFrame]:
    """analyse_blocks of laid-out documents (operators.layout.LAYOUT); sentences have the boxes of their blocks, and the
    table ``telemetry`` tells of the parse."""
    parsed = layout.parse(rows, by_type)
    blocks = layout.to_blocks(parsed["units"])
    out = analyse_blocks(rows.select("doc_id").distinct(), blocks, **options)
    return {**out, "sentences": structure.sentence_boxes(out["sentences"], blocks), "telemetry": parsed["telemetry"]}


def analyse_pdf(spark: SparkSession, path: str, max_pages: int | None = C.MAX_PAGES, extract=None, read: readers.PageReader = readers.pymupdf_pages, by_type: bool = False, **options) -> dict[str, DataFrame]:
    """The analysis of PDF files: as laid-out documents by the extractors (readers.pdf_files), and, where those fail or
    find nothing, as pages of styled lines or plain text (readers.styled_pages). Pages beyond max_pages aren't read. Files and
    pages that can't be read at all are alerts of the stage "source"."""
    rows, errors = readers.pdf_files(spark, path, extract, max_pages)
    rows, failed = keep(rows, "layout"), keep(errors, "failed")
    pages, faults = readers.styled_pages(spark, path, read, max_pages, failed)
    laid_out, paged = analyse_layout(rows, by_type, **options), analyse(pages, **options)
    out = {name: laid_out[name].unionByName(paged[name], allowMissingColumns=True) if name in paged else laid_out[name] for name in laid_out}
    told = F.concat_ws(": ", F.concat(F.lit("page "), F.col("page").cast("string")), "message")
    out["alerts"] = out["alerts"].unionByName(faults.select("doc_id", F.lit("source").alias("stage"), told.alias("message")))
    return out


def analyse_blocks(
    ids: DataFrame, assigned: DataFrame, *, config: fusion.Config = fusion.Config(), scorer: Scorer = fusion.style_probabilities, model: DataFrame | language_model.TokenScorer | None = None,
    corpus: DataFrame | None = None, embedder: semantic.Embedder | None = None, synonyms: dict[str, list[str]] | None = None, meta: dict | None = None, splitter="intended", strict: bool = False,
) -> dict[str, DataFrame]:
    """Tables sections, sentences, windows, documents and alerts of documents (doc_id) by their blocks with sections. What
    can't be planned is an alert; strict, it fails, for those who don't read the table of alerts."""
    notes: list[tuple[str, str]] = []
    told = None if strict else notes
    # Blocks are read by many branches, and so are windows where there are others than style; they are written once.
    assigned = keep(assigned, "blocks")
    sents = structure.sentences(assigned, splitter=splitter)
    bare = structure.windows(sents)
    wins = window_table(bare if model is None and corpus is None else keep(bare, "windows"), model=model, corpus=corpus, embedder=embedder, synonyms=synonyms, alerts=told)
    equal = lambda: wins.withColumns({p: F.lit(1.0) / len(fusion.P) for p in fusion.P})
    scored = _or_else(told, "classifier", lambda: scorer(wins), equal, "uniform probabilities")
    use_meta = meta is not None and bool(meta.get("weights"))
    if use_meta:
        features = semantic.document_features(scored) if corpus is not None else None
        scored = _or_else(told, "meta", lambda: fusion.meta_window_probabilities(scored, meta, features), lambda s=scored: s, "the classifier's probabilities")
    # Models run once: all tables, that of alerts included, read what they made.
    wins = fusion.label(fusion.smooth(keep(scored, "scored")), "window_label", "window_confidence")
    judged = fusion.sentence_probabilities(sents, wins)
    secs = fusion.section_summary(structure.sections(assigned), wins, judged, config)
    summary = fusion.document_summary(wins, config)
    if use_meta:
        # The document's own features are of the windows before they were smoothed, under their own names.
        own = fusion.meta_probabilities(fusion.meta_vector(wins, meta["names"], tau=config.tau_semantic), meta).drop("features")
        summary = summary.drop(*fusion.P).join(own, "doc_id", "left")
        summary = summary.withColumn("verdict", fusion.verdict(F.col("p_ai"), F.col("p_paraphrased_ai"), F.col("coverage_ai"), F.col("coverage_paraphrased"), F.col("max_sim"), F.col("detectgpt_mean"), config))
    # Documents without windows are human with no confidence.
    out = ids.select("doc_id").join(summary, "doc_id", "left").join(fusion.label_percentages(judged), "doc_id", "left")
    fill = {c: 0.0 for c in ("coverage_ai", "coverage_paraphrased", "max_sim", "detectgpt_mean", "p_ai", "p_paraphrased_ai", "pct_ai", "pct_paraphrased_ai")} | {"num_windows": 0, "p_human": 1.0, "pct_human": 100.0, "verdict": "human"}
    notes += [(name, f"{name} is not configured") for name, given in (("language_model", model), ("semantic", corpus), ("meta", meta)) if given is None]
    rows = F.array(*(F.struct(F.lit(s).alias("stage"), F.lit(m).alias("message")) for s, m in notes)) if notes else F.array().cast("array<struct<stage:string,message:string>>")
    alerts = ids.select("doc_id", F.explode(rows).alias("a_")).select("doc_id", "a_.stage", "a_.message")
    for stage, column in ALERTS.items():
        if column in wins.columns:
            alerts = alerts.unionByName(wins.where(F.col(column).isNotNull()).select("doc_id", F.lit(stage).alias("stage"), F.col(column).alias("message")).distinct())
    return {"sections": secs, "sentences": judged, "windows": wins, "documents": out.fillna(fill), "alerts": alerts}


#: What a report shows of each table.
VIEWS = {
    "documents": ("doc_id", "verdict", "p_human", "p_ai", "p_paraphrased_ai", "pct_human", "pct_ai", "pct_paraphrased_ai"),
    "sections": ("doc_id", "section_id", "title", "section_name", "num_windows", "num_sentences", "coverage_ai", "coverage_paraphrased"),
    "windows": ("doc_id", "window_id", "section_name", "span_start", "span_end", "window_label", "window_confidence", "text_clean"),
    "sentences": ("doc_id", "sentence_id", "section_name", "label", "confidence", "text"),
    "alerts": ("doc_id", "stage", "message"),
}


def views(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of an analysis with the columns that a report shows."""
    return {name: tables[name].select(*columns) for name, columns in VIEWS.items() if name in tables}


def search_paraphrases(docs: DataFrame, corpus: DataFrame, meta: DataFrame | None = None, embedder: semantic.Embedder | None = None) -> tuple[DataFrame, DataFrame]:
    """(windows, documents) of paraphrase features: sentences of each text in windows of three, embedded and searched.
    With metadata of the corpus (vec_id, ...), windows have those of their nearest vector."""
    w = window_table(structure.windows_of_texts(docs, structure.T.sentences(F.col("text"))), style=False, corpus=corpus, embedder=embedder)
    found = w if meta is None else semantic.attach_meta(w, meta.withColumnRenamed("vec_id", "nn_id"), "nn_id")
    return found, semantic.document_features(w)
