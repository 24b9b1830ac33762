"""From window features to window, sentence, section and document labels."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .. import constants as C
from ..functions import numbers as N
from ..functions import text as T
from ..session import ship
from ..workers import held
from .language_model import attempt

P = tuple(f"p_{x}" for x in C.LABELS)


@dataclass(frozen=True)
class Config:
    tau_semantic: float = C.TAU_SEMANTIC
    detectgpt_threshold: float = C.DETECTGPT_THRESHOLD
    coverage_ai: float = C.COVERAGE_AI_THRESHOLD
    coverage_para: float = C.COVERAGE_PARA_THRESHOLD
    confidence: float = C.CONFIDENCE_THRESHOLD


def style_probabilities(features: DataFrame) -> DataFrame:
    """The default scorer: a softmax of fixed linear scores of style. It stands in for a trained classifier and makes no
    claim of its accuracy; give analyse() another for that."""
    word, ttr, cv = F.col("avg_word_len"), F.col("ttr"), F.col("burst_cv")
    ps = N.softmax(cv * 2.0 - 0.5, word * 0.3 - 1.0, ttr - 0.5)
    return features.withColumns(dict(zip(P, ps, strict=True)))


def labelled_probabilities(df: DataFrame, by_label: dict[str, Column]) -> DataFrame:
    """df with the p_ columns of probabilities under a classifier's own label names, synonyms resolved, to a sum of 1;
    labels that it lacks have 0."""
    known = {T.plain_label(k): v for k, v in by_label.items()}
    ps = N.renormalise(*(known.get(x, F.lit(0.0)) for x in C.LABELS))
    return df.withColumns(dict(zip(P, ps, strict=True)))


def linear_classifier(path: str) -> Callable[[DataFrame], DataFrame]:
    """A scorer from a JSON file: {"features": [...], "weights": {label: [...]}, "bias": {label: x}}, a softmax of linear
    scores of window features; features that a table lacks count as 0."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    names, labels = spec["features"], list(spec["weights"])

    def score(features: DataFrame) -> DataFrame:
        x = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in features.columns else F.lit(0.0) for n in names]
        linear = [sum((v * float(w) for v, w in zip(x, spec["weights"][k], strict=True)), F.lit(float(spec.get("bias", {}).get(k, 0.0)))) for k in labels]
        return labelled_probabilities(features, dict(zip(labels, N.softmax(*linear), strict=True)))

    return score


def python_scorer(load: Callable[[], Callable[[list[str]], list[dict]]], text: str = "text_clean") -> Callable[[DataFrame], DataFrame]:
    """A scorer from a model in Python. load makes, once a worker process (see workers.held), a function of texts that gives
    a probability a label of each. If it fails on a batch, its texts are tried one by one; those on which it fails get
    equal probabilities, and ``classifier_alert`` says so."""
    name = f"classifier-{uuid.uuid4().hex}"

    def score(features: DataFrame) -> DataFrame:
        ship(features.sparkSession)
        schema = StructType([*features.schema.fields, *(StructField(p, DoubleType()) for p in P), StructField("classifier_alert", StringType())])
        at = features.columns.index(text)

        def run(batches):
            def of(texts):
                got = [{T.plain_label(k): float(v) for k, v in r.items()} for r in held(name, load)(texts)]
                if len(got) != len(texts):
                    raise ValueError("not one result a text")
                return got

            for b in batches:
                got, why = attempt(of, [t or "" for t in b.column(at).to_pylist()])
                got = [r if w is None else dict.fromkeys(C.LABELS, 1 / len(C.LABELS)) for r, w in zip(got, why, strict=True)]
                alerts = [None if w is None else f"classifier failed, uniform probabilities: {w}" for w in why]
                sums = [sum(r.get(x, 0.0) for x in C.LABELS) or 1.0 for r in got]
                columns = [pa.array([r.get(x, 0.0) / s for r, s in zip(got, sums, strict=True)], pa.float64()) for x in C.LABELS]
                yield pa.RecordBatch.from_arrays([*b.columns, *columns, pa.array(alerts, pa.string())], names=[f.name for f in schema])

        return features.mapInArrow(run, schema)

    return score


def merge_features(base: DataFrame, *branches: DataFrame | None, on: tuple[str, ...] = ("doc_id", "window_id")) -> DataFrame:
    """base left-joined with every branch that there is. All joins share their key, so one partitioning serves them."""
    for b in branches:
        if b is not None:
            base = base.join(b, list(on), "left")
    return base


def smooth(probs: DataFrame, doc_id: str = "doc_id", within_section: bool = False) -> DataFrame:
    """Moving means of three windows in document order, truncated at the ends; the raw values go to p_*_raw. They cross
    sections unless within_section."""
    w = Window.partitionBy(doc_id, *(["section_id"] if within_section else [])).orderBy("window_id").rowsBetween(-1, 1)
    out = probs.withColumns({f"{p}_raw": F.col(p) for p in P})
    return out.withColumns({p: F.avg(f"{p}_raw").over(w) for p in P})


def label(df: DataFrame, name: str, confidence: str) -> DataFrame:
    return df.withColumns({name: N.first_label(*(F.col(p) for p in P)), confidence: F.greatest(*P)})


def sentence_probabilities(sentences: DataFrame, windows: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """sentences with the mean probabilities of the windows over them, or (1, 0, 0), their label and confidence; in a
    document without windows confidence is 0."""
    each = windows.select(doc_id, F.explode("sentence_indices").alias("sentence_id"), *P)
    mean = each.groupBy(doc_id, "sentence_id").agg(*(F.avg(p).alias(p) for p in P))
    x = sentences.join(mean, [doc_id, "sentence_id"], "left").withColumns({"covered_": F.col(P[0]).isNotNull()})
    x = x.withColumns({p: F.coalesce(p, F.lit(1.0 if k == 0 else 0.0)) for k, p in enumerate(P)})
    x = label(x, "label", "confidence").withColumn("any_", F.max("covered_").over(Window.partitionBy(doc_id)))
    return x.withColumn("confidence", F.when(F.col("any_"), F.col("confidence")).otherwise(0.0)).drop("covered_", "any_")


def section_summary(sections: DataFrame, windows: DataFrame, sentences: DataFrame, config: Config = Config(), doc_id: str = "doc_id") -> DataFrame:
    """Counts, coverage, mean probabilities and the most confident window of each section, zeros where it has none."""
    key = [doc_id, "section_id"]
    sure = F.col("window_confidence") >= config.confidence
    part = lambda x: F.avg(((F.col("window_label") == x) & sure).cast("double"))
    top = F.min_by(F.struct(F.col("window_label").alias("label"), F.col("window_confidence").alias("confidence"), F.col("text_raw").alias("text"), F.array("span_start", "span_end").alias("span")), F.struct(-F.col("window_confidence"), F.col("window_id")))
    w = windows.groupBy(*key).agg(F.count("*").alias("num_windows"), part("ai").alias("coverage_ai"), part("paraphrased_ai").alias("coverage_paraphrased"), *(F.avg(p).alias(p) for p in P), top.alias("top_window"))
    s = sentences.groupBy(*key).agg(F.count("*").alias("num_sentences"))
    out = sections.join(w, key, "left").join(s, key, "left")
    return out.fillna(0, subset=["num_windows", "num_sentences", "coverage_ai", "coverage_paraphrased", *P])


def verdict(p_ai: Column, p_para: Column, coverage_ai: Column, coverage_para: Column, max_sim: Column, detectgpt: Column, config: Config = Config()) -> Column:
    """Paraphrase first, then machine text, else human."""
    para = (p_para >= 0.5) | ((coverage_para >= config.coverage_para) & (max_sim >= config.tau_semantic))
    ai = (p_ai >= 0.5) | ((coverage_ai >= config.coverage_ai) & (detectgpt <= config.detectgpt_threshold))
    return F.when(para, "paraphrased_ai").when(ai, "ai").otherwise("human")


def document_summary(windows: DataFrame, config: Config = Config(), doc_id: str = "doc_id") -> DataFrame:
    """Coverage, largest similarity, mean perturbation score, mean probabilities and the verdict of each document with
    windows. Features that no branch made count as 0."""
    have = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in windows.columns else F.lit(0.0)
    sure = F.col("window_confidence") >= config.confidence
    d = windows.groupBy(doc_id).agg(
        F.count("*").alias("num_windows"), F.avg(((F.col("window_label") == "ai") & sure).cast("double")).alias("coverage_ai"),
        F.avg(((F.col("window_label") == "paraphrased_ai") & sure).cast("double")).alias("coverage_paraphrased"),
        F.max(have("max_sim")).alias("max_sim"), F.avg(have("detectgpt_score")).alias("detectgpt_mean"), *(F.avg(p).alias(p) for p in P),
    )
    return d.withColumn("verdict", verdict(F.col("p_ai"), F.col("p_paraphrased_ai"), F.col("coverage_ai"), F.col("coverage_paraphrased"), F.col("max_sim"), F.col("detectgpt_mean"), config))


def label_percentages(sentences: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, pct_human, pct_ai, pct_paraphrased_ai) of the sentences."""
    return sentences.groupBy(doc_id).agg(*(F.avg(F.when(F.col("label") == x, 100.0).otherwise(0.0)).alias(f"pct_{x}") for x in C.LABELS))


# --- the optional document classifier


def feature_column(name: str, columns: list[str], tau: float = C.TAU_SEMANTIC) -> Column:
    """A document feature by its name: num_windows; coverage; X_mean and X_max of a column X; a bare column's mean; else 0."""
    if name == "num_windows":
        return F.count("*").cast("double")
    if name == "coverage":
        return F.avg((F.coalesce(F.col("max_sim"), F.lit(0.0)) >= tau).cast("double")) if "max_sim" in columns else F.lit(0.0)
    for end, f in (("_mean", F.avg), ("_max", F.max)):
        if name.endswith(end) and name[: -len(end)] in columns:
            return F.coalesce(f(F.col(name[: -len(end)]).cast("double")), F.lit(0.0))
    name = {"p_paraphrased": "p_paraphrased_ai"}.get(name, name)
    return F.coalesce(F.avg(F.col(name).cast("double")), F.lit(0.0)) if name in columns else F.lit(0.0)


def meta_vector(windows: DataFrame, names=C.META_FEATURES, doc_id: str = "doc_id", tau: float = C.TAU_SEMANTIC) -> DataFrame:
    """(doc_id, features): all features in one aggregation."""
    return windows.groupBy(doc_id).agg(F.array(*(feature_column(n, windows.columns, tau) for n in names)).alias("features"))


def meta_window_probabilities(windows: DataFrame, model: dict, doc_features: DataFrame | None = None, doc_id: str = "doc_id") -> DataFrame:
    """windows with the p_ columns of a meta classifier. Its features are columns of the windows; the names of document
    features (coverage, max_sim, top3_mean, frac_above_tau, num_windows) that the windows lack are those of doc_features, a
    row a document, else 0."""
    names = ("coverage", "max_sim", "top3_mean", "frac_above_tau")
    have = [] if doc_features is None else [n for n in names if n in doc_features.columns and n not in windows.columns and n in model["names"]]
    x = windows.withColumn("num_windows_", F.count("*").over(Window.partitionBy(doc_id)).cast("double"))
    if have:
        x = x.join(doc_features.select(doc_id, *(F.col(n).alias(f"doc_{n}_") for n in have)), doc_id, "left")

    def value(n: str) -> Column:
        c = F.col(n) if n in windows.columns else F.col(f"doc_{n}_") if n in have else F.col("num_windows_") if n == "num_windows" else F.lit(0.0)
        return F.coalesce(c.cast("double"), F.lit(0.0))

    features = F.array(*(value({"p_paraphrased": "p_paraphrased_ai"}.get(n, n)) for n in model["names"]))
    out = meta_probabilities(x.withColumn("meta_features_", features), model, "meta_features_")
    return out.drop("meta_features_", "num_windows_", *(f"doc_{n}_" for n in have))


def load_meta_file(path: str) -> dict | None:
    """load_meta of a JSON file, or of an npz file with arrays columns, mu, sigma, label_map and, a layer each, w0, b0, w1,
    b1, ...; None if it can't be read."""
    try:
        if path.endswith(".npz"):
            with np.load(path, allow_pickle=False) as z:
                spec = {k: z[k].tolist() for k in ("columns", "mu", "sigma", "label_map") if k in z.files}
                spec["layers"] = [{"weights": z[f"w{k}"].tolist(), "bias": z[f"b{k}"].tolist()} for k in range(sum(f.startswith("w") for f in z.files))]
                return load_meta(spec)
        with open(path, encoding="utf-8") as f:
            return load_meta(json.load(f))
    except (OSError, ValueError, KeyError):
        return None


def load_meta(spec: dict) -> dict | None:
    """A model of JSON fields: feature names under any of the usual keys, mu, sigma, and weights a label with biases, or
    layers of weights (a row an output) and biases with an activation between them; None if it isn't usable."""
    if isinstance(spec, list):
        spec = {"columns": spec}
    names = next((spec[k] for k in ("columns", "feature_names", "cols", "feature_columns") if spec.get(k)), None)
    if not names:
        return None
    mu, sigma = (next((spec[k] for k in keys if spec.get(k)), [fill] * len(names)) for keys, fill in ((("mu", "mean"), 0.0), (("sigma", "std"), 1.0)))
    layers = [{"weights": x["weights"], "bias": x.get("bias") or [0.0] * len(x["weights"])} for x in spec.get("layers") or []]
    labels = _label_order(spec.get("label_map"))
    sizes = [len(names), *(len(x["weights"]) for x in layers)]
    fits = all(len(x["bias"]) == len(x["weights"]) and all(len(w) == n for w in x["weights"]) for x, n in zip(layers, sizes, strict=False))
    if layers and (not fits or sizes[-1] != len(labels) or spec.get("activation", "relu") not in ACTIVATIONS):
        return None
    out = {"names": list(names), "mu": list(mu), "sigma": list(sigma), "weights": spec.get("weights"), "bias": spec.get("bias") or [0.0] * len(spec.get("weights") or C.LABELS), "labels": labels}
    return out | ({"layers": layers, "activation": spec.get("activation", "relu"), "weights": layers[-1]["weights"]} if layers else {})


#: What stands between the layers of a meta classifier.
ACTIVATIONS = {"relu": lambda x: np.maximum(x, 0), "tanh": np.tanh, "sigmoid": lambda x: 1 / (1 + np.exp(-x)), "none": lambda x: x}
#: Bytes of its weights, which are broadcast, at most.
WEIGHTS = 256 << 20


def _label_order(labels) -> list[str]:
    if isinstance(labels, dict):
        return [labels[k] for k in sorted(labels, key=int)]
    return list(labels or C.LABELS)


def meta_probabilities(vectors: DataFrame, model: dict, features: str = "features") -> DataFrame:
    """vectors with the softmax of a model's last layer over standardised features: a linear one in expressions, one of
    layers batch by batch with its matrices broadcast."""
    if model.get("layers"):
        return _layered(vectors, model, features)
    array = lambda xs: F.array(*(F.lit(float(x)) for x in xs))
    z = N.z_score(F.col(features), array(model["mu"]), array(model["sigma"]))
    scores = [N.dot(z, array(w)) + F.lit(float(b)) for w, b in zip(model["weights"], model["bias"], strict=True)]
    return labelled_probabilities(vectors, dict(zip(model["labels"], N.softmax(*scores), strict=True)))


def _layered(vectors: DataFrame, model: dict, features: str) -> DataFrame:
    layers = [(np.array(x["weights"], float).T, np.array(x["bias"], float)) for x in model["layers"]]
    if (used := sum(w.nbytes + b.nbytes for w, b in layers)) > WEIGHTS:
        raise ValueError(f"weights of {used} bytes, over {WEIGHTS}")
    ship(vectors.sparkSession)
    shared = vectors.sparkSession.sparkContext.broadcast(layers)
    between = model["activation"]
    labels = [T.plain_label(x) for x in model["labels"]]
    array = lambda xs: F.array(*(F.lit(float(x)) for x in xs))
    own = vectors.drop(*P)
    z = own.withColumn("z_", N.z_score(F.col(features), array(model["mu"]), array(model["sigma"])))
    schema = StructType([*own.schema.fields, *(StructField(p, DoubleType()) for p in P)])

    def run(batches):
        for b in batches:
            x = np.asarray(b.column(b.num_columns - 1).flatten(), float).reshape(b.num_rows, -1)
            for k, (w, bias) in enumerate(shared.value):
                x = (ACTIVATIONS[between](x) if k else x) @ w + bias
            e = np.exp(x - x.max(1, keepdims=True))
            p = e / e.sum(1, keepdims=True)
            of = np.stack([p[:, labels.index(x_)] if x_ in labels else np.zeros(len(p)) for x_ in C.LABELS], 1)
            total = of.sum(1, keepdims=True)
            of /= np.where(total == 0, 1, total)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(np.ascontiguousarray(of[:, k])) for k in range(len(P)))], names=schema.names)

    return z.mapInArrow(run, schema)
