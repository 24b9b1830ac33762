"""Token statistics under a language model, and the simplest one: add-one unigrams of a corpus (operators.ngrams has
conditional ones).

A scorer is a function of a table, its key columns and its text column that makes a table (key, position, lp, entropy,
rank) of the texts' tokens, and may add ``alert``, why it could not score a text. Aggregates don't depend on where it comes from."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from ..functions import text as T
from ..session import keep, ship
from ..workers import held
from . import ngrams
from .ngrams import lookup

#: Makes (key, position, lp, entropy, rank[, alert]) of (table, key, text column).
TokenScorer = Callable[[DataFrame, tuple[str, ...], str], DataFrame]
FEATURES = ("logprob", "ppl", "mean_entropy", "surprisal_mean", "surprisal_var", "avg_rank", "detectgpt_score")


def tokens(df: DataFrame, key: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """(key, position, token), lower-cased."""
    return df.select(*key, F.posexplode(F.transform(T.words(F.col(text)), F.lower)).alias("position", "token"))


def unigrams(toks: DataFrame, k: float = 1.0) -> DataFrame:
    """(token, n, p, lp, rank): p = (n + k) / (N + k (V + 1)), one class being kept for unknown tokens; the rank is one
    more than the number of more frequent tokens. Ranks come from the counts of counts, a table as small as the number
    of different counts, so no task sees the whole vocabulary. The model is written once to the shared folder."""
    counts = toks.groupBy("token").agg(F.count("*").alias("n"))
    levels = counts.groupBy("n").agg(F.count("*").alias("types"))
    above, every = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = levels.select("n", (F.coalesce(F.sum("types").over(above), F.lit(0)) + 1).alias("rank"), F.sum(F.col("n") * F.col("types")).over(every).alias("N_"), F.sum("types").over(every).alias("V_"))
    p = (F.col("n") + k) / (F.col("N_") + k * (F.col("V_") + 1))
    return keep(counts.join(ranked, "n").select("token", "n", p.alias("p"), F.ln(p).alias("lp"), "rank"), "unigrams")


def entropy(model: DataFrame) -> DataFrame:
    """One row: the entropy of the model's known tokens, in nats."""
    return model.agg((-F.sum(F.col("p") * F.col("lp"))).alias("entropy"))


def top_entropy(model: DataFrame, k: int = 100) -> DataFrame:
    """One row: the entropy of the k most likely tokens, renormalised."""
    top = model.orderBy(F.desc("p"), "token").limit(k)
    # With s the sum of p, -sum(p/s ln(p/s)) = ln s - sum(p ln p) / s.
    return top.agg((F.ln(F.sum("p")) - F.sum(F.col("p") * F.ln("p")) / F.sum("p")).alias("entropy"))


def score_tokens(toks: DataFrame, model: DataFrame) -> DataFrame:
    """toks that the model knows with its lp, rank and entropy. The most frequent tokens are broadcast (ngrams.lookup)."""
    known = lookup(toks, model, ["token"], {"lp": "lp", "rank": "rank"}).where(F.col("lp").isNotNull())
    return known.withColumn("entropy", entropy(model).scalar())


def aggregates(scored: DataFrame, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(key, logprob, ppl, mean_entropy, surprisal_mean, surprisal_var, avg_rank); the variance is that of the population."""
    s = -F.col("lp")
    return scored.groupBy(*key).agg(
        F.avg("lp").alias("logprob"), F.exp(F.avg(s)).alias("ppl"), F.avg("entropy").alias("mean_entropy"), F.avg(s).alias("surprisal_mean"), F.var_pop(s).alias("surprisal_var"), F.avg("rank").alias("avg_rank")
    )


def token_counts(df: DataFrame, key: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """(key, token, n): distinct lower-case tokens of each row, counted before anything is shuffled."""
    return tokens(df, key, text).groupBy(*key, "token").agg(F.count("*").alias("n"))


def aggregates_of_counts(counts: DataFrame, model: DataFrame, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """aggregates(score_tokens(...)) of (key, token, n): a token meets the model once a row, not once an occurrence, the most
    frequent ones without a shuffle."""
    x = lookup(counts, model, ["token"], {"lp": "lp", "rank": "rank"}).where(F.col("lp").isNotNull())
    n, total = F.col("n"), F.sum("n")
    mean = F.sum(n * F.col("lp")) / total
    g = x.groupBy(*key).agg(mean.alias("logprob"), F.greatest(F.lit(0.0), F.sum(n * F.col("lp") * F.col("lp")) / total - mean * mean).alias("surprisal_var"), (F.sum(n * F.col("rank")) / total).alias("avg_rank"))
    return g.select(*key, "logprob", F.exp(-F.col("logprob")).alias("ppl"), entropy(model).scalar().alias("mean_entropy"), (-F.col("logprob")).alias("surprisal_mean"), "surprisal_var", "avg_rank")


#: A table of synonyms has at most so many words, as it is part of the plan.
MAX_SYNONYMS = 10_000


def synonym_map(synonyms: dict[str, list[str]]) -> Column:
    """Up to three synonyms of each word, in order, as a map; a word isn't its own synonym."""
    if len(synonyms) > MAX_SYNONYMS:
        raise ValueError(f"over {MAX_SYNONYMS} words with synonyms")
    kept = {w: sorted({x for x in xs if x.lower() != w.lower() and x.isascii() and len(x) > 1})[:3] for w, xs in synonyms.items()}
    pairs = [y for w, xs in kept.items() if xs for y in (F.lit(w.lower()), F.array(*(F.lit(x) for x in xs)))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,array<string>>")


def md5_draws(*parts: Column) -> Column:
    """Draws for perturbed that other engines can repeat: 32 bits of the md5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary")), 1, 8), 16, 10).cast("long")


#: The share of words that a variant lacks.
DROP = 0.05
#: Words, numbers and single signs, of which variants are made, and those that may be dropped.
PIECE, WORDY = r"(?U)\w+|[^\w\s]", r"^(?U)[\p{L}\p{N}]+$"


def perturbed(text: Column, key: Column, k: Column, drop: float = DROP, swap: float = 0.05, replace: float = 0.05, synonyms: dict[str, list[str]] | None = None, draws: Callable[..., Column] = F.xxhash64) -> Column:
    """A variant of a text: words replaced by a synonym where there is a table of them, words and numbers dropped, and
    neighbouring ones swapped, each by a hash, draws(key, k, place, what), so that variant k of a row is the same wherever
    and however often it is made."""
    toks = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    hashed = lambda i, what: draws(key, k, i, F.lit(what))
    draw = lambda i, what: F.pmod(hashed(i, what), F.lit(10_000)) / 10_000.0
    wordy = lambda t: t.rlike(WORDY)
    if synonyms:
        table = synonym_map(synonyms)

        def replaced(t: Column, i: Column) -> Column:
            own = F.element_at(table, F.lower(t))
            return F.when(own.isNotNull() & (draw(i, "synonym") < replace), F.get(own, F.pmod(hashed(i, "which"), F.size(own)).cast("int"))).otherwise(t)

        toks = F.transform(toks, replaced)
    kept = F.transform(F.filter(F.transform(toks, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: ~wordy(x["t"]) | (draw(x["i"], "drop") >= drop)), lambda x: x["t"])
    # A place is swapped with the next if it is even and drawn: pairs never overlap.
    hit = lambda own, i: wordy(F.get(own, i)) & F.coalesce(wordy(F.get(own, i + 1)), F.lit(False)) & (draw(i, "swap") < 2 * swap)

    def moved(own: Column) -> Column:
        # A pair is drawn once, not once a word of it.
        pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(own) / 2).cast("int") - 1, F.lit(0))), lambda j: hit(own, 2 * j))
        return T.let(pairs, lambda hits: F.transform(own, lambda t, i: F.when(F.get(hits, F.shiftright(i, 1)), F.get(own, F.when(i % 2 == 0, i + 1).otherwise(i - 1))).otherwise(t)))

    return F.array_join(T.let(kept, moved), " ")


def text_tokens(df: DataFrame, key: tuple[str, ...], text: str = "text", variants: int = 0, synonyms: dict[str, list[str]] | None = None, draws: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """(key, a0, a1, ..., token): the words, lower-cased, of each text (a0) and of its variants (a1, ...; see perturbed), for
    sums that don't depend on their order.

    Variants aren't written out, as all words of a text but those dropped are in each: a word is a row once for the text and
    once for all variants that have it. That neighbours are swapped changes no such sum; with synonyms, each variant is made."""
    if not variants:
        return df.select(*key, F.lit(True).alias("a0"), F.explode(F.transform(T.words(F.col(text)), F.lower)).alias("token"))
    name = F.col(key[0]) if len(key) == 1 else F.struct(*key)
    if synonyms:
        each = df.select(*key, F.posexplode(F.array(F.col(text), *(perturbed(F.col(text), name, F.lit(k), synonyms=synonyms, draws=draws) for k in range(1, variants + 1)))).alias("k_", "t_"))
        return each.select(*key, *((F.col("k_") == k).alias(f"a{k}") for k in range(variants + 1)), F.explode(F.transform(T.words(F.col("t_")), F.lower)).alias("token"))
    # The text's own words first, then the pieces of variants: no word of a variant goes over the end of a piece.
    x = df.select(*key, T.words(F.col(text)).alias("w_"), F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)).alias("p_"))
    x = x.select(*key, F.size("w_").alias("n_"), F.posexplode(F.concat("w_", "p_")).alias("i_", "t_"))
    own, i, t = F.col("i_") < F.col("n_"), F.col("i_") - F.col("n_"), F.col("t_")
    dropped = lambda k: F.col("wordy_") & (F.pmod(draws(name, F.lit(k), i, F.lit("drop")), F.lit(10_000)) / 10_000.0 < DROP)
    x = x.select(*key, "n_", "i_", "t_", (~own & t.rlike(WORDY)).alias("wordy_"))
    x = x.select(*key, own.alias("a0"), *((~own & ~dropped(k)).alias(f"a{k}") for k in range(1, variants + 1)), F.explode(F.when(own, F.array(t)).otherwise(T.words(t))).alias("token"))
    return x.withColumn("token", F.lower("token"))


def token_sums(toks: DataFrame, model: DataFrame, key: tuple[str, ...], variants: int = 0) -> DataFrame:
    """(key, n0, lp0, n1, lp1, ..., sq, rank): of each text and variant (text_tokens) the number of tokens that the model
    knows and the sum of their lp, of the text those of lp squared and of the ranks too.

    The most frequent tokens (ngrams.HEAD) meet the model where they are and leave one row of sums a key; only the others
    are shuffled, counted."""
    at = [F.col(f"a{k}") for k in range(variants + 1)]
    names = [*(f"n{k}" for k in range(variants + 1)), *(f"lp{k}" for k in range(variants + 1)), "sq", "rank"]
    known = model.select("token", F.col("lp").alias("l_"), F.col("rank").alias("r_"))
    whole = model.count() <= ngrams.HEAD
    head = known if whole else model.orderBy(F.desc("n"), "token").limit(ngrams.HEAD).select("token", F.col("lp").alias("l_"), F.col("rank").alias("r_"))
    x = toks.join(F.broadcast(head), "token", "inner" if whole else "left")
    own = [F.count_if(a) for a in at] + [F.sum(F.when(a, F.col("l_"))) for a in at] + [F.sum(F.when(at[0], F.col("l_") * F.col("l_"))), F.sum(F.when(at[0], F.col("r_")))]
    if whole:
        return x.groupBy(*key).agg(*(c.alias(n) for c, n in zip(own, names, strict=True)))
    rare = F.when(F.col("l_").isNull(), F.col("token")).alias("rare_")
    g = x.groupBy(*key, rare).agg(*(c.alias(n) for c, n in zip(own, names, strict=True)))
    # Rows of sums have nothing to meet and go anywhere.
    g = g.withColumn("token", F.coalesce("rare_", F.concat(F.lit("\x00"), F.xxhash64(*key).cast("string")))).join(known, "token", "left")
    met, n = F.col("rare_").isNotNull(), [F.col(f"n{k}") for k in range(variants + 1)]
    late = [F.when(F.col("l_").isNotNull(), c) for c in n] + [c * F.col("l_") for c in n] + [n[0] * F.col("l_") * F.col("l_"), n[0] * F.col("r_")]
    return g.groupBy(*key).agg(*(F.sum(F.when(met, c).otherwise(F.col(name))).alias(name) for c, name in zip(late, names, strict=True)))


def _aggregates_of_sums(model: DataFrame) -> dict[str, Column]:
    """What aggregates(...) has, of a row of token_sums; null where no token is known."""
    mean = F.when(F.col("n0") > 0, F.col("lp0") / F.col("n0"))
    var = F.greatest(F.lit(0.0), F.try_divide("sq", "n0") - mean * mean)
    return {"logprob": mean, "ppl": F.exp(-mean), "mean_entropy": F.when(F.col("n0") > 0, entropy(model).scalar()), "surprisal_mean": -mean, "surprisal_var": F.when(F.col("n0") > 0, var), "avg_rank": F.try_divide("rank", "n0")}


def _score_of_sums(variants: int) -> Column:
    """The mean log-probability of a text less that of its variants with known tokens, of a row of token_sums."""
    means = F.filter(F.array(*(F.try_divide(f"lp{k}", f"n{k}") for k in range(1, variants + 1))), lambda m: m.isNotNull())
    return T.let(means, lambda ms: F.when(F.size(ms) > 0, F.try_divide("lp0", "n0") - F.aggregate(ms, F.lit(0.0), lambda a, m: a + m) / F.size(ms)))


def aggregates_of_texts(df: DataFrame, model: DataFrame, key: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """aggregates(score_tokens(tokens(...))) by token_sums: texts without known tokens have no row."""
    g = token_sums(text_tokens(df, key, text), model, key).where("n0 > 0")
    return g.select(*key, *(c.alias(n) for n, c in _aggregates_of_sums(model).items()))


def perturbation_score(df: DataFrame, model: DataFrame, key: str | tuple[str, ...] = "doc_id", text: str = "text", variants: int = 5, synonyms: dict[str, list[str]] | None = None, draws: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """(key, detectgpt_score): mean log-probability of a text less that of its variants; 0 for texts without known tokens.

    Rows and their variants are summed token by token as token_sums does it."""
    key = (key,) if isinstance(key, str) else tuple(key)
    got = token_sums(text_tokens(df, key, text, variants, synonyms, draws), model, key, variants).select(*key, _score_of_sums(variants).alias("s_"))
    return df.select(*key).join(got, list(key), "left").select(*key, F.coalesce("s_", F.lit(0.0)).alias("detectgpt_score"))


def features_of_texts(df: DataFrame, model: DataFrame, key: tuple[str, ...], text: str = "text", variants: int = 5, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """(key, FEATURES): features(df, unigram_scorer(model), ...) by token_sums, which give all of them at once."""
    score = _score_of_sums(variants) if variants else F.lit(0.0)
    got = token_sums(text_tokens(df, key, text, variants, synonyms), model, key, variants).select(*key, *(c.alias(n) for n, c in _aggregates_of_sums(model).items()), score.alias("detectgpt_score"))
    return df.select(*key).join(got, list(key), "left").select(*key, *(F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in FEATURES))


@dataclass(frozen=True)
class UnigramScorer:
    """The token scorer of unigrams(...); unknown tokens aren't scored."""

    model: DataFrame

    def __call__(self, df: DataFrame, key: tuple[str, ...], text: str) -> DataFrame:
        return score_tokens(tokens(df, key, text), self.model)


def unigram_scorer(model: DataFrame) -> TokenScorer:
    return UnigramScorer(model)


def python_scorer(load: Callable[[], Callable[[list[str]], list[list[tuple[float, float, float]]]]]) -> TokenScorer:
    """A token scorer from a model in Python. load makes, once a worker process (see workers.held), a function of texts that
    gives (log-probability, entropy, rank) of each token of each text. If it fails on a batch, its texts are tried one by
    one; those on which it fails have one row without scores, with an alert."""
    name = f"lm-{uuid.uuid4().hex}"

    def score(df: DataFrame, key: tuple[str, ...], text: str) -> DataFrame:
        ship(df.sparkSession)
        own = df.select(*key, text)
        schema = StructType([*own.drop(text).schema.fields, StructField("position", IntegerType()), *(StructField(c, DoubleType()) for c in ("lp", "entropy", "rank")), StructField("alert", StringType())])

        def run(batches):
            def of(texts):
                got = [[tuple(map(float, t)) for t in r] for r in held(name, load)(texts)]
                if len(got) != len(texts) or any(len(t) != 3 for r in got for t in r):
                    raise ValueError("not one list of (lp, entropy, rank) a text")
                return got

            for b in batches:
                texts = [t or "" for t in b.column(len(key)).to_pylist()]
                got, why = attempt(of, texts)
                at, rows = [], []
                for k, (r, w) in enumerate(zip(got, why, strict=True)):
                    own_rows = [(n, *t, None) for n, t in enumerate(r)] if w is None else [(-1, None, None, None, f"language_model failed, zeros: {w}")]
                    at += [k] * len(own_rows)
                    rows += own_rows
                kinds = (pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.string())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(len(key))), *columns], names=[f.name for f in schema])

        return own.mapInArrow(run, schema)

    return score


def attempt(f: Callable[[list], list], values: list) -> tuple[list, list[str | None]]:
    """(f's results, faults) of the values: all at once, or one by one if that fails, None where f does not fail."""
    try:
        return list(f(values)), [None] * len(values)
    except Exception:  # whose fault it is shows below
        got: list = []
        why: list[str | None] = []
        for v in values:
            try:
                got.append(f([v])[0])
                why.append(None)
            except Exception as e:  # the alert tells of it
                got.append([])
                why.append(f"{type(e).__name__}: {e}"[:300])
        return got, why


def features(df: DataFrame, scorer: TokenScorer, key: tuple[str, ...], text: str = "text", variants: int = 5, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """(key, FEATURES, language_model_alert): aggregates of the tokens' scores, and the text's mean log-probability less that
    of its variants. A text and its variants are scored in one pass. Texts without scores have zeros."""
    if isinstance(scorer, UnigramScorer):
        return features_of_texts(df, scorer.model, key, text, variants, synonyms).withColumn("language_model_alert", F.lit(None).cast("string"))
    name = F.col(key[0]) if len(key) == 1 else F.struct(*key)
    texts = F.array(F.col(text), *(perturbed(F.col(text), name, F.lit(k), synonyms=synonyms) for k in range(1, variants + 1)))
    scored = scorer(df.select(*key, F.posexplode(texts).alias("k_", "t_")), (*key, "k_"), "t_")
    x = aggregates(scored, (*key, "k_"))
    if "alert" in scored.columns:
        x = x.join(scored.groupBy(*key, "k_").agg(F.max("alert").alias("alert_")), [*key, "k_"])
    else:
        x = x.withColumn("alert_", F.lit(None).cast("string"))
    own = F.col("k_") == 0
    first = {c: F.max(F.when(own, F.col(c))).alias(c) for c in FEATURES[:-1]}
    g = x.groupBy(*key).agg(*first.values(), F.avg(F.when(~own, F.col("logprob"))).alias("others_"), F.max("alert_").alias("language_model_alert"))
    g = g.withColumn("detectgpt_score", F.col("logprob") - F.col("others_"))
    return df.select(*key).join(g, list(key), "left").select(*key, *(F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in FEATURES), "language_model_alert")
