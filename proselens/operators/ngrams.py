"""Conditional token scores: n-grams of a corpus, with the distribution of each context.

p(token | context) = (n(context, token) + k) / (n(context) + k (V + 1)): the counts behind a context interpolated with the
uniform distribution of the V known tokens and one class for unknown ones, the less so the more often the context was seen. A
context that was never seen has the distribution of the empty one. So every context has an entropy of its own, and a token's
rank is among all tokens in its context; both follow from the counts of counts within the context, of which there are few
however many tokens follow it.

The tables are keyed by context, so they score any corpus. A lookup takes the most frequent keys, HEAD of them, by broadcast
and all others by a shuffle: frequent tokens move nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import keep

#: Rows of a table that are broadcast at most.
HEAD = 100_000
#: Stands for what is before a text; no token is like it.
START = "\x02"


@dataclass(frozen=True)
class NGrams:
    """events (context, token, n, lp, entropy, rank), contexts (context, n, types, entropy, lp, rank: of tokens not seen
    behind it); the empty context is that of order 1."""

    order: int
    events: DataFrame
    contexts: DataFrame


def events(df: DataFrame, key: tuple[str, ...], text: str, order: int) -> DataFrame:
    """(key, position, context, token) of lower-case tokens; a context is the order - 1 tokens before."""
    toks = F.transform(T.words(F.coalesce(F.col(text), F.lit(""))), F.lower)
    before = lambda all_, i: F.array_join(F.slice(all_, i + 1, F.lit(order - 1)), " ") if order > 1 else F.lit("")
    led = F.concat(F.array_repeat(F.lit(START), order - 1), toks)
    each = T.let(led, lambda all_: F.transform(F.slice(all_, F.lit(order), F.greatest(F.size(all_), F.lit(1))), lambda t, i: F.struct(before(all_, i).alias("context"), t.alias("token"))))
    return df.select(*key, F.posexplode(each).alias("position", "e_")).select(*key, "position", "e_.context", "e_.token")


def train(df: DataFrame, order: int = 2, k: float = 0.01, text: str = "text") -> NGrams:
    """The model of a corpus' texts. Tables are written once to the shared folder."""
    counts = events(df, (), text, order).groupBy("context", "token").agg(F.count("*").alias("n"))
    counts = keep(counts, "ngrams")
    v = counts.count()
    if order > 1:
        single = keep(counts.groupBy("token").agg(F.sum("n").alias("n")).select(F.lit("").alias("context"), "token", "n"), "unigrams")
        v, counts = single.count(), counts.unionByName(single)
    levels = counts.groupBy("context", "n").agg(F.count("*").alias("types"))
    above = Window.partitionBy("context").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = levels.select("context", "n", (F.coalesce(F.sum("types").over(above), F.lit(0)) + 1).alias("rank"))
    mass = F.sum(F.col("types") * (F.col("n") + k) * F.ln(F.col("n") + k))
    of = levels.groupBy("context").agg(F.sum(F.col("n") * F.col("types")).alias("n"), F.sum("types").alias("types"), mass.alias("a_"))
    z, unseen = F.col("n") + k * (v + 1), F.lit(v + 1) - F.col("types")
    entropy = F.ln(z) - (F.col("a_") + unseen * k * F.ln(F.lit(k))) / z
    contexts = keep(of.select("context", "n", "types", z.alias("z_"), entropy.alias("entropy"), F.ln(F.lit(k) / z).alias("lp"), (F.col("types") + 1).alias("rank")), "contexts")
    # Contexts meet their tokens by levels: a context's rows are those of its different counts.
    known = ranked.join(contexts.select("context", "z_", "entropy"), "context")
    full = counts.join(known, ["context", "n"]).select("context", "token", "n", F.ln((F.col("n") + k) / F.col("z_")).alias("lp"), "entropy", "rank")
    return NGrams(order, keep(full, "events"), contexts.drop("z_"))


def lookup(left: DataFrame, table: DataFrame, on: list[str], values: dict[str, str]) -> DataFrame:
    """left with values (new name: column) of table's row for its key, null where there is none. table has a column n, by
    which its HEAD most frequent keys are broadcast; rows that meet them are spread evenly over the join of the others."""
    right = table.select(*on, *(F.col(c).alias(name) for name, c in values.items()), F.lit(True).alias("met_"))
    n = table.count()
    if n <= HEAD:
        return left.join(F.broadcast(right), on, "left").drop("met_")
    head = table.orderBy(F.desc("n"), *on).limit(HEAD).select(*on)
    hot = F.broadcast(right.join(F.broadcast(head), on))
    x = left.join(hot, on, "left")
    spread = F.concat(F.lit("\x00"), F.xxhash64(*left.columns).cast("string"))
    x = x.withColumns({f"{c}_": F.when(F.col("met_"), spread).otherwise(F.col(c)) for c in on})
    cold = right.drop("met_").select(*(F.col(c).alias(f"{c}_") for c in on), *(F.col(name).alias(f"{name}_") for name in values))
    out = x.join(cold, [f"{c}_" for c in on], "left")
    return out.select(*left.columns, *(F.coalesce(F.col(name), F.col(f"{name}_")).alias(name) for name in values))


#: What a token has in a model, and what texts have of it.
SCORES, SUMS = ("lp", "entropy", "rank"), ("n", "lp", "sq", "entropy", "rank")
#: Partitions a core in which texts' rare n-grams meet the model: in few, a text leaves few rows of sums.
MEETINGS = 4


def sums_of_texts(model: NGrams, df: DataFrame, key: tuple[str, ...], text: str = "text") -> DataFrame:
    """(key, n, lp, sq, entropy, rank): of each text with tokens their number and the sums of their scores (see scorer), of
    lp squared too.

    Only n-grams that aren't among the HEAD most frequent ones are shuffled, and nothing but their text's key with them; what
    has met the model leaves one row of sums a text and partition, and only tokens never seen in their context go on."""
    lp = F.col("lp")
    sums = [F.count("*"), F.sum("lp"), F.sum(lp * lp), F.sum("entropy"), F.sum("rank")]
    named = [c.alias(name) for c, name in zip(sums, SUMS, strict=True)]
    x = events(df, key, text, model.order).select(*key, "context", "token")
    table = model.events.select("context", "token", *SCORES)
    parts = []
    if model.events.count() <= HEAD:
        met = x.join(F.broadcast(table), ["context", "token"], "left")
    else:
        head = keep(model.events.orderBy(F.desc("n"), "context", "token").limit(HEAD).select("context", "token", *SCORES), "head")
        parts = [x.join(F.broadcast(head), ["context", "token"]).groupBy(*key).agg(*named)]
        cold = x.join(F.broadcast(head.select("context", "token")), ["context", "token"], "left_anti")
        met = cold.repartition(MEETINGS * df.sparkSession.sparkContext.defaultParallelism, "context", "token").join(table, ["context", "token"], "left")
    new = lp.isNull()
    # Read twice, so written once.
    met = keep(met.groupBy(*key, *(F.when(new, F.col(c)).alias(c) for c in ("context", "token"))).agg(*named), "met")
    parts.append(met.where("context IS NULL").select(*key, *SUMS))
    rest = met.where("context IS NOT NULL").select(*key, "context", "token", F.col("n").alias("times_"))
    if model.order > 1:
        rest = lookup(rest, model.contexts, ["context"], {f"{c}0": c for c in SCORES})
        rest = lookup(rest, model.events.where(F.col("context") == "").drop("context"), ["token"], {f"{c}1": c for c in SCORES})
    none = F.broadcast(model.contexts.where(F.col("context") == "").select(*(F.col(c).alias(f"{c}2") for c in SCORES)))
    rest = rest.join(none, how="left")
    times, of = F.col("times_"), {c: F.coalesce(*(F.col(f"{c}{e}") for e in (("0", "1", "2") if model.order > 1 else ("2",)))) for c in SCORES}
    parts.append(rest.select(*key, times.alias("n"), (times * of["lp"]).alias("lp"), (times * of["lp"] * of["lp"]).alias("sq"), (times * of["entropy"]).alias("entropy"), (times * of["rank"]).alias("rank")))
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return all_.groupBy(*key).agg(*(F.sum(c).alias(c) for c in SUMS))


def aggregates_of_texts(model: NGrams, df: DataFrame, key: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """language_model.aggregates(scorer(model)(df, key, text)) by sums_of_texts."""
    n = F.col("n")
    mean = F.col("lp") / n
    var = F.greatest(F.lit(0.0), F.col("sq") / n - mean * mean)
    return sums_of_texts(model, df, key, text).select(*key, mean.alias("logprob"), F.exp(-mean).alias("ppl"), (F.col("entropy") / n).alias("mean_entropy"), (-mean).alias("surprisal_mean"), var.alias("surprisal_var"), (F.col("rank") / n).alias("avg_rank"))


def scorer(model: NGrams):
    """A token scorer (see language_model.features) of the model."""

    def score(df: DataFrame, key: tuple[str, ...], text: str) -> DataFrame:
        x = lookup(events(df, key, text, model.order), model.events, ["context", "token"], {"lp": "lp", "entropy": "entropy", "rank": "rank"})
        if model.order > 1:
            x = lookup(x, model.contexts, ["context"], {"lp0": "lp", "entropy0": "entropy", "rank0": "rank"})
            x = lookup(x, model.events.where(F.col("context") == "").drop("context"), ["token"], {"lp1": "lp", "entropy1": "entropy", "rank1": "rank"})
        # What the empty context gives to unknown tokens.
        none = F.broadcast(model.contexts.where(F.col("context") == "").select(F.lit("").alias("none_"), *(F.col(c).alias(f"{c}2") for c in ("lp", "entropy", "rank"))))
        x = x.withColumn("none_", F.lit("")).join(none, "none_", "left")
        names = ("lp", "entropy", "rank")
        ends = ("", "0", "1", "2") if model.order > 1 else ("", "2")
        return x.select(*key, "position", "token", *(F.coalesce(*(F.col(f"{c}{e}") for e in ends)).alias(c) for c in names))

    return score
