"""Style features of texts: one projection, no shuffle.

Sentences, tokens and what is worked out of whole texts are built-in expressions. What is counted token by token goes to one
Arrow function: a batch's tokens are numbered, each different word is tagged and measured once, and the counts of
all its documents follow from the numbers. So does the moving type-token ratio, whose direct form looks at 50 tokens for
each token: it counts in how many windows each token is the last of its kind. Another tagger than the default one stays an
expression.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import numbers as N
from ..functions import text as T
from ..session import ship

FEATURES = ("n_sent", "n_words", "avg_word_len", "ttr", "mattr", *(f"pos_{t}" for t in C.POS_TAGS), "burst_b", "burst_cv", "mean_slen", "flesch", "fk_grade", "gunning_fog")


#: Tokens that are counted at a time: a batch of long texts has millions, and each takes some 150 bytes while it is counted.
SLICE = 200_000


def slices(tokens: pa.ListArray):
    """tokens in stretches of some SLICE tokens, whole lists each."""
    ends = np.cumsum(np.asarray(tokens.value_lengths().fill_null(0), np.int64))
    begin = 0
    while begin < len(tokens):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + SLICE, "right")))
        yield tokens.slice(begin, end - begin)
        begin = end


def recurring(of: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of tokens (codes from 0) that recur in their list, and where each stands next: one sort."""
    key = of * (int(code.max(initial=0)) + 1) + code
    order = np.argsort(key, kind="stable")
    at = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    return order[at], order[at + 1]


def moving_ratios(tokens: pa.ListArray, width: int) -> np.ndarray:
    """The mean type-token ratio over all windows of width tokens of each list; of shorter lists, their own ratio."""
    n = np.asarray(tokens.value_lengths().fill_null(0), np.int64)
    of = np.repeat(np.arange(len(n)), n)
    return _ratios(n, of, recurring(of, np.asarray(tokens.flatten().dictionary_encode().indices, np.int64)), width)


def _ratios(n: np.ndarray, of: np.ndarray, again: tuple[np.ndarray, np.ndarray], width: int) -> np.ndarray:
    j = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + 1
    after = np.full(len(of), 1 << 40)
    after[again[0]] = j[again[1]]
    # Of a list not longer than a window, that is one window.
    w = np.minimum(n, width)[of]
    last = np.minimum(np.minimum(j, n[of] - w + 1), after - w)
    times = np.maximum(last - np.maximum(1, j - w + 1) + 1, 0)
    total = np.bincount(of, times, len(n))
    w = np.maximum(np.minimum(n, width), 1)
    # One division, so that the result is the nearest double.
    return np.where(n > 0, total / (w * np.maximum(n - w + 1, 1)), 0.0)


def tags(words: pa.Array) -> np.ndarray:
    """The places in C.POS_TAGS of functions.text.part_of_speech of lower-case words."""
    at = {t: k for k, t in enumerate(C.POS_TAGS)}
    ends = lambda xs: np.logical_or.reduce([np.asarray(pc.ends_with(words, x)) for x in xs])
    among = lambda xs: np.asarray(pc.is_in(words, pa.array(xs, pa.string())))
    rules = [(among(xs), at[t]) for t, xs in (("pron", C.PRONOUNS), ("det", C.DETERMINERS), ("cconj", C.CONJUNCTIONS), ("adp", C.ADPOSITIONS))]
    rules += [(ends(["ly"]), at["adv"]), (ends(["ed", "ing"]), at["verb"]), (ends(C.ADJECTIVE_ENDS), at["adj"])]
    return np.select([r for r, _ in rules], [k for _, k in rules], at["noun"])


_COUNTS = "struct<chars:long,types:long,hard:long,vowels:long,mattr:double,tags:array<long>>"


def count_tokens(tokens: pa.ListArray, width: int = C.MATTR_WINDOW) -> pa.StructArray:
    """Of each list of words, which are lower-cased (A-Z): characters, different words, words of three and more vowel groups, vowel groups, the
    moving ratio and how many words have each tag."""
    n = np.asarray(tokens.value_lengths().fill_null(0), np.int64)
    words = pc.ascii_lower(tokens.flatten()).dictionary_encode()
    code, known = np.asarray(words.indices, np.int64), words.dictionary
    of, rows, kinds = np.repeat(np.arange(len(n)), n), len(n), len(C.POS_TAGS)
    # Each different word is measured once.
    size, vowels, kind = (np.asarray(x, np.int64)[code] for x in (pc.utf8_length(known), pc.count_substring_regex(known, C.VOWELS), tags(known)))
    chars, many, groups = (np.bincount(of, x, rows).astype(np.int64) for x in (size, vowels >= 3, vowels))
    again = recurring(of, code)
    types = n - np.bincount(of[again[1]], minlength=rows)
    each = np.bincount(of * kinds + kind, minlength=rows * kinds)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * kinds), pa.array(each, pa.int64()))
    return pa.StructArray.from_arrays([pa.array(chars), pa.array(types, pa.int64()), pa.array(many), pa.array(groups), pa.array(_ratios(n, of, again, width)), lists], names=["chars", "types", "hard", "vowels", "mattr", "tags"])


def token_counts(tokens: Column) -> Column:
    ship()

    @F.arrow_udf(_COUNTS)
    def run(words: pa.Array) -> pa.Array:
        return pa.concat_arrays([count_tokens(x) for x in slices(words)]) if len(words) else count_tokens(words)

    return run(tokens)


def mattr(tokens: Column, width: int = C.MATTR_WINDOW) -> Column:
    ship()

    @F.arrow_udf("double")
    def run(hashes: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *(moving_ratios(x, width) for x in slices(hashes))]))

    return run(F.transform(tokens, lambda t: F.xxhash64(t)))


def burstiness(lengths: Column) -> list[Column]:
    """burst_b, burst_cv and mean_slen of sentence lengths; of one sentence or none, 0, 0 and its length."""
    few, m, s = F.size(lengths) <= 1, N.mean(lengths), N.deviation(lengths)
    return [
        F.when(few, 0.0).otherwise((s - m) / (s + m + 1e-12)).alias("burst_b"),
        F.when(few, 0.0).otherwise(s / (m + 1e-12)).alias("burst_cv"),
        m.alias("mean_slen"),
    ]


def features(df: DataFrame, text: str = "text", keep: tuple[str, ...] = (), sentences_of: Column | None = None, with_mattr: bool = True, tagger: Callable[[Column], Column] = T.part_of_speech) -> DataFrame:
    """keep and all FEATURES of each row's text. Sentences are those of the text unless given. tagger makes the tag of a
    lower-case word; tags outside of POS_TAGS count as OTHER."""
    sents = T.sentences(F.col(text)) if sentences_of is None else sentences_of
    base = df.select(*keep, sents.alias("sents_"))
    # The features are those of the sentences joined by one blank, over which no word goes.
    base = base.select(*keep, "sents_", F.transform("sents_", T.words).alias("words_"))
    own = tagger is not T.part_of_speech
    # Vowels stand in words, and numbers have none: but for links and addresses, syllables are the words' vowel groups.
    spoken = lambda sub: F.when(sub == "", 0).when(sub.contains("@") | sub.contains("://"), T.syllables(sub))
    base = base.select(*keep, T.let(F.array_join("sents_", " "), spoken).alias("spoken_"), F.size("sents_").alias("n_sent"), "words_", F.flatten("words_").alias("toks_"))
    tagged = F.transform("toks_", lambda t: T.let(tagger(F.lower(t)), lambda x: F.when(x.isin([k.upper() for k in C.POS_TAGS]), x).otherwise("OTHER")))
    base = base.select(
        *keep, "spoken_", "n_sent", F.size("toks_").alias("n_words"), F.filter(F.transform("words_", lambda w: F.size(w)), lambda n: n >= 0).alias("lens_"),
        token_counts(F.col("toks_")).alias("c_"), *([tagged.alias("tags_")] if own else []),
    )
    n, s = F.col("n_words"), F.col("n_sent")
    of_kind = lambda k, tag: F.size(F.filter("tags_", lambda t: t == tag.upper())) if own else F.get("c_.tags", F.lit(k))
    pos = [N.share(of_kind(k, tag).cast("double"), n).alias(f"pos_{tag}") for k, tag in enumerate(C.POS_TAGS)]
    hard, syllables = F.col("c_.hard"), F.coalesce("spoken_", F.greatest(F.lit(1).cast("long"), F.col("c_.vowels")))
    return base.select(
        *keep, "n_sent", "n_words", N.share(F.col("c_.chars").cast("double"), n).alias("avg_word_len"),
        N.share(F.col("c_.types").cast("double"), n).alias("ttr"), *([F.col("c_.mattr").alias("mattr")] if with_mattr else []), *pos, *burstiness(F.col("lens_")),
        N.flesch(s, n, syllables).alias("flesch"), N.fk_grade(s, n, syllables).alias("fk_grade"), N.gunning_fog(s, n, hard).alias("gunning_fog"),
    )


def run(df: DataFrame, text: str = "text", doc_id: str = "doc_id", max_docs: int | None = None) -> DataFrame:
    """One row of features a document, of the first max_docs documents in doc_id order if that is given; texts without a
    sentence give none."""
    if max_docs is not None:
        df = df.orderBy(doc_id).limit(max_docs)
    return features(df, text, (doc_id,)).where(F.col("n_sent") > 0)
