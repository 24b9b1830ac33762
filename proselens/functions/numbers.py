"""Column expressions over numbers, arrays and vectors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import ship


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 if whole is 0."""
    return F.when(whole == 0, 0.0).otherwise(part / F.greatest(whole, F.lit(1)))


def flesch(sents: Column, words: Column, syllables: Column) -> Column:
    return F.when((sents == 0) | (words == 0), 0.0).otherwise(206.835 - 1.015 * _ratio(words, sents) - 84.6 * _ratio(syllables, words))


def fk_grade(sents: Column, words: Column, syllables: Column) -> Column:
    return F.when((sents == 0) | (words == 0), 0.0).otherwise(0.39 * _ratio(words, sents) + 11.8 * _ratio(syllables, words) - 15.59)


def gunning_fog(sents: Column, words: Column, complex_words: Column) -> Column:
    return F.when((sents == 0) | (words == 0), 0.0).otherwise(0.4 * (_ratio(words, sents) + 100.0 * _ratio(complex_words, words)))


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def type_token_ratio(tokens: Column) -> Column:
    return share(F.size(F.array_distinct(tokens)), F.size(tokens))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def mean(xs: Column) -> Column:
    return F.when(F.size(xs) == 0, 0.0).otherwise(F.try_divide(total(F.transform(xs, lambda x: x.cast("double"))), F.size(xs)))


def deviation(xs: Column) -> Column:
    """Population standard deviation, in two passes."""
    return F.get(F.transform(F.array(mean(xs)), lambda m: F.sqrt(mean(F.transform(xs, lambda x: (x - m) * (x - m))))), F.lit(0))


def running(xs: Column) -> Column:
    """Of each element of an array of whole numbers the sum of those before it."""
    ship()

    @F.arrow_udf("array<long>")
    def run(lists: pa.Array) -> pa.Array:
        n = np.asarray(lists.value_lengths().fill_null(0), np.int64)
        x, end = np.asarray(lists.flatten(), np.int64), np.cumsum(n)
        total = np.r_[0, np.cumsum(x)]
        offsets = pa.array(np.r_[0, end].astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(total[:-1] - np.repeat(total[end - n], n)), mask=lists.is_null() if lists.null_count else None)

    return run(xs)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def unit(v: Column) -> Column:
    """v to unit length; the zero vector stays. The length is worked out once, not once a component."""
    one = lambda c, use: F.get(F.transform(F.array(c), use), F.lit(0))
    scaled = lambda a: one(F.sqrt(dot(a, a)), lambda n: F.transform(a, lambda x: F.when(n == 0, x.cast("double")).otherwise(F.try_divide(x.cast("double"), n))))
    return one(v, scaled)


def mean_pool(vectors: Column, mask: Column) -> Column:
    """The mean of those vectors of an array whose mask isn't 0; null if there is none."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda z: z["m"] != 0), lambda z: z["v"])
    add = F.aggregate(F.slice(kept, F.lit(2), F.size(kept)), F.transform(kept[0], lambda x: x.cast("double")), lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double")))
    return F.when(F.size(kept) > 0, F.transform(add, lambda x: x / F.size(kept)))


def exp(x: Column) -> Column:
    """exp of the C library, as SQL engines have it. Spark's own is another in the last place of one value in ten, which
    decides labels where probabilities all but tie."""

    @F.arrow_udf("double")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else math.exp(v) for v in values.to_pylist()], pa.float64())

    return run(x)


def softmax(*xs: Column) -> list[Column]:
    """Shares of the exponentials, to the last bit those of the C library's."""
    top = F.greatest(*xs)
    e = [exp(x - top) for x in xs]
    s = sum(e[1:], e[0])
    return [x / s for x in e]


def renormalise(*xs: Column) -> list[Column]:
    """Shares of the sum; a sum of 0 counts as 1."""
    s = sum(xs[1:], xs[0])
    s = F.when(s == 0, 1.0).otherwise(s)
    return [x / s for x in xs]


def z_score(xs: Column, mu: Column, sigma: Column) -> Column:
    """Standardised values; a sigma of 0 counts as 1, and arrays of other lengths leave the values as they are."""
    out = F.zip_with(F.zip_with(xs, mu, lambda x, m: x - m), sigma, lambda x, s: x / F.when(s == 0, 1.0).otherwise(s))
    return F.when((F.size(xs) == F.size(mu)) & (F.size(xs) == F.size(sigma)), out).otherwise(xs)


def first_label(human: Column, ai: Column, paraphrased: Column) -> Column:
    """The label with the highest probability; ties go to the earlier label."""
    return F.when((human >= ai) & (human >= paraphrased), "human").when(ai >= paraphrased, "ai").otherwise("paraphrased_ai")
