"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training folds every labelled text into counts per (language, bucket), summed per task before the shuffle, so the table
that is shuffled and broadcast has at most languages x buckets entries whatever the corpus size. Scoring looks up the
log-probability matrix, broadcast once, in numpy batches.

Texts are lower-cased; each character that isn't a letter becomes a blank and runs of blanks become one, so digits,
punctuation and mark-up carry no evidence. Grams of 1 to 4 characters are hashed into 2**16 buckets each order its own
seed.

Defined results: a null text, or one without a letter, has ``lang_pred`` 'und' and score 0. Without any usable training
row everything is 'und'. Ties go to the language that sorts first. Null labels and null texts never train.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, schema_with, ship

BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
SMOOTHING = 0.5
UNDETERMINED = "und"
#: More labels than this is taken as an error in the input, as each costs a row of the broadcast matrix (half a MB).
MAX_LANGUAGES = 1000
_MULT = np.uint32(0x9E3779B1)


#: For every character of the basic plane (others through str methods): its lower-case letter, or 0 if it isn't one.
def _letter_table() -> np.ndarray:
    t = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            t[c] = ord(low) if len(low) == 1 else c
    return t


_TABLE: list[np.ndarray] = []


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, runs of others as one blank (32) with one blank at each end; empty if there is no letter."""
    if not _TABLE:
        _TABLE.append(_letter_table())
    cp = _TABLE[0][np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    if not cp.any():
        return cp[:0]
    cp = np.concatenate(([0], cp, [0])).astype(np.uint32)
    keep = np.ones(len(cp), bool)
    keep[1:] = (cp[1:] != 0) | (cp[:-1] != 0)
    cp = cp[keep]
    cp[cp == 0] = 32
    return cp


def grams(cp: np.ndarray) -> list[np.ndarray]:
    """Bucket numbers of all n-grams, one array an order."""
    out, h = [], np.zeros(len(cp), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(cp) < n:
            break
        h = (h[: len(cp) - n + 1] * np.uint32(16777619)) ^ (cp[n - 1 :] * _MULT)
        if n in ORDERS:
            x = (h ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35)
            out.append((x ^ (x >> np.uint32(15))) & np.uint32(BUCKETS - 1))
    return out


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages in order, float32 log-probabilities[language, bucket] with the prior in the last column) from all rows
    of docs that have both. What reaches the driver is at most languages x buckets counts."""
    ship(docs.sparkSession)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        n: dict[str, int] = {}
        for b in (x.slice(k, 256) for x in batches for k in range(0, x.num_rows, 256)):
            for t, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cp = letters_of(t)
                if len(cp) == 0:
                    continue
                if g not in sums:
                    sums[g], n[g] = np.zeros(BUCKETS, np.int64), 0
                sums[g] += np.bincount(np.concatenate(grams(cp)), minlength=BUCKETS)
                n[g] += 1
        for g, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([g] * (len(at) + 1)), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(s[at], n[g]))], names=["g", "bucket", "n"])

    used = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("g"))
    table = used.mapInArrow(lean(count), "g string, bucket int, n long").groupBy("g", "bucket").agg(F.sum("n").alias("n"))
    got = table.groupBy("g").agg(F.collect_list(F.struct("bucket", "n")).alias("c")).limit(MAX_LANGUAGES + 1).toArrow()
    names = got.column("g").to_pylist()
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages; the model's size bound doesn't hold")
    order = sorted(range(len(names)), key=lambda i: names[i])
    logp = np.zeros((len(names), BUCKETS + 1), np.float32)
    rows = []
    for i in order:
        c = got.column("c")[i].values
        at, n = c.field("bucket").to_numpy(), c.field("n").to_numpy()
        full = np.zeros(BUCKETS)
        full[at[at >= 0]] = n[at >= 0]
        rows.append((full, n[at < 0].sum()))
    total = sum(x[1] for x in rows)
    for j, (full, n) in enumerate(rows):
        logp[j, :BUCKETS] = np.log((full + SMOOTHING) / (full.sum() + SMOOTHING * BUCKETS))
        logp[j, BUCKETS] = np.log(n / total)
    return [names[i] for i in order], logp


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", margin: str | None = None) -> DataFrame:
    """docs with ``lang_pred`` and ``score``, the posterior of that language, and, if it is named, a column ``margin``: how
    much likelier a gram of the text is in that language than among evenly mixed grams, as a mean logarithm. It is above 0
    for text of a learned language and below for what none of them explains; 0 without a letter. Other columns pass
    unchanged; columns of these names are replaced."""
    spark = docs.sparkSession
    ship(spark)
    more = [("lang_pred", "string"), ("score", "double"), *([(margin, "double")] if margin else [])]
    docs = docs.drop(*(n for n, _ in more))
    names, logp = model
    # Buckets in rows: a gram's values for all languages lie side by side.
    shared = spark.sparkContext.broadcast((names, np.ascontiguousarray(logp[:, :BUCKETS].T), logp[:, BUCKETS].astype(float) if names else None))
    at = docs.columns.index(text)

    def score(batches):
        names, table, prior = shared.value
        for b in (x.slice(k, 256) for x in batches for k in range(0, x.num_rows, 256)):
            pred, conf, over = [], [], []
            for t in b.column(at).to_pylist():
                cp = letters_of(t) if t else ()
                if len(cp) == 0 or not names:
                    pred.append(UNDETERMINED)
                    conf.append(0.0)
                    over.append(0.0)
                    continue
                own = grams(cp)
                hits = np.bincount(np.concatenate(own), minlength=BUCKETS) if len(cp) > 60_000 else None
                s = prior + (hits @ table if hits is not None else sum(table[g].sum(0, dtype=np.float64) for g in own))
                e = np.exp(s - s.max())
                k = int(s.argmax())
                pred.append(names[k])
                conf.append(float(e[k] / e.sum()))
                over.append(float((s[k] - prior[k]) / sum(map(len, own)) + np.log(BUCKETS)))
            columns = [pa.array(pred, pa.string()), pa.array(conf, pa.float64()), pa.array(over, pa.float64())][: len(more)]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*b.schema.names, *(n for n, _ in more)])

    schema = schema_with(docs, *more)
    return docs.mapInArrow(lean(score), schema)


def identify(docs: DataFrame, held_out: Column, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with ``held_out``, ``lang_pred`` and ``score``, the model learned from the rows that aren't held out."""
    flagged = docs.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    return predict(flagged, train(flagged.where(~F.col("held_out")), text, lang), text)
