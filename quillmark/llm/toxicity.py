"""Toxicity classifier with a counterfactual penalty.

A logistic model over hashed words and beginnings of words is fitted on
labelled documents.  For every training text that names a group, a second text with
each identity term swapped for another of its kind is made, and the squared
difference of the two scores is added to the loss, so the model can't hang a
label on the mere mention of a group.

The fit uses a bounded, documented sample of labelled rows (``SAMPLE``, the
rows of smallest hash); scoring runs over whole texts of all documents with a
fixed 2 MB of weights.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm import wordstream
from quillmark.llm.common import materialize, tidy

#: Labelled rows that the model is fitted on at most.
SAMPLE = 20_000
HASH_BITS = 19
#: Documents (of the sample) a feature must occur in.
LEAST_DOCUMENTS = 5
COUNTERFACTUAL_WEIGHT = 1.0
RIDGE = 1e-4

#: Terms that name groups of people, by kind; a term is swapped within its kind.
IDENTITY_TERMS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants", "sikhs"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer", "heterosexual"),
    ("woman", "man", "girl", "boy"),
    ("women", "men", "girls", "boys"),
    ("female", "male", "nonbinary"),
    ("deaf", "blind", "disabled", "autistic"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("german", "french", "spanish", "english", "american", "mexican", "chinese", "indian", "turkish", "russian"),
    ("frau", "mann"),
    ("frauen", "männer"),
    ("femme", "homme"),
    ("femmes", "hommes"),
    ("mujer", "hombre"),
    ("mujeres", "hombres"),
    ("muslime", "christen", "juden"),
    ("musulmans", "chrétiens", "juifs"),
    ("musulmanes", "cristianos", "judíos"),
)

#: Bytes of the beginnings of words that are features besides whole words.
HEADS = (4, 5, 6, 7, 8)


def _terms() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the identity terms, and of the term each is swapped for."""
    kinds = []
    for kind in IDENTITY_TERMS:
        data = np.frombuffer(" ".join(kind).encode(), np.uint8)
        kinds.append(wordstream.words(data, np.array([0, len(data)]), wordstream.ALNUM_WORDS)[0])
    terms, others = np.concatenate(kinds), np.concatenate([np.roll(k, -1) for k in kinds])
    order = np.argsort(terms)
    return terms[order], others[order]


def _features_of(data: np.ndarray, offsets: np.ndarray, terms: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, feature, feature after swapping, whether the word names a
    group) of every word, and of the beginnings of all words but those."""
    shift = np.uint64(64 - HASH_BITS)
    hashes, first, heads = wordstream.words_and_heads(data, offsets, wordstream.ALNUM_WORDS, HEADS)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.minimum(np.searchsorted(terms[0], hashes), len(terms[0]) - 1)
    names = terms[0][at] == hashes
    heads = [(w[~names[w]], h[~names[w]]) for w, h in heads]
    every = np.concatenate([hashes, *(h for _, h in heads)])
    swapped = np.concatenate([np.where(names, terms[1][at], hashes), *(h for _, h in heads)])
    owners = np.concatenate([owner, *(owner[w] for w, _ in heads)])
    named = np.zeros(len(every), bool)
    named[: len(names)] = names
    return owners, (every >> shift).astype(np.int64), (swapped >> shift).astype(np.int64), named


def _distinct(owner: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique(owner << HASH_BITS | feature)
    return keys >> HASH_BITS, keys & ((1 << HASH_BITS) - 1)


def _features(rows: DataFrame) -> DataFrame:
    """(toxic, features, swapped): distinct features of each text, and those
    after swapping its identity terms (null where it names none)."""
    schema = pa.schema([("toxic", pa.int32()), ("features", pa.binary()), ("swapped", pa.binary())])

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _terms()
        for batch in batches:
            toxic = batch.column(0).to_pylist()
            for start, end, data, offsets in wordstream.text_slices(batch.column(1)):
                owner, own, swapped, named = _features_of(data, offsets, terms)
                mentions = np.bincount(owner[named], minlength=end - start) > 0
                cut = []
                for feature in (own, swapped):
                    texts, found = _distinct(owner, feature)
                    cut.append(np.split(found.astype("<i4"), np.searchsorted(texts, np.arange(1, end - start))))
                yield pa.RecordBatch.from_pylist(
                    [{"toxic": toxic[start + i], "features": cut[0][i].tobytes(), "swapped": cut[1][i].tobytes() if mentions[i] else None} for i in range(end - start)], schema=schema
                )

    return rows.select("toxic", "text").mapInArrow(tidy(extract), "toxic int, features binary, swapped binary")


class _Sparse:
    """Rows of 0/1 features."""

    def __init__(self, rows: list[np.ndarray]) -> None:
        self.n = len(rows)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.column = np.concatenate(rows) if rows else np.zeros(0, np.int64)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.n)

    def back(self, v: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.column, v[self.row], size)


def fit(rows: list[tuple[int, bytes, bytes | None]], weight: float = COUNTERFACTUAL_WEIGHT, ridge: float = RIDGE, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights of all hashed features and the intercept, by Adam on the
    logistic loss + ridge + weight * mean squared change of swapped texts."""
    size = 1 << HASH_BITS
    y = np.array([t for t, _, _ in rows], float)
    if not len(y) or y.min() == y.max():
        return np.zeros(size, np.float32), -4.0 if not len(y) or not y[0] else 4.0
    own = [np.frombuffer(f, "<i4") for _, f, _ in rows]
    counts = np.zeros((2, size))
    for label, features in zip(y.astype(int), own, strict=True):
        counts[label, features] += 1
    # log-count ratios scale the fit: features that chance explains have none
    ratio = np.log((counts[1] + 0.5) / (y.sum() + 1)) - np.log((counts[0] + 0.5) / ((1 - y).sum() + 1))
    doubt = np.sqrt(1 / (counts[1] + 0.5) + 1 / (counts[0] + 0.5))
    strength = np.where(counts.sum(axis=0) >= LEAST_DOCUMENTS, np.maximum(np.abs(ratio) - 2 * doubt, 0), 0)
    chosen = np.flatnonzero(strength)
    strength = strength[chosen]
    place = np.full(size, -1)
    place[chosen] = np.arange(len(chosen))

    def kept(f: np.ndarray) -> np.ndarray:
        f = place[f]
        return f[f >= 0]

    x = _Sparse([kept(f) for f in own])
    swaps = [i for i, r in enumerate(rows) if r[2] is not None]
    x0 = _Sparse([kept(own[i]) for i in swaps])
    x1 = _Sparse([kept(np.frombuffer(rows[i][2], "<i4")) for i in swaps])
    w, bias = np.zeros(len(chosen)), float(np.log(y.mean() / (1 - y.mean())))
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, steps + 1):
        scaled = w * strength
        p = 1 / (1 + np.exp(-np.clip(x.times(scaled) + bias, -30, 30)))
        g = x.back(p - y, len(chosen)) / len(y)
        if swaps:
            change = x0.times(scaled) - x1.times(scaled)
            g += 2 * weight * (x0.back(change, len(chosen)) - x1.back(change, len(chosen))) / len(swaps)
        grad = np.append((g + ridge * scaled) * strength, (p - y).mean())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1]
        bias -= float(move[-1])
    out = np.zeros(size, np.float32)
    out[chosen] = w * strength
    return out, bias


def scorer(spark: SparkSession, weights: np.ndarray, bias: float):
    """Column function: score from 0 to 1 of a text column."""
    shared = spark.sparkContext.broadcast((weights, bias))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        weights, bias = shared.value
        out, terms = [], _terms()
        for start, end, data, offsets in wordstream.text_slices(texts):
            owner, feature, _, _ = _features_of(data, offsets, terms)
            active = np.abs(weights[feature]) > 1e-6
            owner, feature = _distinct(owner[active], feature[active])
            z = np.bincount(owner, weights[feature], end - start) + bias
            out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return score


def training_rows(docs: DataFrame, labels: DataFrame, train_on, sample: int = SAMPLE) -> DataFrame:
    """(toxic, text) of at most ``sample`` labelled documents that ``train_on``
    (a condition on doc_id) admits: those with the smallest hash of the id.
    Rows of one id with different labels, or without, are left out."""
    agreed = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("high")).filter("toxic = high AND toxic IN (0, 1)").filter(train_on)
    chosen = agreed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    joined = texts.join(F.broadcast(materialize(chosen, "chosen")), "doc_id")  # at most ``sample`` ids
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    return joined.withColumn("_r", F.row_number().over(one)).filter("_r = 1").select("toxic", "text")


def train(docs: DataFrame, labels: DataFrame, train_on, sample: int = SAMPLE, weight: float = COUNTERFACTUAL_WEIGHT):
    """Scoring column function fitted on a bounded sample."""
    found = materialize(_features(training_rows(docs, labels, train_on, sample)), "features").toLocalIterator()
    weights, bias = fit([(r.toxic, bytes(r.features), None if r.swapped is None else bytes(r.swapped)) for r in found], weight)
    return scorer(docs.sparkSession, weights, bias)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, sample: int = SAMPLE, weight: float = COUNTERFACTUAL_WEIGHT) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    Rows whose crc32(doc_id as text) is divisible by ``folds`` are held out
    from the fit.  Null and empty texts get the score of a text without words;
    rows without id are scored and not held out; without labels of both kinds
    the score is a constant; other columns are ignored; an empty table gives
    no rows.
    """
    fold = F.crc32(F.col("doc_id").cast("long").cast("string")) % folds
    score = train(docs, labels, fold != 0, sample, weight)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(F.col("text").cast("string")).alias("score"))
    return scored.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
