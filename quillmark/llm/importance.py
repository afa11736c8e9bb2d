"""Target-distribution importance resampling over hashed n-grams.

Two passes over the texts: one counts features by bucket (per task a table of
``BUCKETS`` counts, then a sum), one weighs each document with the gains of the
buckets.  In both, a run of texts is handled with an integer word dictionary:

1. its distinct words get ids, and texts become arrays of ids;
2. n-grams are tuples of ids, packed into 64 bits two by two;
3. the bytes of each *distinct* tuple are put together from its words and
   hashed once;
4. buckets go back to all occurrences through the tuples' numbers.

Dictionaries are exact (words, not hashes, are their keys) and belong to a run
of ``RUN_BYTES`` of text: one dictionary for the whole corpus would be joined
with every word and every tuple, which shuffles the corpus several times over
and changes no count.  Only the bucket counts, the gains and one number for
each range of the final ranking leave their tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm import wordstream
from quillmark.llm.common import materialize, tidy
from quillmark.operators.ordered import numbered

BUCKETS = 10_000
#: Longest n-grams, in words.
ORDER = 2
#: Text that shares a dictionary.
RUN_BYTES = 2 << 20
#: A-Z as a-z, and blanks for what is in no word.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if wordstream.ALNUM_WORDS[b] else 32 for b in range(256))


class _Dictionary(dict):
    """Ids of words in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _features(data: np.ndarray, offsets: np.ndarray, order: int, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text of a run, and for each n-gram length the bucket and
    the text of every occurrence."""
    raw = data.tobytes().translate(_PLAIN)
    dictionary = _Dictionary()
    numbered_texts = [list(map(dictionary.__getitem__, raw[a:b].split())) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    sizes = np.fromiter(map(len, numbered_texts), np.int64, len(numbered_texts))
    ids = np.fromiter((i for text in numbered_texts for i in text), np.int64, int(sizes.sum()))
    text = np.repeat(np.arange(len(sizes)), sizes)
    words = list(dictionary)
    states = np.fromiter(map(zlib.crc32, words), np.int64, len(words))  # of the bytes of each distinct tuple
    tuples = ids  # number of the tuple that begins at each word
    out = [(states[tuples] % buckets, text)]
    for length in range(2, order + 1):
        inside = text[: len(ids) - length + 1] == text[length - 1 :]  # a tuple ends in its own text
        pairs = (tuples[: len(ids) - length + 1] << 32) | ids[length - 1 :]
        distinct, at = np.unique(pairs, return_inverse=True)
        heads, tails = (distinct >> 32).tolist(), (distinct & 0xFFFFFFFF).tolist()
        blanked = [zlib.crc32(b" ", s) for s in states.tolist()]  # tuple and blank; the next word's bytes follow
        states = np.fromiter((zlib.crc32(words[w], blanked[t]) for t, w in zip(heads, tails, strict=True)), np.int64, len(distinct))
        out.append((states[at][inside] % buckets, text[: len(inside)][inside]))
        tuples = at
    return sizes, out


def bucket_counts(texts: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of the column ``text`` of all rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in wordstream.text_slices(batch.column(0), RUN_BYTES):
                for bucket, _ in _features(data, offsets, order, buckets)[1]:
                    counts += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["bucket", "n"])

    partial = texts.select(F.col("text").cast("string")).mapInArrow(tidy(run), "bucket long, n long")
    return partial.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain): a thousand times the logarithm of the smoothed share of
    each bucket in ``target`` over that in ``corpus``, floored, from their
    ``bucket_counts``."""
    every = corpus.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    both = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0)
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    s, t, whole_s, whole_t = (F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t"))
    odds = (t + 1) * (whole_s + buckets) / ((s + 1) * (whole_t + buckets))
    return both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(odds)).alias("gain"))  # one row


def weigh(docs: DataFrame, gain: np.ndarray, order: int = ORDER) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row of ``docs``: the weight
    is the floored mean of the gains of its features, 0 without features."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # a number for each bucket

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in wordstream.text_slices(batch.column(1), RUN_BYTES):
                sizes, found = _features(data, offsets, order, len(shared.value))
                total, n = np.zeros(end - start, np.int64), np.zeros(end - start, np.int64)
                for bucket, text in found:
                    sums = np.concatenate([[0], np.cumsum(shared.value[bucket])])
                    ends = np.searchsorted(text, np.arange(end - start + 1))
                    total += np.diff(sums[ends])
                    n += np.diff(ends)
                yield pa.RecordBatch.from_arrays([batch.column(0)[start:end], pa.array(sizes), pa.array(n), pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, n_words long, n_features long, weight long")


def gumbel(key: Column) -> Column:
    """A thousand Gumbel units drawn by the hash of ``key``, floored: adding them
    to log-weights and taking the largest sums samples without replacement."""
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), a row for each row of
    ``docs``: importance resampling towards ``target`` (text).  Words are runs
    of ASCII letters and digits (A-Z lower-cased) and all other characters
    beyond ASCII; features are all runs of 1 to ``order`` words.  ``percent`` of
    the documents with ``min_words`` words or more are drawn, by highest score,
    ties to smaller ids; ``rank`` is 1, 2, ... in that order and null for those
    not drawn.

    Null and empty texts have no features, weight 0, and are never drawn (with
    ``min_words`` above 0); a null id is hashed as an empty one and stands last
    among equal scores; repeated rows are rows like any other (which of them
    comes first is not defined); texts may be of any length; other columns are
    ignored; an empty table gives none, an empty target the weights of uniform
    buckets.
    """

    table = gains(bucket_counts(docs, order, buckets), bucket_counts(target, order, buckets), buckets)
    gain = np.zeros(buckets, np.int64)
    for row in table.toLocalIterator():  # a row for each bucket
        gain[row.bucket] = row.gain
    score = F.col("weight") + gumbel(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    scored = materialize(weigh(docs, gain, order).withColumn("score", score), "scored")
    chosen = scored.filter(F.col("n_words") >= min_words)
    drawn = percent * chosen.count() // 100
    ranked = numbered(chosen.withColumns({"down": -F.col("score"), "last": F.col("doc_id").isNull()}), "down", "last", "doc_id", name="n")
    rank = F.when(F.col("n") < drawn, F.col("n").cast("long") + 1)
    rows = ranked.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
    return rows.unionByName(scored.filter(F.col("n_words") < min_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
