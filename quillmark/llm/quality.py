"""Quality classifier: interpolated modified Kneser-Ney over words.

Trusted text (documents labelled good) trains a word bigram model, whose
tables grow with it and are joined shard by shard with what the documents hold
(``wordmodel``).  Words that no trusted text has are spelled by a character
4-gram model over an alphabet of 32 symbols: a-z, and one symbol each for
upper-case letters, other letters, digits, white space, sentence punctuation
and everything else.  It has 32**4 values whatever the corpus, so it is
finished on the driver and the speller (4 MB) is sent to every task.

Trusted documents are measured without what only they added to the tables.  A
document's perplexity is drawn towards the mean of all by ``PRIOR`` imagined
words, so that a few odd words do not decide about a short text.  Documents
above their language's quantile of trusted documents are rejected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm import wordmodel, wordstream
from quillmark.llm.common import discard, free_names, free_shuffles, keyed, materialize, only_kept, tidy, tidy_group

ORDER = 4
SYMBOL_BITS = 5
SYMBOLS = 1 << SYMBOL_BITS
#: Quantile of the trusted documents' perplexity above which one is rejected,
#: and how far above it (as a factor) a document must be.
QUANTILE = 0.99
MARGIN = 1.05
PRIOR = 100
#: Least trusted documents of a language for a threshold of its own.
LEAST_TRUSTED = 30

_SPACE, _UPPER, _LETTER, _DIGIT, _POINT, _OTHER = 0, 27, 28, 29, 30, 31


def _symbol_table() -> np.ndarray:
    table = np.full(256, _OTHER, np.uint8)
    table[0xC3:0xF0] = _LETTER  # first bytes of non-ASCII letters and signs
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    table[ord("A") : ord("Z") + 1] = _UPPER
    table[ord("0") : ord("9") + 1] = _DIGIT
    for c in " \t\n\r\v\f":
        table[ord(c)] = _SPACE
    for c in ".,;:'\"?()-":
        table[ord(c)] = _POINT
    return table


_TABLE = _symbol_table()


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-gram code at every character (white space stands before a text), and
    the first character of each text and the end."""
    lead = (data & 0xC0) != 0x80
    symbols = _TABLE[data[lead]].astype(np.int64)
    first = np.concatenate([[0], np.cumsum(lead)])[offsets]
    codes = symbols.copy()
    for back in range(1, ORDER):
        earlier = np.zeros_like(symbols)
        earlier[back:] = symbols[:-back] if back < len(symbols) else symbols[:0]
        for start in range(back):
            at = first[:-1] + start
            earlier[at[at < first[1:]]] = _SPACE
        codes |= earlier << (SYMBOL_BITS * back)
    return codes, first


_RUN_BITS = 14


def _counts(texts: DataFrame, pick: Callable | None) -> np.ndarray:
    """How often every possible n-gram occurs; tasks send runs of counts."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(SYMBOLS**ORDER, np.int64)
        for batch in batches if pick is None else pick(batches):
            for _, _, data, offsets in wordstream.text_slices(batch.column(1)):
                if len(data):
                    totals += np.bincount(_grams(data, offsets)[0], minlength=len(totals))
        runs = totals.reshape(-1, 1 << _RUN_BITS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(runs))), pa.array([r.tobytes() for r in runs], pa.binary())], ["run", "n"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(data, np.int64) for data in table.column("n").to_pylist())
        return pa.table({"run": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([total.tobytes()], pa.binary())})

    found = np.zeros((SYMBOLS**ORDER >> _RUN_BITS, 1 << _RUN_BITS), np.int64)
    for row in texts.mapInArrow(tidy(count), "run long, n binary").groupBy("run").applyInArrow(tidy_group(add), "run long, n binary").toLocalIterator():
        found[row.run] = np.frombuffer(row.n, np.int64)
    return found.ravel()


def _speller(counts: np.ndarray) -> np.ndarray:
    """Log probability of the last symbol of every possible n-gram given those
    before it: interpolated modified Kneser-Ney on arrays of a fixed size."""
    tables = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):  # in how many contexts a shorter n-gram continues one
        tables[order] = (tables[order + 1].reshape(SYMBOLS, -1) > 0).sum(axis=0)
    lower = np.ones(1)
    below_of_first = 1.0 / SYMBOLS
    for order in range(1, ORDER + 1):
        n = tables[order]
        discount = np.array([0.0, *wordmodel.discounts(*(int((n == i).sum()) for i in range(1, 5)))])[np.minimum(n, 3)]
        by_context = n.reshape(-1, SYMBOLS)
        total = by_context.sum(axis=1, keepdims=True)
        held = discount.reshape(-1, SYMBOLS).sum(axis=1, keepdims=True)
        below = np.tile(lower, SYMBOLS).reshape(-1, SYMBOLS) if order > 1 else np.full((1, SYMBOLS), below_of_first)
        counted = by_context - discount.reshape(-1, SYMBOLS) + held * below
        lower = np.where(total == 0, below, counted / np.maximum(total, 1)).ravel()
    return np.log(lower).astype(np.float32)


def train(texts: DataFrame, pick: Callable | None = None) -> np.ndarray:
    """The character model of a table (key, text); ``pick``, if given, leaves
    of the batches of texts what is to be counted."""
    return _speller(_counts(texts, pick))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of documents that every label row calls good."""
    return labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("quality")).filter("quality = 1").select("doc_id")


def speller(model: np.ndarray, spark):
    """Function without arguments that gives, in a task, the log probabilities
    of words (bytes, offsets) by the character model."""
    shared = spark.sparkContext.broadcast(model)

    def spell(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        codes, first = _grams(data, offsets)
        sums = np.concatenate([[0.0], np.cumsum(shared.value[codes], dtype=np.float64)])
        return np.diff(sums[first])

    return lambda: spell


#: Trusted ids that go to every task (32 MB); more are joined.
MOST_IDS = 4_000_000


def _trusted_texts(typed: DataFrame, trusted: DataFrame, most_ids: int) -> tuple[DataFrame, Callable | None]:
    """Table (doc_id, text) and a filter of its batches that together hold the
    trusted texts: a bounded number of ids goes to where the texts are, more
    are joined, for which the texts are dealt out once."""
    texts = typed.filter("text <> ''").select("doc_id", "text")
    if trusted.limit(most_ids + 1).count() > most_ids:
        return materialize(texts.join(trusted.hint("shuffle_hash"), "doc_id", "left_semi").select(F.col("doc_id"), "text"), "trusted"), None
    ids = trusted.select(F.col("doc_id").cast("long")).toPandas()["doc_id"].to_numpy(np.int64)
    shared = typed.sparkSession.sparkContext.broadcast(np.sort(ids))

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            if len(known):
                asked = batch.column(0).to_numpy(zero_copy_only=False)
                kept = known[np.minimum(np.searchsorted(known, asked), len(known) - 1)] == asked
                yield batch.filter(pa.array(kept))

    return texts.filter("doc_id IS NOT NULL"), pick


def _judged(docs: DataFrame, key: Column, labels: DataFrame, quantile: float, margin: float, prior: int, most_ids: int) -> tuple[DataFrame, DataFrame]:
    """(key, lang, symbols, perplexity, limit, keep) of every distinct text and
    language, and the thresholds by language.  ``key``: of a row's text."""
    spark = docs.sparkSession
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), key.alias("key"))
    asked = typed.filter("text <> ''").select("key", "text")
    trusted = materialize(trusted_ids(labels).select(F.col("doc_id").cast("long").alias("doc_id")), "ids")
    good, pick = _trusted_texts(typed, trusted, most_ids)
    free_shuffles(spark)
    spell = speller(train(good, pick), spark)
    model = wordmodel.train(good, wordmodel.shard_count(asked), pick)
    if pick is None:
        discard(good)
    losses = wordmodel.losses(asked, model, spell)
    names = typed.select("doc_id", "lang", "key")
    # a text is judged alike wherever it stands, so what is trusted is known by its key
    own = names.join(trusted, "doc_id", "left_semi").select("key", "lang")
    scores = materialize(own.join(losses, "key", "left").select("lang", F.coalesce("words", F.lit(0)).alias("symbols"), F.coalesce("unseen", F.lit(0.0)).alias("loss")), "scores")
    mean = scores.agg(F.try_divide(F.sum("loss"), F.sum("symbols")).alias("m")).first().m or 0.0

    def perplexity(symbols: Column, loss: Column) -> Column:
        return F.exp((loss + prior * mean) / (symbols + prior))

    limit = F.percentile_approx(perplexity(F.col("symbols"), F.col("loss")), F.lit(quantile), F.lit(10_000)) * margin
    of_all = scores.agg(limit.alias("limit")).first().limit
    limits = materialize(scores.groupBy("lang").agg(F.count("*").alias("n"), limit.alias("limit")).filter(f"n >= {LEAST_TRUSTED} AND lang IS NOT NULL").select("lang", F.col("limit").alias("own")), "limits")
    marks = own.select("key").distinct().withColumn("trusted", F.lit(True))
    each = names.select("key", "lang").distinct().join(losses, "key", "left").join(marks, "key", "left").join(limits, "lang", "left")
    symbols = F.coalesce("words", F.lit(0)).cast("long")
    loss = F.coalesce(F.when(F.col("trusted"), F.col("unseen")).otherwise(F.col("loss")), F.lit(0.0))
    scored = each.select("key", "lang", symbols.alias("symbols"), perplexity(symbols, loss).alias("perplexity"), F.coalesce("own", F.lit(of_all)).alias("limit"))
    return materialize(scored.withColumn("keep", F.coalesce(F.col("perplexity") <= F.col("limit"), F.lit(True))), "judged"), limits


def quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, prior: int = PRIOR, most_ids: int = MOST_IDS) -> DataFrame:
    """One row per document: doc_id, lang, symbols, perplexity, limit, keep.

    A language's limit is the ``quantile`` of its trusted documents'
    perplexity times ``margin``; languages with few trusted documents, null
    among them, take that of all.  Null and empty texts have the mean
    perplexity and are kept; without any trusted text everything is kept.
    Rows without id and repeated rows are rows like any other; other columns
    are ignored; an empty table gives no rows.
    """
    (name,) = free_names(docs, "key")
    docs = keyed(docs, name)
    judged, _ = _judged(docs, F.col(name), labels, quantile, margin, prior, most_ids)
    rows = docs.select("doc_id", F.col("lang").alias("_lang"), F.col(name).alias("_key"))
    found = rows.join(judged, F.col("_key").eqNullSafe(F.col("key")) & F.col("_lang").cast("string").eqNullSafe(F.col("lang")), "left")
    return found.select("doc_id", F.col("_lang").alias("lang"), "symbols", "perplexity", "limit", "keep")


def keep_good(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, prior: int = PRIOR, most_ids: int = MOST_IDS) -> DataFrame:
    """The documents that the classifier keeps, with their own columns.

    Rows with null or empty texts, without id or language stay like any other
    that isn't rejected, repeated rows all go or all stay, other columns are
    untouched, and an empty table stays empty.
    """
    key, text_key, lang = free_names(docs, "key", "text_key", "lang")
    rows = keyed(docs, key)
    with only_kept(docs.sparkSession) as keep:
        judged, _ = _judged(rows, F.col(key), labels, quantile, margin, prior, most_ids)
        rejected = keep(materialize(judged.filter("NOT keep").select(F.col("key").alias(text_key), F.col("lang").alias(lang)), "rejected"))
    same = (F.col(key) == F.col(text_key)) & F.col("lang").cast("string").eqNullSafe(F.col(lang))
    return rows.join(rejected, same, "left_anti").drop(key)
