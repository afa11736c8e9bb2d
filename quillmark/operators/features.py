"""Feature operators over (doc_id, tokens, counts) and their references."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions import annotate, arrays, cleaning, stylometry
from quillmark.operators import context, measures
from quillmark.sources.connectors import scratch


def nonempty(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` whose array ``column`` has items.  A filter alone is pushed
    below the projection that makes the array, which is then computed again
    (inside lambdas even for each item); nothing is pushed below a generator."""
    return rows.withColumn(column, F.explode_outer(F.array(column))).filter(F.size(column) > 0)


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, w, c): the distinct tokens of each document, counted in place
    (``counts`` are in the order of the sorted distinct tokens)."""
    pairs = F.arrays_zip(F.sort_array(F.array_distinct("tokens")).alias("w"), F.col("counts").alias("c"))
    return docs.select("doc_id", F.explode(pairs).alias("p")).select("doc_id", "p.w", F.col("p.c").cast("long").alias("c"))


def word_freqs(docs: DataFrame) -> DataFrame:
    n = F.size("tokens")
    pairs = F.arrays_zip(F.sort_array(F.array_distinct("tokens")).alias("w"), F.col("counts").alias("c"))
    return docs.select("doc_id", n.alias("n"), F.explode(pairs).alias("p")).select("doc_id", "p.w", (F.col("p.c") / F.col("n")).alias("freq"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(w, c): token counts over a corpus."""
    return word_counts(docs).groupBy("w").agg(F.sum("c").alias("c"))


def reference_freqs(docs: DataFrame) -> DataFrame:
    known = vocabulary(docs)
    return known.crossJoin(F.broadcast(known.agg(F.sum("c").alias("n")))).select("w", (F.col("c") / F.col("n")).alias("q"))  # one row


def kl_divergence(docs: DataFrame, reference: DataFrame) -> DataFrame:
    """Sum of p ln(p / q), q of unseen words 1e-10, never below 0."""
    joined = context.looked_up(word_freqs(docs), reference, ["w"], "q")
    term = F.col("freq") * F.log(F.col("freq") / F.coalesce("q", F.lit(1e-10)))
    return joined.groupBy("doc_id").agg(F.greatest(F.lit(0.0), F.sum(term)).alias("kl"))


def entropy_drop(docs: DataFrame) -> DataFrame:
    """Entropy of the raw text minus that of its rewritten version."""
    raw = docs.select(F.col("sample_id").alias("original_id"), F.col("h").alias("raw_h"))
    return docs.filter("original_id IS NOT NULL").join(raw, "original_id").select("doc_id", (F.col("raw_h") - F.col("h")).alias("entropy_drop"))


def gram_rows(docs: DataFrame, orders: tuple[int, ...]) -> DataFrame:
    grams = F.concat(*(arrays.ngrams(F.col("tokens"), n) for n in orders))
    return docs.select("doc_id", F.explode(grams).alias("g"))


def gram_counts(docs: DataFrame, orders: tuple[int, ...], **parts: str) -> DataFrame:
    """(g, n): how often each n-gram occurs.  With ``parts``, a condition on the
    documents for each name, as columns n_<name> of one pass.  Tasks count runs
    of documents by numbers of their words, and write an n-gram once a run."""
    conditions = {f"n_{name}": condition for name, condition in parts.items()} or {"n": "true"}
    columns = list(conditions)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("tokens")).to_numpy()
            for a, b in measures.runs(sizes):
                some = batch.slice(a, b - a)
                words = some.column("tokens").flatten().dictionary_encode()
                code, known, doc = words.indices.to_numpy().astype(np.int64), words.dictionary, np.repeat(np.arange(b - a), sizes[a:b])
                marks = {name: some.column(name).to_numpy(zero_copy_only=False).astype(np.float64) for name in columns}
                gram, texts = code, known
                for k in range(1, max(orders) + 1):
                    kept = np.flatnonzero(doc[: max(len(doc) - k + 1, 0)] == doc[k - 1 :])
                    if k > 1:
                        keys, first, number = np.unique(gram[kept] * max(len(known), 1) + code[kept + k - 1], return_index=True, return_inverse=True)
                        at = kept[first]
                        texts = pc.binary_join_element_wise(texts.take(pa.array(gram[at])), known.take(pa.array(code[at + k - 1])), " ")
                        gram = gram.copy()
                        gram[kept] = number
                    if k in orders and len(texts):
                        yield pa.RecordBatch.from_pydict({"g": texts, **{name: np.bincount(gram[kept], mark[doc[kept]], len(texts)).astype(np.int64) for name, mark in marks.items()}})

    some = functools.reduce(lambda a, b: a | b, (F.expr(f"coalesce({condition}, false)") for condition in conditions.values()))
    rows = docs.filter(some).select("tokens", *(F.expr(f"coalesce({condition}, false)").cast("int").alias(name) for name, condition in conditions.items()))
    counted = nonempty(rows, "tokens").mapInArrow(count, "g string, " + ", ".join(f"{name} long" for name in columns))
    return counted.groupBy("g").agg(*(F.sum(name).alias(name) for name in columns))


def lexicon_density(docs: DataFrame, lexicon: DataFrame, orders: tuple[int, ...] = (2, 3)) -> DataFrame:
    """Share of a document's n-grams, of all orders together, in the lexicon (a
    few hundred n-grams, held against each document's in its row); documents
    without n-grams have no row."""
    listed = lexicon.agg(F.collect_set("g").alias("_lexicon"))  # one row
    grams = docs.select("doc_id", F.concat(*(arrays.ngrams(F.col("tokens"), n) for n in orders)).alias("_grams"))
    found = nonempty(grams, "_grams").crossJoin(F.broadcast(listed)).withColumn("_hits", F.array_intersect("_grams", "_lexicon"))
    hits = F.when(F.size("_hits") == 0, 0).otherwise(F.size(F.filter("_grams", lambda g: F.array_contains("_hits", g))))
    return found.select("doc_id", (hits / F.size("_grams")).alias("density"))


def backfill(have: DataFrame, wanted: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``have`` and, for keys of ``wanted`` it lacks, what ``compute`` gives."""
    return have.unionByName(compute(wanted.join(have.select(key), key, "left_anti")), allowMissingColumns=True)


def depth_totals(parsed: DataFrame, *keys: str) -> DataFrame:
    """(keys, total, n): the sum of the word depths of each document, and its
    words.  Depths are summed in their row: exploding them would filter by the
    array, which Spark then computes twice."""
    held = parsed.select(*keys, F.explode_outer(F.array(annotate.word_depths(F.col("dep_parse")))).alias("_d"))
    return held.select(*keys, arrays.total(F.transform("_d", lambda x: x.cast("double"))).alias("total"), F.when(F.col("_d").isNotNull(), F.size("_d").cast("long")).alias("n"))


def patch_burstiness(rows: DataFrame) -> DataFrame:
    return rows.withColumn("burstiness", F.when(F.col("sentence_count") >= 2, F.col("burstiness")))


#: All feature columns in their fixed order.
FEATURES = (
    "ttr", "hapax_ratio", "mean_word_len", "word_len_std", "yule_k", "entropy_1gram", "entropy_2gram", "entropy_3gram", "kl_div_word_freq", "perplexity", "perplexity_ratio", "burstiness",
    "mean_token_rank", "frac_rank_top1", "frac_rank_top5", "frac_rank_top10", "rank_entropy", "sent_len_mean", "sent_len_var", "mean_dep_depth", "dep_depth_std",
    *(f"pos_{t.lower()}" for t in annotate.SHOWN_TAGS),
    "syntactic_depth_shift", "conjunction_density", "conjunction_deviation", "function_word_ratio", "lexical_coherence", "ai_cliche_density", "human_informality_density",
    "punct_irregularity_rate", "double_space_rate", "post_punct_case_irregularity_rate", "atesman", "bezirci_yilmaz",
)


def row_features(docs: DataFrame) -> DataFrame:
    """Features that a document has by itself: one pass, no shuffle.  Sentences,
    tokens and tags as ``annotate.annotated`` makes them; what is counted of
    tokens is counted for a run of documents at once."""
    text = cleaning.without_noise(F.col("text"))
    staged = docs.withColumn("raw", F.col("text")).withColumn("text", text).withColumn("sentences", arrays.sentences(F.col("text")))
    staged = staged.withColumns({"parts": F.transform("sentences", arrays.tokens), "sizes": F.transform("sentences", arrays.word_count)})
    staged = staged.withColumn("tokens", F.flatten("parts")).withColumn("tags", F.transform("tokens", annotate.upos))
    sizes = F.col("sizes")
    own = staged.withColumns(
        {
            "token_count": F.size("tokens").cast("long"),
            "sentence_count": F.size("sentences").cast("long"),
            "burstiness": stylometry.burstiness(sizes),
            "sent_len_mean": arrays.mean(sizes),
            "sent_len_var": arrays.sample_variance(sizes),
            "lexical_coherence": stylometry.lexical_coherence(F.col("sentences")),
            "punct_irregularity_rate": stylometry.punct_irregularity_rate(F.col("raw")),
            "double_space_rate": stylometry.double_space_rate(F.col("raw")),
            "post_punct_case_irregularity_rate": stylometry.post_punct_case_irregularity_rate(F.col("raw")),
            "atesman": stylometry.atesman(arrays.words(F.col("text")), F.size("sentences")),
        }
    ).drop("text", "raw", "sentences", "sizes")
    counted = own.withColumn("m", measures.measured(F.col("parts"), F.col("tags"))).drop("parts", "tags")
    none = dict.fromkeys(("entropy_2gram", "entropy_3gram"), 0.0)  # as of texts without n-grams
    return counted.select("*", "m.*").drop("m").withColumn("bezirci_yilmaz", F.col("atesman")).na.fill(none)


def all_features(samples: DataFrame, enabled: tuple[str, ...] = FEATURES) -> DataFrame:
    """doc_id, sample_id, label and the enabled features, in their order.  The
    references are taken from the samples themselves."""
    from quillmark.operators.references import References

    rows = context.cut(parsed(samples, "doc_id", "sample_id", "label"), "rows")  # texts are parsed once, whatever reads the rows
    folder = scratch(samples.sparkSession, "references")
    References.save(rows, folder)
    return References(samples.sparkSession, folder).added(rows).select("doc_id", "sample_id", "label", *enabled)


def parsed(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep``, what references are taken from, and the features
    that a document has by itself."""
    computed = row_features(docs)
    return computed.select(*keep, "tokens", "counts", "depths", "token_count", "sentence_count", *(c for c in FEATURES if c in computed.columns))
