"""Ranked lexical search as a threshold-seeded join of items with documents.

The documents are the shards of a positional index (``build_index``), built
once however many items are looked for.  Scores are sums over an item's terms
of ``w * x``: ``w`` falls with the documents that hold the term, ``x`` rises
with its occurrences and falls with the document's length.

1. *Stored impacts*: one pass over the index gives, for each term of the items,
   the number of its documents and its ``k`` largest ``x``.  Each task keeps
   only its own k largest, which are then merged.
2. *Thresholds*: ``k`` documents have at least a term's kth impact from that
   term alone, so the largest kth impact of an item's terms is a lower bound of
   the item's kth score.
3. *Pruned terms*: an item's terms are ordered by their largest impact.  The
   last ones whose largest impacts together stay below the threshold can't
   bring a document into the result by themselves.  Only the lists of the other
   terms are joined with the items; a candidate goes on if its sum and the
   pruned terms' bound reach the threshold.
4. *Exact scores*: for these candidates the pruned terms are looked up and the
   score is complete.  Each task keeps the k best of each item, and a last
   ranking merges those.

No bound drops a document that could be in the result: the bounds hold for every
document, and equal scores are kept until the final ranking.

Items are handled in blocks of ``BLOCK_BYTES`` of text: their terms go to all
tasks.  A task holds one shard (about 1 MB of text), and k numbers for each term
or item of the block.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm import wordstream
from quillmark.llm.common import discard, materialize, tidy
from quillmark.llm.decontamination import Shard, build_index, unpack

#: Text of the items that are looked for at once.
BLOCK_BYTES = 1 << 20
_SCALE = 1_000_000_000


class Corpus:
    """N documents with a term, L terms in all; scores as integers."""

    def __init__(self, documents: int, terms: int) -> None:
        self.documents, self.terms = documents, terms

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """m of documents of ``n`` terms: 50, and 50 times the length over the
        mean one."""
        return np.array([50 + 50 * size * self.documents // max(self.terms, 1) for size in n.tolist()], np.int64)

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))

    @staticmethod
    def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        return _SCALE * tf // (1000 * tf + 20 * m)


class Terms:
    """Terms of a block of items and the items of each: sorted hashes, and
    (item, term) pairs by item."""

    def __init__(self, texts: list[str], owners: np.ndarray) -> None:
        """``owners``: the number of each text's item."""
        hashes, items = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for start, end, data, offsets in wordstream.text_slices(pa.array(texts, pa.string())):
            words, first = wordstream.words(data, offsets, wordstream.ALNUM_WORDS)
            hashes.append(words)
            items.append(np.repeat(owners[start:end], np.diff(first)))
        self.hashes, number = np.unique(np.concatenate(hashes), return_inverse=True)
        pairs = np.unique(np.concatenate(items) * (len(self.hashes) + 1) + number)  # each term once
        self.item, self.term = np.divmod(pairs, len(self.hashes) + 1)


def _postings(shard: Shard, corpus: Corpus, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the term, document of the shard, x) of the terms the shard has."""
    local = shard.local(terms)
    own = np.flatnonzero(local >= 0)
    which, at = shard.candidates(local[own])
    keys, tf = np.unique(own[which] << 32 | shard.document(at), return_counts=True)
    doc = keys & 0xFFFFFFFF
    return keys >> 32, doc, corpus.saturation(tf, corpus.lengths(np.diff(shard.first))[doc])


def _best(group: np.ndarray, k: int, *order: np.ndarray) -> np.ndarray:
    """Rows that are among the first ``k`` of their group in the given order."""
    by = np.lexsort((*order[::-1], group))
    sorted_groups = group[by]
    fresh = np.ones(len(by), bool)
    fresh[1:] = sorted_groups[1:] != sorted_groups[:-1]
    heads = np.flatnonzero(fresh)
    place = np.arange(len(by)) - np.repeat(heads, np.diff(np.append(heads, len(by))))
    return by[place < k]


def _shards(batches: Iterable[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Shard({name: batch.column(name)[i].as_py() for name in batch.schema.names})


def _size(index: DataFrame) -> Corpus:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = terms = 0
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                sizes = np.diff(unpack(packed))
                documents += int((sizes > 0).sum())
                terms += int(sizes.sum())
        yield pa.RecordBatch.from_pydict({"documents": [documents], "terms": [terms]})

    row = index.select("doc_first").mapInArrow(tidy(run), "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    return Corpus(row[0] or 0, row[1] or 0)


def stored_impacts(index: DataFrame, corpus: Corpus, terms: np.ndarray, k: int) -> DataFrame:
    """(term, df, kth, top): for the number of each term, its documents, its
    kth largest x (0 if it has fewer) and its largest."""
    shared = index.sparkSession.sparkContext.broadcast(terms)  # bounded by the block

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(shared.value), np.int64)
        term, x = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for shard in _shards(batches):
            more, _, found = _postings(shard, corpus, shared.value)
            df += np.bincount(more, minlength=len(df))
            term, x = np.concatenate([term, more]), np.concatenate([x, found])
            kept = _best(term, k, -x)
            term, x = term[kept], x[kept]
        place = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
        n = np.zeros(len(term), np.int64)
        n[place] = df[term[place]]  # counted with the term's first row
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(x), pa.array(n)], names=["term", "x", "n"])

    rows = index.mapInArrow(tidy(run), "term long, x long, n long")
    counts = rows.groupBy("term").agg(F.sum("n").alias("df"), F.max("x").alias("top"))
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("x")))
    kth = rows.select("term", "x", place.alias("place")).filter(F.col("place") <= k).filter(F.col("place") == k).select("term", F.col("x").alias("kth"))
    return materialize(counts.join(kth, "term", "left").na.fill(0, ["kth"]), "impacts")


class Plan:
    """What the tasks need of a block: for each item its threshold, the bound
    of its pruned terms, and its terms with their weights in two lists."""

    def __init__(self, terms: Terms, corpus: Corpus, impacts: list[tuple[int, int, int, int]], items: int) -> None:
        weight, kth, top = (np.zeros(len(terms.hashes), np.int64) for _ in range(3))
        for term, df, kth_x, top_x in impacts:
            w = corpus.weight(df)
            weight[term], kth[term], top[term] = w, w * kth_x, w * top_x
        used = weight[terms.term] > 0  # terms that no document holds, or all, add nothing
        item, term = terms.item[used], terms.term[used]
        self.hashes, self.weight = terms.hashes, weight
        self.least = np.ones(items, np.int64)  # scores are above 0
        np.maximum.at(self.least, item, kth[term])
        by = np.lexsort((top[term], item))  # smallest first: suffixes of the falling order
        item, term = item[by], term[by]
        sums = np.cumsum(top[term])
        fresh = np.ones(len(item), bool)
        fresh[1:] = item[1:] != item[:-1]
        heads = np.flatnonzero(fresh)
        before = np.concatenate([[0], sums])[heads]
        inner = sums - np.repeat(before, np.diff(np.append(heads, len(item))))
        pruned = inner < self.least[item]
        self.bound = np.zeros(items, np.int64)
        np.maximum.at(self.bound, item[pruned], inner[pruned])
        seeds = ~pruned
        order = np.argsort(term[seeds], kind="stable")
        self.seed_term, self.seed_item = term[seeds][order], item[seeds][order]
        self.rest_item, self.rest_term = item[pruned], term[pruned]  # by item


def _expanded(keys: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of keys, row of sorted_keys) of all equal pairs."""
    low, high = np.searchsorted(sorted_keys, keys), np.searchsorted(sorted_keys, keys, "right")
    sizes = high - low
    rows = np.repeat(np.arange(len(keys)), sizes)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[rows]


def scored(shard: Shard, corpus: Corpus, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, document of the shard, score) of all documents of the shard whose
    score reaches their item's threshold."""
    term, doc, x = _postings(shard, corpus, plan.hashes)
    impact = plan.weight[term] * x
    row, seed = _expanded(term, plan.seed_term)
    keys, at = np.unique(plan.seed_item[seed] << 32 | doc[row], return_inverse=True)
    score = np.zeros(len(keys), np.int64)
    np.add.at(score, at, impact[row])
    kept = score + plan.bound[keys >> 32] >= plan.least[keys >> 32]
    keys, score = keys[kept], score[kept]
    # the pruned terms of what is left
    row, rest = _expanded(keys >> 32, plan.rest_item)
    wanted = plan.rest_term[rest] << 32 | keys[row] & 0xFFFFFFFF
    held = term << 32 | doc  # sorted
    at = np.minimum(np.searchsorted(held, wanted), max(len(held) - 1, 0))
    hit = held[at] == wanted if len(held) else np.zeros(0, bool)
    np.add.at(score, row[hit], impact[at[hit]])
    kept = score >= plan.least[keys >> 32]
    keys, score = keys[kept], score[kept]
    return keys >> 32, keys & 0xFFFFFFFF, score


def _ranked(index: DataFrame, corpus: Corpus, plan: Plan, k: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of each item in each task."""
    shared = index.sparkSession.sparkContext.broadcast(plan)  # bounded by the block

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, score, doc, null = (np.zeros(0, np.int64) for _ in range(4))
        for shard in _shards(batches):
            more, at, found = scored(shard, corpus, shared.value)
            item, score = np.concatenate([item, more]), np.concatenate([score, found])
            doc, null = np.concatenate([doc, shard.ids[at]]), np.concatenate([null, shard.nulls[at].astype(np.int64)])
            kept = _best(item, k, -score, null, doc)
            item, score, doc, null = item[kept], score[kept], doc[kept], null[kept]
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, mask=null > 0), pa.array(score)], names=["item", "doc_id", "score"])

    return index.mapInArrow(tidy(run), "item long, doc_id long, score long")


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """(item, text) rows in hash blocks of about ``block_bytes``, all texts of an
    item in one."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for block in range(n):
        yield [(r.item_id, r.text) for r in items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == block).toLocalIterator()]


def search(docs: DataFrame, items: DataFrame, k: int = 50, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of ``docs`` (doc_id,
    text) of highest score above 0 for each item of ``items`` (item_id, text),
    equal scores by ascending doc_id.

    Terms are runs of ASCII letters and digits (A-Z lower-cased) and of all
    other characters beyond ASCII; an item's terms count once each.  Null and
    empty texts have no terms: such documents are in no result and in no count,
    such items have no rows.  Rows without item_id are ignored; rows of one
    item_id are one item with the terms of all; repeated documents and ids are
    rows like any other; documents without id stand last among equal scores.
    Texts may be of any length; other columns are ignored; an empty table on
    either side gives none.
    """
    spark: SparkSession = docs.sparkSession
    kind = items.schema["item_id"].dataType
    wanted = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    index = build_index(docs)
    corpus = _size(index)
    found = spark.createDataFrame([], "item_id string, doc_id long, score long")
    for block in _blocks(wanted, block_bytes):
        names = sorted({name for name, _ in block})
        number = {name: i for i, name in enumerate(names)}
        terms = Terms([text for _, text in block], np.array([number[name] for name, _ in block], np.int64))
        if not len(terms.hashes):
            continue
        impacts = stored_impacts(index, corpus, terms.hashes, k)
        plan = Plan(terms, corpus, [tuple(r) for r in impacts.select("term", "df", "kth", "top").toLocalIterator()], len(names))
        discard(impacts)
        best = materialize(_ranked(index, corpus, plan, k), "ranked")
        label = spark.createDataFrame([(i, name) for name, i in number.items()], "item long, item_id string")
        found = found.unionByName(best.join(F.broadcast(label), "item").select("item_id", "doc_id", "score"))  # a row for each item of the block
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = found.select("item_id", place.alias("rank"), "doc_id", "score").filter(F.col("rank") <= k)
    return ranked.withColumn("item_id", F.col("item_id").cast(kind))
