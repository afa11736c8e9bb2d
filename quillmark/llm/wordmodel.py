"""Interpolated modified Kneser-Ney over word bigrams, in sharded tables.

Words are what stands between white space, in any case; a mark stands before
and after each text.  All counts are kept: the table of bigrams and that of
words grow with the trusted text, are dealt out by hash, and no task and not
the driver holds either as a whole.  Words that no trusted text has take the
mass that the discount of the words frees, spelled by the character model.

A text's log probability is a sum over its words and bigrams of one weight
each: log p(w) + log gamma(w) for a word, and for a bigram that was counted
log p(w|v) - log gamma(v) - log p(w).  So texts are scored by one count join
for each order, in which tasks send what their texts hold as packed postings
and get sums by text back; the texts themselves are not sent.

Three things of a fixed greatest size spare most of what would be sent: the
HEAD most frequent n-grams of either order go to every task, and a bit filter
of the others tells what was surely never counted.

Every sum comes twice: as it is, and with what only the text itself can have
added (as many counts as the text has) taken as unseen, which is what a
trusted text is worth to a model that was not trained on it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import wordstream
from quillmark.llm.common import discard, free_shuffles, materialize, tidy, tidy_cogroup, tidy_group

#: Bits kept of hashes; bytes of text packed together and to a shard.
HASH_BITS = 48
CHUNK_BYTES = 2 << 20
#: Bigrams of a table's row (all of one first word stand in one row).
ROW_BIGRAMS = 200_000
SHARD_BYTES = 20 << 20
#: Most n-grams of an order that go to every task (16 bytes each), and most
#: bits of the filter of the others (16 MB).
HEAD = 1 << 20
FILTER_BITS = 27
#: Parts of the texts, one after the other, that ask for n-grams of an order:
#: what bigrams send is most of the disk that scoring takes.
PARTS = {1: 1, 2: 2}

_EDGE = np.uint64(1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(64 - HASH_BITS)
_PAIRS = pa.schema([("shard", pa.int32()), ("v", pa.binary()), ("w", pa.binary()), ("n", pa.binary())])
_PAIRS_SQL = "shard int, v binary, w binary, n binary"
_MODEL = pa.schema([("shard", pa.int32()), ("gram", pa.binary()), ("weight", pa.binary()), ("n", pa.binary())])
_MODEL_SQL = "shard int, gram binary, weight binary, n binary"
_ASKED = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("words", pa.binary()), ("gram", pa.binary()), ("size", pa.binary()), ("doc", pa.binary()), ("n", pa.binary()), ("spelled", pa.binary()), ("loss", pa.binary()), ("unseen", pa.binary())])
_ASKED_SQL = "shard int, chunk long, keys binary, words binary, gram binary, size binary, doc binary, n binary, spelled binary, loss binary, unseen binary"
_SUMS = pa.schema([("chunk", pa.int64()), ("keys", pa.binary()), ("words", pa.binary()), ("loss", pa.binary()), ("unseen", pa.binary())])
_SUMS_SQL = "chunk long, keys binary, words binary, loss binary, unseen binary"


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight together, so that leading zeros compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T).tobytes()


def _values(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _steps(sorted_values: np.ndarray) -> bytes:
    return _planes(np.diff(sorted_values, prepend=np.uint64(0)))


def _summed(data: bytes) -> np.ndarray:
    return np.cumsum(_values(data, "<u8"), dtype=np.uint64)


def _shards_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each hash; ascending hashes have ascending shards."""
    return ((hashes >> np.uint64(HASH_BITS - 32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _bigram(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return wordstream.mix(v * _MIX + w) >> _SHIFT


def _word_bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the byte after it, in the order of ``words``."""
    flags = np.concatenate([wordstream.SPACE_WORDS[data], [False]])
    heads, tails = flags[:-1].copy(), flags[:-1] & ~flags[1:]
    heads[1:] &= ~flags[:-2]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    heads[inner] = flags[inner]
    tails[inner - 1] = flags[inner - 1]
    return np.flatnonzero(heads), np.flatnonzero(tails) + 1


def _marked(grams: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of an n-gram in a filter, in one block of 512: ascending
    n-grams have ascending blocks."""
    place = grams >> np.uint64(HASH_BITS - bits)
    return place, (place & ~np.uint64(511)) | (grams & np.uint64(511))


class Known:
    """The most frequent n-grams of an order, sorted, and the filter of all."""

    def __init__(self, gram: np.ndarray, weight: np.ndarray, n: np.ndarray, marks: np.ndarray, bits: int) -> None:
        self.gram, self.weight, self.n, self.marks, self.bits = gram, weight, n, marks, bits

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the head, and whether it is there."""
        if not len(self.gram):
            return np.zeros(len(grams), np.int64), np.zeros(len(grams), bool)
        at = np.minimum(np.searchsorted(self.gram, grams), len(self.gram) - 1)
        return at, self.gram[at] == grams

    def maybe(self, grams: np.ndarray) -> np.ndarray:
        """False only for n-grams that no trusted text has."""
        there = np.ones(len(grams), bool)
        for place in _marked(grams, self.bits):
            there &= self.marks[place >> np.uint64(3)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0
        return there


class _Chunk:
    """Words of many texts, one edge mark (hash 1) before each text's."""

    def __init__(self) -> None:
        self.bytes, self.texts = 0, 0
        self.v, self.w, self.doc, self.lengths, self.keys, self.spelled = [], [], [], [], [], []

    def add(self, keys: np.ndarray, data: np.ndarray, offsets: np.ndarray, spell: Callable | None, known: Known | None) -> None:
        words, first = wordstream.words(data, offsets, wordstream.SPACE_WORDS)
        words >>= _SHIFT
        lengths = np.diff(first)
        seq = np.insert(words, first[:-1], _EDGE) if len(lengths) else words
        after = np.append(seq[1:], _EDGE) if len(seq) else seq  # the mark before a text ends the one before it
        doc = np.repeat(np.arange(self.texts, self.texts + len(lengths), dtype=np.uint32), lengths + 1)
        if spell is not None:
            logs = np.zeros(len(seq), np.float32)
            if len(words):
                unlike, at, back, count = np.unique(words, return_index=True, return_inverse=True, return_counts=True)
                place, there = known.find(unlike)
                there[there] = known.n[place[there]] > count[there]  # never worth less than counted: needs no spelling
                wanted = np.flatnonzero(~there)
                start, end = _word_bytes(data, offsets)
                size = (end - start)[at[wanted]]
                inner = np.concatenate([[0], np.cumsum(size)])
                letters = data[np.arange(inner[-1]) + np.repeat(start[at[wanted]] - inner[:-1], size)]
                each = np.zeros(len(unlike), np.float32)
                if len(letters):
                    each[wanted] = spell(letters, inner)
                logs[~np.insert(np.zeros(len(words), bool), first[:-1], True)] = each[back]
            self.spelled.append(logs)
        self.v.append(seq)
        self.w.append(after)
        self.doc.append(doc)
        self.lengths.append(lengths + 1)
        self.keys.append(keys)
        self.texts += len(lengths)
        self.bytes += len(data)


def _chunks(batches: Iterable[pa.RecordBatch], spell: Callable | None = None, known: Known | None = None) -> Iterator[_Chunk]:
    """Chunks of (key, text) batches."""
    chunk = _Chunk()
    for batch in batches:
        keys = batch.column(0).to_numpy()
        for low, high, data, offsets in wordstream.text_slices(batch.column(1)):
            chunk.add(keys[low:high], data, offsets, spell, known)
            if chunk.bytes >= CHUNK_BYTES:
                yield chunk
                chunk = _Chunk()
    if chunk.texts:
        yield chunk


def shard_count(texts: DataFrame) -> int:
    return max(6, math.ceil((texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / SHARD_BYTES))


def _pairs(texts: DataFrame, shards: int, pick: Callable | None) -> DataFrame:
    """Counted bigrams of a table (key, text), of the batches that ``pick``
    leaves: one row for each shard of first words, sorted by both words."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches if pick is None else pick(batches)):
            v, w, n = _distinct(np.concatenate(chunk.v), np.concatenate(chunk.w), None)
            cuts = np.searchsorted(_shards_of(v, shards), np.arange(shards + 1))
            rows = [{"shard": s, "v": _steps(v[a:b]), "w": _planes(w[a:b]), "n": _planes(n[a:b].astype("<u4"))} for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            yield pa.RecordBatch.from_pylist(rows, schema=_PAIRS)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        parts = [(_summed(r["v"]), _values(r["w"], "<u8"), _values(r["n"], "<u4").astype(np.int64)) for batch in table.to_batches() for r in _rows(batch)]
        v, w, n = _distinct(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        heads = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        cuts = np.unique(heads[np.searchsorted(heads, np.arange(0, len(v), ROW_BIGRAMS), "right") - 1])
        rows = [{"shard": key[0].as_py(), "v": _steps(v[a:b]), "w": _planes(w[a:b]), "n": _planes(n[a:b].astype("<i8"))} for a, b in zip(cuts, np.append(cuts[1:], len(v)), strict=True)]
        return pa.Table.from_pylist(rows, schema=_PAIRS)

    return texts.mapInArrow(tidy(count), _PAIRS_SQL).groupBy("shard").applyInArrow(tidy_group(merge), _PAIRS_SQL)


def _distinct(v: np.ndarray, w: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((w, v))
    v, w = v[order], w[order]
    at = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])])) if len(v) else np.zeros(0, np.int64)
    n = np.diff(np.append(at, len(v))) if n is None else np.add.reduceat(n[order], at) if len(at) else np.zeros(0, np.int64)
    return v[at], w[at], n


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """One row at a time: packed rows are large."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _read_pairs(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _summed(row["v"]), _values(row["w"], "<u8"), _values(row["n"], "<i8")


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """D1, D2 and D3+ of modified Kneser-Ney (Chen and Goodman, 1998)."""
    if not n1 or not n2:
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0]
    return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(found)]


class Model:
    """By order: packed rows of all n-grams (``_MODEL``), and what goes to
    every task (a broadcast ``Known``)."""

    def __init__(self, shards: int, unseen: float) -> None:
        self.tables: dict[int, DataFrame] = {}
        self.known: dict[int, object] = {}
        self.shards, self.unseen = shards, unseen


def _read_model(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _summed(row["gram"]), _values(row["weight"], "<f4"), _values(row["n"], "<u4")


_STEPS = 8


def _level(n: np.ndarray) -> np.ndarray:
    return (np.log2(np.maximum(n, 1)) * _STEPS).astype(np.int64)


def _known(table: DataFrame, head: int) -> Known:
    """The n-grams of the highest counts, as many whole levels of counts as
    fit into ``head``; and the filter of all."""

    def levels(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(32 * _STEPS + 1, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                found += np.bincount(_level(_values(data, "<u4")), minlength=len(found))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found))), pa.array(found)], ["level", "k"])

    counts = np.zeros(32 * _STEPS + 1, np.int64)
    for row in table.select("n").mapInArrow(tidy(levels), "level long, k long").groupBy("level").agg(F.sum("k").alias("k")).collect():
        counts[row.level] = row.k
    fits = np.flatnonzero(np.cumsum(counts[::-1])[::-1] <= head)
    least = int(fits[0]) if len(fits) else len(counts)
    bits = min(FILTER_BITS, max(16, math.ceil(math.log2(8 * max(1, int(counts.sum()))))))

    def top(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                gram, weight, n = _read_model(row)
                there = _level(n) >= least
                yield pa.RecordBatch.from_arrays([pa.array([x[there].tobytes()], pa.binary()) for x in (gram, weight, n)], ["gram", "weight", "n"])

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                found = np.unique(np.concatenate(_marked(_summed(row["gram"]), bits)))
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]], pa.int32()), pa.array([_steps(found)], pa.binary())], ["shard", "places"])

    def marks(key: tuple, table: pa.Table) -> pa.Table:
        found = np.concatenate([_summed(data) for data in table.column("places").to_pylist()]).astype(np.int64)
        first = int(found.min()) // 8 * 8
        flags = np.zeros(int(found.max()) - first + 1, bool)
        flags[found - first] = True
        return pa.table({"first": pa.array([first // 8], pa.int64()), "marks": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    parts: tuple[list, list, list] = ([], [], [])
    for row in table.select("gram", "weight", "n").mapInArrow(tidy(top), "gram binary, weight binary, n binary").toLocalIterator():
        for held, data, kind in zip(parts, row, ("<u8", "<f4", "<u4"), strict=True):
            held.append(np.frombuffer(data, kind))
    gram, weight, n = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in zip(parts, ("<u8", "<f4", "<u4"), strict=True))
    by = np.argsort(gram)
    whole = np.zeros((1 << bits) // 8, np.uint8)
    for row in table.select("shard", "gram").mapInArrow(tidy(places), "shard int, places binary").groupBy("shard").applyInArrow(tidy_group(marks), "first long, marks binary").toLocalIterator():
        whole[row.first : row.first + len(row.marks)] |= np.frombuffer(row.marks, np.uint8)
    return Known(gram[by], weight[by], n[by], whole, bits)


def train(texts: DataFrame, shards: int, pick: Callable | None = None, head: int = HEAD) -> Model:
    """Model of a table (key, text), in tables of ``shards`` shards.  ``pick``,
    if given, leaves of the batches of texts what is to be counted."""
    spark = texts.sparkSession
    pairs = materialize(_pairs(texts, shards, pick), "pairs")
    free_shuffles(spark)

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in np.bincount(np.minimum(_read_pairs(row)[2], 5), minlength=6)[1:5]], ["n1", "n2", "n3", "n4"])

    d = np.array(discounts(*(x or 0 for x in pairs.mapInArrow(tidy(tally), "n1 long, n2 long, n3 long, n4 long").agg(*(F.sum(f"n{i}") for i in range(1, 5))).first())))

    def contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(word, c, n, gamma): pieces of a word's counts after others, and
        what it holds back before others."""
        for batch in batches:
            for row in _rows(batch):
                v, w, n = _read_pairs(row)
                if len(v):
                    at = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
                    gamma = np.add.reduceat(d[np.minimum(n, 3) - 1], at) / np.add.reduceat(n, at)
                    order = np.argsort(w, kind="stable")
                    word = w[order]
                    cuts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                    zeros, some = np.zeros(len(at), np.int64), len(cuts)
                    columns = [np.concatenate([v[at], word[cuts]]).astype(np.int64), np.concatenate([zeros, np.diff(np.append(cuts, len(w)))]), np.concatenate([zeros, np.add.reduceat(n[order], cuts)]), np.concatenate([gamma, np.zeros(some)])]
                    for low in range(0, len(columns[0]), 50_000):
                        yield pa.RecordBatch.from_arrays([pa.array(x[low : low + 50_000]) for x in columns], ["word", "c", "n", "gamma"])

    counted = materialize(pairs.mapInArrow(tidy(contexts), "word long, c long, n long, gamma double").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"), F.sum("gamma").alias("gamma")), "words")
    free_shuffles(spark)
    total = counted.agg(F.sum("c").alias("total"), *(F.count_if(F.col("c") == i).alias(f"n{i}") for i in range(1, 5))).first()
    d1, d2, d3 = discounts(total.n1, total.n2, total.n3, total.n4)
    less = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
    held = counted.agg(F.sum(less)).first()[0] or 0.0
    words = counted.select("word", "n", "gamma", ((F.col("c") - less) / F.lit(total.total or 1)).alias("p"))

    def ratios(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each bigram: the hash, the second word, the count, and the counted
        share over what is held back."""
        v, w, n = _read_pairs(row)
        at = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
        less = d[np.minimum(n, 3) - 1]
        r = (n - less) / np.repeat(np.add.reduceat(less, at), np.diff(np.append(at, len(v)))) if len(v) else less
        return _bigram(v, w), w, n, r

    def common(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Finished bigrams whose second word is in the head."""
        probable = shared.value
        for batch in batches:
            for row in _rows(batch):
                gram, w, n, r = ratios(row)
                at, there = probable.find(w)
                if there.any():
                    gram, n, weight = gram[there], n[there], np.log1p(r[there] / probable.weight[at[there]])
                    yield pack(gram, weight.astype("<f4"), np.minimum(n, (1 << 32) - 1).astype("<u4"))

    def others(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(gram, word, n, r) of the other bigrams."""
        probable = shared.value
        for batch in batches:
            for row in _rows(batch):
                gram, w, n, r = ratios(row)
                left = ~probable.find(w)[1]
                columns = [gram[left].astype(np.int64), w[left].astype(np.int64), n[left], r[left]]
                for low in range(0, len(columns[0]), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[low : low + 50_000]) for x in columns], ["gram", "word", "n", "r"])

    def pack(gram: np.ndarray, weight: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(gram)
        gram, weight, n = gram[order], weight[order], n[order]
        cuts = np.searchsorted(_shards_of(gram, shards), np.arange(shards + 1))
        return pa.RecordBatch.from_pylist([{"shard": s, "gram": _steps(gram[a:b]), "weight": _planes(weight[a:b]), "n": _planes(n[a:b])} for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a], schema=_MODEL)

    def whole(key: tuple, table: pa.Table) -> pa.Table:
        """A shard's rows as few: the closer n-grams stand, the fewer bytes."""
        gram, weight, n = (np.concatenate(x) for x in zip(*(_read_model(r) for batch in table.to_batches() for r in _rows(batch)), strict=True))
        order = np.argsort(gram)
        parts = np.array_split(order, -(-len(order) // ROW_BIGRAMS))
        return pa.Table.from_pylist([{"shard": key[0].as_py(), "gram": _steps(gram[i]), "weight": _planes(weight[i]), "n": _planes(n[i])} for i in parts], schema=_MODEL)

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            held.append((batch.column(0).to_numpy().astype(np.uint64), batch.column(1).to_numpy().astype("<f4"), np.minimum(batch.column(2).to_numpy(), (1 << 32) - 1).astype("<u4")))
            if sum(len(x[0]) for x in held) >= 1_000_000:
                yield pack(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
        if held:
            yield pack(*(np.concatenate(x) for x in zip(*held, strict=True)))

    model = Model(shards, math.log(held / total.total) if total.total and held else 0.0)
    model.tables[1] = materialize(words.select(F.col("word").alias("gram"), (F.log("p") + F.log("gamma")).alias("weight"), "n").mapInArrow(tidy(packed), _MODEL_SQL), "model1")
    probable = materialize(words.select(F.col("word").alias("gram"), F.col("p").alias("weight"), "n").mapInArrow(tidy(packed), _MODEL_SQL), "words1")
    shared = spark.sparkContext.broadcast(_known(probable, head))
    free_shuffles(spark)
    joined = pairs.mapInArrow(tidy(others), "gram long, word long, n long, r double").join(words.select("word", "p"), "word").select("gram", F.log1p(F.col("r") / F.col("p")).alias("weight"), "n").mapInArrow(tidy(packed), _MODEL_SQL)
    model.tables[2] = materialize(pairs.mapInArrow(tidy(common), _MODEL_SQL).unionByName(joined).groupBy("shard").applyInArrow(tidy_group(whole), _MODEL_SQL), "model2")
    shared.destroy()  # with the driver's file, which unpersist leaves
    for table in (pairs, probable, counted):
        discard(table)
    del joined, words
    free_shuffles(spark)
    for order, table in model.tables.items():
        model.known[order] = spark.sparkContext.broadcast(_known(table, head))
    return model


def _asked(texts: DataFrame, model: Model, order: int, spell_of: Callable) -> DataFrame:
    """What the texts hold and the head doesn't, as postings by n-gram, and a
    row for each chunk with the sums over what needs no asking: rows of
    ``_ASKED``."""
    shards, unseen, shared = model.shards, model.unseen, model.known[order]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        task = TaskContext.get().partitionId() << 32
        for number, chunk in enumerate(_chunks(batches, spell_of() if order == 1 else None, known)):
            first, doc = np.concatenate(chunk.v), np.concatenate(chunk.doc)
            gram = first if order == 1 else _bigram(first, np.concatenate(chunk.w))
            by = np.argsort(gram, kind="stable")
            gram, doc = gram[by], doc[by]
            at = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])]))
            n = np.diff(np.append(at, len(gram))).astype("<u4")
            spelled = np.concatenate(chunk.spelled)[by][at] if order == 1 else np.zeros(len(at), np.float32)
            gram, doc = gram[at], doc[at]
            heads = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            size = np.diff(np.append(heads, len(gram)))
            unlike = gram[heads]
            place, there = known.find(unlike)
            ask = ~there
            ask[ask] = known.maybe(unlike[ask])
            else_ = unseen + spelled.astype(np.float64) if order == 1 else np.zeros(len(gram))
            value = np.where(np.repeat(there, size), np.repeat(known.weight[place].astype(np.float64) if len(known.weight) else np.zeros(len(place)), size), else_)
            other = np.where(np.repeat(np.where(there, known.n[place] if len(known.n) else 0, 0), size) > n, value, else_)
            asked = np.repeat(ask, size)
            value[asked] = other[asked] = 0.0
            loss, alone = (-np.bincount(doc, x * n, chunk.texts) for x in (value, other))
            rows = [{"shard": (task >> 32) % shards, "chunk": task | number, "keys": np.concatenate(chunk.keys).tobytes(), "words": np.concatenate(chunk.lengths).astype("<i8").tobytes(), "loss": loss.astype("<f8").tobytes(), "unseen": alone.astype("<f8").tobytes()}]
            gram, size, doc, n, spelled = unlike[ask], size[ask].astype("<u4"), doc[asked].astype("<u4"), n[asked], spelled[heads][ask]
            ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
            cuts = np.searchsorted(_shards_of(gram, shards), np.arange(shards + 1))
            for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if b > a:
                    part = slice(ends[a], ends[b])
                    rows.append({"shard": s, "chunk": task | number, "words": np.int64(chunk.texts).tobytes(), "gram": _steps(gram[a:b]), "size": _planes(size[a:b]), "doc": _planes(doc[part]), "n": _planes(n[part]), "spelled": _planes(spelled[a:b].astype("<f4")) if order == 1 else None})
            for row in rows:
                yield pa.RecordBatch.from_pylist([row], schema=_ASKED)

    return texts.mapInArrow(tidy(run), _ASKED_SQL)


def _sums(texts: DataFrame, model: Model, order: int, spell_of: Callable) -> DataFrame:
    """(key, words, loss, unseen): minus the summed weights of one order."""
    unseen = model.unseen

    def look_up(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [_read_model(r) for r in left.to_pylist()]
        known, weight, count = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, "<f4"), np.zeros(0, "<u4"))
        by = np.argsort(known, kind="stable")
        known, weight, count = known[by], weight[by].astype(np.float64), count[by]
        out = []
        for r in right.to_pylist():
            if r["keys"] is not None:
                out.append({c: r[c] for c in ("chunk", "keys", "words", "loss", "unseen")})
                continue
            gram, size = _summed(r["gram"]), _values(r["size"], "<u4")
            doc, n = _values(r["doc"], "<u4"), _values(r["n"], "<u4")
            at = np.searchsorted(known, gram)
            hit = at < len(known)
            hit[hit] = known[at[hit]] == gram[hit]
            else_ = unseen + _values(r["spelled"], "<f4").astype(np.float64) if order == 1 else np.zeros(len(gram))
            value, seen = else_.copy(), np.zeros(len(gram), np.int64)
            value[hit], seen[hit] = weight[at[hit]], count[at[hit]]
            value, other = np.repeat(value, size), np.where(np.repeat(seen, size) > n, np.repeat(value, size), np.repeat(else_, size))
            whose, at = np.unique(doc, return_inverse=True)  # only texts that asked: few, if there are many shards
            out.append({"chunk": r["chunk"], "words": _planes(np.diff(whose, prepend=np.uint32(0)).astype("<u4")), **{name: (-np.bincount(at, x * n)).astype("<f4").tobytes() for name, x in (("loss", value), ("unseen", other))}})
        return pa.Table.from_pylist(out, schema=_SUMS)

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["keys"] is None, r["loss"]))  # one order of addition, the texts' own row first
        for r in rows:
            if r["keys"] is not None:
                keys, words = np.frombuffer(r["keys"], "<i8"), np.frombuffer(r["words"], "<i8")
                loss, alone = (np.frombuffer(r[name], "<f8").copy() for name in ("loss", "unseen"))
            else:
                whose = np.cumsum(_values(r["words"], "<u4"))
                loss[whose] += np.frombuffer(r["loss"], "<f4")
                alone[whose] += np.frombuffer(r["unseen"], "<f4")
        return pa.table({"key": keys, "words": words, "loss": loss, "unseen": alone})

    asked = _asked(texts, model, order, spell_of)
    found = model.tables[order].groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(tidy_cogroup(look_up), _SUMS_SQL)
    return found.groupBy("chunk").applyInArrow(tidy_group(gather), "key long, words long, loss double, unseen double")


def losses(texts: DataFrame, model: Model, spell_of: Callable) -> DataFrame:
    """(key, words, loss, unseen) of each key of a table (key, text) in which
    equal keys have equal texts.  ``words`` counts the end of the text.
    ``spell_of()`` gives a function of bytes and offsets to log probabilities.
    The model's tables are used up."""
    spark = texts.sparkSession
    parts = []
    for order in model.tables:
        for part in range(PARTS[order]):
            some = texts.filter(F.pmod("key", F.lit(PARTS[order])) == part) if PARTS[order] > 1 else texts
            found = _sums(some, model, order, spell_of).groupBy("key").agg(F.max("words").alias("words"), F.max("loss").alias("loss"), F.max("unseen").alias("unseen"))
            parts.append(materialize(found, f"sums{order}"))
            del found
            free_shuffles(spark)
        discard(model.tables[order])
        model.known[order].destroy()
    both = reduce(DataFrame.unionByName, parts)
    return materialize(both.groupBy("key").agg(F.max("words").alias("words"), F.sum("loss").alias("loss"), F.sum("unseen").alias("unseen")), "losses")
