"""Language-model features from counted contexts: ranks of words after their
left neighbour, and masked pseudo-perplexity between both neighbours.

Models are count tables that stay distributed and are joined with what the
documents ask of them.  Whole documents are counted and scored, unless a caller
asks for the first ``most`` tokens only.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.sources.connectors import scratch

#: Tokens that the single features score, as their SQL has it.
MOST_TOKENS = 512
#: Weights of both neighbours together, and of the two single neighbours
#: together; the words by themselves have the rest.
BOTH, SINGLE = 0.4, 0.4
#: Added to the count of each word, and of one unseen word.
SMOOTHING = 1.0
#: A word (or context) with more than one in so many of all counts is hot.
HOT_SHARE = 1000


def cut(rows: DataFrame, name: str, **options: object) -> DataFrame:
    """``rows`` written (with ``options`` of the writer) and read again: what is read several times is computed
    once, and survives lost executors."""
    path = scratch(rows.sparkSession, name)
    rows.write.options(**options).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def looked_up(rows: DataFrame, known: DataFrame, key: list[str], weight: str = "c") -> DataFrame:
    """``rows`` with the columns of ``known``, null where it lacks the key.

    Rows of hot keys (at most HOT_SHARE of them, so they are broadcast) are
    dealt out to as many parts as a shuffle has, and only their rows of
    ``known`` are copied; all others are joined as they are."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    total = known.agg(F.sum(weight).alias("_total"))  # one row
    hot = known.crossJoin(F.broadcast(total)).filter(F.col(weight) * HOT_SHARE > F.col("_total")).select(*key, F.lit(True).alias("_hot"))
    every = F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))))
    right = known.join(F.broadcast(hot), key, "left").withColumn("_part", every).drop("_hot")
    left = rows.join(F.broadcast(hot), key, "left").withColumn("_part", F.when(F.col("_hot"), F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")).otherwise(0)).drop("_hot")
    return left.join(right, [*key, "_part"], "left").drop("_part")


# --- ranks after the left neighbour -------------------------------------------


def ranks(known: DataFrame) -> DataFrame:
    """(w, r): rank of each word by count, ties alike.  Ranks come from the
    histogram of counts, so no window sees the whole vocabulary."""
    by_count = known.groupBy("c").agg(F.count("*").alias("words"))
    above = by_count.select("c", (F.coalesce(F.sum("words").over(Window.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1).alias("r"))
    return known.join(above, "c").select("w", "r")


def successor_ranks(successors: DataFrame) -> DataFrame:
    """(l, w, r): places of the words seen after each word, by falling count,
    equal counts alike.  A window holds the different counts of one context."""
    counts = successors.groupBy("l", "c").agg(F.count("*").alias("words"))
    above = Window.partitionBy("l").orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.select("l", "c", (F.coalesce(F.sum("words").over(above), F.lit(0)) + 1).alias("r"))
    return successors.join(placed, ["l", "c"]).select("l", "w", "r")


def backed_off(asked: DataFrame, successors: DataFrame, known: DataFrame) -> DataFrame:
    """(l, w, r) of the pairs ``asked`` that no successor list has: such words
    stand behind the list, by their own counts, without those that it has.  Words
    that were never seen are last."""
    by_count = ranks(known)
    size = known.agg((F.count("*") + 1).alias("last"))
    words = looked_up(asked.withColumn("doc_id", F.hash("l")), known.join(by_count, "w"), ["w"]).drop("doc_id")
    words = cut(words.crossJoin(F.broadcast(size)).select("l", "w", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("r", "last").alias("own")), "behind")  # one row
    listed = looked_up(successors.select("l", "w").withColumn("doc_id", F.hash("l")), known, ["w"]).groupBy("l", "c").agg(F.count("*").alias("words"))
    lengths = successors.groupBy("l").agg(F.count("*").alias("length"))
    # of each list, the words that are more frequent than the one asked for
    marks = listed.unionByName(words.select("l", "c", F.lit(0).cast("long").alias("words"))).groupBy("l", "c").agg(F.sum("words").alias("words"))
    more = Window.partitionBy("l").orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, -1)
    before = marks.select("l", "c", F.coalesce(F.sum("words").over(more), F.lit(0)).alias("before"))
    found = words.join(before, ["l", "c"]).join(lengths, "l", "left")
    return found.select("l", "w", (F.coalesce("length", F.lit(0)) + F.col("own") - F.col("before")).alias("r"))


def context_ranks(docs: DataFrame, training: DataFrame, most: int | None = None) -> DataFrame:
    """(doc_id, mean_token_rank, frac_rank_top1/5/10, rank_entropy) of a
    document, or of its first ``most`` tokens: each token's place in the list of what follows its left
    neighbour in ``training`` (the rest of the vocabulary behind it), and the
    entropy of ten equal buckets of log2 rank.  Zeros for fewer than two tokens."""
    return placed_ranks(docs, cut(successor_counts(training), "successors"), cut(word_totals(training), "words"), most)


def _follows(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, left neighbour and word of each place that has a left one."""
    l, w, _ = _words(h, sizes)
    inner = np.ones(len(w), bool)
    inner[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
    return np.repeat(np.arange(len(sizes)), sizes)[inner], l[inner], w[inner]


def successor_counts(training: DataFrame) -> DataFrame:
    """(l, w, c): how often a word follows another, by the words' 64-bit hashes.
    Tasks count runs of documents, and only their sums are shuffled."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sizes, h in _batched(batches):
            _, l, w = _follows(h, sizes)
            _, first, counts = np.unique(_key(_NEXT, l, w), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_pydict({"l": l[first], "w": w[first], "c": counts})

    return training.select(_hashed()).mapInArrow(count, "l long, w long, c long").groupBy("l", "w").agg(F.sum("c").alias("c"))


def word_totals(training: DataFrame) -> DataFrame:
    """(w, c): how often each word occurs."""
    return training.select(F.explode("tokens").alias("w")).groupBy("w").agg(F.count("*").alias("c"))


def placed_ranks(docs: DataFrame, successors: DataFrame, known: DataFrame, most: int | None = None) -> DataFrame:
    """``context_ranks`` from the counts of its training documents.

    Documents are held in chunks; a chunk asks for each different pair once, and
    gets its rank back, so a place is no row of a shuffle."""
    kind_of = docs.schema["doc_id"].dataType.simpleString()
    words = known.select(F.xxhash64("w").alias("w"), "c")
    last = words.agg((F.count("*") + 1).alias("last"))

    def different(l: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place and number of each pair: both only depend on the chunk."""
        return np.unique(_key(_NEXT, l, w), return_index=True, return_inverse=True)[1:]

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, l, w = _follows(*_held(batch, i)[::-1])
                first, _ = different(l, w)
                yield pa.RecordBatch.from_pydict({"chunk": np.full(len(first), batch.column("chunk")[i].as_py()), "number": np.arange(len(first)), "l": l[first], "w": w[first]})

    def stats(rows: pa.Table, found: pa.Table) -> pa.Table:
        length, h = _held(rows, 0)
        doc, l, w = _follows(h, length)
        first, number = different(l, w)
        at = found.column("number").to_numpy()
        rank, bucket = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        rank[at], bucket[at] = found.column("r").to_numpy(), found.column("bucket").to_numpy()
        r, n = rank[number], np.bincount(doc, minlength=len(length))
        some = np.maximum(n, 1)
        in_bucket = np.bincount(doc * 10 + bucket[number], minlength=len(length) * 10).reshape(-1, 10)
        plogp = (in_bucket * np.log2(np.maximum(in_bucket, 1))).sum(1)
        top = {f"frac_rank_top{k}": np.bincount(doc[r <= k], minlength=len(length)) / some for k in (1, 5, 10)}
        return pa.table({"doc_id": rows.column("doc_ids")[0].values, "mean_token_rank": np.bincount(doc, r, len(length)) / some, **top, "rank_entropy": np.log2(some) - plogp / some})

    chunks = _cut_chunks(docs, most)
    pairs_of = cut(chunks.mapInArrow(ask, "chunk long, number long, l long, w long"), "pairs")
    asked = cut(pairs_of.select("l", "w").distinct(), "asked")
    direct = successor_ranks(successors)
    behind = backed_off(asked.join(successors, ["l", "w"], "left_anti"), successors, words)
    table = direct.join(asked, ["l", "w"], "left_semi").unionByName(behind).crossJoin(F.broadcast(last))  # one row
    bucket = F.least(F.floor(F.log2("r") / (F.log2("last") / 10)), F.lit(9))
    found = pairs_of.join(table.select("l", "w", "r", bucket.cast("long").alias("bucket")), ["l", "w"]).select("chunk", "number", "r", "bucket")
    schema = f"doc_id {kind_of}, mean_token_rank double, frac_rank_top1 double, frac_rank_top5 double, frac_rank_top10 double, rank_entropy double"
    return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(stats, schema)


# --- masked pseudo-perplexity -------------------------------------------------

#: What is counted of a place: the word between both neighbours and their pair,
#: two words that follow each other, and each of the three words.  The pair of
#: the left neighbour and the word is the same table as that of the word and the
#: right one.
_TRIPLE, _AROUND, _NEXT, _LEFT, _RIGHT, _WORD = range(6)
#: Places of a chunk: what its documents ask for is asked once.
CHUNK = 2**19
#: Keys are dealt out to parts by their first bits; a task holds a part at a time.
PART_BITS = 12


def _key(kind: int, *words: np.ndarray) -> np.ndarray:
    """64-bit hashes of a kind and its words' hashes, in their order."""
    x = np.full(len(words[0]), (kind + 1) * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for w in words:
        x = (x ^ w.view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
    return x.view(np.int64)


def _hashed(most: int | None = None) -> Column:
    """The hashes of a document's first ``most`` tokens, those of '' around
    them."""
    end = F.array(F.lit(""))
    tokens = F.coalesce(F.slice("tokens", 1, most) if most else F.col("tokens"), F.array().cast("array<string>"))
    return F.transform(F.concat(end, tokens, end), lambda w: F.xxhash64(w)).alias("h")


def _cuts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """From and to of runs of documents of at most CHUNK places, or of one."""
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if i > first and held + n > CHUNK:
            yield first, i
            first, held = i, 0
        held += int(n)
    if len(sizes) > first:
        yield first, len(sizes)


def _words(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left neighbour, word and right neighbour of each place; ``h`` are the
    documents one after the other, of ``sizes`` words and both their ends."""
    at = np.arange(sizes.sum()) + 2 * np.repeat(np.arange(len(sizes)), sizes) + 1
    return h[at - 1], h[at], h[at + 1]


def _batched(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of documents with their sizes and hashes."""
    for batch in batches:
        lists = batch.column("h")
        sizes = np.diff(lists.offsets.to_numpy()) - 2
        for a, b in _cuts(sizes):
            yield batch.slice(a, b - a), sizes[a:b], lists.slice(a, b - a).flatten().to_numpy()


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers as planes of their bytes, as many as the largest needs."""
    width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    return values.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpacked(blob: bytes | pa.Buffer, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        planes = np.frombuffer(blob, np.uint8).reshape(-1, n)
        out[:, : len(planes)] = planes.T
    return out.view("<i8").ravel()


def _unsorted(blob: bytes | pa.Buffer, n: int) -> np.ndarray:
    """Sorted keys from their packed differences."""
    return np.cumsum(_unpacked(blob, n).view(np.uint64), dtype=np.uint64)


def _binaries(columns: dict[str, object]) -> pa.RecordBatch:
    kinds = {"chunk": pa.int64(), "part": pa.int32(), "n": pa.int32(), "word": pa.bool_()}
    return pa.RecordBatch.from_pydict({name: pa.array(values, kinds.get(name, pa.binary())) for name, values in columns.items()})


def _dealt(keys: np.ndarray, counts: dict[str, np.ndarray], **same: object) -> pa.RecordBatch:
    """A row for each part that ``keys`` (sorted) have: the differences of its
    keys, and their counts."""
    part = (keys >> np.uint64(64 - PART_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(part, prepend=-1))
    ends = np.append(first, len(keys))[1:]
    gaps = np.diff(keys, prepend=np.uint64(0))
    gaps[first] = keys[first]
    runs = list(zip(first.tolist(), ends.tolist(), strict=True))
    packed = {name: [_packed(values[a:b]) for a, b in runs] for name, values in {"keys": gaps, **counts}.items()}
    return _binaries({**{name: [value] * len(runs) for name, value in same.items()}, "part": part[first], "n": ends - first, **packed})


def chunked(docs: DataFrame, most: int | None = None) -> DataFrame:
    """(chunk, doc_ids, sizes, words, places, n): documents held in chunks, with
    the hashes of their different words, and the number of each place's word
    among them (of their first ``most`` tokens).  To be written before it is
    read twice."""
    kind_of = docs.schema["doc_id"].dataType.simpleString()

    def hold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, (batch, length, h) in enumerate(_batched(batches)):
            words, place = np.unique(h, return_inverse=True)
            arrays = {"doc_ids": pa.ListArray.from_arrays([0, len(length)], pa.concat_arrays([batch.column("doc_id")])), "sizes": pa.array([length.astype(np.int64)]), "words": pa.array([words])}
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([part << 32 | number]), **arrays, "places": pa.array([_packed(place)], pa.binary()), "n": pa.array([len(h)])})

    return docs.select("doc_id", _hashed(most)).mapInArrow(hold, f"chunk long, doc_ids array<{kind_of}>, sizes array<long>, words array<long>, places binary, n long")


def _cut_chunks(docs: DataFrame, most: int | None) -> DataFrame:
    """Chunks, written.  A reader's batch is up to 4096 rows of a row group, so
    groups are of a few chunks."""
    return cut(chunked(docs, most), "chunks", **{"parquet.block.size": 2**23, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 4})


def _held(row: pa.RecordBatch | pa.Table, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and hashes of the documents of a chunk."""
    places = _unpacked(row.column("places")[i].as_buffer(), row.column("n")[i].as_py())
    return row.column("sizes")[i].values.to_numpy(), row.column("words")[i].values.to_numpy()[places]


def two_sided_counts(training: DataFrame, **parts: str) -> DataFrame:
    """(word, part, n, keys, c): the model, as sorted keys and their counts of
    runs of documents, to be summed where they are asked.  With ``parts``, a
    condition on the training documents for each name, one model for each part,
    as columns c_<name>.  Words by themselves stand in rows of their own.  Keys
    are 64-bit hashes of the words; of n different ones about n * n / 2**65 pairs
    share a count."""
    conditions = parts or {"": "true"}
    marks = {f"c_{name}" if name else "c": F.expr(f"CASE WHEN {condition} THEN 1 ELSE 0 END").cast("long") for name, condition in conditions.items()}
    columns = list(marks)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sizes, h in _batched(batches):
            l, w, r = _words(h, sizes)
            last = np.cumsum(sizes)[sizes > 0] - 1  # pairs with the end behind them
            each = {name: np.repeat(batch.column(name).to_numpy(), sizes) for name in columns}
            around = [_key(_TRIPLE, l, w, r), _key(_AROUND, l, r), _key(_NEXT, l, w), _key(_NEXT, w[last], r[last]), _key(_LEFT, l), _key(_RIGHT, r)]
            for word, asked in ((False, around), (True, [_key(_WORD, w)])):
                keys, place = np.unique(np.concatenate(asked).view(np.uint64), return_inverse=True)
                weights = {name: np.concatenate([m[last] if len(k) < len(m) else m for k in asked]) for name, m in each.items()}
                yield _dealt(keys, {name: np.bincount(place, m, len(keys)).astype(np.uint64) for name, m in weights.items()}, word=word)

    some = functools.reduce(lambda a, b: a | b, (F.expr(f"coalesce({condition}, false)") for condition in conditions.values()))
    rows = training.filter(some).select(_hashed(), *(mark.alias(name) for name, mark in marks.items()))
    return rows.mapInArrow(count, "word boolean, part int, n int, keys binary, " + ", ".join(f"{name} binary" for name in columns))


def _summed(pieces: list[tuple[np.ndarray, list[np.ndarray]]], columns: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted keys and the sums of their counts, a last key behind all others."""
    if not pieces:
        return np.full(1, 2**64 - 1, np.uint64), [np.zeros(1, np.int64)] * columns
    keys, place = np.unique(np.concatenate([k for k, _ in pieces]), return_inverse=True)
    sums = [np.bincount(place, np.concatenate([c[i] for _, c in pieces]), len(keys)).astype(np.int64) for i in range(columns)]
    return np.append(keys, np.uint64(2**64 - 1)), [np.append(c, 0) for c in sums]


def counted(asked: DataFrame, model: DataFrame, columns: list[str]) -> DataFrame:
    """(chunk, part, n, columns): the counts of the keys of (chunk, part, n,
    keys), in their order.  Rows with chunk -1 have in their columns the sum of
    the words' counts of a part, and the number of words counted.

    The rows of a part come one after the other, those of the model first, so a
    task holds one part's keys at a time, and a key is dealt out once."""
    model = model.select(F.lit(-1).cast("long").alias("chunk"), "part", "word", "n", "keys", *columns)
    both = model.unionByName(asked.select("chunk", "part", "n", "keys"), allowMissingColumns=True)

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pieces, table = -1, ([], []), None
        out: dict[str, list] = {}

        def put(chunk: int, part: int, values: list[np.ndarray]) -> None:
            for name, value in zip(("chunk", "part", "n", *columns), (chunk, part, len(values[0]), *(_packed(v) for v in values)), strict=True):
                out.setdefault(name, []).append(value)

        def close() -> None:
            if pieces[1]:
                _, sums = _summed(pieces[1], len(columns))
                put(-1, held, [np.array([c.sum(), np.count_nonzero(c)], np.uint64) for c in sums])

        for batch in batches:
            chunk, part, n, word = (batch.column(name).to_pylist() for name in ("chunk", "part", "n", "word"))
            keys, blobs = batch.column("keys"), [batch.column(name) for name in columns]
            for i in range(batch.num_rows):
                if part[i] != held:
                    close()
                    held, pieces, table = part[i], ([], []), None
                asks = _unsorted(keys[i].as_buffer(), n[i])
                if chunk[i] < 0:
                    pieces[word[i]].append((asks, [_unpacked(b[i].as_buffer(), n[i]) for b in blobs]))
                    continue
                if table is None:
                    table = _summed(pieces[0] + pieces[1], len(columns))
                at = np.searchsorted(table[0], asks)
                hit = table[0][at] == asks
                put(chunk[i], held, [np.where(hit, c[at], 0).astype(np.uint64) for c in table[1]])
            if out:
                yield _binaries(out)
                out = {}
        close()
        if out:
            yield _binaries(out)

    return both.repartition("part").sortWithinPartitions("part", "chunk").mapInArrow(answer, "chunk long, part int, n int, " + ", ".join(f"{name} binary" for name in columns))


def masked_perplexities(docs: DataFrame, model: DataFrame, names: tuple[str, ...], most: int | None = None) -> DataFrame:
    """(doc_id, perplexity_<name> of each name): exp of minus the mean log
    probability of the tokens, or of the first ``most``, each hidden and guessed from both
    its neighbours by the model in column c_<name>.

    The probability mixes the share of the word between both neighbours, after
    the left and before the right one, and its smoothed own share; the weight
    of a context that was never seen goes to the latter.  Documents without
    tokens have no row.

    Documents are held in chunks; a chunk asks the model once for each key, and
    the counts go back to the chunk.  So a place is no row of a shuffle."""
    kind_of = docs.schema["doc_id"].dataType.simpleString()
    columns = [f"c_{name}" for name in names]

    def places(row: pa.RecordBatch | pa.Table, i: int) -> tuple[np.ndarray, list[np.ndarray]]:
        length, h = _held(row, i)
        l, w, r = _words(h, length)
        return length, [_key(_TRIPLE, l, w, r), _key(_AROUND, l, r), _key(_NEXT, l, w), _key(_LEFT, l), _key(_NEXT, w, r), _key(_RIGHT, r), _key(_WORD, w)]

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys = np.unique(np.concatenate(places(batch, i)[1]).view(np.uint64))
                yield _dealt(keys, {}, chunk=batch.column("chunk")[i].as_py())

    def score(rows: pa.Table, found: pa.Table) -> pa.Table:
        length, keys = places(rows, 0)
        place = np.unique(np.concatenate(keys).view(np.uint64), return_inverse=True)[1].reshape(7, -1)
        found = found.sort_by("part")
        n_of, doc = found.column("n").to_pylist(), np.repeat(np.arange(len(length)), length)
        sums = {}
        for name in names:
            blobs = found.column(f"c_{name}")
            known = np.concatenate([np.zeros(0, np.int64), *(_unpacked(b.as_buffer(), n) for b, n in zip(blobs, n_of, strict=True))])
            c = [known[at] for at in place]
            p, rest = np.zeros(len(doc)), np.ones(len(doc))
            for part, whole, weight in ((0, 1, BOTH), (2, 3, SINGLE / 2), (4, 5, SINGLE / 2)):
                p += np.where(c[whole] > 0, weight * c[part] / np.maximum(c[whole], 1), 0.0)
                rest -= np.where(c[whole] > 0, weight, 0.0)
            n, v = rows.column(f"n_{name}")[0].as_py(), rows.column(f"v_{name}")[0].as_py()
            sums[f"log_{name}"] = np.bincount(doc, np.log(p + rest * (c[6] + SMOOTHING) / (n + SMOOTHING * (v + 1))), len(length))
        return pa.table({"doc_id": rows.column("doc_ids")[0].values, "n": length, **sums})

    def totals(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            pairs = {name: np.array([_unpacked(b.as_buffer(), 2) for b in batch.column(f"c_{name}")], np.int64).reshape(-1, 2) for name in names}
            yield pa.RecordBatch.from_pydict({f"{kind}_{name}": pairs[name][:, i] for name in names for i, kind in enumerate("nv")})

    chunks = _cut_chunks(docs, most)
    answers = cut(counted(chunks.mapInArrow(ask, "chunk long, part int, n int, keys binary"), model, columns), "answers")
    shape = [f"{kind}_{name}" for name in names for kind in "nv"]
    sizes = answers.filter("chunk < 0").mapInArrow(totals, ", ".join(f"{c} long" for c in shape)).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in shape))  # one row
    found = answers.filter("chunk >= 0")
    logs = chunks.crossJoin(F.broadcast(sizes)).groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(score, f"doc_id {kind_of}, n long, " + ", ".join(f"log_{name} double" for name in names))
    return logs.filter("n > 0").groupBy("doc_id").agg(*(F.exp(-F.sum(f"log_{name}") / F.sum("n")).alias(f"perplexity_{name}") for name in names))


def masked_perplexity(docs: DataFrame, model: DataFrame, most: int | None = None) -> DataFrame:
    """(doc_id, perplexity) by one model (kind, key, c)."""
    return masked_perplexities(docs, model.withColumnRenamed("c", "c_own"), ("own",), most).withColumnRenamed("perplexity_own", "perplexity")


def log_ratio(one: Column, two: Column) -> Column:
    """Logarithm of the ratio of two perplexities, 0 where there is none above
    0."""
    return F.when(one / two > 0, F.log(one / two)).otherwise(0.0)
