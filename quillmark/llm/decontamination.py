"""Benchmark decontamination on a distributed positional inverted index.

``build_index`` stores the corpus as shards: one row per run of about 1 MB of
text holds the document borders and, term by term, the sorted positions of
all words (delta coded).  The index is a table in the shared folder, so any
benchmark is looked for in it instead of the texts, and losing an executor
loses nothing.
``search`` answers phrase and proximity queries shard by shard: the list of a
window's rarest term (by counts over the whole corpus) gives the candidate
starts, which are intersected with the offset-adjusted lists of the other
terms in order of rarity.

Sizes: a shard is bounded by its text run.  Benchmark items are handled in
blocks of bounded bytes (their windows are one array of words and places in
it), so what reaches the driver and the executors at once does not grow with
the benchmark or the corpus.  Words are compared by 64-bit hashes: a window of
ten words is taken for another with a probability of 2**-64 for each word.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import wordstream
from quillmark.llm.common import free_names, keyed, materialize, only_kept, tidy

WINDOW_WORDS = 10
#: Words from a window's rarest word within which all its words must lie.
SLOP = 12
#: Benchmark text looked for at once.
BLOCK_BYTES = 4 << 20

INDEX_SCHEMA = "shard string, doc_ids binary, id_nulls binary, doc_first binary, terms binary, counts binary, postings binary"
PART_SCHEMA = "shard string, ordinal int, doc_id long, n_words long, n_hit long, hits binary, items array<string>, near array<string>"


def _pack(values: np.ndarray) -> bytes:
    """int32 values as byte planes: the high planes of small values compress away."""
    return np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel().astype(np.int64)


def _wide(values: np.ndarray) -> bytes:
    """uint64 values as byte planes."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _terms(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def _shard(ids: np.ndarray, nulls: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> dict:
    positions = np.argsort(hashes, kind="stable")
    own = hashes[positions]
    heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    deltas = np.diff(positions, prepend=0)
    deltas[heads] = positions[heads]
    return {
        "doc_ids": ids.astype("<i8").tobytes(),
        "id_nulls": nulls.astype(np.uint8).tobytes(),
        "doc_first": _pack(first),
        "terms": _wide(np.diff(own[heads], prepend=np.uint64(0))),
        "counts": _pack(np.diff(np.append(heads, len(own)))),
        "postings": _pack(deltas),
    }


def build_index(docs: DataFrame) -> DataFrame:
    """Positional inverted index of all words of ``docs`` (doc_id, text),
    materialised."""

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.string()), *((n, pa.binary()) for n in ("doc_ids", "id_nulls", "doc_first", "terms", "counts", "postings"))])
        for batch in batches:
            ids = batch.column(0)
            nulls = np.asarray(ids.is_null())
            ids = np.asarray(ids.fill_null(0))
            for start, end, data, offsets in wordstream.text_slices(batch.column(1)):
                hashes, first = wordstream.words(data, offsets, wordstream.ALNUM_WORDS)
                row = _shard(ids[start:end], nulls[start:end], hashes, first)
                yield pa.RecordBatch.from_pylist([{"shard": uuid.uuid4().hex} | row], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(index), INDEX_SCHEMA)
    return materialize(rows, "positions")


class Shard:
    """A shard's lists as one sorted array of (term, position) keys."""

    def __init__(self, row: dict) -> None:
        self.ids = np.frombuffer(row["doc_ids"], "<i8")
        self.nulls = np.frombuffer(row["id_nulls"], np.uint8).astype(bool)
        self.first = unpack(row["doc_first"])
        self.terms = _terms(row["terms"])
        counts = unpack(row["counts"])
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        deltas = np.cumsum(unpack(row["postings"]))
        base = np.concatenate([[0], deltas])[self.starts[:-1]]
        self.postings = deltas - np.repeat(base, counts)
        self.keys = np.repeat(np.arange(len(counts)) << 32, counts) + self.postings

    def local(self, terms: np.ndarray) -> np.ndarray:
        """This shard's number of each term, -1 if it has none of it."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def candidates(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of terms, position) for every posting of each local term."""
        sizes = self.starts[terms + 1] - self.starts[terms]
        rows = np.repeat(np.arange(len(terms)), sizes)
        within = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return rows, self.postings[self.starts[terms][rows] + within]

    def has(self, terms: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the lists of terms have a position in [low, high]."""
        base = terms << 32
        at = np.searchsorted(self.keys, base + np.maximum(low, 0))
        found = self.keys[np.minimum(at, len(self.keys) - 1)]
        return (at < len(self.keys)) & (found <= base + high)

    def document(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, positions, "right") - 1


class Windows:
    """Distinct benchmark windows by length: the words of all items in one
    array, where each window begins in it, and the numbers of its items."""

    def __init__(self, items: list[tuple[str, np.ndarray]], width: int) -> None:
        self.names = [name for name, _ in items]
        self.words = np.concatenate([h for _, h in items]) if items else np.zeros(0, np.uint64)
        self.vocabulary = np.unique(self.words)
        sizes = np.array([len(h) for _, h in items], np.int64)
        first = np.cumsum(sizes) - sizes
        wide = np.minimum(sizes, width)
        self.groups: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []  # size, starts, item numbers and where each window's begin
        for size in np.unique(wide[wide > 0]).tolist():
            own = np.flatnonzero(wide == size)
            each = sizes[own] - size + 1
            item = np.repeat(own, each)
            start = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first[own], each)
            # equal windows have equal ranks: words are numbered, and rows compared
            number = np.searchsorted(self.vocabulary, self.words).astype(np.int32)
            rows = np.stack([number[start + i] for i in range(size)], axis=1)
            order = np.lexsort((item, *rows.T[::-1]))
            rows, item, start = rows[order], item[order], start[order]
            fresh = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])
            heads = np.flatnonzero(fresh)
            self.groups.append((size, start[heads], item, np.append(heads, len(item))))

    def terms(self, start: np.ndarray, size: int) -> np.ndarray:
        return self.words[start[:, None] + np.arange(size)]

    def items_of(self, group: int, row: int) -> list[str]:
        _, _, item, heads = self.groups[group]
        return [self.names[i] for i in item[heads[row] : heads[row + 1]]]

    def rank(self, totals: np.ndarray) -> None:
        """Order each window's offsets from the rarest term on."""
        self.orders = [np.argsort(totals[np.searchsorted(self.vocabulary, self.terms(start, size))], axis=1, kind="stable").astype(np.int16) for size, start, _, _ in self.groups]

    def here(self, group: int, shard: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows all of whose words the shard has: rows, the shard's numbers
        of their words, and the order of their offsets."""
        size, start, _, _ = self.groups[group]
        known = shard.local(self.vocabulary)
        number = known[np.searchsorted(self.vocabulary, self.words)]
        rows = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(number, size).min(axis=1)[start] >= 0)
        return rows, number[start[rows][:, None] + np.arange(size)], self.orders[group][rows].astype(np.int64)


def phrase_hits(shard: Shard, windows: Windows) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(group, length, window rows, start positions) per length."""
    for group, (size, _, _, _) in enumerate(windows.groups):
        rows, local, order = windows.here(group, shard)
        if not len(rows):
            continue
        which, at = shard.candidates(local[np.arange(len(rows)), order[:, 0]])
        at = at - order[which, 0]
        for step in range(1, size):
            offset = order[which, step]
            kept = shard.has(local[which, offset], at + offset, at + offset)
            which, at = which[kept], at[kept]
        kept = at >= 0
        which, at = which[kept], at[kept]
        kept = shard.document(at) == shard.document(at + size - 1)
        if kept.any():
            yield group, size, rows[which[kept]], at[kept]


def near_hits(shard: Shard, windows: Windows, slop: int, least: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(group, window rows, position of the rarest word) where every word of a
    window of ``least`` words or more lies within ``slop`` words of that
    position, in the same document."""
    for group, (size, _, _, _) in enumerate(windows.groups):
        if size < least:
            continue
        rows, local, order = windows.here(group, shard)
        if not len(rows):
            continue
        which, at = shard.candidates(local[np.arange(len(rows)), order[:, 0]])
        for step in range(1, size):
            document = shard.document(at)
            low, high = np.maximum(at - slop, shard.first[document]), np.minimum(at + slop, shard.first[document + 1] - 1)
            kept = shard.has(local[which, order[which, step]], low, high)
            which, at = which[kept], at[kept]
        if len(which):
            yield group, rows[which], at


def _search_shard(row: dict, windows: Windows, slop: int | None, least: int) -> list[dict]:
    shard = Shard(row)
    n_docs, n_words = len(shard.ids), int(shard.first[-1])
    edges = np.zeros(n_words + 1, np.int64)
    named: list[set[str]] = [set() for _ in range(n_docs)]
    near: list[set[str]] = [set() for _ in range(n_docs)]
    for group, size, rows, at in phrase_hits(shard, windows):
        np.add.at(edges, at, 1)
        np.add.at(edges, at + size, -1)
        for d, r in set(zip(shard.document(at).tolist(), rows.tolist(), strict=True)):
            named[d].update(windows.items_of(group, r))
    if slop is not None:
        for group, rows, at in near_hits(shard, windows, slop, least):
            for d, r in set(zip(shard.document(at).tolist(), rows.tolist(), strict=True)):
                near[d].update(windows.items_of(group, r))
    covered = np.cumsum(edges[:-1]) > 0
    return [
        {
            "shard": row["shard"],
            "ordinal": i,
            "doc_id": None if shard.nulls[i] else int(shard.ids[i]),
            "n_words": int(shard.first[i + 1] - shard.first[i]),
            "n_hit": int(covered[shard.first[i] : shard.first[i + 1]].sum()),
            "hits": np.packbits(covered[shard.first[i] : shard.first[i + 1]]).tobytes() if named[i] else b"",
            "items": sorted(named[i]),
            "near": sorted(near[i]),
        }
        for i in range(n_docs)
    ]


def _term_totals(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Corpus count of each vocabulary term: one row of sums per task, then a sum."""
    shared = index.sparkSession.sparkContext.broadcast(vocabulary)

    def partial(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros(len(shared.value), np.int64)
        for frame in frames:
            for terms, counts in zip(frame["terms"], frame["counts"], strict=True):
                terms = _terms(terms)
                at = np.minimum(np.searchsorted(shared.value, terms), len(shared.value) - 1)
                kept = shared.value[at] == terms
                np.add.at(totals, at[kept], unpack(counts)[kept])
        found = np.flatnonzero(totals)
        yield pd.DataFrame({"term": found, "n": totals[found]})

    sums = index.select("terms", "counts").mapInPandas(partial, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    totals = np.zeros(len(vocabulary), np.int64)
    totals[sums["term"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    return totals


def _item_words(texts: list[str | None]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for start, end, data, offsets in wordstream.text_slices(pa.array(texts, pa.string())):
        hashes, first = wordstream.words(data, offsets, wordstream.ALNUM_WORDS)
        out += [hashes[first[i] : first[i + 1]] for i in range(end - start)]
    return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Benchmark items in hash blocks of about ``block_bytes`` of text."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    for block in range(n):
        chosen = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block) if n > 1 else items
        yield [(r.item_id, r.text) for r in chosen.toLocalIterator()]


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW_WORDS, slop: int | None = None, block_bytes: int = BLOCK_BYTES, short_near: bool = True) -> DataFrame:
    """Benchmark windows in whole documents: one row per row of ``docs``.

    Words are runs of ASCII letters and digits (A-Z lower-cased) and all
    non-ASCII characters.  A window is ``width`` consecutive words of an item
    (an item of fewer words is one window).  ``n_hit`` counts document words
    inside any occurrence of a window, ``n_items`` the items with occurring
    windows, ``items_sha256`` digests their ids; with ``slop``, ``near_items``
    counts items with a window whose words all lie within ``slop`` words of its
    rarest word (without ``short_near``: a window of ``width`` words).

    Nulls and empty texts have no words and are clean; benchmark rows without
    id or text are ignored; repeated rows and ids give a row each; an empty
    benchmark leaves every document clean; other columns are ignored.
    """
    index = build_index(docs)
    least = 1 if short_near else width
    found = [_search(index, block, width, slop, least) for block in _blocks(benchmark, block_bytes)] or [_search(index, [], width, slop, least)]
    if len(found) == 1:
        return _finished(found[0])
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        """One document's parts, a row for each block."""
        head = frame.iloc[[0]].copy()
        bits = [np.frombuffer(h, np.uint8) for h in frame["hits"] if len(h)]
        union = np.bitwise_or.reduce(bits) if bits else np.zeros(0, np.uint8)
        head["hits"] = [union.tobytes()]
        head["n_hit"] = int(np.unpackbits(union).sum())
        for name in ("items", "near"):
            head[name] = [sorted(set().union(*frame[name]))]
        return head

    return _finished(every.groupBy("shard", "ordinal").applyInPandas(merge, PART_SCHEMA))


def _search(index: DataFrame, block: list[tuple[str, str]], width: int, slop: int | None, least: int) -> DataFrame:
    """Each document's hits for one block of items (PART_SCHEMA)."""
    windows = Windows(list(zip([n for n, _ in block], _item_words([t for _, t in block]), strict=True)), width)
    windows.rank(_term_totals(index, windows.vocabulary) if windows.groups else np.zeros(0, np.int64))
    shared = index.sparkSession.sparkContext.broadcast(windows)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.string()), ("ordinal", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("hits", pa.binary()), ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string()))])
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist(_search_shard(row, shared.value, slop, least), schema=schema)

    return index.mapInArrow(tidy(search), PART_SCHEMA)


def _finished(parts: DataFrame) -> DataFrame:
    return parts.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near").cast("long").alias("near_items"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW_WORDS, slop: int | None = SLOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window, word for word or,
    with ``slop``, all its words within ``slop`` words of its rarest one (windows
    of fewer than ``width`` words: word for word only, as a few common words
    stand close by in clean texts, too).

    Null and repeated ids are rows like any other, null and empty texts are
    clean and stay, other columns are untouched, an empty table or an empty
    benchmark changes nothing."""
    key, hit = free_names(docs, "key", "hit")
    rows = keyed(docs, key)  # a row is known by its text
    with only_kept(docs.sparkSession) as keep:
        found = contamination(rows.select(F.col(key).alias("doc_id"), "text"), benchmark, width, slop, block_bytes, short_near=False)
        gone = keep(materialize(found.filter("contaminated OR near_items > 0").select(F.col("doc_id").alias(hit)).distinct(), "contaminated"))
    return rows.join(gone, F.col(key) == F.col(hit), "left_anti").drop(key)
