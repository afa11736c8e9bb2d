"""Substring deduplication: passages that recur in other documents are found,
confirmed, compiled into Aho-Corasick automata and located in every document.

1. *Chunks*: documents are stored as runs of about 1 MB of text, which have
   numbers from here on.
2. *Recurring anchors*: of the ``ANCHOR``-word runs in a window, the one of the
   least hash is its anchor (the leftmost of equals), so equal windows have
   equal anchors, and only one word in about five begins one.  Each chunk sends
   its distinct anchors with its smallest and largest document; those that
   occur in two documents go back to the chunks.
3. *Confirmed windows*: each chunk sends the digests (96 bits) of its distinct
   windows round such anchors, again with its smallest and largest document;
   windows that begin in a smaller document than the chunk's largest go back,
   as a place in the chunk and that smallest document.
4. *Automata*: each chunk compiles the word sequences that came back into
   automata of at most ``PATTERNS`` windows and streams all its documents
   through each.  Every match marks its words where the window's smallest
   document is smaller than the document at hand.

The sequences of a chunk occur in it, so an automaton is bounded by its chunk,
and each is compiled where it is needed: nothing is broadcast or collected.  A
passage of all documents costs one row for each chunk, however many documents
of the chunk have it, and these rows go through a window that sorts and spills.
Two different windows of one anchor are taken for each other with a probability
of 2**-96; words are numbered by 64-bit hashes inside a chunk.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm import wordstream
from quillmark.llm.common import discard, free_shuffles, materialize, tidy

#: Words of a window, and of its anchor.
WINDOW_WORDS = 13
ANCHOR_WORDS = 5
#: Windows of one automaton (about 100 bytes a word of each).
PATTERNS = 50_000

_CHUNK = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("text", pa.binary())])
_CHUNK_SQL = "chunk long, ids array<long>, sizes array<long>, text binary"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("text", pa.string())])
_OUT_SQL = "doc_id long, n_words long, removed array<struct<start:long,end:long>>, text string"


class _Chunk:
    """Words of a stored chunk: hashes, first word and id of each document,
    and the document of each word."""

    def __init__(self, ids: list[int | None], sizes: list[int], packed: bytes) -> None:
        self.raw = zstandard.ZstdDecompressor().decompress(packed)
        self.offsets = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])
        self.hashes, self.first = wordstream.words(np.frombuffer(self.raw, np.uint8), self.offsets, wordstream.SPACE_WORDS, wordstream.EXACT)
        self.ids = ids
        counts = np.diff(self.first)
        self.known = np.repeat(np.array([i is not None for i in ids], bool), counts)
        self.doc = np.repeat(np.array([i or 0 for i in ids], np.int64), counts)
        self.end = np.repeat(self.first[1:], counts)

    def anchored(self, width: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the windows (in documents with an id), the place of each
        one's anchor, and the hash of the anchor at each place."""
        grams = wordstream.runs(self.hashes, anchor)
        starts = np.flatnonzero(self.known & (np.arange(len(self.hashes)) + width <= self.end))
        if not len(starts):
            return starts, starts, grams
        inside = np.lib.stride_tricks.sliding_window_view(grams, width - anchor + 1)
        best = np.concatenate([inside[part].argmin(axis=1) for part in np.array_split(starts, -(-len(starts) // 65536))])
        return starts, starts + best, grams


def _chunks(docs: DataFrame) -> DataFrame:
    """Chunks (_CHUNK) of (doc_id, text); null texts are empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        packer = zstandard.ZstdCompressor(3)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for start, end, data, offsets in wordstream.text_slices(batch.column(1)):
                yield pa.RecordBatch.from_pylist([{"chunk": number, "ids": ids[start:end], "sizes": np.diff(offsets).tolist(), "text": packer.compress(data.tobytes())}], schema=_CHUNK)
                number += 1

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), _CHUNK_SQL)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, _Chunk, pa.Array | None]]:
    """Number, words and listed values (null: none) of each stored chunk."""
    for batch in batches:
        for i in range(batch.num_rows):
            number, ids, sizes, packed = (batch.column(k)[i].as_py() for k in range(4))
            yield number, _Chunk(ids, sizes, packed), batch.column(4)[i].values if batch.num_columns > 4 else None


def _distinct(keys: tuple[np.ndarray, ...], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, smallest and largest document of each distinct key."""
    order = np.lexsort((doc, *keys[::-1]))
    fresh = np.ones(len(order), bool)
    if len(order):
        fresh[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    heads = np.flatnonzero(fresh)
    tails = np.append(heads[1:], len(order)) - 1
    return order[heads], doc[order[heads]], doc[order[tails[: len(heads)]]]


def _anchors(chunks: DataFrame, width: int, anchor: int) -> DataFrame:
    """(anchor, chunk, lo, hi): each chunk's distinct anchors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk, _ in _rows(batches):
            _, places, grams = chunk.anchored(width, anchor)
            places = np.unique(places)
            at, lo, hi = _distinct((grams[places],), chunk.doc[places])
            yield pa.RecordBatch.from_arrays([pa.array(grams[places[at]].view(np.int64)), pa.array(np.full(len(at), number)), pa.array(lo), pa.array(hi)], names=["anchor", "chunk", "lo", "hi"])

    return chunks.mapInArrow(tidy(run), "anchor long, chunk long, lo long, hi long")


def _windows(chunks: DataFrame, width: int, anchor: int) -> DataFrame:
    """(h, g, chunk, place, lo, hi): each chunk's distinct windows round the
    anchors listed with it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk, listed in _rows(batches):
            starts, places, grams = chunk.anchored(width, anchor)
            starts = starts[np.isin(grams[places], np.asarray(listed).view(np.uint64))]
            h = wordstream.runs(chunk.hashes, width)[starts]
            g = (wordstream.runs(wordstream.mix(chunk.hashes), width)[starts] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            at, lo, hi = _distinct((h, g), chunk.doc[starts])
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(g[at]), pa.array(np.full(len(at), number)), pa.array(starts[at].astype(np.int32)), pa.array(lo), pa.array(hi)], names=["h", "g", "chunk", "place", "lo", "hi"])

    return chunks.mapInArrow(tidy(run), "h long, g int, chunk long, place int, lo long, hi long")


def spelled(hashes: np.ndarray, vocabulary: np.ndarray) -> str:
    """Words as a string of two characters each: the upper and the lower digit
    of the word's number in the sorted vocabulary, from two alphabets of about
    the square root of its size; zeros for all other words.  An automaton looks
    through a state's successors one by one, so it needs small alphabets."""
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    base = math.isqrt(len(vocabulary)) + 1
    digits = np.stack(np.divmod(at, base), axis=1) + np.array([1, 1 + base])
    digits[vocabulary[at] != hashes] = 0
    return digits.astype("<u4").tobytes().decode("utf-32-le")


def compiled(words: str, places: np.ndarray, width: int) -> ahocorasick.Automaton:
    """Automaton of the ``width`` words from each place on; a match gives
    the last character of its last word and the number of its pattern."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, at in enumerate(places.tolist()):
        automaton.add_word(words[2 * at : 2 * (at + width)], k)
    automaton.make_automaton()
    return automaton


def _covered(chunk: _Chunk, places: np.ndarray, owners: np.ndarray, width: int, limit: int = PATTERNS) -> np.ndarray:
    """Which words of the chunk a listed window covers whose smallest document
    is smaller than theirs; ``limit`` windows an automaton."""
    edges = np.zeros(len(chunk.hashes) + 1, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(chunk.hashes, width)
    for base in range(0, len(places), limit):
        some, own = places[base : base + limit], owners[base : base + limit]
        words = spelled(chunk.hashes, np.unique(windows[some]))
        automaton = compiled(words, some, width)
        for doc, low, high in zip(chunk.ids, chunk.first[:-1].tolist(), chunk.first[1:].tolist(), strict=True):
            if doc is None or high - low < width:
                continue
            found = list(automaton.iter(words[2 * low : 2 * high]))
            if found:
                last, row = np.array(found, np.int64).T
                last = last[own[row] < doc] // 2 + low
                np.add.at(edges, last - width + 1, 1)
                np.add.at(edges, last + 1, -1)
    return np.cumsum(edges[:-1]) > 0


def _located(chunks: DataFrame, width: int) -> DataFrame:
    """Documents (_OUT) of chunks with the windows that came back."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, chunk, hits in _rows(batches):
            gone = np.zeros(len(chunk.hashes), bool) if hits is None else _covered(chunk, np.asarray(hits.field("place")), np.asarray(hits.field("owner")), width)
            out = []
            for i, doc in enumerate(chunk.ids):
                words = chunk.raw[chunk.offsets[i] : chunk.offsets[i + 1]].split()
                cut = gone[chunk.first[i] : chunk.first[i + 1]]
                steps = np.flatnonzero(np.diff(np.concatenate([[False], cut, [False]]).astype(np.int8)))
                spans = [{"start": a, "end": b} for a, b in steps.reshape(-1, 2).tolist()]
                ends = [0, *steps.tolist(), len(words)]
                kept = words if not spans else [w for a, b in zip(ends[::2], ends[1::2], strict=True) for w in words[a:b]]
                out.append({"doc_id": doc, "n_words": len(words), "removed": spans, "text": b" ".join(kept).decode()})
            yield pa.RecordBatch.from_pylist(out, schema=_OUT)

    return chunks.mapInArrow(tidy(run), _OUT_SQL)


def without_repeats(docs: DataFrame, width: int = WINDOW_WORDS, anchor: int = ANCHOR_WORDS) -> DataFrame:
    """(doc_id, n_words, removed, text), a row for each row of ``docs``: words
    (between ASCII white space) covered by a window of ``width`` words that also
    begins in a document of a smaller doc_id are removed.  ``removed`` are their
    places as [start, end) word numbers, ``text`` the words kept, joined by
    blanks.  Windows are judged on the input.

    Null and empty texts have no words; rows without id lose nothing and make
    no other row lose anything; rows of one id don't count against each other;
    texts may be of any length; other columns are ignored; an empty table gives
    none.
    """
    if not 1 <= anchor <= width:
        raise ValueError("an anchor has one word at least and no more than its window")
    spark = docs.sparkSession
    chunks = materialize(_chunks(docs), "chunks")
    alike = Window.partitionBy("anchor")
    recurring = _anchors(chunks, width, anchor).select("anchor", "chunk", F.min("lo").over(alike).alias("lo"), F.max("hi").over(alike).alias("hi")).filter("lo < hi")
    listed = materialize(recurring.groupBy("chunk").agg(F.collect_list("anchor").alias("anchors")), "anchors")
    free_shuffles(spark)
    first = F.min("lo").over(Window.partitionBy("h", "g"))
    confirmed = _windows(chunks.join(listed, "chunk"), width, anchor).withColumn("owner", first).filter("owner < hi")
    windows = materialize(confirmed.groupBy("chunk").agg(F.collect_list(F.struct("place", "owner")).alias("windows")), "windows")
    free_shuffles(spark)
    discard(listed)
    return _located(chunks.join(windows, "chunk", "left"), width)
