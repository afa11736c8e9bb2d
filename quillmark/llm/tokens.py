"""Byte-level BPE ids of many texts at once.

The vocabulary file's pre-tokenisation pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
only looks at character classes, so the borders of all pre-tokens of a run of
texts come from array operations.  Each distinct pre-token is then encoded
once and its ids are copied wherever it occurs.
"""

from __future__ import annotations

import functools
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex

from quillmark.llm import wordstream

#: Distinct pre-tokens kept by a worker before it starts over (memory bound).
CACHE_ENTRIES = 300_000
#: Bytes of text encoded at once.
SLICE_BYTES = 256 << 10

_LETTER, _NUMBER, _SPACE = 1, 2, 3
_ONE_LETTER = tuple(map(ord, "stmd"))
_TWO_LETTERS = (tuple(map(ord, "re")), tuple(map(ord, "ve")), tuple(map(ord, "ll")))


def _classes() -> np.ndarray:
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    table = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            table[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    return table


def pretoken_starts(points: np.ndarray, firsts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Start of every pre-token.  ``firsts``: where non-empty texts begin."""
    n = len(points)
    kind = classes[points]
    head = np.ones(n, bool)
    head[1:] = kind[1:] != kind[:-1]
    head[firsts] = True
    opens = np.zeros(n + 1, bool)  # a text begins here (or everything ends)
    opens[firsts] = True
    opens[n] = True
    follows = ~opens[:n]  # the character before belongs to the same text
    space = kind == _SPACE
    blank = points == 32
    starts = head.copy()
    before = np.zeros(n, bool)
    before[1:] = blank[:-1]
    starts &= space | ~(before & follows)  # a blank goes with the word after it
    last = space.copy()  # last white space before something else of this text
    last[:-1] &= ~space[1:] & ~opens[1:n]
    last[-1] = False
    starts |= last
    # contractions: a lone apostrophe that begins a match, and some letters
    quote = np.flatnonzero((points == 39) & starts)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == _LETTER) & ~opens[quote + 1]]
    one = np.isin(points[quote + 1], _ONE_LETTER)
    two = np.zeros(len(quote), bool)
    wide = np.flatnonzero(quote + 2 < n)
    pair = quote[wide]
    for a, b in _TWO_LETTERS:
        two[wide] |= (points[pair + 1] == a) & (points[pair + 2] == b) & ~opens[pair + 2]
    hit = one | two
    quote, length = quote[hit], np.where(one[hit], 2, 3)
    starts[quote + 1] = False
    after = quote + length
    starts[after[after < n]] = True
    return np.flatnonzero(starts)


def _byte_of() -> dict[str, int]:
    """Byte for each character that stands for one in the vocabulary file:
    printable bytes stand for themselves, the others are numbered from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Known:
    """Open-addressing table from pre-token hashes to ids, all in arrays."""

    def __init__(self, bits: int = 16) -> None:
        self.bits, self.n = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 if unknown."""
        mask = np.uint64((1 << self.bits) - 1)
        slot = hashes & mask
        seen = self.keys[slot]
        out = np.where(seen == hashes, self.values[slot], np.int32(-1))
        open_ = np.flatnonzero((seen != hashes) & (seen != 0))
        while len(open_):
            slot = (slot if len(slot) == len(open_) else slot[open_]) + np.uint64(1) & mask
            seen, wanted = self.keys[slot], hashes[open_]
            equal = seen == wanted
            out[open_[equal]] = self.values[slot[equal]]
            more = ~equal & (seen != 0)
            open_, slot = open_[more], slot[more]
        return out

    def add(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """Distinct unknown hashes."""
        if 2 * (self.n + len(hashes)) > len(self.keys):
            kept = self.keys != 0
            old = self.keys[kept], self.values[kept]
            self.__init__(self.bits + 1 + int(4 * (self.n + len(hashes)) > 4 * len(self.keys)))
            self.add(*old)
            return self.add(hashes, values)
        mask = np.uint64((1 << self.bits) - 1)
        self.n += len(hashes)
        slot = hashes & mask
        while len(hashes):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[free]
            placed = self.keys[slot] == hashes
            self.values[slot[placed]] = values[placed]
            hashes, values, slot = hashes[~placed], values[~placed], slot[~placed] + np.uint64(1) & mask
        return None


@functools.cache
def encoder(path: str) -> BatchEncoder:
    """The encoder of a vocabulary file, loaded once in a worker."""
    return BatchEncoder(path)


class BatchEncoder:
    """Ids of texts as ``Tokenizer.from_file(path)`` gives them, special-token
    strings taken as ordinary text."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        byte_of = _byte_of()
        special = {t["content"] for t in described["added_tokens"] if t["special"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in described["model"]["vocab"].items() if token not in special}
        # ids are merge ranks in this vocabulary; tests hold the ids against the tokenizers library
        self._piece = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.classes = _classes()
        self.codes = wordstream.mix(np.arange(1, 0x110001, dtype=np.uint64)) | np.uint64(1)
        self._reset()

    def _reset(self) -> None:
        self.known = _Known()
        self.first = np.zeros(1 << 16, np.int32)
        self.pool = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        encoded = list(map(self._piece, pieces))
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        flat = np.fromiter(itertools.chain.from_iterable(encoded), np.uint32, int(sizes.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        at = self.known.n
        while at + len(pieces) + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.first[at + 1 : at + 1 + len(pieces)] = self.used + np.cumsum(sizes)
        self.used += len(flat)
        self.known.add(hashes, np.arange(at, at + len(pieces), dtype=np.int32))

    def _entries(self, hashes: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        entries = self.known.find(hashes)
        missing = np.flatnonzero(entries < 0)
        if len(missing):
            unique, where = np.unique(hashes[missing], return_index=True)
            if self.known.n + len(unique) > CACHE_ENTRIES and self.known.n:
                self._reset()
                return self._entries(hashes, raw, starts, ends)
            chosen = missing[where]
            self._learn(unique, [raw[a:b] for a, b in zip(starts[chosen].tolist(), ends[chosen].tolist(), strict=True)])
            entries[missing] = self.known.find(hashes[missing])
        return entries

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first id of each text and the end) of a run of texts."""
        raw = data.tobytes()
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), "<u4")
        if not len(points):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        byte_at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        at = np.searchsorted(byte_at, offsets)
        starts = pretoken_starts(points, np.unique(at[:-1][np.diff(at) > 0]), self.classes)
        ends = np.append(starts[1:], len(points))
        up, down = wordstream.powers(len(points))
        sums = np.take(self.codes, points)
        sums *= up
        np.cumsum(sums, out=sums)
        hashes = sums[ends - 1]
        hashes[1:] -= hashes[:-1].copy()
        hashes *= down[starts]
        hashes = wordstream.mix(hashes + (ends - starts).astype(np.uint64)) | np.uint64(1)
        entry = self._entries(hashes, raw, byte_at[starts], byte_at[ends])
        low = self.first[entry].astype(np.int64)
        size = self.first[entry + 1] - low
        end = np.cumsum(size)
        ids = self.pool[np.arange(end[-1]) + np.repeat(low - (end - size), size)]
        return ids, np.concatenate([[0], end])[np.searchsorted(starts, at)]

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, first id of each row and the end) per run."""
        for start, end, data, offsets in wordstream.text_slices(column, SLICE_BYTES):
            ids, first = self._slice(data, offsets)
            yield start, end, ids, first
