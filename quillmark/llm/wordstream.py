"""Vectorised word tokenisation and hashing over Arrow text columns.

A batch of texts is handled as one byte array.  Word borders come from a
256-entry class table, and the 64-bit hash of every word from one running sum
of a polynomial modulo 2**64, so no Python code runs per word or character.
All bytes of a multi-byte UTF-8 character are >= 0x80, so byte classes agree
with code point classes for the ASCII-only separators used here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; numpy temporaries take about 40 times that.
SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


#: Numbers of the bytes in word hashes: as they are, and with A-Z as a-z.
EXACT = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLDED = EXACT.copy()
FOLDED[65:91] = EXACT[97:123]


def _class_table(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], dtype=bool)


#: Words between the six ASCII white-space characters.
SPACE_WORDS = _class_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words of ASCII letters, digits and all other non-ASCII characters.
ALNUM_WORDS = _class_table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (in place on a fresh array)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class _Powers:
    """Powers of the polynomial base and its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                powers = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()
powers = _POWERS.upto


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) runs of about ``limit`` bytes.

    Null texts are empty.  A text longer than the limit is a run of its own.
    """
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if not len(column):
        return
    _, offsets_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offsets_buffer, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    if column.null_count:
        lengths = np.where(np.asarray(column.is_null()), 0, lengths)
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        local = offsets[start : end + 1] - offsets[start]
        if not np.array_equal(np.diff(local), lengths[start:end]):  # a null over bytes: compact
            parts = [data[offsets[i] : offsets[i] + lengths[i]] for i in range(start, end)]
            local = np.concatenate([[0], np.cumsum(lengths[start:end])])
            yield start, end, np.concatenate(parts) if parts else data[:0], local
        else:
            yield start, end, data[offsets[start] : offsets[end]], local
        start = end


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, codes: np.ndarray = FOLDED) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and for each text the index of its first word (one
    entry more than texts)."""
    hashes, first, _ = words_and_heads(data, offsets, table, (), codes)
    return hashes, first


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from every word on that has so many from
    there on: a polynomial in the words' hashes, from one running sum."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _POWERS.upto(len(hashes))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up, dtype=np.uint64)])
    return mix((sums[size:] - sums[:n]) * down[:n])


def words_and_heads(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, sizes: tuple[int, ...], codes: np.ndarray = FOLDED) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """As ``words``, and for each size (word index, hash of its first bytes)
    of all words longer than that."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return none[1], np.zeros(len(offsets), np.int64), [none for _ in sizes]
    flags = np.zeros(n + 1, bool)
    flags[:n] = table[data]
    heads = flags[:n].copy()
    heads[1:] &= ~flags[: n - 1]
    borders = offsets[(offsets > 0) & (offsets < n)]
    heads[borders] = flags[borders]
    tails = flags[:n] & ~flags[1:]
    tails[borders - 1] = flags[borders - 1]
    starts, ends = np.flatnonzero(heads), np.flatnonzero(tails)
    up, down = _POWERS.upto(n)
    sums = np.take(codes, data)
    sums *= up
    np.cumsum(sums, out=sums)
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    hashes = mix((sums[ends] - before) * down[starts] + (ends - starts).astype(np.uint64))
    heads = []
    for size in sizes:
        long = np.flatnonzero(ends - starts >= size)
        first = starts[long]
        heads.append((long, mix((sums[first + size - 1] - before[long]) * down[first] + np.uint64(size << 32))))
    return hashes, np.searchsorted(starts, offsets), heads
