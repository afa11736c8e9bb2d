"""Near-duplicate join on word n-gram sets by vertical partitioning.

The global n-gram order is that of 64-bit hashes.  It is cut into fragments,
and every document's set is cut likewise into segments.

1. *Segments as signatures*: sets that can be similar differ in at most ``d``
   n-grams, ``d`` following from their sizes.  Sizes are dealt into groups, one
   for each power of the similarity, and the order is cut into ``k > d``
   fragments for each group; of two similar sets at least ``k - d`` segments
   must be equal.  One pass over the texts sends the hash of every segment to
   its shard.  Equal sets are one class from here on.
2. *Candidates*: short lists of classes with an equal segment give their
   pairs.  Of the segments with long lists a class leaves out the ``k - d - 1``
   most frequent ones, as it must share one of the others with each similar
   class (those that it shares with more are not all left out).
3. *Bound*: a class carries parity bits of its n-grams, 512 or a power of two
   with a bit for each n-gram; the bits in which two classes differ are no more
   than the n-grams in which they differ.  More bits are folded onto fewer.
4. *Partial counts*: for the pairs left, overlaps are counted fragment by
   fragment, separately, and summed per pair; the sum decides.  Each class is
   first held against the most alike of its partners; pairs whose ends are in
   one component by then need no count.  The texts are read again for the sets
   of the pairs to be counted, and only these are dealt out.
5. *Long lists* (groups of many near copies): in each round every class is only
   compared with one hub of its list, and pairs inside a known component are
   never looked at again.  When hubs find little more, the classes of
   *different* components in a list are held against each other block by
   block, and the pairs that pass the bound are counted as in 4.  So no link
   between different components is lost, and no task sees more than two blocks.

Nothing is capped, and every size of input takes these steps.  Sets are held
as 64-bit hashes, so an overlap of two sets of n and m n-grams is wrong with a
probability of about n * m / 2**64, and two sets are taken for equal by 128
bits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm import wordstream
from quillmark.llm.common import discard, free_names, free_shuffles, materialize, only_kept, tidy, tidy_group
from quillmark.llm.components import components

#: Fragments in which overlaps are counted.
FRAGMENT_BITS = 2
#: Fragments of a group beyond the ``d + 1`` it needs, as a part of those.
SPARE = 0.25
#: Classes of one list that are all compared with each other; longer lists go
#: through hubs, and block by block what hubs leave open.
SHORT_LIST = 8
BLOCK = 1024
#: Text for each shard of segments (about 2 million), segments sent at once.
SHARD_BYTES = 32 << 20
CHUNK_SEGMENTS = 1 << 19
#: Hubs are tried on while a round links more than this part of the open rows.
HUB_GAIN = 0.02
#: Least parity bits of a class, as 64-bit words; blocks are compared by as many.
WORDS = 8
#: Pairs whose names go to every task, and whose fragments are counted at once;
#: the fragments of more are counted one after the other.
PAIRS_AT_ONCE = 1 << 12
#: Least and most bits of the filter that picks the sets to read again.
FILTER_BITS = (16, 28)

_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_BITS = [f"w{i}" for i in range(WORDS)]

_DOCS, _OWNERS, _SEGMENTS, _MORE, _PAIR, _HOT = range(6)
_SENT = pa.schema([("shard", pa.int64()), ("kind", pa.int32()), ("chunk", pa.int64()), ("x", pa.binary()), ("y", pa.binary()), ("z", pa.binary())])
_SENT_SQL = "shard long, kind int, chunk long, x binary, y binary, z binary"
_FOUND = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("x", pa.binary()), ("y", pa.binary()), ("z", pa.binary()), ("gram", pa.int64()), ("total", pa.int64()), ("at", pa.int64()), ("chunk2", pa.int64()), ("at2", pa.int64())])
_FOUND_SQL = "kind int, chunk long, x binary, y binary, z binary, gram long, total long, at long, chunk2 long, at2 long"


def _written(df: DataFrame, name: str, by: Iterable[str] = ()) -> DataFrame:
    """A table in the shared folder; the shuffle files it took are deleted
    before the next one takes its own."""
    table = materialize(df, name, by)
    free_shuffles(df.sparkSession)
    return table


# --- sets -------------------------------------------------------------------


def _slice_grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from every word on (fewer at the end)."""
    total = np.full(len(hashes), size, np.uint64)
    for i in range(min(size, len(hashes))):
        total[: len(hashes) - i] += wordstream.mix(hashes[i:] + _K[i % 8]) * _K[(i + 3) % 8] * np.uint64(2 * i + 1)
    return wordstream.mix(total)


def _sets(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[object, int, np.ndarray]]:
    """(doc_id, key, sorted distinct n-gram hashes) of each row of (doc_id,
    text, key)."""
    for batch in batches:
        ids, keys = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for start, end, data, offsets in wordstream.text_slices(batch.column(1)):
            hashes, first = wordstream.words(data, offsets, wordstream.SPACE_WORDS)
            grams = _slice_grams(hashes, size)
            for i in range(end - start):
                low, high = first[i], first[i + 1]
                if high - low > size:
                    out = np.sort(grams[low : high - size + 1])
                    yield ids[start + i], keys[start + i], out[np.concatenate([[True], out[1:] != out[:-1]])]
                else:  # the whole sequence as one; its length is in the hash
                    yield ids[start + i], keys[start + i], _slice_grams(hashes[low:high], high - low)[:1]


def _fingerprint(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def _row_key() -> Column:
    """Rows of equal id and text have equal keys."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _row_key().alias("key"))


def _width(n: int) -> int:
    """Words of the parity bits of a set of ``n``: a bit for each n-gram at
    least, as fewer bits than n-grams that may differ tell nothing."""
    return max(WORDS, (1 << (n - 1).bit_length()) // 64)


def _parity(grams: np.ndarray) -> np.ndarray:
    size = 64 * _width(len(grams))
    bits = np.bincount((grams & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).view("<i8")


# --- groups of sizes --------------------------------------------------------


class _Groups:
    """Largest smaller set of each group, its ``d`` and its ``k``."""

    def __init__(self, percent: int) -> None:
        self.percent, top = percent, [1]
        while top[-1] < 1 << 40:
            top.append(max(top[-1] + 1, 100 * top[-1] // percent))
        self.top = np.array(top)
        self.apart = [(u + 100 * u // percent) * (100 - percent) // (100 + percent) for u in top]
        self.cuts = [d + 1 + math.ceil(SPARE * (d + 1)) for d in self.apart]

    def of(self, n: int) -> range:
        """Groups of the pairs in which a set of ``n`` can stand."""
        low, high = np.searchsorted(self.top, [-(-self.percent * n // 100), n])
        return range(int(low), int(high) + 1)

    def segments(self, grams: np.ndarray, mixed: np.ndarray, group: int) -> tuple[np.ndarray, int]:
        """Hashes of a set's segments, and how many of them it must share
        with a similar set."""
        cuts = self.cuts[group]
        fragment = ((grams >> np.uint64(32)) * np.uint64(cuts)) >> np.uint64(32)
        at = np.flatnonzero(np.concatenate([[True], fragment[1:] != fragment[:-1]]))
        which, sums = fragment[at], np.add.reduceat(mixed, at)
        share = cuts - self.apart[group] - (cuts - len(at))
        if share <= 0:  # so many segments are empty that these may be all it shares
            empty = np.setdiff1d(np.arange(cuts, dtype=np.uint64), which)
            which, sums = np.concatenate([which, empty]), np.concatenate([sums, np.zeros(len(empty), np.uint64)])
        return wordstream.mix(sums + which * _K[0] + np.uint64((group + 1) * int(_K[1]) % (1 << 64))), max(share, 1)


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight together, so that leading zeros compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T).tobytes()


def _values(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


# --- candidates -------------------------------------------------------------


def _sent(docs: DataFrame, size: int, percent: int, shards: int) -> DataFrame:
    """Packed rows, by kind.  _DOCS: x ids and null marks, y set sizes
    and row keys, z fingerprints of the rows of a chunk.  _OWNERS: x (n, group, share) and z
    fingerprints of each class and group of the chunk, y parity bits of each class.
    _SEGMENTS: x sorted hashes, y number of owners of each, z owners.  _MORE:
    x hash and z owner beyond the first ``SHORT_LIST + 1`` in the chunk."""
    groups, short = _Groups(percent), SHORT_LIST

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        seen: set[bytes] = set()
        number = 0
        rows: list[tuple] = []
        owners: list[tuple] = []
        hashes: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            chunk = part | number
            out = [{"shard": chunk % shards, "kind": _DOCS, "chunk": chunk, "x": np.array([0 if r[0] is None else r[0] for r in rows], "<i8").tobytes() + np.array([r[0] is None for r in rows], bool).tobytes(), "y": np.array([r[1:3] for r in rows], "<i8").T.tobytes(), "z": b"".join(r[3] for r in rows)}]
            if owners:
                out.append({"shard": chunk % shards, "kind": _OWNERS, "chunk": chunk, "x": np.array([o[:3] for o in owners], "<i8").tobytes(), "y": b"".join(o[3] for o in owners), "z": b"".join(o[4] for o in owners)})
                every = np.concatenate(hashes)
                who = np.repeat(np.arange(len(owners), dtype=np.int64), [len(h) for h in hashes])
                by = np.argsort(every, kind="stable")
                every, who = every[by], who[by]
                heads = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
                counts = np.diff(np.append(heads, len(every)))
                over = np.arange(len(every)) - np.repeat(heads, counts) > short
                if over.any():
                    out.append({"shard": chunk % shards, "kind": _MORE, "chunk": chunk, "x": _planes(every[over]), "z": _planes(who[over].astype("<u4"))})
                gram, counts, who = every[heads], np.minimum(counts, short + 1), who[~over]
                ends = np.concatenate([[0], np.cumsum(counts)])
                cuts = np.searchsorted(_shards_of(gram, shards), np.arange(shards + 1))
                for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    if b > a:
                        out.append({"shard": s, "kind": _SEGMENTS, "chunk": chunk, "x": _planes(np.diff(gram[a:b], prepend=np.uint64(0))), "y": counts[a:b].astype(np.uint8).tobytes(), "z": _planes(who[ends[a] : ends[b]].astype("<u4"))})
            for row in out:
                yield pa.RecordBatch.from_pylist([row], schema=_SENT)

        for doc, key, grams in _sets(batches, size):
            n = len(grams)
            fp = _fingerprint(grams) if n else bytes(16)
            rows.append((doc, n, key, fp))
            if n and fp not in seen:  # equal sets stand once in a task
                seen.add(fp)
                mixed = wordstream.mix(grams)
                bits = None
                for group in groups.of(n):
                    if groups.apart[group]:
                        found, share = groups.segments(grams, mixed, group)
                        bits = _parity(grams).tobytes() if bits is None else b""  # with the first of its groups
                        owners.append((n, group, share, bits, fp))
                        hashes.append(found)
                        held += len(found)
            if held >= CHUNK_SEGMENTS or len(rows) >= 50_000:
                yield from flush()
                number, held, rows, owners, hashes = number + 1, 0, [], [], []
                if len(seen) > 500_000:
                    seen = set()
        if rows:
            yield from flush()

    return _texts(docs).mapInArrow(tidy(run), _SENT_SQL)


def _shards_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each hash; ascending hashes have ascending shards."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _lists(table: pa.Table, short: int) -> pa.Table:
    """Lists of a shard: the pairs of short ones (_PAIR), the owners in long
    ones (_HOT, with the list's length); other rows pass.

    A chunk sends at most ``SHORT_LIST + 1`` owners of a segment here, however
    many it has, so a segment of all documents costs a shard some ten bytes for
    each chunk of the corpus."""
    passed = table.filter(pc.not_equal(table.column("kind"), _SEGMENTS))
    out = [pa.table({"kind": passed.column("kind"), "chunk": passed.column("chunk"), "x": passed.column("x"), "y": passed.column("y"), "z": passed.column("z"), **{f.name: pa.nulls(len(passed), f.type) for f in list(_FOUND)[5:]}}, schema=_FOUND)]
    rows = table.filter(pc.equal(table.column("kind"), _SEGMENTS)).select(["chunk", "x", "y", "z"]).to_pylist()
    if rows:
        sizes = [np.frombuffer(r["y"], np.uint8) for r in rows]
        gram = np.concatenate([np.repeat(np.cumsum(_values(r["x"], "<u8"), dtype=np.uint64), s) for r, s in zip(rows, sizes, strict=True)])
        at = np.concatenate([_values(r["z"], "<u4") for r in rows])
        chunk = np.repeat(np.array([r["chunk"] for r in rows]), [int(s.sum()) for s in sizes])
        by = np.argsort(gram, kind="stable")
        gram, at, chunk = gram[by], at[by].astype(np.int64), chunk[by]
        heads = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        counts = np.diff(np.append(heads, len(gram)))
        hot = np.repeat(counts > short, counts)
        none = pa.nulls(int(hot.sum()), pa.binary())
        out.append(pa.table({"kind": pa.array(np.full(int(hot.sum()), _HOT, np.int32)), "chunk": chunk[hot], "x": none, "y": none, "z": none, "gram": gram[hot].view(np.int64), "total": np.repeat(counts, counts)[hot], "at": at[hot], "chunk2": pa.nulls(len(none), pa.int64()), "at2": pa.nulls(len(none), pa.int64())}, schema=_FOUND))
        size, place = np.repeat(np.where(counts > short, 0, counts), counts), np.arange(len(gram)) - np.repeat(heads, counts)
        pairs = []
        for step in range(1, short):
            i = np.flatnonzero(place + step < size)
            if not len(i):
                break
            pairs.append(np.stack([chunk[i], at[i], chunk[i + step], at[i + step]], axis=1))
        if pairs:
            unlike = np.unique(np.concatenate(pairs), axis=0)
            nothing = pa.nulls(len(unlike), pa.binary())
            out.append(pa.table({"kind": pa.array(np.full(len(unlike), _PAIR, np.int32)), "chunk": unlike[:, 0], "x": nothing, "y": nothing, "z": nothing, "gram": pa.nulls(len(unlike), pa.int64()), "total": pa.nulls(len(unlike), pa.int64()), "at": unlike[:, 1], "chunk2": unlike[:, 2], "at2": unlike[:, 3]}, schema=_FOUND))
    return pa.concat_tables(out)


def _sets_of(found: DataFrame) -> DataFrame:
    """(doc_id, key, n, fp) of every row of the documents; fp is null if n is 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, z in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                n, keys = np.frombuffer(y, "<i8").reshape(2, -1)
                fps = pa.Array.from_buffers(pa.binary(16), len(n), [None, pa.py_buffer(z)])
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x[: 8 * len(n)], "<i8"), mask=np.frombuffer(x[8 * len(n) :], bool)), pa.array(keys), pa.array(n), pc.if_else(pa.array(n > 0), fps.cast(pa.binary()), pa.scalar(None, pa.binary()))], ["doc_id", "key", "n", "fp"])

    return found.filter(f"kind = {_DOCS}").select("x", "y", "z").mapInArrow(tidy(run), "doc_id long, key long, n long, fp binary")


def _owners(found: DataFrame) -> DataFrame:
    """(chunk, at, fp, n, group, share, bits): the parity bits stand with the
    first group of a class, others have none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, x, y, z in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                numbers, own = np.frombuffer(x, "<i8").reshape(-1, 3), np.frombuffer(z, "<u8").reshape(-1, 2)
                first = np.concatenate([[True], (own[1:] != own[:-1]).any(axis=1)])
                ends = np.concatenate([[0], np.cumsum(np.where(first, [_width(n) for n in numbers[:, 0].tolist()], 0))])
                bits = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(y, "<i8")))
                fps = pa.Array.from_buffers(pa.binary(16), len(own), [None, pa.py_buffer(z)]).cast(pa.binary())
                columns = [np.full(len(own), chunk), np.arange(len(own)), *numbers.T]
                yield pa.RecordBatch.from_arrays([fps, *(pa.array(np.ascontiguousarray(c)) for c in columns), bits], ["fp", "chunk", "at", "n", "group", "share", "bits"])

    return found.filter(f"kind = {_OWNERS}").select("chunk", "x", "y", "z").mapInArrow(tidy(run), "fp binary, chunk long, at long, n long, group long, share long, bits array<long>")


def _more(found: DataFrame) -> DataFrame:
    """(gram, chunk, at) of the owners beyond those a chunk sent to a shard."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, x, z in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                gram = _values(x, "<u8").view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(np.full(len(gram), chunk)), pa.array(_values(z, "<u4").astype(np.int64))], ["gram", "chunk", "at"])

    return found.filter(f"kind = {_MORE}").select("chunk", "x", "z").mapInArrow(tidy(run), "gram long, chunk long, at long")


def _long_lists(found: DataFrame, owners: DataFrame) -> DataFrame:
    """(gram, fp, n): the classes in long lists, without each class's
    ``share - 1`` most frequent segments; lists of one class are left out."""
    hot = found.filter(f"kind = {_HOT}").select("gram", "total", "chunk", "at")
    totals = hot.select("gram", "total").distinct()
    every = hot.unionByName(_more(found).join(totals, "gram").select("gram", "total", "chunk", "at"))
    classes = every.join(owners.select("chunk", "at", "fp", "n", "group", "share"), ["chunk", "at"]).select("gram", "fp", "total", "n", "group", "share").distinct()
    by = Window.partitionBy("fp", "group").orderBy(F.desc("total"), F.desc("gram"))
    kept = _written(classes.withColumn("rank", F.row_number().over(by)).filter("rank >= share").select("gram", "fp", "n"), "kept")
    several = kept.groupBy("gram").agg(F.count("*").alias("k")).filter("k > 1").select("gram")
    lists = _written(kept.join(several, "gram", "left_semi"), "long")
    discard(kept)
    return lists


_CLASS = ("fp", "n", *_BITS)


def _side(names: Iterable[str], suffix: str) -> list[Column]:
    return [F.col(c).alias(f"{c}{suffix}") for c in names]


def _fits(percent: int) -> str:
    """SQL: sizes of the two sides allow the similarity."""
    return f"100 * least(na, nb) >= {percent} * greatest(na, nb)"


def _folded(bits: str, words: str) -> str:
    """SQL: parity bits, folded onto ``words`` words."""
    return f"if(size({bits}) = {words}, {bits}, transform(sequence(0, {words} - 1), i -> aggregate(sequence(i, size({bits}) - 1, {words}), 0L, (x, j) -> x ^ {bits}[j])))"


def _apart() -> str:
    """SQL: parity bits in which the two sides differ."""
    one, two = (_folded(bits, "least(size(bitsa), size(bitsb))") for bits in ("bitsa", "bitsb"))
    return f"aggregate(zip_with({one}, {two}, (x, y) -> bit_count(x ^ y)), 0, (x, y) -> x + y)"


def _can_link(percent: int) -> str:
    """SQL: bits in which the two sides differ allow the similarity."""
    return f"{100 + percent} * ((na + nb - apart) div 2) >= {percent} * (na + nb)"


def _ordered(pairs: DataFrame) -> DataFrame:
    """(a, b, na, nb) of pairs (fpa, fpb, na, nb), each once: in the order of
    the first round's hubs, so that a hub is the ``a`` of its pairs."""
    swap = F.xxhash64(F.lit(0), "fpa") > F.xxhash64(F.lit(0), "fpb")
    return pairs.select(*(F.when(swap, F.col(y)).otherwise(F.col(x)).alias(name) for x, y, name in (("fpa", "fpb", "a"), ("fpb", "fpa", "b"), ("na", "nb", "na"), ("nb", "na", "nb")))).distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    """(fp): the classes of pairs (a, b)."""
    return pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()


def _bounded(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Of pairs (fpa, fpb, na, nb) those that can be linked, each once, and in
    how many bits they differ: sizes first, then the parity bits of what is
    left."""
    unlike = _written(_ordered(pairs.filter("fpa <> fpb").filter(_fits(percent))), "unlike")
    named = _named(bits, _ends(unlike), unlike.count() <= PAIRS_AT_ONCE)
    one, two = named.select(F.col("fp").alias("a"), F.col("bits").alias("bitsa")), named.select(F.col("fp").alias("b"), F.col("bits").alias("bitsb"))
    apart = unlike.join(one, "a").join(two, "b").select("a", "b", "na", "nb", F.expr(_apart()).alias("apart"))
    bounded = _written(apart.filter(_can_link(percent)), "bounded")
    discard(unlike)
    return bounded


def _one_each(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b, na, nb, apart) that of each ``b`` with the most alike
    ``a``: a forest, as ``a`` comes first in the order of the pairs."""
    best = F.min_by(F.struct("a", "na", "nb"), F.struct("apart", "a"))
    return pairs.groupBy("b").agg(best.alias("best")).select("best.a", "b", "best.na", "best.nb")


def _still_apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components so far."""
    for end in ("a", "b"):
        own = labels.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
        pairs = pairs.join(own, end, "left")
    return pairs.filter("coalesce(root_a, a) <> coalesce(root_b, b)").drop("root_a", "root_b")


def _short_pairs(found: DataFrame, owners: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    pairs = found.filter(f"kind = {_PAIR}").select("chunk", "at", "chunk2", "at2").distinct()
    one = owners.select("chunk", "at", *_side(("fp", "n"), "a"))
    two = owners.select(F.col("chunk").alias("chunk2"), F.col("at").alias("at2"), *_side(("fp", "n"), "b"))
    return _bounded(pairs.join(one, ["chunk", "at"]).join(two, ["chunk2", "at2"]).select("fpa", "fpb", "na", "nb"), bits, percent)


def _hub_pairs(open_lists: DataFrame, bits: DataFrame, round_no: int, percent: int) -> DataFrame:
    """Every class of a list with the list's hub of this round, where they can
    be linked."""
    hubs = open_lists.groupBy("gram").agg(F.min(F.struct(F.xxhash64(F.lit(round_no), "fp").alias("h"), "fp", "n", "label")).alias("hub"))
    hub = hubs.select("gram", *(F.col(f"hub.{c}").alias(f"{c}b") for c in ("fp", "n", "label")))
    pairs = open_lists.select("gram", *_side(("fp", "n", "label"), "a")).join(hub, "gram").filter("labela <> labelb")
    return _bounded(pairs.select("fpa", "fpb", "na", "nb"), bits, percent)


#: Lists that a class names, so that a pair is passed on from one of them.
NAMED_LISTS = 8


def _cross_pairs(open_lists: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """All pairs of classes of different components in a list that can be
    linked, found block by block.  A pair in many lists comes from the first
    that both classes name (a class names its first NAMED_LISTS; pairs that
    name none in common come from each)."""
    sizes = open_lists.groupBy("gram").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    first = F.row_number().over(Window.partitionBy("fp").orderBy("gram"))
    named = open_lists.withColumn("i", first).filter(f"i <= {NAMED_LISTS}").groupBy("fp").agg(F.array_sort(F.collect_list("gram")).alias("lists"))
    words = [F.expr(f"aggregate(sequence({i}, size(bits) - 1, {WORDS}), 0L, (x, j) -> x ^ bits[j])").alias(w) for i, w in enumerate(_BITS)]
    described = bits.select("fp", *words).join(named, "fp").select("fp", "lists", *_BITS)
    rows = open_lists.join(sizes, "gram").join(described, "fp").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    copies = rows.withColumn("other", other).select("gram", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "label", "lists", *_CLASS)

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        block = table.column("block").to_numpy()
        gram, low, high = (k.as_py() for k in key)
        n = table.column("n").to_numpy()
        bits = np.stack([table.column(w).to_numpy() for w in _BITS], axis=1).view(np.uint64)
        lists = np.full((len(table), NAMED_LISTS), gram)
        for at, names in enumerate(table.column("lists").to_pylist()):
            lists[at, : len(names)] = names
        label = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        order = right[np.argsort(n[right], kind="stable")]
        sizes = n[order]
        a, b = [], []
        for i in left:
            x = int(n[i])
            near = order[np.searchsorted(sizes, -(-percent * x // 100)) : np.searchsorted(sizes, 100 * x // percent, "right")]
            near = near[(label[near] != label[i]) & (near > i if low == high else True)]
            if len(near):
                apart = np.bitwise_count(bits[near] ^ bits[i]).sum(axis=1, dtype=np.int64)
                both = x + n[near]
                near = near[(100 + percent) * ((both - apart) // 2) >= percent * both]
            if len(near):
                same = (lists[near][:, :, None] == lists[i][None, None, :]).any(axis=2)
                near = near[np.where(same, lists[near], gram).min(axis=1) == gram]
                a.append(np.full(len(near), i))
                b.append(near)
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        fp = table.column("fp").combine_chunks()
        return pa.table({"fpa": fp.take(pa.array(a)), "fpb": fp.take(pa.array(b)), "na": n[a], "nb": n[b]})

    return _bounded(copies.groupBy("gram", "i", "j").applyInArrow(compare, "fpa binary, fpb binary, na long, nb long"), bits, percent)


# --- partial counts ---------------------------------------------------------


def _filter_of(fps: DataFrame) -> tuple[np.ndarray, int]:
    """Bit filter over fingerprints, of a size that follows their number up to
    a greatest one; beyond that more sets are sent, and dropped by a join."""
    bits = min(max(math.ceil(math.log2(16 * max(1, fps.count()))), FILTER_BITS[0]), FILTER_BITS[1])
    chunk_bits = min(16, bits)

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        marks = np.zeros(1 << chunk_bits, bool)
        marks[table.column("bit").to_numpy()] = True
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(marks).tobytes()], pa.binary())})

    h = F.conv(F.hex(F.substring("fp", 1, 4)), 16, 10).cast("long").bitwiseAND((1 << bits) - 1)  # fingerprints are hashes
    places = fps.select(F.shiftright(h, chunk_bits).alias("chunk"), h.bitwiseAND((1 << chunk_bits) - 1).alias("bit")).distinct()
    out = np.zeros((1 << bits) // 8, np.uint8)
    step = (1 << chunk_bits) // 8
    for row in places.groupBy("chunk").applyInArrow(fill, "chunk long, bits binary").toLocalIterator():
        out[row.chunk * step : (row.chunk + 1) * step] = np.frombuffer(row.bits, np.uint8)
    return out, bits


def _marked(marks: np.ndarray, bits: int, first: np.ndarray) -> np.ndarray:
    """Which of the numbers in the first 32 bits of fingerprints a filter has."""
    at = first & ((1 << bits) - 1)
    return marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 > 0


def _segments(docs: DataFrame, size: int, names: DataFrame) -> DataFrame:
    """(fp, fragment, segment): the sets named in ``names``, once each, cut at
    the fragments' borders.  The texts are read where they lie."""
    borders = np.arange(1, 1 << FRAGMENT_BITS, dtype=np.uint64) << np.uint64(64 - FRAGMENT_BITS)
    shared = docs.sparkSession.sparkContext.broadcast(_filter_of(names))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, bits = shared.value
        seen: set[bytes] = set()
        held: list[tuple[bytes, int, np.ndarray]] = []
        count = 0

        def flush() -> pa.RecordBatch:
            ends = np.concatenate([[0], np.cumsum([len(h[2]) for h in held])]).astype(np.int32)
            values = pa.array(np.concatenate([h[2] for h in held]).view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.binary()), pa.array([h[1] for h in held], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), values)], ["fp", "fragment", "segment"])

        for _, _, grams in _sets(batches, size):
            if not len(grams):
                continue
            fp = _fingerprint(grams)
            at = int.from_bytes(fp[:4], "big") & ((1 << bits) - 1)
            if not marks[at >> 3] >> (7 - (at & 7)) & 1 or fp in seen:
                continue
            seen.add(fp)
            for fragment, part in enumerate(np.split(grams, np.searchsorted(grams, borders))):
                if len(part):
                    held.append((fp, fragment, part))
                    count += len(part)
            if count > 200_000:
                yield flush()
                held, count = [], 0
        if held:
            yield flush()

    found = _texts(docs).mapInArrow(tidy(run), "fp binary, fragment int, segment array<long>")
    return _written(found.join(names, "fp", "left_semi").dropDuplicates(["fp", "fragment"]), "segments", ["fragment"])


def _named(table: DataFrame, names: DataFrame, few: bool) -> DataFrame:
    """Rows of ``table`` whose ``fp`` is in ``names`` (of many names, and a
    few others): only these are dealt out."""
    if few:
        return table.join(F.broadcast(names), "fp", "left_semi")
    shared = table.sparkSession.sparkContext.broadcast(_filter_of(names))

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, bits = shared.value
        for batch in batches:
            first = np.frombuffer(b"".join(fp[:4] for fp in batch.column("fp").to_pylist()), ">u4").astype(np.int64)
            yield batch.filter(pa.array(_marked(marks, bits, first)))

    return table.mapInArrow(tidy(pick), table.schema)


def _links(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b, na, nb), those whose summed partial overlaps reach
    the similarity."""
    few = pairs.count() <= PAIRS_AT_ONCE
    ends = {end: pairs.select(F.col(end).alias("fp")).distinct() for end in ("a", "b")}
    parts = []
    for part in [segments] if few else [segments.filter(F.col("fragment") == i) for i in range(1 << FRAGMENT_BITS)]:
        one = _named(part, ends["a"], few).select(F.col("fp").alias("a"), "fragment", F.col("segment").alias("one"))
        two = _named(part, ends["b"], few).select(F.col("fp").alias("b"), "fragment", F.col("segment").alias("two"))
        parts.append(_written(pairs.join(one, "a").join(two, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("one", "two")).cast("long").alias("common")), "partial"))
        del one, two
    summed = reduce(DataFrame.unionByName, parts).groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
    links = _written(summed.filter(f"100 * common >= {percent} * (na + nb - common)").select("a", "b"), "links")
    for part in parts:
        discard(part)
    return links


# --- components -------------------------------------------------------------


def _linked(docs: DataFrame, found: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, root) over the fingerprints that have a link."""
    owners = _written(_owners(found), "owners")
    bits = _written(owners.filter("size(bits) > 0").select("fp", "bits").dropDuplicates(["fp"]), "bits")
    short = _short_pairs(found, owners, bits, percent)
    lists = _long_lists(found, owners)
    discard(owners)
    listed = lists.withColumn("label", F.col("fp"))
    hubs = _hub_pairs(listed, bits, 0, percent)
    candidates = _written(hubs.unionByName(short).distinct(), "pairs")
    discard(short)
    discard(hubs)
    first = _written(_one_each(candidates), "first")
    segments = _segments(docs, size, _ends(first))
    links = _links(first, segments, percent)
    discard(segments)
    labels = _joined(None, links)
    # most classes are linked by now: what is left of the pairs goes with the next ones
    rest = _written(_still_apart(candidates.join(first.select("a", "b"), ["a", "b"], "left_anti"), labels).select("a", "b", "na", "nb"), "rest")
    discard(candidates)
    round_no = 0
    while True:
        listed = lists.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("root", "fp")).drop("root")
        several = listed.groupBy("gram").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("gram")
        open_lists = _written(listed.join(several, "gram", "left_semi"), "open")
        left = open_lists.count()
        if not left or links.count() <= HUB_GAIN * left:
            break
        round_no += 1
        if round_no == 1:  # lists that are closed stay so: these are all that any later round asks for
            segments = _segments(docs, size, open_lists.select("fp").unionByName(_ends(rest)).distinct())
        hubs = _hub_pairs(open_lists, bits, round_no, percent).select("a", "b", "na", "nb")
        links = _links(_written(hubs.unionByName(rest).distinct(), "pairs"), segments, percent)
        labels, rest = _joined(labels, links), rest.limit(0)
    if left:
        cross = _cross_pairs(open_lists, bits, percent).select("a", "b", "na", "nb")
        rest = _written(cross.unionByName(rest).distinct(), "pairs")
    if not rest.limit(1).count():
        return labels
    if not round_no:
        segments = _segments(docs, size, _ends(rest))
    return _joined(labels, _links(rest, segments, percent))


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    edges = links if labels is None else links.unionByName(labels.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return _written(components(edges), "components")


def classes(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, key, n, fp, root) of every row; root is null without words."""
    spark = docs.sparkSession
    shards = max(16, math.ceil((docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0) / SHARD_BYTES))
    short = SHORT_LIST
    found = materialize(_sent(docs, size, percent, shards).groupBy("shard").applyInArrow(tidy_group(lambda key, table: _lists(table, short)), _FOUND_SQL), "lists")
    free_shuffles(spark)
    linked = _linked(docs, found, size, percent)
    return _sets_of(found).join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("doc_id", "key", "n", "fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """Components of documents linked by 100 * overlap >= percent * union.

    Words are runs other than ASCII white space, A-Z lower-cased; a set holds
    the distinct ``size``-word shingles (a shorter text: the whole sequence).
    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable by
    links, itself included), n_copies (documents with exactly its set).

    Null texts, empty texts and texts without words have size 0 and are linked
    with nothing; rows with a null doc_id link others but are named by their
    component's smallest id, null if it has none; repeated rows are rows of
    one class; other columns are ignored; an empty table gives no rows.
    """
    rows = materialize(classes(docs, size, percent), "classes")
    by_class = rows.filter("n > 0").groupBy("fp", "root").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"))
    least = by_class.groupBy("root").agg(F.min("id").alias("component_id"))
    labels = by_class.join(least, "root").select("fp", "copies", "component_id")
    return rows.select("doc_id", "n", "fp").join(labels, "fp", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("copies", F.lit(1).cast("long")).alias("n_copies")
    )


def _asked(keys: DataFrame) -> Callable[[Column], Column]:
    """Whether a row key is in ``keys`` (of one column), and of a few others."""
    key = F.col(keys.columns[0])
    shared = keys.sparkSession.sparkContext.broadcast(_filter_of(keys.select(F.unhex(F.lpad(F.hex(key), 16, "0")).alias("fp"))))

    @F.arrow_udf("boolean")
    def asked(keys: pa.Array) -> pa.Array:
        marks, bits = shared.value
        return pa.array(_marked(marks, bits, keys.to_numpy(zero_copy_only=False) >> 32))

    return asked


def first_of_each_group(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest
    doc_id (null only if all are), of rows that repeat an id the one with the
    smallest key, of equal rows any one.

    Rows without words are in no group and stay; other columns are kept as
    they are; an empty table stays empty.
    """
    with only_kept(docs.sparkSession) as keep:
        rows = keep(materialize(classes(docs, size, percent).filter("n > 0").select("doc_id", "key", "root"), "rows"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "key")).alias("first")).select("root", "first")
    own, key = free_names(docs, "id", "key")
    names = [F.col("doc_id").alias(own), F.col("key").alias(key)]
    other = materialize(rows.join(first, "root").filter("key <> first.key OR NOT doc_id <=> first.doc_id").select(*names).distinct(), "others")
    again = materialize(rows.groupBy(*names).agg(F.count("*").alias("k")).filter("k > 1").drop("k"), "again")
    marked = docs.withColumn(key, _row_key())
    asked = _asked(other.select(key).unionByName(again.select(key)).distinct())(F.col(key))
    clear, marked = marked.filter(~asked), marked.filter(asked)  # whole texts: only what a join may ask for is dealt out

    def same(table: DataFrame) -> Column:  # an id and a hash: rows of different ids are never taken for each other
        return (marked[key] == table[key]) & F.col("doc_id").cast("long").eqNullSafe(table[own])

    kept = marked.join(other, same(other), "left_anti")
    if again.limit(1).count():  # rows that are equal to one another
        once = kept.join(again, same(again), "left_semi").withColumn(own, F.col("doc_id").cast("long")).dropDuplicates([own, key]).drop(own)
        kept = kept.join(again, same(again), "left_anti").unionByName(once)
    return clear.select(*docs.columns).unionByName(kept.select(*docs.columns))
