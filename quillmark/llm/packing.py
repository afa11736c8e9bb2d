"""Best-fit packing of tokenised documents into sequences of fixed length.

Bulk-synchronous best fit: pieces are ordered by length, longest first; open
gaps are ordered by size; each length is matched with its successor, the
smallest gap that holds it, many at a time; pieces that want the same gaps are
served by their rank within the length; gaps are updated; and so on.  This is
exactly best-fit decreasing.

Lengths are integers of at most ``max_tokens``, so both ordered lists are runs
of equal values.  The sweeps work on runs: their state is the histogram of
lengths and the runs of equal gaps (each length leaves at most two runs more
than it found), which does not grow with the corpus.  Everything that does
grow - tokens, pieces, ranks and places - stays distributed: ranks within a
length come from counts per (length, bucket) and a row number inside each
bucket, and every piece finds its place by its rank alone.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import materialize, tidy

MAX_TOKENS = 1024
END_ID = 2
#: Pieces ranked by one task.
BUCKET_ROWS = 4000

_PIECES = "key string, doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Tokenised documents, cut where longer than ``max_tokens``: the first
    piece takes the remainder, the others are full."""
    schema = pa.schema([("key", pa.string()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.list_(pa.int32()))] if keep_ids else []))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from quillmark.llm.tokens import encoder

        task, row = uuid.uuid4().hex, 0
        end = np.array([end_id], "<u4")
        for batch in batches:
            names = batch.column(0).to_pylist()
            for low, high, ids, first in encoder(tokenizer_path).encode(batch.column(1)):
                out: dict[str, list] = {n: [] for n in schema.names}
                for i in range(high - low):
                    own = np.concatenate([ids[first[i] : first[i + 1]].astype("<u4"), end])
                    begin = 0
                    stop = len(own) % max_tokens or max_tokens
                    number = 0
                    while begin < len(own):
                        part = own[begin:stop]
                        values = (f"{task}-{row}", names[low + i], number, begin, len(part), zlib.crc32(part.tobytes()))
                        for n, v in zip(schema.names, values, strict=False):
                            out[n].append(v)
                        if keep_ids:
                            out["ids"].append(part.astype(np.int32))
                        begin, stop, number = stop, stop + max_tokens, number + 1
                    row += 1
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(tidy(cut), _PIECES + (", ids array<int>" if keep_ids else ""))


def plan(histogram: dict[int, int], max_tokens: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places by rank: (length, first rank, end rank, first sequence, pieces
    of this length in each sequence, offset of the first of them)."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # size -> runs (first sequence, sequences)
    sizes: list[int] = []  # of gaps there are, ascending
    places: list[tuple[int, int, int, int, int, int]] = []
    opened = 0

    def leave(size: int, run: tuple[int, int]) -> None:
        if size > 0:
            if size not in gaps:
                gaps[size] = []
                bisect.insort(sizes, size)
            gaps[size].append(run)

    for length in sorted(histogram, reverse=True):
        rank, total = 0, histogram[length]
        at = bisect.bisect_left(sizes, length)
        while rank < total:
            if at < len(sizes):  # the successor gap
                size = sizes[at]
                first, n = gaps[size].pop()
                if not gaps[size]:
                    del gaps[size]
                    sizes.pop(at)
            else:
                size, first = max_tokens, opened
                n = -(-(total - rank) // (max_tokens // length))
                opened += n
            each = size // length
            full = min(n, (total - rank) // each)
            if full:
                places.append((length, rank, rank + full * each, first, each, max_tokens - size))
                leave(size - each * length, (first, full))
                rank += full * each
            if full < n:
                rest = total - rank
                if rest:
                    places.append((length, rank, total, first + full, rest, max_tokens - size))
                    leave(size - rest * length, (first + full, 1))
                    rank, full = total, full + 1
                if full < n:
                    leave(size, (first + full, n - full))
            at = bisect.bisect_left(sizes, length)
    return places


def _ranked(cut: DataFrame, rows: int) -> DataFrame:
    """Rank of each piece among those of its length, from 0, by bucket counts."""
    buckets = max(1, -(-rows // BUCKET_ROWS))
    keyed = cut.withColumn("bucket", F.pmod(F.xxhash64("key", "piece"), F.lit(buckets)))
    counts = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    number = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("key", "piece"))
    return keyed.withColumn("number", number).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("number") - 1).drop("bucket", "number", "before")


def pack(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """All documents as pieces placed in sequences of at most ``max_tokens``.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset (and
    the ids with ``keep_ids``).  Null and empty texts are one piece of the end
    id alone; null and repeated doc_ids are documents like any other; other
    columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer_path, max_tokens, end_id, keep_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most max_tokens rows
    places = np.array(plan(histogram, max_tokens), np.int64).reshape(-1, 6)
    keys = places[:, 0] << 40 | places[:, 1]
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], places[order]))
    narrow = cut.drop("ids")
    ranked = _ranked(narrow, sum(histogram.values())).select("key", "doc_id", "piece", "start", "length", "ids_crc32", "rank")

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, places = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            own = places[np.searchsorted(keys, length << 40 | rank, "right") - 1]
            within = rank - own[:, 1]
            sequence = own[:, 3] + within // own[:, 4]
            offset = own[:, 5] + within % own[:, 4] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(6)), pa.array(sequence), pa.array(offset)], [*batch.schema.names[:6], "sequence_id", "offset"])

    placed = ranked.mapInArrow(tidy(put), _PIECES + ", sequence_id long, offset long")
    if keep_ids:
        placed = placed.join(cut.select("key", "piece", "ids"), ["key", "piece"])
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if keep_ids else []))
