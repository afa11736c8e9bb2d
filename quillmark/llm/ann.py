"""Approximate nearest neighbours by inner product: a hash-prefix forest.

Vectors are lifted by one component to a common length, so the largest inner
product is the smallest angle, and every tree gives each vector a string of
random-hyperplane bits.  A tree is the sorted array of those strings, cut by
their first bits into shards of bounded size that tasks hold one at a time.  A
query descends to its longest prefix matches in all trees and then ascends in
all of them at once, level by level, until enough entries of one tree share a
prefix with it; all that any tree has there are scored exactly.

How long a prefix must at least be shared is fitted on a bounded sample: for
``SAMPLE_QUERIES`` queries the true neighbours are found by brute force, and
the longest level is taken at which ``TARGET_RECALL`` of them share a prefix
in some tree.  Every vector is indexed.  Equal vectors are one entry with their
``k + 1`` smallest ids, which is all that any result can show of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import materialize

TREES = 32
BITS = 32
SHARD_ROWS = 20_000
SAMPLE_QUERIES = 64
TARGET_RECALL = 0.95
SEED = 7
_QUERIES_AT_ONCE = 512


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of rows that take part: an id, and a vector of finite
    components, not all zero, of the most common dimension (no inner product
    is defined between two dimensions).  Single precision stays so, all other
    numbers are held in double precision."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind if kind == "array<float>" else "array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return rows.filter(F.size("v") == (common[0].d if common else 0))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dimension)


def _norm(v: Column) -> Column:
    """Length of a vector, without the squares of its largest component."""
    largest = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    return F.get(F.transform(F.array(largest), lambda m: m * F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x / m) * (x / m)))), F.lit(0))


def _planes(dimension: int) -> np.ndarray:
    """One random rotation's rows after another: bits of a tree differ most."""
    rng = np.random.default_rng(SEED)
    blocks, need = [], TREES * BITS
    while need > 0:
        q, _ = np.linalg.qr(rng.standard_normal((dimension + 1, dimension + 1)))
        blocks.append(q[:need])
        need -= len(blocks[-1])
    return np.concatenate(blocks).T.astype(np.float32)


def _hashes(x: np.ndarray, planes: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """(rows, TREES) bit strings of BITS bits as integers."""
    x = x.astype(np.float64) / longest  # what is on which side of a plane doesn't change
    lift = np.zeros(len(x)) if query else np.sqrt(np.maximum(1 - (x * x).sum(1), 0))
    bits = (np.column_stack([x, lift]).astype(np.float32) @ planes > 0).reshape(len(x), TREES, BITS)
    return bits @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, in one fixed order of addition."""
    return (x.astype(np.float64) * q.astype(np.float64)).sum(axis=1)


def _best(x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, rough: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best rows, ties to smaller ids."""
    if len(rough) > k:
        limit = np.partition(rough, len(rough) - k)[len(rough) - k]
        chosen = np.flatnonzero(rough >= limit - 1e-9 * max(1.0, abs(limit)))
    else:
        chosen = np.arange(len(rough))
    score = _scores(x[chosen], q)
    order = np.lexsort((ids[chosen], -score))[:k]
    return ids[chosen[order]], score[order]


def _top(frame: DataFrame, k: int, item: str = "rid") -> DataFrame:
    best = frame.groupBy("q", item).agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc(item)))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k)


def _fitted_level(entries: DataFrame, sample: pd.DataFrame, k: int, dimension: int, planes: np.ndarray, longest: float) -> int:
    """Longest prefix that TARGET_RECALL of the sample's true neighbours share."""
    queries = np.array(sample["v"].tolist(), np.float64).reshape(-1, dimension)
    shared = entries.sparkSession.sparkContext.broadcast((sample["rid"].to_numpy(), queries, planes))

    def brute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries, planes = shared.value
        wanted = _hashes(queries, planes, longest, True)
        for batch in batches:
            x, ids = _matrix(batch.column(1), dimension), batch.column(0).to_numpy()
            rough = queries.astype(np.float64) @ x.T.astype(np.float64)
            own = _hashes(x, planes, longest, False)
            place = {int(i): n for n, i in enumerate(ids)}
            out = []
            for i, name in enumerate(names):
                near, score = _best(x, ids, queries[i], k + 1, rough[i])
                for other, s in zip(near.tolist(), score.tolist(), strict=True):
                    if other != name:
                        differ = own[place[other]] ^ wanted[i]
                        level = BITS - int(min(d.bit_length() for d in map(int, differ)))
                        out.append((int(name), other, s, level))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ([], [], [], []), (pa.int64(), pa.int64(), pa.float64(), pa.int32()), strict=True)], ["q", "rid", "score", "level"])

    found = entries.select("rid", "v").mapInArrow(brute, "q long, rid long, score double, level int")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rid"))
    levels = np.array([r.level for r in found.withColumn("rank", rank).filter(F.col("rank") <= k).select("level").collect()])
    if not len(levels):
        return 0
    return max(level for level in range(BITS + 1) if (levels >= level).mean() >= TARGET_RECALL or level == 0)


def search(vectors: DataFrame, is_query: Column, k: int = 20, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` (a
    condition on vec_id) names, its k nearest other rows, nearest first, ties
    to the smaller vec_id; all other rows if there are no more than k.

    Null, zero and non-finite vectors and rows without id take no part, nor do
    vectors of another dimension than most; scores are exact on the vectors as
    given, in single or double precision; rows that repeat an id are rows of
    their own, and no row of the query's id is a neighbour; other columns are
    ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = materialize(usable(vectors), "vectors")
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    few = materialize(rows.withColumn("_n", F.row_number().over(by_vector)).filter(F.col("_n") <= k + 1).withColumn("rid", F.min("vec_id").over(Window.partitionBy("v"))), "few")
    entries = materialize(few.filter("_n = 1").select("rid", "v"), "entries")
    asked = rows.filter(is_query).select("vec_id", "v")
    head = entries.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"), F.max(_norm(F.col("v"))).alias("longest")).first()
    named = materialize(asked.select("v").distinct().join(entries, "v").select("rid", "v"), "queries")
    if not head.n:
        return _shown(spark.createDataFrame([], "q long, rid long, score double"), few, asked, named, k)
    dimension, longest = head.d, float(head.longest) * (1 + 1e-6)
    planes = _planes(dimension)
    sample = named.orderBy(F.xxhash64("rid")).limit(SAMPLE_QUERIES).toPandas()
    level = _fitted_level(entries, sample, k, dimension, planes, longest) if len(sample) else 0
    head_bits = max(0, int(np.ceil(np.log2(max(1, head.n / shard_rows)))))
    shared = spark.sparkContext.broadcast(planes)

    def strings(query: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low in range(0, batch.num_rows, 1000):
                    part = batch.slice(low, 1000)
                    h = _hashes(_matrix(part.column(1), dimension), shared.value, longest, query)
                    n = part.num_rows
                    owner = pa.array(np.repeat(np.arange(n), TREES))
                    tree = pa.array(np.tile(np.arange(TREES, dtype=np.int32), n))
                    yield pa.RecordBatch.from_arrays([tree, pa.array(h.ravel()), part.column(0).take(owner), part.column(1).take(owner)], ["tree", "hash", "rid", "v"])

        return run

    schema = f"tree int, hash long, rid long, v {entries.schema['v'].dataType.simpleString()}"
    prefix = F.shiftright("hash", BITS - head_bits) if head_bits else F.lit(0).cast("long")
    index = entries.select("rid", "v").mapInArrow(strings(False), schema).withColumn("shard", prefix)
    queries = materialize(named.select("rid", "v").mapInArrow(strings(True), schema).withColumn("shard", prefix), "strings")

    # how many entries share a prefix of each length, tree by tree
    sizes = index.groupBy("tree", "shard").agg(F.count("*").alias("n")).toPandas()  # TREES * rows / shard_rows rows
    held = np.zeros((TREES, 1 << head_bits), np.int64)
    held[sizes["tree"].to_numpy(), sizes["shard"].to_numpy()] = sizes["n"].to_numpy()
    stop = _stop_levels(index.select("tree", "shard", "hash"), queries.select("tree", "shard", "hash", "rid"), held, head_bits, level, 4 * (k + 1))
    sent = queries.join(stop, "rid")
    low = F.expr(f"shiftleft(shiftright(shard, {head_bits} - least(stop, {head_bits})), {head_bits} - least(stop, {head_bits}))")
    sent = sent.withColumn("to", F.explode(F.sequence(low, low + F.expr(f"shiftleft(1L, {head_bits} - least(stop, {head_bits}))") - 1))).select("tree", F.col("to").alias("shard"), "hash", "rid", "v", "stop")
    found = _candidates(index, sent, dimension, k + 1)
    return _shown(found, few, asked, named, k)


def _stop_levels(index: DataFrame, queries: DataFrame, held: np.ndarray, head_bits: int, level: int, enough: int) -> DataFrame:
    """(rid, stop): the longest level, ``level`` at most, at which one tree
    alone has ``enough`` entries; 0 if none has.

    Entries of one tree are distinct and at most one is the query's own, so
    what all trees find can't be repeats of a few."""
    shared = index.sparkSession.sparkContext.broadcast(held)
    deepest = max(level, head_bits)

    def count(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        strings = np.sort(left["hash"].to_numpy(np.int64))
        asked = right["hash"].to_numpy(np.int64)
        out = np.zeros((len(asked), deepest + 1), np.int64)
        for at in range(deepest + 1):
            if at >= head_bits:
                base = asked >> (BITS - at)
                out[:, at] = np.searchsorted(strings, (base + 1) << (BITS - at)) - np.searchsorted(strings, base << (BITS - at))
            else:
                sums = shared.value[tree].reshape(1 << at, -1).sum(axis=1)
                out[:, at] = sums[asked >> (BITS - at)]
        return pd.DataFrame({"rid": right["rid"].to_numpy(np.int64)} | {f"c{i}": out[:, i] for i in range(deepest + 1)})

    counts = index.groupBy("tree", "shard").cogroup(queries.groupBy("tree", "shard")).applyInPandas(count, "rid long" + "".join(f", c{i} long" for i in range(deepest + 1)))
    most = counts.groupBy("rid").agg(*(F.max(f"c{i}").alias(f"c{i}") for i in range(deepest + 1)))
    stop = F.lit(0)
    for at in range(1, level + 1):
        stop = F.when(F.col(f"c{at}") >= enough, F.lit(at)).otherwise(stop)
    return materialize(most.select("rid", stop.alias("stop")), "stop")


def _candidates(index: DataFrame, sent: DataFrame, dimension: int, k: int) -> DataFrame:
    """(q, rid, score): the best k of each query in each shard it reaches."""

    def score(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names, near, scores = [], [], []
        if len(left) and len(right):
            order = np.argsort(left["hash"].to_numpy(np.int64), kind="stable")
            strings = left["hash"].to_numpy(np.int64)[order]
            x = np.stack(left["v"].to_numpy())[order].reshape(-1, dimension)
            ids = left["rid"].to_numpy(np.int64)[order]
            q = np.stack(right["v"].to_numpy()).reshape(-1, dimension)
            asked, stop, rid = (right[c].to_numpy(np.int64) for c in ("hash", "stop", "rid"))
            base = asked >> (BITS - stop)
            low, high = np.searchsorted(strings, base << (BITS - stop)), np.searchsorted(strings, (base + 1) << (BITS - stop))
            together = np.lexsort((high, low))
            cuts = np.flatnonzero(np.diff(low[together]) | np.diff(high[together])) + 1
            for group in np.split(together, cuts):
                a, b = low[group[0]], high[group[0]]
                for part in np.array_split(group, -(-len(group) // _QUERIES_AT_ONCE)) if b > a else ():
                    rough = q[part].astype(np.float64) @ x[a:b].T.astype(np.float64)
                    for row, i in enumerate(part):
                        found, s = _best(x[a:b], ids[a:b], q[i], k, rough[row])
                        names.append(np.full(len(found), rid[i]))
                        near.append(found)
                        scores.append(s)
        if not names:
            return pd.DataFrame({"q": np.zeros(0, np.int64), "rid": np.zeros(0, np.int64), "score": np.zeros(0)})
        return pd.DataFrame({"q": np.concatenate(names), "rid": np.concatenate(near), "score": np.concatenate(scores)})

    return index.select("tree", "shard", "hash", "rid", "v").groupBy("tree", "shard").cogroup(sent.groupBy("tree", "shard")).applyInPandas(score, "q long, rid long, score double")


def _shown(found: DataFrame, few: DataFrame, asked: DataFrame, named: DataFrame, k: int) -> DataFrame:
    """Entries turned back into rows: the k nearest ids of every query."""
    ids = few.select("rid", "vec_id")
    near = materialize(_top(found, k + 1).select("q", "rid", "score"), "near")
    every = near.join(ids, "rid").select("q", "vec_id", "score")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    # two more than k ids: those of the query itself may be among them
    kept = materialize(every.withColumn("_r", F.dense_rank().over(best)).filter(F.col("_r") <= k + 1).drop("_r"), "kept")
    queries = materialize(asked.join(named, "v").select(F.col("rid").alias("q"), F.col("vec_id").alias("query_id")).distinct(), "asked")
    joined = queries.join(kept, "q").filter("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return joined.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
