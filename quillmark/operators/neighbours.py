"""Nearest-neighbour estimates without comparing everything with everything:
dispersion of embeddings by a cell index with triangle bounds, and mutual
information from ranks."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.context import cut
from quillmark.operators.corpus import long_form, unit
from quillmark.operators.ordered import placed

#: Most pivots (cells) of an index, and rows of a block that meets another.
CELLS = 256
BLOCK = 2048
#: Blocks of a load, and tasks that a table is dealt out to at least, if its
#: blocks are enough.
LOAD, TASKS = 16, 32


# --- dispersion ---------------------------------------------------------------


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances (of unit vectors, and of ones without a direction,
    which are at 0)."""
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * (x @ pivots.T), 0))


def _opened(frames: Iterable[pd.DataFrame], pivots: np.ndarray, radius: np.ndarray, most: int, group: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
    """(v, u, kth, target, open): the groups of cells in which the bound leaves
    some of (v, u, cell, kth) open, and these as bits, in frames of at most
    ``most`` rows: where it closes few cells, each vector is copied once for each
    group (a cell by itself, unless ``group`` has a number for each)."""
    group = np.arange(len(pivots)) if group is None else group
    for frame in frames:
        for first in range(0, len(frame), most):
            part = frame.iloc[first : first + most]
            d = _distances(np.stack(part["u"].to_numpy()), pivots)
            bound = np.sqrt(np.maximum(2 - 2 * part["kth"].fillna(-1.0).to_numpy(), 0)) + 1e-9
            look = d - radius[None, :] <= bound[:, None]
            look[np.arange(len(d)), part["cell"].to_numpy()] = False
            row, target = np.nonzero(np.stack([look[:, group == g].any(axis=1) for g in range(group.max() + 1)], axis=1))
            for at in range(0, len(row), most):
                some, to = row[at : at + most], target[at : at + most]
                bits = np.packbits(look[some] & (group[None, :] == to[:, None]), axis=1)
                yield pd.DataFrame({"v": part["v"].to_numpy()[some], "u": part["u"].to_numpy()[some], "kth": part["kth"].to_numpy()[some], "target": to.astype(np.int32), "open": [b.tobytes() for b in bits]})


def _met(left: DataFrame, members: DataFrame, sizes: dict[int, int], k: int, block: int) -> DataFrame:
    """(v, sim, m, compared): for each row (v, u, kth, target, open) the k most
    similar members of the open cells of its target group, with their
    multiplicities, that are nearer than ``kth``.  Groups are cut into loads of LOAD blocks, as
    are the rows that look into them, so no task sees more than two loads, which
    it compares a block at a time; a vector is copied once for each load of the
    other side."""
    spark = left.sparkSession
    load = block * LOAD
    askers = {r.target: r.n for r in left.groupBy("target").agg(F.count("*").alias("n")).collect()}  # a row for each group
    fair = max(block, min(load, -(-sum(sizes.values()) * len(sizes) // TASKS)))
    parts = spark.createDataFrame([(c, max(1, -(-n // load)), max(1, -(-askers.get(c, 0) // fair))) for c, n in sizes.items()], "target int, blocks int, askers int")
    table = F.broadcast(parts)  # a row for each group
    own = F.pmod(F.xxhash64("v"), F.col("askers")).cast("int")
    queries = left.join(table, "target").withColumn("asker", own).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = members.join(table, "target").filter(F.col("target").isin(list(askers)))
    held = held.withColumn("part", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")).withColumn("asker", F.explode(F.sequence(F.lit(0), F.col("askers") - 1)))

    def best(_, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"v": [], "sim": [], "m": [], "compared": []})
        y = y.sort_values("cell", kind="stable")
        xu, yu, xv, yv, ym = np.stack(x["u"].to_numpy()), np.stack(y["u"].to_numpy()), x["v"].to_numpy(), y["v"].to_numpy(), y["m"].to_numpy()
        bits = np.unpackbits(np.frombuffer(b"".join(x["open"]), np.uint8).reshape(len(x), -1), axis=1)
        sim, m, compared = np.full((len(x), k), -np.inf), np.zeros((len(x), k), np.int64), np.zeros(len(x), np.int64)
        cells, starts = np.unique(y["cell"].to_numpy(), return_index=True)
        for cell, start, end in zip(cells, starts, [*starts[1:], len(y)], strict=True):
            rows = np.flatnonzero(bits[:, cell])
            for i, j in itertools.product(range(0, len(rows), block), range(start, end, block)):
                some, to = rows[i : i + block], slice(j, min(j + block, end))
                s = xu[some] @ yu[to].T
                s[xv[some][:, None] == yv[to][None, :]] = -np.inf
                compared[some] += s.shape[1]
                at = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
                near = np.concatenate([sim[some], np.take_along_axis(s, at, 1)], axis=1)
                many = np.concatenate([m[some], ym[to][at]], axis=1)
                at = np.argpartition(-near, k - 1, axis=1)[:, :k]
                sim[some], m[some] = np.take_along_axis(near, at, 1), np.take_along_axis(many, at, 1)
        keep = sim > x["kth"].fillna(-np.inf).to_numpy(np.float64)[:, None]
        row, at = np.nonzero(keep)
        none = np.zeros(len(x), np.int64)
        return pd.DataFrame({"v": np.concatenate([xv[row], xv]), "sim": np.concatenate([sim[row, at], none - 3.0]), "m": np.concatenate([m[row, at], none]), "compared": np.concatenate([np.zeros(len(row), np.int64), compared])})

    shape = ["v", "u", "target", "part", "asker"]
    return queries.select(*shape, "kth", "open").groupBy("target", "part", "asker").cogroup(held.select(*shape, "m", "cell").groupBy("target", "part", "asker")).applyInPandas(best, "v long, sim double, m long, compared long")


def _nearest(found: DataFrame, k: int) -> DataFrame:
    """The rows of (v, sim, m) that make up the k nearest of each v, ``w`` of
    each counting."""
    before = F.coalesce(F.sum("m").over(Window.partitionBy("v").orderBy(F.desc("sim"), F.col("m")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.filter("sim > -2 AND m > 0").withColumn("before", before).filter(F.col("before") < k).withColumn("w", F.least(F.col("m"), k - F.col("before")))


def neighbourhood_dispersion(rows: DataFrame, key: str, column: str, k: int = 10, cells: int = CELLS, block: int = BLOCK) -> DataFrame:
    """(key, dispersion, compared): the mean of the k largest cosines of each
    row with other rows, exactly, and how many vectors it was compared with.

    Equal vectors are one with a multiplicity.  Vectors are dealt to the nearest
    of up to ``cells`` pivots; a vector first meets its own cell, which bounds
    its kth distance, and then only cells that the triangle inequality leaves
    open: those whose pivot is no farther than that bound and the cell's radius
    together."""
    spark = rows.sparkSession
    units = cut(rows.select(F.col(key).alias("id"), unit(F.col(column)).alias("u")).filter("u IS NOT NULL"), "units")
    own = units.groupBy("u").agg(F.min("id").alias("v"), F.count("*").alias("m"))
    distinct = cut(own, "distinct")
    n = distinct.count()
    chosen = distinct.select("u", F.xxhash64("v").alias("h")).orderBy("h").limit(max(1, min(cells, int(n**0.5)))).collect()  # the pivots
    if not chosen:
        return units.select(F.col("id").alias(key), F.lit(0.0).alias("dispersion"), F.lit(0).cast("long").alias("compared"))
    pivots = spark.sparkContext.broadcast(np.array([r.u for r in chosen]))

    def deal(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                d = _distances(np.stack(frame["u"].to_numpy()), pivots.value)
                at = d.argmin(axis=1)
                yield frame.assign(cell=at, d=d[np.arange(len(d)), at])

    members = cut(distinct.mapInPandas(deal, "u array<double>, v long, m long, cell int, d double"), "cells")
    stats = members.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("radius")).collect()  # a row for each cell
    sizes = {r.cell: r.n for r in stats}
    radius = np.full(len(chosen), -np.inf)
    for r in stats:
        radius[r.cell] = r.radius
    group = np.zeros(len(chosen), np.int32)
    held = 0
    for c in range(1, len(chosen)):  # cells side by side, up to a load
        held += sizes.get(c - 1, 0)
        full = held + sizes.get(c, 0) > block * LOAD
        group[c] = group[c - 1] + full
        held = 0 if full else held
    loads: dict[int, int] = {}
    for c, size in sizes.items():
        loads[int(group[c])] = loads.get(int(group[c]), 0) + size
    grouped = members.withColumn("target", F.get(F.array(*(F.lit(int(g)) for g in group)), F.col("cell")))
    itself = F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x)
    copies = distinct.filter("m > 1").select("v", itself.alias("sim"), (F.col("m") - 1).alias("m"), F.lit(0).cast("long").alias("compared"))
    alone = F.array(*(F.lit(bytearray(np.packbits(np.arange(len(chosen)) == c).tobytes())) for c in range(len(chosen))))
    own_cell = grouped.select(F.col("v").alias("v"), F.col("u").alias("u"), F.lit(None).cast("double").alias("kth"), F.col("target").alias("target"), F.get(alone, F.col("cell")).alias("open"))
    inside = cut(_met(own_cell, grouped, loads, k, block).unionByName(copies), "inside")
    reached = _nearest(inside, k).groupBy("v").agg(F.when(F.sum("w") >= k, F.min("sim")).alias("kth"))
    bounded = cut(members.select("v", "u", "cell").join(reached, "v", "left").select("v", "u", "cell", "kth"), "bounded")

    def open_cells(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _opened(frames, pivots.value, radius, block, group)

    outside = _met(bounded.mapInPandas(open_cells, "v long, u array<double>, kth double, target int, open binary"), grouped, loads, k, block)
    every = cut(inside.unionByName(outside), "found")
    means = _nearest(every, k).groupBy("v").agg((F.sum(F.col("sim") * F.col("w")) / F.sum("w")).alias("dispersion"))
    work = every.groupBy("v").agg(F.sum("compared").alias("compared"))
    by_vector = distinct.join(means, "v", "left").join(work, "v", "left").select("u", F.coalesce("dispersion", F.lit(0.0)).alias("dispersion"), F.coalesce("compared", F.lit(0)).alias("compared"))
    return units.join(by_vector, "u").select(F.col("id").alias(key), "dispersion", "compared")


# --- mutual information -------------------------------------------------------


def digamma(n: Column) -> Column:
    """Of positive numbers: six steps up, then the asymptotic series."""
    x = n.cast("double") + 6
    steps = sum((1 / (n.cast("double") + i) for i in range(6)), F.lit(0.0))
    return F.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6) - steps


def counted_below(points: DataFrame, asked: DataFrame, by: str, value: str) -> DataFrame:
    """``asked`` (``by``, ``value``, ``with_equal`` and more) with ``below``: how
    many points of the group have a smaller value, or an equal one as well.
    Numbers come from range partitions, so no task sees a whole group."""
    kind = F.when(F.col("with_equal"), 2).otherwise(0)  # before or behind the points of the same value
    extra = [c for c in asked.columns if c not in (by, value)]
    marks = cut(asked.withColumn("_kind", kind), "asked")
    both = points.select(by, value, F.lit(1).alias("_kind")).unionByName(marks, allowMissingColumns=True)
    order = (value, "_kind", *(c for c in extra if c != "with_equal"))
    among_all = placed(both, [by], *order, name="_all").filter("_kind <> 1").select(by, value, *extra, "_all")
    alone = placed(marks, [by], *order, name="_own").select(*(F.col(c).alias(f"_{c}") for c in (by, value, *extra)), "_own")
    same = functools.reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (by, value, *extra)))
    return among_all.join(alone, same).select(by, value, *extra, (F.col("_all") - F.col("_own")).alias("below"))


def mutual_information(rows: DataFrame, features: list[str], label: str, k: int = 3) -> DataFrame:
    """(feature, mi): mutual information in nats of each feature with a label,
    by distances to the kth neighbour of the same label (Ross 2014); missing
    values are replaced by the feature's mean, and labels of a single row are
    left out.  Ties aren't broken by noise: points count that are nearer than
    the kth neighbour, or equal where that is at distance 0.

    Neighbours stand at most k places away in the label's order, and the points
    within a radius are a difference of ranks in the order of all, so no row
    meets another one that isn't near."""
    long = cut(long_form(rows, features, label), "values")  # texts are read once
    means = long.groupBy("feature").agg(F.avg("x").alias("mean"))
    filled = long.join(F.broadcast(means), "feature").select("feature", F.col(label).alias("label"), F.coalesce("x", "mean").alias("x")).filter("x IS NOT NULL AND label IS NOT NULL")  # a row for each feature
    sizes = filled.groupBy("feature", "label").agg(F.count("*").alias("own")).filter("own > 1")
    points = cut(filled.join(F.broadcast(sizes), ["feature", "label"]), "points")  # a row for each label and feature
    numbered = cut(placed(points.withColumn("_cell", F.struct("feature", "label")), ["_cell"], "x", name="at").drop("_cell"), "places")
    nearby = numbered.select("feature", "label", "own", "x", F.explode(F.sequence(F.col("at") - k, F.col("at") + k)).alias("to"), "at").filter("`to` >= 0 AND `to` < own")
    around = nearby.groupBy("feature", "label", "to", "own").agg(F.max(F.when(F.col("at") == F.col("to"), F.col("x"))).alias("x"), F.collect_list(F.when(F.col("at") != F.col("to"), F.col("x"))).alias("others"))
    used = F.least(F.lit(k), F.col("own") - 1)
    radii = around.select("feature", "label", "own", "to", "x", used.cast("int").alias("used"), F.sort_array(F.transform("others", lambda y: F.abs(y - F.col("x")))).alias("gaps"))
    known = cut(radii.select("feature", "label", F.col("to").alias("at"), "own", "used", "x", F.get("gaps", F.col("used") - 1).alias("r")), "radii")
    ends = known.select("feature", "label", "at", F.explode(F.array(
        F.struct(F.lit(True).alias("upper"), F.when(F.col("r") > 0, F.col("x") + F.col("r")).otherwise(F.col("x")).alias("x"), (F.col("r") == 0).alias("with_equal")),
        F.struct(F.lit(False).alias("upper"), F.when(F.col("r") > 0, F.col("x") - F.col("r")).otherwise(F.col("x")).alias("x"), (F.col("r") > 0).alias("with_equal")),
    )).alias("e")).select("feature", "label", "at", "e.upper", "e.x", "e.with_equal")
    ranks = counted_below(points, ends, "feature", "x")
    within = ranks.groupBy("feature", "label", "at").agg(F.sum(F.when(F.col("upper"), F.col("below")).otherwise(-F.col("below"))).alias("m"))
    terms = known.join(within, ["feature", "label", "at"])
    sums = terms.groupBy("feature").agg(F.count("*").alias("n"), F.avg(digamma(F.col("used"))).alias("k"), F.avg(digamma(F.col("own"))).alias("l"), F.avg(digamma(F.greatest("m", F.lit(1)))).alias("m"))
    return sums.select("feature", F.greatest(F.lit(0.0), digamma(F.col("n")) + F.col("k") - F.col("l") - F.col("m")).alias("mi"))
