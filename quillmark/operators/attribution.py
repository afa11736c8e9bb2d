"""Shapley values of tree ensembles, exact for the path-dependent expectation.

What a model expects when only some features are known follows both ways at a
split on an unknown one, weighted by the training rows that went there.  A leaf
then is its value times a product over the features of its path: whether the row
goes along (known), or the share of rows that did (unknown).  The Shapley value
of such a product needs the sums over subsets of each size only, which are the
coefficients of a polynomial, so a leaf costs the cube of its depth and no
subset is listed.  Rows are explained in Arrow batches with the trees (of the
model's size, not the data's) in every task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.sources.connectors import scratch


class Leaf:
    """Value of a leaf by output, and for each feature of its path the interval
    (above, up to] that leads there and the share of rows that were in it."""

    def __init__(self, value: np.ndarray, conditions: dict[int, tuple[float, float, float]]) -> None:
        self.value = value
        self.features = list(conditions)
        self.low, self.high, self.share = (np.array(c) for c in zip(*conditions.values(), strict=True)) if conditions else (np.zeros(0),) * 3


def leaves(model: Model, spark_rows: DataFrame) -> tuple[list[Leaf], np.ndarray]:
    """All leaves of a fitted forest or boosted model with continuous features,
    weighted by their trees, and the expected output.  Forests give a
    probability for each class, boosted trees one margin."""
    spark, path = spark_rows.sparkSession, scratch(spark_rows.sparkSession, "trees")
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    nodes = data.select("treeID", "nodeData.*") if "nodeData" in data.columns else data.select(F.lit(0).alias("treeID"), "*")
    trees: dict[int, dict[int, object]] = {}
    for r in nodes.select("treeID", "id", "prediction", "impurityStats", "rawCount", "leftChild", "rightChild", "split").toLocalIterator():  # the model's nodes
        trees.setdefault(r.treeID, {})[r.id] = r
    boosted = type(model).__name__.startswith("GBT")
    weights = list(getattr(model, "treeWeights", [1.0]))
    scale = 1.0 if boosted else 1 / sum(weights)
    found: list[Leaf] = []

    def walk(tree: dict[int, object], node: object, weight: float, conditions: dict[int, tuple[float, float, float]]) -> None:
        if node.leftChild < 0:
            stats = np.array(node.impurityStats)
            value = np.array([node.prediction]) if boosted else stats / stats.sum()
            found.append(Leaf(value * weight * scale, conditions))
            return
        feature, threshold = node.split.featureIndex, node.split.leftCategoriesOrThreshold[0]
        if node.split.numCategories >= 0:
            raise ValueError("categorical splits aren't explained")
        low, high, share = conditions.get(feature, (-np.inf, np.inf, 1.0))
        for child, a, b in ((tree[node.leftChild], low, min(high, threshold)), (tree[node.rightChild], max(low, threshold), high)):
            walk(tree, child, weight, {**conditions, feature: (a, b, share * child.rawCount / node.rawCount)})

    for number, tree in sorted(trees.items()):
        walk(tree, tree[0], weights[number], {})
    return found, sum(leaf.value * leaf.share.prod() for leaf in found)


def shapley(x: np.ndarray, found: list[Leaf], outputs: int) -> np.ndarray:
    """(rows, features, outputs) of a matrix of rows."""
    phi = np.zeros((*x.shape, outputs))
    for leaf in found:
        d = len(leaf.features)
        if not d:
            continue
        own = x[:, leaf.features]
        along = ((own > leaf.low) & (own <= leaf.high)).astype(np.float64)
        for j in range(d):
            # coefficient s: subsets of s of the other features
            sums = np.zeros((len(x), d))
            sums[:, 0] = 1.0
            for i in range(d):
                if i != j:
                    moved = np.zeros_like(sums)
                    moved[:, 1:] = sums[:, :-1] * along[:, i : i + 1]
                    sums = sums * leaf.share[i] + moved
            weights = np.array([factorial(s) * factorial(d - 1 - s) / factorial(d) for s in range(d)])
            phi[:, leaf.features[j]] += ((along[:, j] - leaf.share[j]) * (sums @ weights))[:, None] * leaf.value
    return phi


def tree_attribution(rows: DataFrame, model: Model, names: list[str], array: str, key: str) -> DataFrame:
    """(key, output, feature, phi): each feature's part of the difference
    between a row's output and the expected one.  Outputs are the classes of a
    forest, or the margin (0) of a boosted model."""
    found, expected = leaves(model, rows)
    shared = rows.sparkSession.sparkContext.broadcast((found, len(expected), names))  # of the model's size

    def explain(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, outputs, labels = shared.value
        for frame in frames:
            if len(frame):
                phi = shapley(np.stack(frame[array].to_numpy()), known, outputs)
                n, d, _ = phi.shape
                yield pd.DataFrame({key: np.repeat(frame[key].to_numpy(), d * outputs), "output": np.tile(np.arange(outputs, dtype=np.int32), n * d), "feature": np.tile(np.repeat(labels, outputs), n), "phi": phi.ravel()})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, F.col(array).cast("array<double>").alias(array)).mapInPandas(explain, f"{key} {kind}, output int, feature string, phi double")
