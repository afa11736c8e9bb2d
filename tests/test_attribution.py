"""Tree attribution against the definition: all subsets of the features."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from quillmark.operators import attribution


def data(spark, n, d, classes):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, d)).round(1)
    y = ((x[:, 0] > 0) + (x[:, 1] * x[:, 2] > 0.3) * (classes > 2)).astype(float)
    rows = spark.createDataFrame([(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "key long, x array<double>, y double")
    return x, rows.withColumn("features", array_to_vector("x"))


def by_subsets(row, found, d):
    """Shapley values from the expectation for every subset of known features."""

    def expected(known):
        total = 0.0
        for leaf in found:
            part = leaf.value
            for f, low, high, share in zip(leaf.features, leaf.low, leaf.high, leaf.share, strict=True):
                part = part * (float(low < row[f] <= high) if f in known else share)
            total = total + part
        return total

    phi = []
    for j in range(d):
        others = [i for i in range(d) if i != j]
        phi.append(sum(factorial(s) * factorial(d - 1 - s) / factorial(d) * (expected({*some, j}) - expected(set(some))) for s in range(d) for some in combinations(others, s)))
    return np.array(phi)


@pytest.mark.parametrize("kind", ["forest", "boosted", "tree"])
def test_equals_all_subsets_and_sums_to_the_output(spark, kind):
    d = 4
    x, rows = data(spark, 120, d, 2 if kind == "boosted" else 3)
    make = {"forest": RandomForestClassifier(labelCol="y", numTrees=4, maxDepth=4, seed=1), "boosted": GBTClassifier(labelCol="y", maxIter=3, maxDepth=3, seed=1), "tree": DecisionTreeClassifier(labelCol="y", maxDepth=4, seed=1)}[kind]
    model = make.fit(rows)
    got = attribution.tree_attribution(rows, model, list("abcd"), "x", "key").toPandas()
    found, mean = attribution.leaves(model, rows)
    assert len(got) == 120 * d * len(mean)
    table = got.pivot_table(index="key", columns=["feature", "output"], values="phi").to_numpy().reshape(120, d, len(mean))
    for i in (0, 17, 99):
        assert table[i] == pytest.approx(by_subsets(x[i], found, d), abs=1e-12)
    total = table.sum(axis=1) + mean
    if kind == "boosted":
        margins = np.array([sum(w * t.predict(r.features) for w, t in zip(model.treeWeights, model.trees, strict=True)) for r in rows.orderBy("key").limit(10).collect()])
        assert total[:10, 0] == pytest.approx(margins)
    else:
        scores = [r.probability.toArray() for r in model.transform(rows).orderBy("key").collect()]
        assert total == pytest.approx(np.array(scores))


def test_a_model_of_one_leaf(spark):
    _, rows = data(spark, 20, 3, 2)
    model = DecisionTreeClassifier(labelCol="one").fit(rows.withColumn("one", F.lit(0.0)))
    assert attribution.tree_attribution(rows, model, list("abc"), "x", "key").filter("phi <> 0").count() == 0
