"""Neighbour estimates against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmark.operators import neighbours


def dispersion(x, k):
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10)
    s = unit @ unit.T
    np.fill_diagonal(s, -np.inf)
    k = min(k, len(x) - 1)
    return np.sort(s, axis=1)[:, len(x) - k :].mean(axis=1) if k else np.zeros(len(x))


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "k long, v array<double>")


@pytest.mark.parametrize("blocks", [7, 2048])
def test_dispersion_equals_all_pairs(spark, blocks):
    """Clusters, copies of one vector in a third of the rows, and outliers."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 6)) * 5
    x = np.concatenate([centres[rng.integers(0, 8, 160)] + rng.normal(size=(160, 6)) * 0.05, np.tile(centres[:1], (80, 1)), rng.normal(size=(10, 6)), np.zeros((3, 6))])
    got = {r.k: r for r in neighbours.neighbourhood_dispersion(vectors(spark, x), "k", "v", 10, cells=12, block=blocks).collect()}
    want = dispersion(x, 10)
    assert len(got) == len(x)
    for i, w in enumerate(want):
        assert got[i].dispersion == pytest.approx(w, abs=1e-9), i
    distinct = len(np.unique(x, axis=0))
    assert sum(r.compared for i, r in got.items() if i < 160) < 0.5 * 160 * distinct  # far cells are left out


def test_dispersion_of_few_rows(spark):
    for x in (np.eye(4), np.ones((2, 3)), np.ones((1, 3))):
        got = {r.k: r.dispersion for r in neighbours.neighbourhood_dispersion(vectors(spark, x), "k", "v", 10).collect()}
        assert got == {i: pytest.approx(w) for i, w in enumerate(dispersion(x, 10))}
    assert neighbours.neighbourhood_dispersion(vectors(spark, np.eye(1)).limit(0), "k", "v").collect() == []


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, int(n)))


def estimate(x, y, k):
    known = [v for v in x if v is not None]
    x = np.array([np.mean(known) if v is None else v for v in x])
    own = {c: int((y == c).sum()) for c in set(y)}
    used = [i for i in range(len(x)) if own[y[i]] > 1]
    ks, ls, ms = [], [], []
    for i in used:
        gaps = sorted(abs(x[j] - x[i]) for j in used if j != i and y[j] == y[i])
        n = min(k, own[y[i]] - 1)
        r = gaps[n - 1]
        ms.append(sum((x[j] < x[i] + r and x[j] > x[i] - r) if r > 0 else x[j] == x[i] for j in used))
        ks.append(psi(n))
        ls.append(psi(own[y[i]]))
    return max(0.0, psi(len(used)) + np.mean(ks) - np.mean(ls) - np.mean([psi(m) for m in ms]))


def test_mutual_information_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 3, 150)
    y[0] = 9  # a label of one row
    a = rng.normal(size=150) + y
    b = rng.integers(0, 4, 150).astype(float)  # ties
    c = [None if i % 11 == 0 else float(v) for i, v in enumerate(rng.normal(size=150))]
    rows = spark.createDataFrame([(float(p), float(q), r, f"l{v}") for p, q, r, v in zip(a, b, c, y, strict=True)], "a double, b double, c double, label string").repartition(5)
    for k in (3, 1):
        got = {r.feature: r.mi for r in neighbours.mutual_information(rows, ["a", "b", "c"], "label", k).collect()}
        assert got == {name: pytest.approx(estimate(list(x), y, k), abs=1e-7) for name, x in (("a", a), ("b", b), ("c", c))}
    assert got["a"] > got["c"]


def test_digamma(spark):
    got = [r.p for r in spark.range(1, 40).select(neighbours.digamma(F.col("id")).alias("p")).collect()]
    assert got == [pytest.approx(psi(n), abs=1e-9) for n in range(1, 40)]


def test_open_cells_leave_in_small_frames():
    """Vectors whose bound closes no cell are copied for each, a few at a time."""
    rng = np.random.default_rng(5)
    u, pivots = rng.normal(size=(50, 8)), rng.normal(size=(20, 8))
    frame = pd.DataFrame({"v": np.arange(50), "u": list(u), "cell": np.arange(50) % 20, "kth": [np.nan] * 25 + [1.0] * 25})
    parts = list(neighbours._opened([frame, frame.iloc[:0]], pivots, np.full(20, 9.0), 7))
    assert max(map(len, parts)) <= 7
    found = pd.concat(parts)
    assert set(zip(found["v"], found["target"], strict=True)) == {(v, c) for v in range(50) for c in range(20) if c != v % 20}
    assert all((row.u == u[row.v]).all() for row in found.itertuples())
