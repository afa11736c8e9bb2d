import numpy as np
from pyspark.sql import functions as F

from quillmark.llm import ann


def brute(rows, k, step):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % step == 0:
            near = sorted((-(v * q).sum(), j) for j, v in good if j != i)
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def vectors(n, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(n)]
    same = rng.standard_normal(8).astype(np.float32).tolist()
    rows += [(n + i, same) for i in range(n // 3)]
    return rows + [(5000, None), (5020, [0.0] * 8), (5040, [float("nan")] * 8), (5060, [1.0, None] + [0.0] * 6), (5080, [float("inf")] * 8), (5100, [1.0]), (None, same), (5120, [])]


def searched(spark, rows, k, step, kind="float", **options):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, rank int")
    got = {}
    for r in ann.search(df, F.col("vec_id") % step == 0, k, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


def recall(got, want):
    assert set(got) == set(want)
    hits = total = 0
    for q, near in want.items():
        assert len(got[q]) == len(near) and len({i for i, _ in got[q]}) == len(near)
        limit = near[-1][1] - 1e-9
        hits += sum(s >= limit for _, s in got[q])
        total += len(near)
    return hits / total


def test_recall_over_shards(spark):
    rows = vectors(900)
    assert recall(searched(spark, rows, 20, 20, shard_rows=150), brute(rows, 20, 20)) >= 0.9


def test_few_rows_give_all_candidates(spark):
    rows = vectors(9)
    assert searched(spark, rows, 20, 3) == {q: [(i, s) for i, s in near] for q, near in brute(rows, 20, 3).items()}


def test_nothing_to_find(spark):
    assert searched(spark, [], 20, 1) == {}
    assert searched(spark, [(1, [0.0, 0.0])], 20, 1) == {}
    assert searched(spark, [(1, [1.0, 0.0])], 20, 1) == {}


def test_mixed_density_gives_every_query_k_rows(spark):
    rng = np.random.default_rng(1)
    near = np.repeat(rng.standard_normal((57, 32)), 50, axis=0) + 0.01 * rng.standard_normal((2850, 32))
    every = np.concatenate([near, rng.standard_normal((150, 32))])
    every /= np.linalg.norm(every, axis=1, keepdims=True)
    got = searched(spark, list(enumerate(rng.permutation(every).astype(np.float32).tolist())), 20, 2)
    assert len(got) == 1500 and all(len(near) == 20 for near in got.values())


def test_double_precision_is_kept(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal(8)
    rows = [(i, (base * (1 + i * 1e-12)).tolist()) for i in range(12)] + [(50, [1e300, *([0.0] * 7)]), (7, rng.standard_normal(8).tolist())]
    want = brute(rows, 20, 1)
    got = searched(spark, rows[:12], 20, 1, "double")
    assert {q: [i for i, _ in near] for q, near in got.items()} == {q: [i for i, _ in near] for q, near in brute(rows[:12], 20, 1).items()}
    again = searched(spark, rows, 20, 1, "double")
    assert set(again) == set(want) and all(np.isfinite(s) for near in again.values() for _, s in near)
