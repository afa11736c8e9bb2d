"""Metrics, splits and streaming forms on inline rows."""

import pytest
from pyspark.sql import functions as F

from quillmark.operators import metrics, splits
from quillmark.operators.ordered import numbered, placed, quantiles, running_sums
from quillmark.sources import connectors
from quillmark.streaming import events


def test_metrics_by_hand(spark):
    rows = spark.createDataFrame(list(zip([0, 1, 2, 0, 1, 2], [0, 1, 1, 0, 2, 2], strict=True)), "y int, yhat int")
    got = metrics.summary(rows).first()
    assert (got.accuracy, got.macro_f1, got.n) == (pytest.approx(4 / 6), pytest.approx((1 + 0.5 + 0.5) / 3), 6)


def test_auc_and_reliability(spark):
    rows = spark.createDataFrame([(1, 0.2, 0.8), (0, 0.6, 0.4), (1, 0.6, 0.4), (0, 0.9, 0.1)], "y int, p_0 double, p_1 double")
    got = {r["class"]: r.auc for r in metrics.auc(rows, 2).collect()}
    assert got == {0: pytest.approx(0.875), 1: pytest.approx(0.875)}
    bins = {(r["class"], r.bin): r.n for r in metrics.reliability(rows, 10, 2).collect()}
    assert bins[(1, 3)] == 2 and bins[(1, 7)] == 1
    assert metrics.auc(rows.filter("y = 1"), 2).filter("class = 1").first().auc is None


def samples(spark):
    rows = [(f"human_{i}", "human", "human") for i in range(10)]
    rows += [(f"r_{g}_{i}", "ai_raw", g) for g, n in (("qwen", 6), ("gpt4o_mini", 4), ("claude_sonnet5", 2)) for i in range(n)]
    rows += [(f"h_{i}", "ai_humanized", "qwen") for i in range(5)]
    return spark.createDataFrame(rows, "sample_id string, label string, generator string")


def test_leave_one_out_and_balance(spark):
    rows = samples(spark)
    people = splits.human_split(rows, "sample_id").filter("test")
    assert people.count() == 2
    for name, n in (("qwen", 11), ("gpt4o_mini", 4), ("claude_sonnet5", 2)):
        train, test = splits.leave_one_out(rows, name, people, "sample_id")
        assert test.filter("label <> 'human'").count() == n and train.join(test, "sample_id").count() == 0
    assert {r["count"] for r in splits.balanced(rows, "label", "sample_id").groupBy("label").count().collect()} == {5}


def test_groups_stay_in_one_fold(spark):
    rows = spark.createDataFrame([(i, f"g{i % 11}", ("a", "b")[i % 2]) for i in range(200)], "k int, g string, label string")
    folds = splits.grouped_folds(rows, "g", "label", 5)
    assert folds.groupBy("g").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    assert folds.count() == 200
    rare = spark.createDataFrame([(i, f"g{i // 3}", "a" if i < 240 else None) for i in range(300)], "k int, g string, label string")
    shares = splits.grouped_folds(rare, "g", "label", 5).groupBy("fold").agg(F.count("*").alias("n"), F.count_if(F.col("label").isNull()).alias("b")).collect()
    assert [(r.n, r.b) for r in shares] == [(60, 12)] * 5


def test_connected_chain(spark):
    edges = spark.createDataFrame([(f"g{i:02d}", f"t{j}") for i in range(20) for j in (i, i + 1)] + [("z", "other")], "a string, b string")
    got = {r.a: r.root for r in splits.connected(edges).collect()}
    assert got == {**{f"g{i:02d}": "g00" for i in range(20)}, "z": "z"}


def test_numbers_of_many_rows_in_ranges_that_are_merged(spark):
    """More rows than borders are sampled from, in more ranges than are kept:
    every row is there once, with its number."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        rows = spark.range(0, 300_000, 1, 3).select(F.hash("id").alias("v"), "id", F.repeat(F.lit("x"), 200).alias("wide"))
        got = numbered(rows, "v", "id", name="n").select("v", "id", "n")
        assert got.count() == 300_000 and got.select("n").distinct().count() == 300_000
        assert got.agg(F.min("n"), F.max("n")).first() == (0, 299_999)
        first = [r.id for r in got.orderBy("n").limit(50).collect()]
        assert first == [r.id for r in rows.orderBy("v", "id").limit(50).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_numbered_without_one_task(spark):
    got = numbered(spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(5), "x").collect()
    assert sorted(r.n for r in got) == list(range(1000)) and all(r.n == r.x for r in got)


def test_streaks_and_caps(spark):
    kinds = "error error error purchase error error purchase purchase purchase".split()
    rows = spark.createDataFrame([(i, 1, k) for i, k in enumerate(kinds)] + [(50 + i, 2, "purchase") for i in range(4)], "event_id long, user_id long, event_type string")
    ok, bad = F.col("event_type") == "purchase", F.col("event_type") == "error"
    assert [(r.user_id, r.since) for r in events.blacklisted(rows, "user_id", "event_id", ok, bad, 3).collect()] == [(1, 2)]
    got = events.harvested(rows, "user_id", "event_id", ok, bad, 3, 3).collect()
    assert sorted(r.event_id for r in got) == [50, 51, 52]


def test_stream_equals_batch(spark):
    path = "/root/testdata/sf0.001"
    batch = events.blacklisted(spark.read.parquet(f"{path}/events.parquet"), "user_id", "event_id", F.col("event_type") == "purchase", F.col("event_type") == "error", 2)
    stream = events.drained(spark, events.streak_state(events.file_stream(spark, path, "events"), 2), "streaks")
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))


def test_sources(spark):
    rows = spark.createDataFrame([(1, "ğ é"), (2, None)], "id long, text string")
    assert sorted(map(tuple, connectors.roundtrip_jsonl(rows).collect())) == [(1, "ğ é"), (2, None)]
    lines = spark.createDataFrame([("# no",), ("",), (" a ",), ("b",)], "line string")
    assert sorted(r.prompt for r in connectors.prompts(lines, "line").collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        connectors.read_texts(spark, "/nowhere", "*.pdf")


def test_places_sums_and_quantiles_by_group(spark):
    rows = [(None if i % 3 == 0 else i % 3, i * 7 % 50, i) for i in range(50)]
    df = spark.createDataFrame(rows, "g int, x int, k int").repartition(4)
    want = {}
    for g, x, k in sorted(rows, key=lambda r: r[1]):
        want.setdefault(g, []).append((x, k))
    got = placed(df, ["g"], "x").collect()
    assert all(want[r.g][r.n] == (r.x, r.k) for r in got) and len(got) == 50
    sums = {(r.g, r.x): r.sum_k for r in running_sums(df, ["g"], "x", "k").collect()}
    for g, held in want.items():
        total = 0
        for x, k in held:
            total += k
            assert sums[(g, x)] == total
    known = df.filter("g IS NOT NULL").withColumn("x", F.col("x").cast("double"))
    found = {r.g: r.q for r in quantiles(known, "g", "x", [0.0, 0.3, 0.5, 1.0]).collect()}
    import numpy as np

    for g in (1, 2):
        assert found[g] == pytest.approx(np.quantile([x for x, _ in want[g]], [0.0, 0.3, 0.5, 1.0]).tolist())
