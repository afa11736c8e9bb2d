"""What the findings of round 3 named: work that a plan did more than once, and
counts of runs of documents against the plain definitions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quillmark.functions import annotate, arrays, stylometry
from quillmark.operators import features, measures

SF = "/root/testdata/sf0.001"


def plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["txt11_translation_pieces", "gen06_augmentation"])
def test_pieces_are_cut_once(spark, name):
    """one split into sentences, one into words."""
    assert plan(__spark_entry__.queries()[name](spark, SF)).count("(?U)") <= 4


def test_hops():
    """a walk ends at a root, behind the table, or where it comes back."""
    assert measures.hops([0, 1, 2]) == [0, 1, 2]
    assert measures.hops([2, 3, 1, 1, 4]) == [3, 3, 3, 4, 5]
    assert measures.hops([9]) == [1]
    assert measures.hops([1, 0]) == [1, 0]
    assert measures.hops([]) == []


def test_measured(spark, monkeypatch, tmp_path):
    """what is counted in runs is what the functions of a row give."""
    rng = random.Random(4)
    words = ["the", "of", "cat", "Dog", "runs", "slowly", "é", "😀", "12", ",", "-", " x"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", "", ".", "! "]) for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["", " ", "...", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(measures, "RUN", 50)
    rows = annotate.annotated(docs).withColumn("parts", F.transform("sentences", arrays.tokens)).withColumn("tags", F.transform("dep_parse", lambda w: w["upos"]))
    rows = rows.withColumn("depths", annotate.word_depths(F.col("dep_parse"))).withColumn("counts", arrays.run_counts(F.col("tokens")))
    c, t, tags = F.col("counts"), F.col("tokens"), F.col("tags")
    numbers = {
        "ttr": stylometry.ttr(c), "hapax_ratio": stylometry.hapax_ratio(c), "mean_word_len": stylometry.mean_word_len(t), "word_len_std": stylometry.word_len_std(t), "yule_k": stylometry.yule_k(c),
        "entropy_1gram": stylometry.entropy(c), "entropy_2gram": stylometry.entropy_ngram(t, 2), "entropy_3gram": stylometry.entropy_ngram(t, 3),
        "mean_dep_depth": arrays.mean(F.col("depths")), "dep_depth_std": F.sqrt(arrays.sample_variance(F.col("depths"))),
        **{name: stylometry.tag_share(tags, wanted) for name, wanted in measures.SHARES.items()},
    }
    assert tuple(numbers) == measures.NUMBERS
    want = rows.select("doc_id", c, "depths", *(x.alias(name) for name, x in numbers.items())).collect()
    path = str(tmp_path / "rows")
    rows.write.parquet(path)
    rows = spark.read.parquet(path)
    got = {r.doc_id: r.m for r in rows.select("doc_id", measures.measured(F.col("parts"), F.col("tags")).alias("m")).collect()}
    assert len(want) == len(texts)
    for r in want:
        m = got[r.doc_id]
        if texts[r.doc_id] is None:
            assert m is None
            continue
        assert (m.counts, m.depths) == (r.counts, r.depths), texts[r.doc_id]
        assert tuple(m)[2:] == pytest.approx(tuple(r)[3:], abs=1e-9)


def test_grams_of_runs(spark, monkeypatch):
    """F16, F20, F23, F25: n-grams of two kinds of documents in one pass."""
    monkeypatch.setattr(measures, "RUN", 20)
    rng = random.Random(5)
    docs = [(i, [rng.choice(["a", "b", "ç", ",", "😀"]) for _ in range(rng.randint(0, 12))]) for i in range(50)] + [(50, None)]
    rows = spark.createDataFrame(docs, "doc_id long, tokens array<string>").repartition(3)
    want = {name: Counter(" ".join(t[i : i + k]) for d, t in docs if t and keep(d) for k in (2, 3) for i in range(len(t) - k + 1)) for name, keep in (("n_a", lambda d: d < 20), ("n_b", lambda d: d >= 30))}
    got = features.gram_counts(rows, (2, 3), a="doc_id < 20", b="doc_id >= 30").collect()
    assert len({r.g for r in got}) == len(got)
    for name, counts in want.items():
        assert Counter({r.g: r[name] for r in got if r[name]}) == counts


@pytest.mark.parametrize("name", ["num04_log_odds", "num05_lexicons", "num17_mutual_information", "num18_select_by_mi"])
def test_texts_are_read_once(spark, name):
    """F16, F23, F27, F29: what is returned reads counts or values, no texts."""
    assert "regexp_extract_all" not in plan(__spark_entry__.queries()[name](spark, SF))
