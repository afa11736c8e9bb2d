"""Columns of the documents that are named like those of the operators, and
texts that share a 64-bit hash."""

import pytest
from pyspark.sql import functions as F

from quillmark.llm import common
from quillmark.llm.decontamination import without_contaminated
from quillmark.llm.ngram_join import first_of_each_group
from quillmark.llm.quality import keep_good
from quillmark.llm.secrets import redact

NAMES = ["_key", "_lang", "_base", "_all", "_assign", "_access", "_hex", "_candidates", "_hit", "_id", "_shared", "_text_key", "key", "__key", "KEY2", "root", "fp", "chunk"]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60)
    return common.materialize(rows.withColumns({n: F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")) for n in NAMES}), "docs")


@pytest.mark.parametrize("stage", ["quality", "near", "leaks", "secrets"])
def test_columns_stay(spark, docs, stage):
    run = {
        "quality": lambda d: keep_good(d, spark.read.parquet(f"{SF}/labels.parquet")),
        "near": first_of_each_group,
        "leaks": lambda d: without_contaminated(d, spark.read.parquet(f"{SF}/benchmark.parquet")),
        "secrets": redact,
    }[stage]
    out = run(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert got and all(r[n] == f"{n} of {r.doc_id}" for r in got for n in NAMES)
    bare = run(docs.drop(*NAMES)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted((r.doc_id, r.text) for r in bare)


def test_free_names(spark):
    table = spark.createDataFrame([(1, 2, 3)], "a int, _Key int, __lang int")
    assert common.free_names(table, "key", "lang") == ["___key", "___lang"] and common.free_names(table, "b") == ["_b"]


def test_texts_that_share_a_hash_have_different_numbers(spark, monkeypatch):
    """With a first hash of two values, numbers still tell all texts apart."""
    rows = spark.createDataFrame([(i, f"text {i % 20}" if i % 7 else None) for i in range(60)], "doc_id long, text string")
    real = F.xxhash64
    monkeypatch.setattr(common.F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(2)) if len(c) == 1 else real(*c))
    got = common.keyed(rows, "number").collect()
    assert len(got) == 60
    by_text = {}
    for r in got:
        by_text.setdefault(r.text, set()).add(r.number)
    assert all(len(v) == 1 for v in by_text.values())
    assert len(set().union(*by_text.values())) == len(by_text)


def test_near_passages_go_and_short_items_need_every_word(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = spark.createDataFrame([
        (1, item), (2, "alpha beta gamma delta (sic) epsilon zeta eta theta iota kappa"), (3, "alpha beta gamma"), (4, "red of blue"), (5, "blue and red"), (6, "red blue"), (None, None),
    ], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, item), (2, "red blue")], "item_id long, text string")
    assert {r.doc_id for r in without_contaminated(rows, benchmark).collect()} == {3, 4, 5, None}
    assert {r.doc_id for r in without_contaminated(rows, benchmark, slop=None).collect()} == {2, 3, 4, 5, None}
