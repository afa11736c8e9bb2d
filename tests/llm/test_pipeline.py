import re

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import test_decontamination, test_ngram_join

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    good = corpus_pipeline.materialize(stages["quality"](spark, docs, SF), "good")
    assert good.columns == columns and 0.7 * docs.count() < good.count() < docs.count()
    kept = corpus_pipeline.materialize(stages["near_duplicates"](spark, good, SF), "kept")
    groups = test_ngram_join.brute([(r.doc_id, r.text) for r in good.collect()], 5, 80)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _, root in groups if d == root)
    clean = corpus_pipeline.materialize(stages["decontamination"](spark, kept, SF), "clean")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {r[0] for r in test_decontamination.brute([(r.doc_id, r.text) for r in kept.collect()], items) if r[5]}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in kept.collect() if r.doc_id not in hit)
    hidden = corpus_pipeline.materialize(stages["secrets"](spark, clean, SF), "hidden")
    assert hidden.columns == columns and hidden.count() == clean.count()
    before = {r.doc_id: r.text for r in clean.collect()}
    for r in hidden.collect():
        assert not re.search("[0-9a-f]{16}", r.text) and r.n_chars == len(r.text)
        if "[SECRET]" not in r.text:
            assert r.text == before[r.doc_id]
    packed = stages["packing"](spark, hidden, SF).collect()
    assert {r.doc_id for r in packed} == set(before)


def test_stages_take_nulls_repeats_and_empty_tables(spark, tmp_path):
    """Rows without id, text or language, repeated rows, a contaminated text
    without id, columns named like those of the operators, and no rows."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(3).collect()]
    leak = next(t for _, t in items if len(t.split()) >= 12)
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    plain, other = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars BETWEEN 1500 AND 3000").orderBy("doc_id").collect() if r.doc_id in good][:2]
    rows = [(9001, plain, "en", "a", 1), (9001, plain, "en", "a", 1), (None, plain + " x", None, None, None), (None, leak, "en", "b", 2), (9002, None, "en", "c", 0), (9003, "", None, "d", 0), (9004, "token=0123456789abcdef " + other, "de", "e", 5)]
    table = spark.read.parquet(f"{SF}/documents.parquet").filter(~F.col("text").isin(plain, other))
    columns = table.columns
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select(*columns)
    every = table.unionByName(more).withColumns({"keep": F.lit(7), "component_id": F.lit("x")})
    for docs in (every, every.limit(0)):
        empty = docs is not every
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == every.columns, name
            docs = corpus_pipeline.materialize(out, name)
            got = [(r.doc_id, r.text) for r in docs.collect()]
            if empty:
                assert got == []
            elif name == "quality":
                assert got.count((9001, plain)) == 2 and {(9002, None), (9003, ""), (None, plain + " x")} <= set(got)
            elif name == "near_duplicates":
                assert got.count((9001, plain)) == 1 and (None, plain + " x") not in got and {(9002, None), (9003, "")} <= set(got)
            elif name == "decontamination":
                assert all(t != leak for _, t in got) and {(9001, plain), (9002, None), (9003, "")} <= set(got)
            elif name == "secrets":
                assert any(i == 9004 and t.startswith("[SECRET] ") for i, t in got) and (9002, None) in got
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
        assert len(packed) >= len(got) and all(r.length >= 1 for r in packed) and len({r.doc_id for r in packed}) == len({i for i, _ in got})
