"""Context models against plain Python, and language profiles."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import context, language

WORDS = ["the", "of", "a", "cat", "dog", "runs", "sees", ",", "."]


def corpus(rng, n, unseen=()):
    return [(i, [rng.choice([*WORDS[: 3 + i % 7], *unseen]) for _ in range(rng.randint(0, 30))]) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(3)


def ranks_by_hand(docs, training, most):
    successors, counts = {}, Counter()
    for _, t in training:
        counts.update(t)
        for left, w in zip(t, t[1:], strict=False):
            successors.setdefault(left, Counter())[w] += 1
    last = len(counts) + 1

    def rank(left, w):
        follow = successors.get(left, Counter())
        if w in follow:
            return 1 + sum(c > follow[w] for c in follow.values())
        behind = sum(counts[v] > counts[w] for v in counts if v not in follow)
        return len(follow) + 1 + behind

    out = {}
    for doc, t in docs:
        r = [rank(left, w) for left, w in zip(t[:most], t[1:most], strict=False)]
        if not r:
            out[doc] = (0.0,) * 5
            continue
        buckets = Counter(min(int(math.log2(x) / (math.log2(last) / 10)), 9) for x in r)
        entropy = -sum(c / len(r) * math.log2(c / len(r)) for c in buckets.values())
        out[doc] = (sum(r) / len(r), *(sum(x <= k for x in r) / len(r) for k in (1, 5, 10)), entropy)
    return out


def test_ranks_in_context(spark):
    rng = random.Random(1)
    training, docs = corpus(rng, 30), corpus(rng, 40, ("new", "word"))
    for most in (512, 7):
        got = {r.doc_id: tuple(r)[1:] for r in context.context_ranks(frame(spark, docs), frame(spark, training), most).collect()}
        want = ranks_by_hand(docs, training, most)
        assert got.keys() == want.keys()
        for doc, values in want.items():
            assert got[doc] == pytest.approx(values, abs=1e-9), doc


def masked_by_hand(docs, training, most):
    tables = [Counter() for _ in range(7)]
    for _, t in training:
        for x, w, y in zip(["", *t], t, [*t[1:], ""], strict=False):
            for table, key in zip(tables, ((x, w, y), (x, y), (x, w), x, (w, y), y, w), strict=True):
                table[key] += 1
    n, v = sum(tables[6].values()), len(tables[6])
    out = {}
    for doc, t in docs:
        t = t[:most]
        logs = []
        for x, w, y in zip(["", *t], t, [*t[1:], ""], strict=False):
            p, rest = 0.0, 1.0
            for weight, part, whole in ((context.BOTH, tables[0][x, w, y], tables[1][x, y]), (context.SINGLE / 2, tables[2][x, w], tables[3][x]), (context.SINGLE / 2, tables[4][w, y], tables[5][y])):
                if whole:
                    p, rest = p + weight * part / whole, rest - weight
            logs.append(math.log(p + rest * (tables[6][w] + 1) / (n + v + 1)))
        if t:
            out[doc] = math.exp(-sum(logs) / len(logs))
    return out


def test_masked_perplexity(spark):
    rng = random.Random(2)
    training, docs = corpus(rng, 30), corpus(rng, 40, ("new",))
    model = context.two_sided_counts(frame(spark, training))
    for most in (512, 5):
        got = {r.doc_id: r.perplexity for r in context.masked_perplexity(frame(spark, docs), model, most).collect()}
        assert got == pytest.approx(masked_by_hand(docs, training, most))
    empty = context.two_sided_counts(frame(spark, []))
    assert all(r.perplexity == pytest.approx(1.0) for r in context.masked_perplexity(frame(spark, docs), empty).collect())


def test_ratio_is_of_its_own(spark):
    """Two models in one table: both as alone, and a ratio that is no function
    of one perplexity."""
    rng = random.Random(3)
    docs, training = corpus(rng, 40), corpus(rng, 35)
    model = context.two_sided_counts(frame(spark, training), one="doc_id < 10", two="doc_id >= 10")
    both = context.masked_perplexities(frame(spark, docs), model, ("one", "two"))
    got = {r.doc_id: r for r in both.withColumn("ratio", context.log_ratio(F.col("perplexity_one"), F.col("perplexity_two"))).collect()}
    a, b = masked_by_hand(docs, training[:10], 512), masked_by_hand(docs, training[10:], 512)
    for d in a:
        assert (got[d].perplexity_one, got[d].perplexity_two, got[d].ratio) == pytest.approx((a[d], b[d], math.log(a[d] / b[d])))
    order = sorted(a, key=a.get)
    assert sorted(a, key=lambda d: got[d].ratio) not in (order, order[::-1])


def test_hot_words_are_dealt_out(spark):
    """A word of most rows is copied to all parts, and only that."""
    known = spark.createDataFrame([("the", 5000), *((f"w{i}", 1) for i in range(50))], "w string, c long")
    rows = spark.createDataFrame([(i, "the" if i % 3 else f"w{i % 60}") for i in range(600)], "doc_id long, w string")
    got = {(r.doc_id, r.w): r.c for r in context.looked_up(rows, known, ["w"]).collect()}
    table = {r.w: r.c for r in known.collect()}
    assert got == {(r.doc_id, r.w): table.get(r.w) for r in rows.collect()}


SF = "/root/testdata/sf0.01"


def test_languages_of_texts_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) >= 60")
    profiles = language.Profiles(docs.filter("doc_id % 5 <> 0").select("lang", "text"))
    named = profiles.detected(docs.filter("doc_id % 5 = 0").select("doc_id", "text"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").filter("lang IS NOT NULL").collect()
    assert len(named) > 100 and sum(r.detected_lang == r.lang for r in named) >= 0.95 * len(named)


def test_language_split_by_text(spark):
    labelled = spark.createDataFrame([("de", "der die das und nicht"), ("en", "the and of that not"), (None, "x"), ("en", None)], "lang string, text string")
    profiles = language.Profiles(labelled)
    docs = spark.createDataFrame([(1, "das und der", "en"), (2, "of the", "de"), (3, None, "de"), (4, "", None)], "doc_id long, text string, lang string")
    detected = profiles.detected(docs, "doc_id")
    assert {r.doc_id: r.detected_lang for r in detected.collect()} == {1: "de", 2: "en", 3: None, 4: None}
    kept, rest = language.split(docs, detected, "doc_id", "de")
    assert [r.doc_id for r in kept.collect()] == [1] and {r.doc_id: r.detected_lang for r in rest.collect()} == {2: "en", 3: None, 4: None}
    assert kept.columns == docs.columns


def test_places_are_no_rows_of_a_shuffle(spark):
    """A chunk asks once for each key; runs of documents hold whole ones."""
    docs = frame(spark, corpus(random.Random(4), 30))
    model = context.two_sided_counts(docs)
    found = context.masked_perplexity(docs, model)
    for rows in (model, found):
        assert "Generate" not in rows._jdf.queryExecution().optimizedPlan().toString()
    most = context.CHUNK
    assert list(context._cuts(np.array([most - 1, 1, 1, most + 5, 0, 2]))) == [(0, 2), (2, 3), (3, 4), (4, 6)] and list(context._cuts(np.array([], int))) == []
    l, w, r = context._words(np.array([0, 5, 6, 0, 0, 0, 0, 7, 0]), np.array([2, 0, 1]))
    assert (l.tolist(), w.tolist(), r.tolist()) == ([0, 5, 0], [5, 6, 7], [6, 0, 0])


def test_profiles_are_counted_once(spark):
    """What profiles are made of is written, so texts aren't counted again with
    each use."""
    profiles = language.Profiles(spark.createDataFrame([("de", "der die das"), ("en", "the and")], "lang string, text string"))
    assert "translate" not in profiles.gains._jdf.queryExecution().optimizedPlan().toString()
    rows = {r.g: (r.gain_0, r.gain_1) for r in profiles.gains.collect()}
    assert rows[" di"] == (pytest.approx(math.log(2)), 0.0) and rows[" d" + "e"] == (pytest.approx(math.log(2)), 0.0) and rows["the"] == (0.0, pytest.approx(math.log(2)))
    docs = spark.createDataFrame([(1, "the"), (2, "")], "doc_id long, text string")
    assert "sort_array" not in profiles.scored(docs, "doc_id")._jdf.queryExecution().optimizedPlan().toString()
