"""Text, feature and corpus functions on inline rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.functions import annotate, arrays, cleaning, stylometry
from quillmark.operators import corpus, features


def column(spark, values, kind, *exprs):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [tuple(r)[1:] if len(exprs) > 1 else r[1] for r in rows.select("i", *exprs).orderBy("i").collect()]


def test_lexical(spark):
    tokens = [["a", "b", "c"], ["a", "a", "a"], ["a", "a", "b", "b"], ["a", "a", "b", "c"], []]
    c = arrays.run_counts(F.col("v"))
    got = column(spark, tokens, "array<string>", stylometry.ttr(c), stylometry.hapax_ratio(c))
    assert [round(x, 6) for x, _ in got] == [1.0, 0.333333, 0.5, 0.75, 0.0]
    assert [h for _, h in got] == [1.0, 0.0, 0.0, 0.5, 0.0]
    lengths = [["ab", "cde", "f"], ["ab", "cd", "ef"], ["kelime"], []]
    assert [(round(m, 6), round(s, 6)) for m, s in column(spark, lengths, "array<string>", stylometry.mean_word_len(F.col("v")), stylometry.word_len_std(F.col("v")))] == [(2, 1), (2, 0), (6, 0), (0, 0)]
    unique, same = column(spark, [[str(i) for i in range(20)], ["x"] * 20], "array<string>", stylometry.yule_k(arrays.run_counts(F.col("v"))))
    assert same > unique


def test_entropy(spark):
    values = [["a", "b", "c", "d"], ["a"] * 4, ["a"]]
    one, two = zip(*column(spark, values, "array<string>", stylometry.entropy_ngram(F.col("v"), 1), stylometry.entropy_ngram(F.col("v"), 2)), strict=True)
    assert one[0] == pytest.approx(math.log2(4) + 3 / (8 * math.log(2))) and one[1] == 0
    assert two[1] == 0 and two[2] == 0


def test_burstiness_and_sentences(spark):
    got = column(spark, [[10] * 4, [5], [], [1, 100, 2, 200, 3, 150], [0, 0]], "array<int>", stylometry.burstiness(F.col("v")))
    assert got[0] == -1 and got[1] is None and got[2] is None and got[3] > 0 and got[4] == 0
    assert column(spark, ["One. Two!  Three?\nFour", "", "  "], "string", arrays.sentences(F.col("v"))) == [["One.", "Two!", "Three?", "Four"], [], []]


def test_cleaning(spark):
    dirty = ["a  b\tc", "x\n\n\n\ny", "a\x07b﻿\x00", "kel-\nime", "  x  ", "ë", "kel-\n1", None]
    assert column(spark, dirty, "string", cleaning.clean_text(F.col("v"))) == ["a b c", "x\n\ny", "ab", "kelime", "x", "ë", "kel-\n1", None]


def follow_the_rules(parts, sentences, least, most):
    """Chunks hold all sentences in order; one of several sentences has at most
    ``most`` words (but for a short end that joined it); a chunk could not have
    taken the next sentence; only a single chunk is shorter than ``least`` at
    the end."""
    sizes = [len(s.split()) for s in sentences]
    assert " ".join(parts) == " ".join(sentences)
    at, ends = 0, []
    for part in parts:
        first = at
        while " ".join(sentences[first:at]) != part:
            at += 1
        ends.append((first, at))
    for number, (a, b) in enumerate(ends):
        words = sum(sizes[a:b])
        if number < len(ends) - 1:
            assert (words <= most or b - a == 1) and words + sizes[b] > most
        else:
            short = next((c for c in range(a + 1, b) if sum(sizes[a:c]) + sizes[c] > most), b)
            assert sum(sizes[short:b]) < least and (short < b or words <= most or b - a == 1)
            assert len(parts) == 1 or words >= least


def test_chunks(spark):
    texts = ["Bu bir cümle. " * 100, "a b c. " * 20 + "d.", "", " \n", "word " * 200 + ". x y.", "One."]
    for least, most in ((10, 50), (1, 7), (30, 850)):
        sentences = column(spark, texts, "string", arrays.sentences(F.col("v")))
        for parts, own in zip(column(spark, texts, "string", cleaning.chunks(F.col("v"), least, most)), sentences, strict=True):
            if own:
                follow_the_rules(parts, own, least, most)
            else:
                assert parts == []
    assert column(spark, ["a b. c d. e. f g h."], "string", cleaning.chunks(F.col("v"), 2, 4)) == [["a b. c d.", "e. f g h."]]
    assert column(spark, ["a b. c d. e."], "string", cleaning.chunks(F.col("v"), 2, 4)) == [["a b. c d. e."]]
    assert column(spark, ["", "a. b."], "string", cleaning.translation_pieces(F.col("v"), 1)) == [[""], ["a.", "b."]]


def test_filters(spark):
    assert column(spark, ["", "漢字ab"], "string", cleaning.cjk_ratio(F.col("v"))) == [0.0, 0.5]
    headers = ["123", "ALL UPPER CASE", "Cilt 3 of it", "12-15", "3. Yazar adı", "see (3), 53-66 here", "plain words in lower case"]
    got = column(spark, headers, "string", cleaning.looks_like_header(F.col("v"), F.lit(True)))
    assert got == [True, True, True, True, True, True, False]
    assert column(spark, ["a (1999)\nb\n\nc", ""], "string", cleaning.bibliography_ratio(F.col("v"))) == [pytest.approx(1 / 3), 0.0]
    assert column(spark, ["Uzun Madde: Bir!", "***"], "string", cleaning.slug(F.col("v"), F.col("i"))) == ["wikipedia_tr_00000_Uzun_Madde_Bir.txt", "wikipedia_tr_00001.txt"]


def test_generators(spark):
    ids = ["human_x_1", "ai_raw_transformers_1", "ai_humanized_backtranslate_ai_raw_openai_2", "ai_raw_anthropic_3"]
    assert column(spark, ids, "string", cleaning.generator(F.col("v"))) == ["human", "qwen", "gpt4o_mini", "claude_sonnet5"]
    with pytest.raises(Exception, match="no generator"):
        column(spark, ["mystery"], "string", cleaning.generator(F.col("v")))


def test_orthography_and_readability(spark):
    got = column(spark, ["a!! b?? c.... d!?!! e,, f!!?", "", "plain"], "string", stylometry.punct_irregularity_rate(F.col("v")))
    assert got == [pytest.approx(6 / 28), 0.0, 0.0]
    assert column(spark, ["a  b c", ""], "string", stylometry.double_space_rate(F.col("v"))) == [pytest.approx(1 / 3), 0.0]
    assert column(spark, ["A. b. C. x", ""], "string", stylometry.post_punct_case_irregularity_rate(F.col("v"))) == [pytest.approx(2 / 3), 0.0]
    words = column(spark, [["kitap", "bir", "kalem"], []], "array<string>", stylometry.atesman(F.col("v"), F.lit(1)))
    assert words == [pytest.approx(198.825 - 40.175 * 5 / 3 - 2.610 * 3), 0.0]


def test_coherence(spark):
    got = column(spark, [["kedi süt içti", "kedi uyudu"], ["tek"], ["ve", "bu"]], "array<string>", stylometry.lexical_coherence(F.col("v")))
    assert got == [pytest.approx(1 / 4), None, None]
    got = column(spark, [['Kedi " geldi.', 'Kedi " gitti.'], ["(a) b", "a ()"]], "array<string>", stylometry.lexical_coherence(F.col("v")))
    assert got == [pytest.approx(1 / 3), 0.0]


def depths(parse):
    """Hops to a word without head; a hop back to a word seen before is the last."""
    heads = dict(parse)
    out = []
    for word, _ in parse:
        hops, seen, at = 0, {word}, word
        while heads.get(at, 0):
            hops, at = hops + 1, heads[at]
            if at in seen:
                break
            seen.add(at)
        out.append(hops)
    return out


def test_depths_use_one_map_and_stop_at_cycles(spark):
    rnd = random.Random(9)
    parses = [[(1, 2), (2, 0), (1, 0), (2, 3), (3, 2)], [(1, 1), (2, 1)], [(i, i - 1) for i in range(1, 101)], [(2, 7), (5, 2)], []]
    for _ in range(30):
        n = rnd.randrange(1, 12)
        parses.append([(i, rnd.randrange(0, n + 1)) for _ in range(rnd.choice([1, 2])) for i in range(1, n + 1)])
    rows = [[(i, "w", "w", "NOUN", h, "dep") for i, h in parse] for parse in parses]
    got = column(spark, rows, annotate.PARSE, annotate.word_depths(F.col("v")))
    assert got == [depths(p) for p in parses] and max(got[2]) == 99


def test_scaling(spark):
    rows = spark.createDataFrame([(1, 1.0, 5.0, True), (2, 2.0, 5.0, True), (3, float("nan"), 5.0, True), (4, 9.0, 5.0, False)], "k int, x double, c double, train boolean")
    got = {r.k: (r.x, r.c) for r in corpus.standardize(rows, ["x", "c"], "zscore", "train").collect()}
    assert got[1] == (-1.0, 0.0) and got[2] == (1.0, 0.0) and got[3] == (0.0, 0.0) and got[4] == (15.0, 0.0)
    with pytest.raises(ValueError):
        corpus.standardize(rows, ["x"], "other")
    robust = corpus.fit_robust(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("nan"),)], "x double"), ["x"]).first()
    assert (robust.centre, robust.scale) == (2.0, 1.0)


def test_residuals(spark):
    rng = np.random.default_rng(0)
    data = [(int(t), float(2 / np.log1p(t) + rng.normal(0, 0.01))) for t in rng.integers(20, 900, 200)]
    rows = spark.createDataFrame(data, "n int, kl double")
    out = corpus.residualize(rows, corpus.fit_residualizer(rows, ["kl"], "n"), "n").toPandas()
    before, after = (abs(np.corrcoef(np.log1p([d[0] for d in data]), v)[0, 1]) for v in ([d[1] for d in data], out["kl"]))
    assert before > 0.5 and after < 0.1
    few = corpus.fit_residualizer(rows.limit(5), ["kl"], "n").first()
    assert (few.slope, few.intercept) == (0.0, 0.0)


def test_geometry(spark):
    def frame(m):
        return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "k long, v array<double>")

    for m, want in ((np.ones((5, 4)), 1.0), (np.eye(4), 0.0), (np.ones((1, 4)), 0.0)):
        assert corpus.anisotropy(frame(m), "v").first()[0] == pytest.approx(want)
    assert corpus.direction_collapse(frame(np.ones((5, 4))), "v") == 1.0
    assert corpus.direction_collapse(frame(np.eye(4)), "v") == pytest.approx(1 / 3)


def test_selection():
    x = np.random.default_rng(1).normal(size=(200, 3))
    x = np.column_stack([x, x[:, 0] + 1e-3 * x[:, 1]])
    assert corpus.vif(x.T @ x)[0] > 10 > corpus.vif(x.T @ x)[2]
    assert len(corpus.filter_by_vif(x.T @ x)) == 3
    assert corpus.cluster_columns(np.ones((2, 2))).tolist() == [0, 0]
    assert corpus.cluster_columns(np.eye(2)).tolist() == [0, 1]


def test_log_odds_and_noise(spark):
    a, b = (spark.createDataFrame(r, "g string, n long") for r in ([("x y", 3), ("u v", 1)], [("x y", 1), ("p q", 2)]))
    got = {r.g: r.score for r in corpus.log_odds(a, b).collect()}
    v, ta, tb = 3, 4, 3
    assert got["x y"] == pytest.approx(math.log(3.5 / (ta + 0.5 * v)) - math.log(1.5 / (tb + 0.5 * v)))
    assert column(spark, ["a b", "(CID:3) x", "a ,", "# *"], "string", corpus.is_noise(F.col("v"))) == [False, True, True, False]


def test_kl_of_equal_and_unseen(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["z", "a"])], "doc_id long, tokens array<string>").withColumn("counts", arrays.run_counts(F.col("tokens")))
    got = {r.doc_id: r.kl for r in features.kl_divergence(docs, features.reference_freqs(docs.filter("doc_id = 1"))).collect()}
    assert got[1] == pytest.approx(0) and 0 < got[2] < 100


def test_parses_are_computed_once(spark):
    """The root of a sentence is looked for once, not at each of its words, and
    texts are parsed once."""
    texts = ["the old dog barks. it is of the house, and 3 more!", "of the", "", None]
    docs = spark.createDataFrame([(i, t, "human") for i, t in enumerate(texts)], "doc_id long, text string, label string")
    parsed = annotate.annotated(docs)
    plan = parsed.select("dep_parse")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_position") == 1
    rows = {r.doc_id: r.dep_parse for r in parsed.select("doc_id", "dep_parse").collect()}
    assert [w.head for w in rows[0]] == [2, 0, 2, 2, 2, 2, 3, 4, 5, 0, 5, 8, 5, 5, 5] and [w.head for w in rows[1]] == [0, 1] and rows[2] == [] and rows[3] is None
    totals = features.depth_totals(parsed, "doc_id")
    assert totals._jdf.queryExecution().optimizedPlan().toString().count("array_position") == 1
    depths = {r.doc_id: r.depths for r in parsed.select("doc_id", annotate.word_depths(F.col("dep_parse")).alias("depths")).collect()}
    assert {r.doc_id: (r.total, r.n) for r in totals.collect()} == {i: (None, None) if d is None else (float(sum(d)), len(d)) for i, d in depths.items()}


def test_ngrams_are_counted_once(spark):
    docs = spark.createDataFrame([(1, "a b a b c".split()), (2, [])], "doc_id long, tokens array<string>")
    found = docs.select("doc_id", stylometry.entropy_ngram(F.col("tokens"), 2).alias("h"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("sort_array") == 1
    assert {r.doc_id: r.h for r in found.collect()} == {1: pytest.approx(1.5 + 2 / (8 * math.log(2))), 2: 0.0}
