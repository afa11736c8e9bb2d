import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillmark.llm import quality


def symbols(text):
    return [int(quality._TABLE[c.encode()[0]]) for c in text]


def kneser_ney(texts):
    """Interpolated modified Kneser-Ney by dictionaries."""
    tables = {4: Counter()}
    for text in texts:
        s = [0, 0, 0, *symbols(text)]
        tables[4].update(tuple(s[i : i + 4]) for i in range(len(s) - 3))
    for order in (3, 2, 1):
        tables[order] = Counter(g[1:] for g in tables[order + 1])
    discounts, contexts = {}, {}
    for order, counts in tables.items():
        n = Counter(counts.values())
        if n[1] and n[2]:
            y = n[1] / (n[1] + 2 * n[2])
            found = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 2.0]
            discounts[order] = [min(max(d, 0.05), i + 0.95) for i, d in enumerate(found)]
        else:
            discounts[order] = [0.5] * 3
        sums = defaultdict(lambda: [0, 0.0])
        for g, c in counts.items():
            sums[g[:-1]][0] += c
            sums[g[:-1]][1] += discounts[order][min(c, 3) - 1]
        contexts[order] = sums

    def p(g):
        order = len(g)
        below = p(g[1:]) if order > 1 else 1 / 32
        total, held = contexts[order].get(g[:-1], (0, 0))
        if not total:
            return below
        c = tables[order].get(g, 0)
        return ((c - discounts[order][min(c, 3) - 1] if c else 0) + held * below) / total

    return p


def corpus():
    rnd = random.Random(5)
    syllables = ["the", "an", "er", "in", "on", "re", "st", "ed"]
    good = [(i, " ".join("".join(rnd.choice(syllables) for _ in range(rnd.choice([1, 2, 3]))) for _ in range(rnd.choice([1, 20, 60]))) + ".", "en") for i in range(80)]
    bad = [(1000 + i, " ".join(rnd.choice(["$$%", "QXZ!!", "||", "#@#"]) + rnd.choice("zqxj") for _ in range(40)), "en") for i in range(10)]
    rest = [(2000, None, "en"), (2001, "", None), (2002, "é" * 30_000, "xx"), (None, "the an er", "en"), (5, "the an er", "en")]
    return good + bad + rest


def test_model_equals_dictionaries(spark):
    texts = [t for _, t, _ in corpus()[:40]]
    model = quality.train(spark.createDataFrame([(0, t) for t in texts], "key long, text string"))
    p = kneser_ney(texts)
    assert np.exp(model.astype(float)).reshape(-1, 32).sum(axis=1) == pytest.approx(1, abs=1e-4)
    for text in ("the stan", "zq $", "A1. "):
        s = [0, 0, 0, *symbols(text)]
        for i in range(len(s) - 3):
            g = tuple(s[i : i + 4])
            code = sum(x << (5 * (3 - k)) for k, x in enumerate(g))
            assert model[code] == pytest.approx(math.log(p(g)), abs=1e-4)


def test_keeps_good_and_rejects_bad(spark):
    docs = spark.createDataFrame([(*r, 0.5) for r in corpus()], "doc_id long, text string, lang string, keep double")
    labels = spark.createDataFrame([(i, int(i % 9 != 8), 0) for i in range(60)] + [(1000, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality(docs, labels).collect()
    assert len(got) == len(corpus())
    kept = [r for r in got if r.doc_id is None or r.doc_id < 1000 or r.doc_id in (2000, 2001)]
    assert sum(r.keep for r in kept) >= len(kept) - 2
    assert not any(r.keep for r in got if r.doc_id is not None and 1000 <= r.doc_id < 1010)
    kept_rows = quality.keep_good(docs, labels)
    assert kept_rows.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept_rows.collect()) == sorted(str(r.doc_id) for r in got if r.keep)
    joined = {(r.doc_id, r.symbols): r.perplexity for r in quality.quality(docs, labels, most_ids=3).collect()}
    assert joined == pytest.approx({(r.doc_id, r.symbols): r.perplexity for r in got})


def test_without_trusted_texts_or_rows(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.keep for r in quality.quality(docs, labels).collect())
    assert quality.quality(docs.limit(0), labels).collect() == []
