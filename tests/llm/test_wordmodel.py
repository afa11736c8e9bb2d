import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import quality, wordmodel


def brute(trusted, spelled):
    """log p of every text of words by dictionaries, and the share of unknown words."""
    pairs = Counter(p for t in trusted for p in zip(["", *t.split()], [*t.split(), ""], strict=True))
    after = Counter(w for _, w in pairs)

    def held(counts):
        n = Counter(counts.values())
        return wordmodel.discounts(n[1], n[2], n[3], n[4])

    d2, d1 = held(pairs), held(after)
    total = sum(after.values())
    free = sum(d1[min(c, 3) - 1] for c in after.values()) / total

    def p1(w):
        return (after[w] - d1[min(after[w], 3) - 1]) / total if w in after else free * math.exp(spelled(w))

    def p2(v, w):
        mine = {b: n for (a, b), n in pairs.items() if a == v}
        if not mine:
            return p1(w)
        hold = sum(d2[min(n, 3) - 1] for n in mine.values())
        counted = mine[w] - d2[min(mine[w], 3) - 1] if w in mine else 0
        return (counted + hold * p1(w)) / sum(mine.values())

    return lambda text: sum(math.log(p2(v, w)) for v, w in zip(["", *text.split()], [*text.split(), ""], strict=True))


@pytest.mark.parametrize("head", [0, 6, 1000])
def test_losses_equal_dictionaries(spark, head):
    rnd = random.Random(3)
    words = ["ab", "cd", "e", "fgh", "ijk.", "l", "mn"]
    trusted = [" ".join(rnd.choices(words, range(1, 8), k=rnd.choice([1, 4, 30]))) for _ in range(40)]
    asked = [*trusted[:5], "ab zz zz cd", "qq", " ", "fgh fgh ab"]
    texts = spark.createDataFrame([(t,) for t in trusted], "text string").select(F.lit(0).cast("long").alias("key"), "text").repartition(3)

    def spell(data, offsets):
        return -2.0 * np.diff(offsets)

    model = wordmodel.train(texts, 5, head=head)
    want = brute(trusted, lambda w: -2.0 * len(w))
    frame = spark.createDataFrame(list(enumerate(asked)), "key long, text string").repartition(2)
    got = {r.key: r for r in wordmodel.losses(frame, model, lambda: spell).collect()}
    for i, text in enumerate(asked):
        assert got[i].words == len(text.split()) + 1
        assert -got[i].loss == pytest.approx(want(text), rel=1e-5, abs=1e-4), text


@pytest.mark.parametrize("head", [0, 1000])
def test_own_counts_are_unseen(spark, head):
    texts = spark.createDataFrame([(1, "a b a b"), (2, "c d"), (3, "c d")], "key long, text string")
    got = {r.key: r for r in wordmodel.losses(texts, wordmodel.train(texts, 3, head=head), lambda: lambda data, offsets: -9.0 * np.diff(offsets)).collect()}
    assert got[1].unseen > got[1].loss + 20  # only its own text has these words
    assert got[2].unseen == pytest.approx(got[2].loss)


def test_a_repeated_made_up_word_is_rejected(spark):
    rnd = random.Random(4)
    words = ["the", "there", "rest", "this", "other", "in", "thin", "string"]
    good = [(i, " ".join(rnd.choices(words, k=60)), "en") for i in range(60)]
    docs = spark.createDataFrame([*good, (100, "thering " * 300, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(100, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.keep for r in quality.quality(docs, labels).collect()}
    assert not got[100]
    assert sum(got[i] for i in range(60)) >= 58


def test_bigrams_are_asked_for_in_parts(spark, monkeypatch):
    texts = spark.createDataFrame([(i, f"a b{i % 3} c{i}") for i in range(-10, 10)], "key long, text string")
    model = wordmodel.train(texts, 3)
    files, asked, sums = [known._path for known in model.known.values()], [], wordmodel._sums

    def noted(some, model, order, spell_of):
        asked.append((order, [r.key for r in some.collect()]))
        return sums(some, model, order, spell_of)

    monkeypatch.setattr(wordmodel, "_sums", noted)
    got = wordmodel.losses(texts, model, lambda: lambda data, offsets: -9.0 * np.diff(offsets)).collect()
    assert sorted(r.key for r in got) == list(range(-10, 10))
    parts = [keys for order, keys in asked if order == 2]
    assert len(parts) > 1 and max(map(len, parts)) < 20 and sorted(sum(parts, [])) == list(range(-10, 10))
    assert not any(os.path.exists(path) for path in files)  # the driver's copies go, too
