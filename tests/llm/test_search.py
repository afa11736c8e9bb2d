import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from quillmark.llm import search as operator
from quillmark.llm.search import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    texts = [(d, terms(t)) for d, t in docs]
    n, total = sum(bool(w) for _, w in texts), sum(len(w) for _, w in texts)
    df = {}
    for _, w in texts:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    wanted = {}
    for item, text in items:
        if item is not None and terms(text):
            wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in wanted.items():
        found = []
        for d, w in texts:
            m = 50 + 50 * len(w) * n // total if total else 50
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 20 * m)) for t in own if t in w)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -score) for i, (score, _, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, k, **more):
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit(1), "item_id": F.lit("x"), "term": F.lit(0)}).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({"doc_id": F.lit(1), "rank": F.lit(0)})
    return sorted(map(tuple, search(table, asked, k, **more).collect()), key=str)


def zipf(rng, n):
    return " ".join(f"t{int(rng.paretovariate(0.6))}" if rng.random() < 0.7 else "the" for _ in range(n))


def test_against_brute_force(spark):
    rng = random.Random(3)
    docs = [(rng.choice([i, i, i // 2]), zipf(rng, rng.randint(0, 60))) for i in range(400)]
    items = [(i, zipf(rng, rng.randint(1, 25))) for i in range(30)]
    for k, block in ((5, 1 << 20), (50, 1 << 20), (3, 900)):
        assert found(spark, docs, items, k, block_bytes=block) == brute(docs, items, k)


def test_nulls_ties_repeats_and_long_texts(spark):
    docs = [(3, "a b"), (1, "a b"), (1, "a b"), (None, "A, B!"), (None, "b a"), (5, None), (6, ""), (7, "..."), (8, "a " * 200_000 + "zz"), (9, "Ünï zz"), (10, "c"), (2**40, "c c")]
    items = [(1, "A b"), (1, "zz"), (2, None), (3, "?"), (None, "a"), (4, "zz ünï Ünï nothing"), (4, "zz ünï Ünï nothing"), (5, "c c"), (6, "nowhere")]
    for k in (1, 2, 50):
        assert found(spark, docs, items, k) == brute(docs, items, k)
    assert found(spark, [], items, 5) == [] and found(spark, docs, [], 5) == []


def test_pruning_keeps_every_result_and_saves_work():
    """Thresholds and bounds hold on a corpus in one shard; some terms are
    pruned, and what they bring is still in the scores."""
    rng = random.Random(8)
    docs = [(i, zipf(rng, 40)) for i in range(300)]
    texts = [t for _, t in docs]
    own = operator.Terms([zipf(rng, 30) for _ in range(20)], np.arange(20))
    corpus = operator.Corpus(300, 300 * 40)
    everything = operator.Terms(texts, np.arange(300))
    by_term = {}
    for d, words in enumerate(map(terms, texts)):
        assert len(words) == 40 and everything.item.max() == 299
        for t in set(words):
            by_term.setdefault(t, []).append(int(corpus.saturation(np.array([words.count(t)]), corpus.lengths(np.array([40])))[0]))
    from quillmark.llm import wordstream
    import pyarrow as pa

    impacts = []
    for t, xs in by_term.items():
        _, _, data, offsets = next(wordstream.text_slices(pa.array([t])))
        h = wordstream.words(data, offsets, wordstream.ALNUM_WORDS)[0][0]
        at = np.searchsorted(own.hashes, h)
        if at < len(own.hashes) and own.hashes[at] == h:
            xs = sorted(xs, reverse=True)
            impacts.append((int(at), len(xs), xs[9] if len(xs) >= 10 else 0, xs[0]))
    plan = operator.Plan(own, corpus, impacts, 20)
    assert len(plan.rest_item) > 0 and len(plan.seed_item) > 0
    assert (plan.bound < plan.least).all()
