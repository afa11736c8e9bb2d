import hashlib
import math
import random
import re
import zlib

from pyspark.sql import functions as F

from quillmark.llm.importance import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def buckets_of(text, order, buckets):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)]
    return len(w), [zlib.crc32(g.encode()) % buckets for g in grams]


def brute(docs, target, percent, least, order=2, buckets=10_000):
    s, t = {}, {}
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for b in buckets_of(text, order, buckets)[1]:
                counts[b] = counts.get(b, 0) + 1
    S, T = sum(s.values()), sum(t.values())
    rows = []
    for d, text in docs:
        n, found = buckets_of(text, order, buckets)
        gains = [math.floor(1000 * math.log((t.get(b, 0) + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in found]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = percent * len(able) // 100
    out = [(r[0], *r[2:], i + 1 if i < drawn else None) for i, r in enumerate(able)]
    return sorted(out + [(r[0], *r[2:], None) for r in rows if r[1] < least], key=str)


def found(spark, docs, target, percent, least, **more):
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"rank": F.lit(1), "n": F.lit("x"), "down": F.lit(0)}).repartition(3)
    texts = spark.createDataFrame([(x, 1) for x in target], "text string, n int")
    return sorted(map(tuple, resample(table, texts, percent, least, **more).collect()), key=str)


def sentence(rng, n):
    return " ".join(rng.choice(["ä", "Das", "x1", "of", f"w{rng.randint(0, 50)}"]) for _ in range(n))


def test_against_brute_force(spark):
    rng = random.Random(4)
    docs = [(i, sentence(rng, rng.randint(0, 60))) for i in range(300)]
    target = [sentence(rng, 20) for _ in range(10)]
    assert found(spark, docs, target, 25, 20) == brute(docs, target, 25, 20)
    assert found(spark, docs, target, 100, 0, order=3, buckets=97) == brute(docs, target, 100, 0, 3, 97)


def test_nulls_ties_repeats_empty_and_long_texts(spark):
    rng = random.Random(9)
    text = sentence(rng, 30)
    docs = [(1, text), (1, text), (2, None), (3, ""), (4, "?!"), (None, text), (5, "A b. " * 100_000), (6, "ab a"), (7, "a ba"), (8, "x" * 300_000)]
    for target in ([text, None, ""], []):
        assert found(spark, docs, target, 50, 2) == brute(docs, target, 50, 2)
    assert found(spark, [], [text], 25, 20) == []


def test_the_target_is_drawn_more_often(spark):
    """Documents of the target's words are drawn before the others."""
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["red", "blue"] if i % 4 == 0 else ["one", "two"]) for _ in range(50))) for i in range(200)]
    drawn = [r[0] for r in found(spark, docs, ["red blue blue red"] * 50, 20, 20) if r[4] is not None]
    assert len(drawn) == 40 and sum(d % 4 == 0 for d in drawn) >= 38
