import random
import zlib

from quillmark.llm import toxicity

INSULTS = ["idiot", "moron", "scum"]


def corpus():
    rnd = random.Random(3)
    words = [f"word{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(500):
        toxic = int(i % 4 == 0)
        text = [rnd.choice(words) for _ in range(rnd.choice([5, 40, 120]))]
        if toxic:
            text.insert(rnd.randrange(len(text)), rnd.choice(INSULTS).upper())
            if rnd.random() < 0.8:
                text.insert(rnd.randrange(len(text)), "muslim")
        elif rnd.random() < 0.1:
            text.insert(rnd.randrange(len(text)), "christian")
        docs.append((i, " ".join(text)))
        labels.append((i, 1, toxic))
    docs += [(1000, None), (1001, ""), (None, "idiot"), (1, docs[1][1]), (1002, "x " * 50_000 + "idiot")]
    return docs, [*labels, (None, 1, 1), (2, 1, None), (3, 0, 1)]


def made(spark):
    docs, labels = corpus()
    return spark.createDataFrame([(d, t, 0.1) for d, t in docs], "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows_are_told_apart(spark):
    docs, labels = made(spark)
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    truth = {i: int(i % 4 == 0) for i in range(500)}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1000].score == by_id[1001].score and by_id[1000].predicted == 0
    assert by_id[None].predicted == 1 and not by_id[None].held_out and by_id[1002].predicted == 1
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_counterfactual_penalty_frees_neutral_mentions(spark):
    docs, labels = made(spark)
    neutral = spark.createDataFrame([(1, "a muslim wrote this text"), (2, "a christian wrote this text")], "doc_id long, text string")
    gaps = []
    for weight in (0.0, 10.0):
        score = toxicity.train(docs, labels, "true", weight=weight)
        a, b = (r.s for r in neutral.select(score("text").alias("s")).collect())
        gaps.append(abs(a - b))
    assert gaps[1] < 0.3 * gaps[0]


def test_without_labels_or_rows(spark):
    docs, labels = made(spark)
    got = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert len({r.score for r in got}) == 1
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []
