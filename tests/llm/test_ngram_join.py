import random
import re

from quillmark.llm import components as parts
from quillmark.llm import ngram_join
from quillmark.llm.components import components
from quillmark.llm.ngram_join import first_of_each_group, near_duplicates


def shingles(text, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(size, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(docs, size=4, percent=85):
    sets = [(d, shingles(t, size)) for d, t in docs]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, x) in enumerate(sets):
        for j in range(i):
            y = sets[j][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i))) for i, (d, s) in enumerate(sets)), key=str)


def rows(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def corpus(seed=3):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    docs = []
    for group in range(12):
        base = [rnd.choice(words) for _ in range(rnd.choice([5, 12, 40, 90]))]
        for _ in range(rnd.choice([1, 2, 9])):
            text = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
                text[rnd.randrange(len(text))] = rnd.choice(words)
            docs.append((len(docs), " ".join(text) + (" common line that many texts share here" if group % 2 else "")))
    docs += [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "ONE"), (905, "a b c"), (906, "a B c"), (907, "a b c d"), (None, "a b c d"), (None, "zz yy xx ww vv"), (908, docs[0][1]), (908, docs[0][1]), (1, docs[1][1]), (2, docs[2][1]), (2, docs[3][1]), (909, "é É ö"), (910, "x " * 20_000)]
    return docs


def test_matches_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, component_id int")
    assert rows(near_duplicates(df)) == brute(docs)


def test_any_limits_give_the_same_rows(spark, monkeypatch):
    docs = corpus(5)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 2)
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "HUB_GAIN", 2.0)
    monkeypatch.setattr(ngram_join, "CHUNK_SEGMENTS", 40)
    assert rows(near_duplicates(df)) == brute(docs)
    assert rows(near_duplicates(df, size=5, percent=80)) == brute(docs, 5, 80)


def test_large_groups_of_near_copies(spark):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(3):
        base = [rnd.choice(words) for _ in range(70)]
        for _ in range(45):
            text = list(base)
            for _ in range(rnd.choice([1, 1, 2, 3])):
                text[rnd.randrange(len(text))] = rnd.choice(words)
            docs.append((len(docs), " ".join(text)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(near_duplicates(df)) == brute(docs)


def test_empty_table(spark):
    assert rows(near_duplicates(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    for held_links in (1, 1000):
        got = {r.node: r.root for r in components(edges, held_links).collect()}
        assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_one_row_of_each_group_stays(spark):
    base = " ".join(f"w{i}" for i in range(60))
    docs = [(5, base, 1), (3, base + " tail", 2), (3, base + " tail", 2), (3, base + " end", 3), (None, base + " x", 4), (None, "only null ids here", 5), (None, "only null ids here", 6), (8, None, 7), (8, None, 8), (9, "", 9), (10, "other words", 10)]
    df = spark.createDataFrame(docs, "doc_id long, text string, key int")
    left = first_of_each_group(df)
    assert left.columns == df.columns
    got = [(r.doc_id, r.text) for r in left.collect()]
    assert len([g for g in got if g[1] and g[1].startswith("w0")]) == 1 and [g[0] for g in got if g[1] and g[1].startswith("w0")] == [3]
    assert got.count((None, "only null ids here")) == 1 and got.count((8, None)) == 2 and (9, "") in got and (10, "other words") in got and len(got) == 6
    assert first_of_each_group(df.limit(0)).count() == 0


def test_two_thousand_near_copies(spark):
    rnd = random.Random(4)
    base = [f"w{rnd.randrange(500)}" for _ in range(150)]
    docs = []
    for i in range(2000):
        text = list(base)
        text[rnd.randrange(150)] = f"x{i}"
        docs.append((i, " ".join(text)))
    docs += [(3000 + i, " ".join(base[:100] + [f"y{rnd.randrange(10**6)}" for _ in range(70)])) for i in range(300)]  # share a passage, linked with nothing
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.component_id for r in got} == {**{i: 0 for i in range(2000)}, **{3000 + i: 3000 + i for i in range(300)}}


def test_pairs_inside_a_component_are_not_counted(spark, monkeypatch):
    base = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join([*base[: 10 * i + 5], f"x{i}", *base[10 * i + 5 :]])) for i in range(8)]  # one short list: 28 pairs
    counted, links = [], ngram_join._links

    def noted(pairs, segments, percent):
        counted.append(pairs.count())
        return links(pairs, segments, percent)

    monkeypatch.setattr(ngram_join, "_links", noted)
    assert rows(near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)
    assert counted == [7]


def test_fragments_one_after_the_other_give_the_same_rows(spark, monkeypatch):
    docs = corpus(7)
    monkeypatch.setattr(ngram_join, "PAIRS_AT_ONCE", 0)
    assert rows(near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_links_that_a_task_may_hold_need_no_steps(spark, monkeypatch):
    steps, star = [], parts._star
    monkeypatch.setattr(parts, "_star", lambda *x: steps.append(x) or star(*x))
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long").repartition(4)
    assert {r.node: r.root for r in components(edges).collect()} == {i: 0 for i in range(41)} and not steps
    assert {r.node: r.root for r in components(edges, 10).collect()} == {i: 0 for i in range(41)} and steps


def test_long_texts_that_are_too_far_apart_are_not_counted(spark, monkeypatch):
    words = [[f"{x}{i}" for i in range(4000)] for x in "stuv"]
    docs = [(i, " ".join(w[:2600] + words[0][2600:])) for i, w in enumerate(words)]  # a common third, so common segments
    docs += [(10, " ".join([*words[1][:3900], *words[0][3900:]])), (11, " ".join([*words[1][:3890], "x", *words[0][3890:]]))]
    counted, links = [], ngram_join._links

    def noted(pairs, segments, percent):
        counted.append(pairs.count())
        return links(pairs, segments, percent)

    monkeypatch.setattr(ngram_join, "_links", noted)
    assert rows(near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)
    assert sum(counted) == 1


def test_parity_bits_of_sets_of_unlike_sizes_bound_their_difference(spark):
    import numpy as np
    from pyspark.sql import functions as F

    rnd = np.random.default_rng(3)
    grams = [np.unique(rnd.integers(0, 1 << 64, n, np.uint64)) for n in (1, 500, 513, 1000, 1030, 4100, 9000)]
    rows_ = [([int(w) for w in ngram_join._parity(g)],) for g in grams]
    assert [len(r[0]) for r in rows_] == [ngram_join._width(len(g)) for g in grams] == [8, 8, 16, 16, 32, 128, 256]
    df = spark.createDataFrame(rows_, "bits array<long>")
    for words in (8, 16, 64):
        got = [r[0] for r in df.filter(f"size(bits) >= {words}").select(F.expr(ngram_join._folded("bits", str(words)))).collect()]
        for bits, g in zip(got, [g for g in grams if ngram_join._width(len(g)) >= words], strict=True):
            want = np.packbits((np.bincount((g & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1).astype(np.uint8)).view("<i8")
            assert bits == want.tolist()
    one, two = np.sort(grams[4])[:1000], grams[4]  # 16 and 32 words
    pair = spark.createDataFrame([([int(w) for w in ngram_join._parity(one)], [int(w) for w in ngram_join._parity(two)])], "bitsa array<long>, bitsb array<long>")
    apart = pair.select(F.expr(ngram_join._apart())).first()[0]
    assert 0 < apart <= len(two) - len(one)


def test_only_texts_that_may_go_are_dealt_out(spark):
    base = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(f"{i}x{j}" for j in range(30))) for i in range(300)] + [(1000 + i, " ".join([*base, f"y{i}"])) for i in range(3)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = first_of_each_group(df)
        got = sorted(r.doc_id for r in left.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [*range(300), 1000]
    branches = left._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert branches.strip().startswith("Union")  # rows that no join may ask for pass beside it
