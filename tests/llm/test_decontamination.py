import hashlib
import re

from quillmark.llm.decontamination import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items, width=10):
    windows = {}
    for item, text in items:
        if item is None or text is None:
            continue
        w = WORD.findall(lowered(text))
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w = WORD.findall(lowered(text))
        hit, named = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i : i + n]))
                if found:
                    hit.update(range(i, i + n))
                    named |= found
        out.append((doc, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def rows(df):
    return sorted([tuple(r)[:6] for r in df.collect()], key=str)


ITEM = "one two three four five six seven eight nine ten eleven twelve"
DOCS = [
    (1, "x " + ITEM.upper() + " y. " + ITEM),
    (2, "short PHRASE here, short phrase"),
    (3, None),
    (4, ""),
    (4, "é" * 300_000 + " " + ITEM),
    (None, "two three four five six seven eight nine ten eleven!"),
    (6, "one two three four five six seven eight nine"),
    (7, "clean"),
    (8, " ".join(["one two three four five six seven eight nine ten"] * 3)),
]
ITEMS = [(10, ITEM), (2, "short phrase"), (2, ITEM + " thirteen"), (5, None), (None, "clean"), (6, "...")]


def make(spark):
    docs = spark.createDataFrame([(d, t, 1) for d, t in DOCS], "doc_id long, text string, n_hit int")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


def test_matches_brute_force(spark):
    docs, items = make(spark)
    assert rows(contamination(docs, items)) == brute(DOCS, ITEMS)


def test_blocks_of_items_give_the_same_rows(spark):
    docs, items = make(spark)
    assert rows(contamination(docs, items, block_bytes=20)) == brute(DOCS, ITEMS)


def test_empty_tables(spark):
    docs, items = make(spark)
    assert all(r[2] == 0 for r in rows(contamination(docs, items.limit(0))))
    assert rows(contamination(docs.limit(0), items)) == []


def test_proximity_finds_shuffled_words(spark):
    docs = spark.createDataFrame([(1, "ten nine eight seven six five four three two one"), (2, "ten nine " + "z " * 40 + ITEM[:38])], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r.near_items) for r in contamination(docs, items, slop=12).collect()}
    assert got == {1: (False, 1), 2: (False, 0)}


def test_whole_small_corpus(spark):
    path = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert any(r[5] for r in want)
    assert rows(contamination(docs, items)) == want
