import hashlib
import random
import re

import numpy as np
import zstandard
from pyspark.sql import functions as F

from quillmark.llm import repeats


def brute(rows, width):
    """(doc_id, words, removed places, kept text) of each (doc_id, text)."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    begins = {}
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - width + 1):
            if d is not None:
                begins.setdefault(tuple(w[i : i + width]), []).append(d)
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = {p for i in range(len(w) - width + 1) if d is not None and min(begins[tuple(w[i : i + width])]) < d for p in range(i, i + width)}
        out.append((d, len(w), sorted(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def found(spark, rows, width, **more):
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"place": F.lit(1), "owner": F.lit("x"), "chunk": F.lit(2)}).repartition(3)
    got = repeats.without_repeats(table, width, **more).collect()
    return [(r.doc_id, r.n_words, [p for s in r.removed for p in range(s.start, s.end)], r.text) for r in got]


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[3], r[1])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_against_brute_force_on_dense_repeats(spark):
    rng = random.Random(5)
    rows = []
    for d in range(120):
        text = []
        while len(text) < rng.randint(0, 60):
            text += [rng.choice("ab") * rng.randint(1, 2)] if rng.random() < 0.6 else [f"w{rng.randint(0, 400)}"]
        if rows and rng.random() < 0.5:
            other = (rng.choice(rows)[1] or "").split()
            text[rng.randint(0, len(text)) : 0] = other[rng.randint(0, 5) : rng.randint(5, 40)]
        rows.append((rng.choice([d, d, d // 2]), rng.choice([" ", "\n", " \t "]).join(text)))
    rng.shuffle(rows)
    for width, anchor in ((4, 2), (13, 5), (3, 3), (5, 1)):
        same(found(spark, rows, width, anchor=anchor), brute(rows, width))


def test_nulls_ties_repeats_case_and_long_texts(spark):
    line = " ".join(f"word{i}" for i in range(20))
    long = " ".join(f"x{i % 5000}" for i in range(60_000))
    rows = [
        (1, line), (1, line), (2, line), (None, line), (None, line), (3, None), (4, ""), (5, " \n "), (6, line.upper()), (7, " ".join(line.split()[:12])),
        (8, long), (9, "a b " + long + " c"), (-5, "ünï " * 20), (10, "ünï " * 13 + "end"), (11, "one two " * 13), (12, "one two " * 14),
    ]
    got = found(spark, rows, 13)
    same(got, brute(rows, 13))
    assert [r[3] for r in got if r[0] == 10] == ["end"] and [r[3] for r in got if r[0] == 1] == [line, line]
    assert found(spark, [], 13) == []


def test_more_windows_than_an_automaton_holds():
    """Automata of few windows find what one of all finds."""
    text = " ".join(f"w{i % 17}" if i % 50 else "x" for i in range(400))
    raw = f"{text}\n{text} end".encode()
    chunk = repeats._Chunk([1, 2], [len(text), len(text) + 5], zstandard.ZstdCompressor().compress(raw))
    _, places = np.unique(np.lib.stride_tricks.sliding_window_view(chunk.hashes, 4), axis=0, return_index=True)
    owners = np.where(places % 2, 1, 2)
    whole = repeats._covered(chunk, places, owners, 4)
    assert whole.any() and not whole.all()
    assert (whole == repeats._covered(chunk, places, owners, 4, limit=7)).all()


def test_words_as_characters():
    hashes = np.arange(70_000, dtype=np.uint64) * np.uint64(3)
    words = repeats.spelled(hashes, hashes[1:])
    assert len({words[i : i + 2] for i in range(0, 140_000, 2)}) == 70_000 and words[:2] == "\0\0"
    assert not set(words[2::2]) & set(words[3::2]) and len(set(words)) < 600
    assert repeats.spelled(hashes[5:9], hashes[1:]) == words[10:18]


def test_query(spark):
    from quillmark.llm.queries import op13_substring_dedup

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted((d, n, len(gone), hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, kept in brute(rows, 13))
    assert sorted(map(tuple, op13_substring_dedup(spark, sf).collect())) == want
