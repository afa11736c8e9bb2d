import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillmark.llm.packing import pack, plan
from quillmark.llm.tokens import BatchEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return tokenizer


@pytest.fixture(scope="module")
def encoder():
    return BatchEncoder(PATH)


def encoded(encoder, texts):
    out = []
    for a, b, ids, first in encoder.encode(pa.array(texts, pa.string())):
        out += [ids[first[i] : first[i + 1]].tolist() for i in range(b - a)]
    return out


@settings(deadline=None, max_examples=300)
@given(texts=st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab Z'strevlmd01 \n\t!.é漢٣😀\x85　"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=6))
def test_ids_equal_the_library(reference, encoder, texts):
    assert encoded(encoder, texts) == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]


def test_plan_is_best_fit_decreasing():
    rnd = random.Random(4)
    for _ in range(60):
        limit = rnd.choice([10, 50, 100])
        lengths = sorted((rnd.randint(1, limit) for _ in range(rnd.randint(0, 300))), reverse=True)
        gaps = []
        for n in lengths:
            fit = min((g for g in gaps if g >= n), default=None)
            if fit is None:
                gaps.append(limit - n)
            else:
                gaps.remove(fit)
                gaps.append(fit - n)
        histogram = {n: lengths.count(n) for n in set(lengths)}
        spots = defaultdict(list)
        for n, low, high, first, each, offset in plan(histogram, limit):
            for r in range(low, high):
                spots[first + (r - low) // each].append((offset + (r - low) % each * n, n))
        assert sum(map(len, spots.values())) == len(lengths)
        assert len(spots) == len(gaps)
        for places in spots.values():
            at = 0
            for offset, n in sorted(places):
                assert offset == at
                at += n
            assert at <= limit


def test_packs_whole_documents(spark, reference):
    docs = [(1, None), (2, ""), (3, "word " * 5000), (3, "tie"), (3, "tie"), (None, "no id <|endoftext|>")] + [(i, "some words here " * (i % 90)) for i in range(10, 200)]
    df = spark.createDataFrame([(d, t, 9) for d, t in docs], "doc_id long, text string, piece int")
    got = pack(df, PATH, keep_ids=True).collect()
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 1024
    want = sorted((d, ids) for d, ids in ((-1 if d is None else d, reference.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in docs) if len(ids) <= 1024)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids) for r in got if r.piece == 0 and not (r.doc_id == 3 and r.length > 10)) == want
    long = [r for r in sorted(got, key=lambda r: r.piece) if r.doc_id == 3 and r.length > 10]
    assert [i for r in long for i in r.ids] == reference.encode("word " * 5000, add_special_tokens=False).ids + [2]
    assert all(r.length == 1024 for r in long[1:]) and [r.start for r in long] == [0, *np.cumsum([r.length for r in long])[:-1].tolist()]
    total = sum(r.length for r in got)
    assert len(sequences) <= -(-total // 1024) + 1


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
