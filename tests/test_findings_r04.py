"""What the findings of round 4 named."""

import random

import numpy as np
import pandas as pd
import pytest

from quillmark.operators import context, neighbours
from tests.test_context import corpus, frame, masked_by_hand, ranks_by_hand


def test_whole_texts_are_scored(spark):
    """behind the first 512 tokens, too."""
    rng = random.Random(6)
    training = corpus(rng, 30)
    docs = [(i, t * (1 + 600 // max(len(t), 1)) + ["new", "word"] * 40) for i, t in corpus(rng, 12)]
    model = context.two_sided_counts(frame(spark, training))
    got = {r.doc_id: r.perplexity for r in context.masked_perplexity(frame(spark, docs), model).collect()}
    assert got == pytest.approx(masked_by_hand(docs, training, 10**6))
    placed = {r.doc_id: tuple(r)[1:] for r in context.context_ranks(frame(spark, docs), frame(spark, training)).collect()}
    for doc, values in ranks_by_hand(docs, training, 10**6).items():
        assert placed[doc] == pytest.approx(values, abs=1e-9), doc


def test_keys_are_packed():
    """F6-F8: keys and counts leave a run as a few rows of bytes, and come back."""
    rng = np.random.default_rng(7)
    keys = np.unique(rng.integers(0, 2**64, 5000, np.uint64))
    counts = rng.integers(0, 70000, len(keys)).astype(np.uint64)
    rows = context._dealt(keys, {"c": counts}, chunk=3)
    assert rows.schema.names == ["chunk", "part", "n", "keys", "c"] and rows.num_rows <= 2**context.PART_BITS
    held = [(context._unsorted(k.as_buffer(), n.as_py()), context._unpacked(c.as_buffer(), n.as_py())) for n, k, c in zip(*(rows.column(name) for name in ("n", "keys", "c")), strict=True)]
    assert np.array_equal(np.concatenate([k for k, _ in held]), keys) and np.array_equal(np.concatenate([c for _, c in held]), counts)
    assert context._dealt(keys[:0], {}, chunk=3).num_rows == 0 and len(context._unpacked(context._packed(keys[:0]), 0)) == 0


def test_keys_are_dealt_out_once(spark):
    """F6-F8: counts and what is asked of them meet in one shuffle, as bytes,
    and a chunk's answers stand in the order of its keys."""
    rng = random.Random(8)
    docs = frame(spark, corpus(rng, 30))
    model = context.two_sided_counts(docs)
    assert "Aggregate" not in model._jdf.queryExecution().optimizedPlan().toString()
    asked = spark.createDataFrame([(0, 0, 2, context._packed(np.array([0, 5], np.uint64)))], "chunk long, part int, n int, keys binary")
    pieces = [(False, 0, 2, context._packed(np.array([5, 2], np.uint64)), context._packed(np.array([3, 4], np.uint64))), (False, 0, 1, context._packed(np.array([5], np.uint64)), context._packed(np.array([300], np.uint64)))]
    table = spark.createDataFrame(pieces, "word boolean, part int, n int, keys binary, c binary")
    found = context.counted(asked, table, ["c"]).collect()
    assert [(r.chunk, r.part, context._unpacked(bytes(r.c), r.n).tolist()) for r in found] == [(0, 0, [0, 303])]


def test_vectors_are_copied_for_groups_of_cells():
    """a vector leaves once for each group, with its open cells as bits."""
    rng = np.random.default_rng(9)
    u, pivots, group = rng.normal(size=(30, 8)), rng.normal(size=(20, 8)), np.arange(20) // 5
    frame_ = pd.DataFrame({"v": np.arange(30), "u": list(u), "cell": np.arange(30) % 20, "kth": [np.nan] * 30})
    got = pd.concat(neighbours._opened([frame_], pivots, np.full(20, 9.0), 7, group))
    assert len(got) == 30 * 4
    cells = {v: sorted(c for b in rows["open"] for c in np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8)))) for v, rows in got.groupby("v")}
    assert cells == {v: [c for c in range(20) if c != v % 20] for v in range(30)}
