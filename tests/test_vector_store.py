"""Vectors by content: encoded once, kept whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators.generation import HashEncoder, encoded
from quillmark.operators.vector_store import VectorStore


class Broken(HashEncoder):
    """Fails on one text."""

    def encode(self, texts):
        if "t7" in texts:
            raise RuntimeError("lost")
        return super().encode(texts)


def texts(spark, low, high):
    return spark.createDataFrame([(i, f"t{i % 20} word") for i in range(low, high)] + [(-1, None)], "doc_id long, text string")


def test_only_missing_texts_are_encoded(spark, tmp_path):
    store = VectorStore(spark, f"file://{tmp_path}/v", "m", "mean")
    docs = texts(spark, 0, 50)
    assert store.missing(docs).count() == 20 and store.rows().count() == 0
    assert store.add(docs.filter("doc_id < 5"), HashEncoder, 8) == 5
    assert store.add(docs, HashEncoder, 8) == 15
    assert store.add(docs, HashEncoder, 8) == 0 and store.missing(docs).count() == 0
    got = {r.doc_id: r.vector for r in store.vectors(docs).collect()}
    want = {r.doc_id: r.embedding for r in encoded(docs.filter("text IS NOT NULL"), HashEncoder, 8).collect()}
    assert got.pop(-1) is None and got.keys() == want.keys()
    assert all(np.allclose(got[d], want[d]) for d in want)
    other = VectorStore(spark, f"file://{tmp_path}/v", "m", "cls")
    assert other.missing(docs).count() == 20  # another pooling is another key


def test_a_lost_writer_leaves_no_half_row(spark, tmp_path):
    store = VectorStore(spark, f"file://{tmp_path}/w", "m", "mean")
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(30)], "doc_id long, text string").repartition(4)
    with pytest.raises(Exception, match="lost"):
        store.add(docs, Broken, 8)
    left = store.rows().collect()
    assert all(len(r.vector) == 8 for r in left)
    assert store.add(docs, HashEncoder, 8) == 30 - len(left)
    assert store.rows().count() == 30
    assert store.rows().filter(F.substring("key", 1, 2) != F.col("prefix")).count() == 0


def test_two_writers_of_one_key(spark, tmp_path):
    store = VectorStore(spark, f"file://{tmp_path}/x", "m", "mean")
    docs = texts(spark, 0, 20)
    store.add(docs, HashEncoder, 8)
    store.rows().limit(5).write.mode("append").partitionBy("prefix").parquet(store.folder)
    assert store.rows().count() == 20 and store.vectors(docs).count() == docs.count()
