"""A store of vectors by what they are made of: model, pooling and text.

The key is a digest of the three, so equal texts are encoded once, whatever
rows they stand in.  Files are partitioned by the key's first two digits: a
look-up reads the keys of the prefixes that are asked for, and writers of
different texts touch different files.  Only texts whose key is missing are
encoded.  A write adds whole files, which Spark commits at its end: a lost task
is done again, a lost writer leaves nothing that a reader sees, or whole rows
only, and what is then missing is encoded the next time.  Where two writers have
added one key, readers take one of the equal rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators.context import cut
from quillmark.operators.generation import encoded
from quillmark.operators.text import cache_key

PREFIX = 2
SCHEMA = "key string, vector array<double>, prefix string"


class VectorStore:
    """The vectors of one model and pooling in a folder."""

    def __init__(self, spark: SparkSession, folder: str, model: str, pooling: str) -> None:
        self.spark, self.folder, self.model, self.pooling = spark, folder, model, pooling

    def key(self, text: Column) -> Column:
        return cache_key(self.model, self.pooling, text)

    def rows(self) -> DataFrame:
        """(key, vector, prefix): all there is, a row for each key."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.folder).dropDuplicates(["key"])

    def _asked(self, docs: DataFrame) -> DataFrame:
        keyed = docs.filter("text IS NOT NULL").withColumn("key", self.key(F.col("text")))
        return keyed.withColumn("prefix", F.substring("key", 1, PREFIX))

    def missing(self, docs: DataFrame) -> DataFrame:
        """(key, prefix, text) of the texts without a vector, once each."""
        asked = self._asked(docs).select("key", "prefix", "text").dropDuplicates(["key"])
        return asked.join(self.rows().select("prefix", "key"), ["prefix", "key"], "left_anti")

    def add(self, docs: DataFrame, make: Callable[[int], object], width: int) -> int:
        """Encode what is missing of (text) and keep it; how many texts that
        were."""
        new = cut(self.missing(docs), "missing")  # what is encoded is what was found missing
        n = new.count()
        if n:
            vectors = encoded(new, make, width, "key").withColumnRenamed("embedding", "vector")
            kept = vectors.withColumn("prefix", F.substring("key", 1, PREFIX))
            kept.repartition("prefix").write.mode("append").partitionBy("prefix").parquet(self.folder)
        return n

    def vectors(self, docs: DataFrame) -> DataFrame:
        """``docs`` (with text) and their ``vector``, null where there is none."""
        asked = docs.withColumn("_key", self.key(F.col("text")))
        found = self.rows().select(F.col("key").alias("_key"), "vector")
        return asked.join(found, "_key", "left").drop("_key")
