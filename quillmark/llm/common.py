"""Shared plumbing: the shared folder, materialised tables, text columns."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests on one machine) a temporary
    folder is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quillmark-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quillmark/{name}-{uuid.uuid4().hex}"


#: Rows of a batch that goes to a Python worker while a table is written: whole
#: texts are long, and both sides hold a batch in memory.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


#: Paths of the tables written inside each ``only_kept`` that is open.
_WRITTEN: list[list[str]] = []


@contextlib.contextmanager
def only_kept(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are materialised inside are deleted at the end, but for those
    passed through what this gives: an operator whose result rests on one small
    table doesn't leave the others behind."""
    kept: set[str] = set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(_WRITTEN[-1][-1])  # the last one written
        return table

    _WRITTEN.append([])
    try:
        yield keep
        for path in _WRITTEN[-1]:
            if path not in kept:
                delete_path(spark, path)
    finally:
        _WRITTEN.pop()


def materialize(df: DataFrame, name: str, by: Iterable[str] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage in
    a way that survives the loss of any executor.  ``by``: columns of few
    values, each in files of its own."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)  # tables are read once or twice
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def trim() -> None:
    """Give freed memory back to the system: workers are reused, and what one
    stage has freed but kept counts against the next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches that gives memory back when a task ends."""

    def tidied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return tidied


def tidy_group(run: Callable[[tuple, pa.Table], pa.Table]) -> Callable[[tuple, pa.Table], pa.Table]:
    """The same for a function of groups."""

    def tidied(key: tuple, table: pa.Table) -> pa.Table:
        try:
            return run(key, table)
        finally:
            trim()

    return tidied


def tidy_cogroup(run: Callable[[tuple, pa.Table, pa.Table], pa.Table]) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """The same for a function of groups of two tables."""

    def tidied(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(key, left, right)
        finally:
            trim()

    return tidied


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def discard(df: DataFrame) -> None:
    """Delete the files behind a materialised table that nothing reads any more,
    those of all values of the columns it was written by."""
    files = df.inputFiles()
    if files:
        delete_path(df.sparkSession, re.sub("(/[^/=]+=[^/]*)+$", "", files[0].rsplit("/", 1)[0]))


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files of frames that nothing holds any more are deleted."""
    for _ in range(2):  # the first makes the frames unreachable, the second finds their shuffles so
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have, made from ``names``."""
    taken, mark = {c.lower() for c in df.columns}, "_"
    while any((mark + name).lower() in taken for name in names):
        mark += "_"
    return [mark + name for name in names]


def keyed(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a 64-bit number of each row's text in the new column
    ``name`` (null texts have one, too).  Texts that share the first hash with
    another text (as 128 bits tell) are numbered by a second one, so different
    texts of a corpus have different numbers."""
    text = F.col("text").cast("string")
    first, second = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    alike = docs.select(first.alias("first"), second.alias("second")).groupBy("first").agg(F.min("second").alias("lo"), F.max("second").alias("hi"))
    (shared,) = free_names(docs, "shared")
    table = materialize(alike.filter("lo <> hi").select(F.col("first").alias(shared)), "shared-hashes")
    return docs.join(table, first == F.col(shared), "left").withColumn(name, F.when(F.col(shared).isNull(), first).otherwise(second)).drop(shared)
