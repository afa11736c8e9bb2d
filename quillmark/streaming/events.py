"""Streaming forms: rate limits, streaks, caps, event-time windows, resume.

Each has a batch form (window functions) and, where state is needed, a
Structured Streaming form that gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.sources.connectors import scratch


def trailing_count(rows: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Rows with ``in_window``: rows of the key in the trailing interval."""
    second = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(second).rangeBetween(-seconds * 1_000_000, Window.currentRow)
    return rows.withColumn("in_window", F.count("*").over(w))


def capped_accepts(rows: DataFrame, key: str, order: str, accepted: Column, most: int) -> DataFrame:
    """The first ``most`` accepted rows of each key."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.filter(accepted).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def blacklisted(rows: DataFrame, key: str, order: str, accepted: Column, rejected: Column, streak: int) -> DataFrame:
    """(key, since): where a key first has ``streak`` rejects in a row; accepts
    begin a new count, other rows neither count nor break it."""
    w = Window.partitionBy(key).orderBy(order)
    island = rows.filter(accepted | rejected).withColumn("_i", F.sum(accepted.cast("int")).over(w))
    run = F.sum(rejected.cast("int")).over(Window.partitionBy(key, "_i").orderBy(order))
    return island.withColumn("_run", run).filter(F.col("_run") >= streak).groupBy(key).agg(F.min(order).alias("since"))


def harvested(rows: DataFrame, key: str, order: str, accepted: Column, rejected: Column, most: int, streak: int) -> DataFrame:
    """Accepted rows under the cap and before the key's blacklisting."""
    cut = blacklisted(rows, key, order, accepted, rejected, streak)
    kept = rows.join(cut, key, "left").filter(F.col("since").isNull() | (F.col(order) < F.col("since"))).drop("since")
    return capped_accepts(kept, key, order, accepted, most)


def _run(query) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def drained(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a stream gives for the files there are, as a table."""
    path = scratch(spark, name)
    if mode == "append":
        _run(stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-state").trigger(availableNow=True).start())
        return spark.read.schema(stream.schema).parquet(path)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    _run(stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", path + "-state").trigger(availableNow=True).start())
    return spark.read.schema(stream.schema).parquet(path)


def file_stream(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Stream over a table's files."""
    return spark.readStream.schema(spark.read.parquet(f"{path}/{name}.parquet").schema).option("pathGlobFilter", f"{name}.parquet").parquet(path)


def _timed(events: DataFrame, late: str) -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late) if events.isStreaming else timed


def tumbling(events: DataFrame, size: str, late: str = "1 hour") -> DataFrame:
    w = F.window("ts", size)
    grouped = _timed(events, late)
    return grouped.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str, step: str, late: str = "1 hour") -> DataFrame:
    grouped = _timed(events, late)
    return grouped.groupBy(F.window("ts", size, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    grouped = _timed(events, late)
    return grouped.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def streak_state(stream: DataFrame, streak: int) -> DataFrame:
    """(user_id, since): keyed state over a stream (user_id, event_id,
    event_type); rows of a batch are taken in event_id order."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        run, done = state.get if state.exists else (0, False)
        out = []
        for row in pd.concat(list(frames)).sort_values("event_id").itertuples():
            if row.event_type == "purchase":
                run = 0
            elif row.event_type == "error":
                run += 1
                if run >= streak and not done:
                    done = True
                    out.append((key[0], row.event_id))
        state.update((run, done))
        yield pd.DataFrame(out, columns=["user_id", "since"]).astype({"user_id": "int64", "since": "int64"})

    return stream.select("user_id", "event_id", "event_type").groupBy("user_id").applyInPandasWithState(update, "user_id long, since long", "run int, done boolean", "append", "NoTimeout")


def resumed(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is still to do, by key and never by count."""
    return todo.join(done.select(key), key, "left_anti")
