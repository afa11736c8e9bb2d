"""Queries of streaming-like behaviour (STR1-STR7) and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.plans.base import query, table
from quillmark.streaming import events as operators



def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _kinds():
    return F.col("event_type") == "purchase", F.col("event_type") == "error"


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECONDS PRECEDING AND CURRENT ROW) AS in_window FROM events")
def str01_rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.trailing_count(_events(spark, sf_dir), "user_id", "ts", 86400).select("event_id", "in_window")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'purchase') WHERE n <= 5")
def str02_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.capped_accepts(_events(spark, sf_dir), "user_id", "event_id", F.col("event_type") == "purchase", 5).select("event_id", "user_id")


_BLACK = """i AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE event_type IN ('purchase', 'error')),
 r AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, i ORDER BY event_id) AS run FROM i), b AS (SELECT user_id, min(event_id) AS since FROM r WHERE run >= 3 GROUP BY 1)"""


@query(f"WITH {_BLACK} SELECT user_id, since FROM b")
def str03_blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted, rejected = _kinds()
    return operators.blacklisted(_events(spark, sf_dir), "user_id", "event_id", accepted, rejected, 3)


@query(f"WITH {_BLACK} SELECT user_id, since FROM b")
def str03_blacklist_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.drained(spark, operators.streak_state(operators.file_stream(spark, sf_dir, "events"), 3), "streaks")


@query(f"WITH {_BLACK}, k AS (SELECT e.*, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events e LEFT JOIN b USING (user_id) WHERE event_type = 'purchase' AND (since IS NULL OR event_id < since)) SELECT event_id, user_id FROM k WHERE n <= 5")
def src16_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted, rejected = _kinds()
    return operators.harvested(_events(spark, sf_dir), "user_id", "event_id", accepted, rejected, 5, 3).select("event_id", "user_id")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def str04_resume_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = operators.file_stream(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return operators.drained(spark, stream, "counts", "complete")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def str05_resume_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    return operators.resumed(d, d.filter("doc_id % 3 = 0"), "doc_id")


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100")
def str07_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").orderBy("doc_id").limit(100)


_TUMBLING = "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


@query(_TUMBLING)
def ext02_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.tumbling(_events(spark, sf_dir), "1 day").select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT CAST(epoch(start) AS BIGINT) AS start_s, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(h) AS start FROM events, (SELECT unnest(range(0, 6)) AS h)) GROUP BY 1")
def ext03_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.sliding(_events(spark, sf_dir), "6 hours", "1 hour").select(F.unix_seconds("start").alias("start_s"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s.s""".replace("SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s.s", "SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s"))
def ext04_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.sessions(_events(spark, sf_dir), "6 hours")


@query(_TUMBLING + " HAVING time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def ext05_tumbling_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As a stream, which gives a window when its events can't be late any more."""
    stream = operators.tumbling(operators.file_stream(spark, sf_dir, "events"), "1 day")
    return operators.drained(spark, stream, "windows").select("start", "event_type", "n", F.round("total", 4).alias("total"))
