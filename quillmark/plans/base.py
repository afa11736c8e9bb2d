"""Input relations of the queries, in Spark and, as SQL text, for the oracle.

Every adaptation of the tables (which document counts as which kind of sample)
is stated twice, once per engine, and nowhere else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.arrays import tokens

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its oracle."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def spread(rows: DataFrame) -> DataFrame:
    """A table of fewer splits than cores (one small file) dealt out to all of
    them, since per-document work is heavy; larger tables are left alone."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def r6(c: Column) -> Column:
    return F.round(c, 6)


# --- samples: documents as human, raw and humanized texts -----------------

SAMPLES_SQL = """samples AS (
  SELECT doc_id, text, lang, source, doc_id % 10 AS kind,
    CASE WHEN doc_id % 10 < 4 THEN 'human' WHEN doc_id % 10 < 7 THEN 'ai_raw' ELSE 'ai_humanized' END AS label,
    CASE WHEN doc_id % 10 < 4 THEN 'human_rechunked_' || doc_id
         WHEN doc_id % 10 < 7 THEN 'ai_raw_' || CASE doc_id % 10 WHEN 4 THEN 'transformers' WHEN 5 THEN 'openai' ELSE 'anthropic' END || '_' || doc_id
         ELSE 'ai_humanized_backtranslate_ai_raw_' || CASE doc_id % 10 WHEN 7 THEN 'transformers' WHEN 8 THEN 'openai' ELSE 'anthropic' END || '_' || (doc_id - 3) END AS sample_id,
    CASE WHEN doc_id % 10 >= 7 THEN 'ai_raw_' || CASE doc_id % 10 WHEN 7 THEN 'transformers' WHEN 8 THEN 'openai' ELSE 'anthropic' END || '_' || (doc_id - 3) END AS original_id,
    (doc_id // 10) % 5 = 0 AS holdout
  FROM documents)"""

GENERATOR_SQL = """CASE WHEN sample_id LIKE 'human%' THEN 'human' WHEN contains(sample_id, '_transformers_') THEN 'qwen'
  WHEN contains(sample_id, '_openai_') THEN 'gpt4o_mini' WHEN contains(sample_id, '_anthropic_') THEN 'claude_sonnet5' END"""

TOKENS_SQL = r"regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')"
#: Words between white space, as list.
WORDS_SQL = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    kind = F.col("doc_id") % 10
    raw_kind = F.when(kind.isin(4, 7), "transformers").when(kind.isin(5, 8), "openai").otherwise("anthropic")
    raw = F.concat(F.lit("ai_raw_"), raw_kind, F.lit("_"), F.when(kind >= 7, F.col("doc_id") - 3).otherwise(F.col("doc_id")).cast("string"))
    return d.withColumns(
        {
            "kind": kind,
            "label": F.when(kind < 4, "human").when(kind < 7, "ai_raw").otherwise("ai_humanized"),
            "sample_id": F.when(kind < 4, F.concat(F.lit("human_rechunked_"), F.col("doc_id").cast("string"))).when(kind < 7, raw).otherwise(F.concat(F.lit("ai_humanized_backtranslate_"), raw)),
            "original_id": F.when(kind >= 7, raw),
            "holdout": F.floor(F.col("doc_id") / 10) % 5 == 0,
        }
    )


def tokenised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).withColumn("tokens", tokens(F.col("text")))


# --- predictions: three classes from the embeddings table -----------------

PREDICTIONS_SQL = """p0 AS (
  SELECT vec_id, label % 3 AS y, CASE WHEN vec_id % 4 = 0 THEN (label % 3 + 1) % 3 ELSE label % 3 END AS yhat, vec_id % 97 AS k,
    CASE vec_id % 4 WHEN 0 THEN 'human' WHEN 1 THEN 'qwen' WHEN 2 THEN 'gpt4o_mini' ELSE 'claude_sonnet5' END AS generator
  FROM embeddings),
predictions AS (SELECT *, (1.0 + CASE WHEN yhat = 0 THEN k ELSE 0 END) / (3 + k) AS p_0, (1.0 + CASE WHEN yhat = 1 THEN k ELSE 0 END) / (3 + k) AS p_1,
    (1.0 + CASE WHEN yhat = 2 THEN k ELSE 0 END) / (3 + k) AS p_2 FROM p0)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    y = F.col("label") % 3
    base = e.select(
        "vec_id",
        y.alias("y"),
        F.when(F.col("vec_id") % 4 == 0, (y + 1) % 3).otherwise(y).alias("yhat"),
        (F.col("vec_id") % 97).alias("k"),
        F.when(F.col("vec_id") % 4 == 0, "human").when(F.col("vec_id") % 4 == 1, "qwen").when(F.col("vec_id") % 4 == 2, "gpt4o_mini").otherwise("claude_sonnet5").alias("generator"),
    )
    return base.withColumns({f"p_{c}": (F.lit(1.0) + F.when(F.col("yhat") == c, F.col("k")).otherwise(0)) / (F.lit(3) + F.col("k")) for c in range(3)})
