"""Queries of groups, splits and samplers (SPL1-SPL13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import cleaning
from quillmark.operators import splits as operators
from quillmark.plans.base import GENERATOR_SQL, SAMPLES_SQL, query, samples

_S = f"WITH {SAMPLES_SQL}, s AS (SELECT *, {GENERATOR_SQL} AS generator FROM samples)"


def _hash(*columns: str) -> str:
    return "md5(" + " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in columns) + " || '|42')"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).withColumn("generator", cleaning.generator(F.col("sample_id")))


_GROUPS = f"""WITH RECURSIVE {SAMPLES_SQL}, pr AS (SELECT sample_id AS oid, 'ai_topic_' || lang AS parent FROM samples WHERE label = 'ai_raw'),
 p AS (SELECT sample_id, label, CASE label WHEN 'human' THEN 'human_doc_file_' || source WHEN 'ai_raw' THEN 'ai_topic_' || lang ELSE coalesce(parent, 'ai_topic_unknown_' || sample_id) END AS a, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS b FROM samples LEFT JOIN pr ON original_id = oid),
 e AS (SELECT DISTINCT x.a AS a, y.a AS c FROM p x JOIN p y USING (b)), r AS (SELECT a, a AS c FROM (SELECT DISTINCT a FROM p) UNION SELECT r.a, e.c FROM r JOIN e ON r.c = e.a), root AS (SELECT a, min(c) AS root FROM r GROUP BY 1)"""


@query(_GROUPS + " SELECT a, root FROM root")
def spl01_union_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    topic = F.concat(F.lit("ai_topic_"), F.col("lang"))
    parents = s.filter("label = 'ai_raw'").select(F.col("sample_id").alias("original_id"), topic.alias("parent"))
    edges = s.join(parents, "original_id", "left").select(
        F.when(F.col("label") == "human", F.concat(F.lit("human_doc_file_"), F.col("source"))).when(F.col("label") == "ai_raw", topic).otherwise(F.coalesce("parent", F.concat(F.lit("ai_topic_unknown_"), F.col("sample_id")))).alias("a"),
        F.md5(F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).alias("b"),
    )
    return operators.connected(edges.distinct())


@query(_GROUPS + " SELECT sample_id, label, root AS group_id FROM p JOIN root USING (a)")
def spl02_source_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.source_groups(samples(spark, sf_dir))


@query(f"WITH {SAMPLES_SQL}, f AS (SELECT source, min(doc_id) AS first FROM samples WHERE label = 'ai_raw' GROUP BY 1) SELECT source, 'ai_topic_' || lpad(CAST(dense_rank() OVER (ORDER BY first) - 1 AS VARCHAR), 2, '0') AS topic FROM f")
def spl03_topic_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.topic_numbers(samples(spark, sf_dir).filter("label = 'ai_raw'"), "source", "doc_id")


@query()
def spl04_grouped_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = operators.source_groups(samples(spark, sf_dir))
    folds = operators.grouped_folds(groups, "group_id", "label", 5)
    return folds.groupBy("fold", "label").agg(F.count("*").alias("n"))


@query(_S + f", f AS (SELECT sample_id, label, (row_number() OVER (PARTITION BY label ORDER BY {_hash('sample_id')}, sample_id) - 1) % 5 AS fold FROM s) SELECT label, fold, count(*) AS n FROM f GROUP BY 1, 2")
def spl05_stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = operators.stratified_folds(_rows(spark, sf_dir), "sample_id", "label", 5)
    return rows.groupBy("label", F.col("fold").cast("long").alias("fold")).agg(F.count("*").alias("n"))


@query(_S + f", r AS (SELECT sample_id, label, row_number() OVER (PARTITION BY label ORDER BY {_hash('sample_id')}, sample_id) AS rn FROM s), m AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM s GROUP BY label)) SELECT sample_id, label FROM r, m WHERE rn <= least")
def spl06_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.balanced(_rows(spark, sf_dir), "label", "sample_id").select("sample_id", "label")


@query(_S + f", r AS (SELECT sample_id, label, generator, row_number() OVER (PARTITION BY label, generator ORDER BY {_hash('sample_id')}, sample_id) AS rn FROM s) SELECT sample_id, label, generator FROM r WHERE label = 'human' OR rn <= 50")
def spl07_generator_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.generator_balanced(_rows(spark, sf_dir), "sample_id", 50).select("sample_id", "label", "generator")


@query(_S + f", r AS (SELECT sample_id, label, row_number() OVER (PARTITION BY label ORDER BY {_hash('sample_id')}, sample_id) AS rn FROM s) SELECT sample_id, label FROM r WHERE rn <= 200")
def spl08_capped_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.capped(_rows(spark, sf_dir), ["label"], "sample_id", 200).select("sample_id", "label")


_SPLIT = f", h AS (SELECT sample_id, row_number() OVER (ORDER BY {_hash('sample_id')}, sample_id) - 1 AS n FROM s WHERE label = 'human'), hs AS (SELECT sample_id, n < floor((SELECT count(*) FROM h) * 0.2) AS test FROM h)"


@query(_S + _SPLIT + " SELECT sample_id, test FROM hs")
def spl09_human_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.human_split(_rows(spark, sf_dir), "sample_id").select("sample_id", "test")


@query(_S + _SPLIT + """ SELECT 'train' AS part, sample_id FROM s LEFT JOIN hs USING (sample_id) WHERE (label <> 'human' AND generator <> 'qwen') OR (label = 'human' AND NOT test)
 UNION ALL SELECT 'test' AS part, sample_id FROM s LEFT JOIN hs USING (sample_id) WHERE (label <> 'human' AND generator = 'qwen') OR (label = 'human' AND test)""")
def spl10_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).select("sample_id", "label", "generator")
    test = operators.human_split(rows, "sample_id").filter("test")
    train, held = operators.leave_one_out(rows, "qwen", test, "sample_id")
    return train.select(F.lit("train").alias("part"), "sample_id").unionByName(held.select(F.lit("test").alias("part"), "sample_id"))


@query(_S + " SELECT sample_id, generator FROM s")
def spl11_generator_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("sample_id", "generator")


@query(_S + f", r AS (SELECT sample_id, source, row_number() OVER (PARTITION BY source ORDER BY {_hash('sample_id')}, sample_id) AS rn FROM s) SELECT sample_id, source FROM r WHERE rn <= ceil(100 / (SELECT count(DISTINCT source) FROM s))")
def spl12_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.quotas(_rows(spark, sf_dir), "source", "sample_id", 100).select("sample_id", "source")


@query(_S + f" SELECT sample_id FROM s ORDER BY {_hash('sample_id')}, sample_id LIMIT 500")
def spl13_projection_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).orderBy(operators.hash_order("sample_id"), "sample_id").limit(500).select("sample_id")
