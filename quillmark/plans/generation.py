"""Queries of generation and rewriting connectors (GEN1-GEN9), with fakes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators import generation as operators
from quillmark.plans.base import SAMPLES_SQL, query, samples, table


@query("WITH p AS (SELECT DISTINCT text AS prompt FROM benchmark), l AS (SELECT prompt, row_number() OVER (ORDER BY prompt) - 1 AS i FROM p), n AS (SELECT unnest(range(0, 100)) AS id) SELECT 'ai_raw_fake_' || lpad(CAST(id AS VARCHAR), 4, '0') AS sample_id, md5(prompt) AS prompt_md5 FROM n JOIN l ON i = id % (SELECT count(*) FROM p)")
def gen01_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = table(spark, sf_dir, "benchmark").select(F.col("text").alias("prompt")).distinct()
    return operators.plan(spark, prompts, 100, "fake").select("sample_id", F.md5("prompt").alias("prompt_md5"))


@query("SELECT 'ai_raw_fake_' || item_id AS sample_id, '[generated] ' || text AS text FROM benchmark")
def gen02_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("ai_raw_fake_"), F.col("item_id").cast("string")).alias("sample_id"), F.col("text").alias("prompt"))
    return operators.generated(asked, operators.EchoGenerator)


@query(f"WITH {SAMPLES_SQL} SELECT 'ai_humanized_fake_' || sample_id AS sample_id, sample_id AS original_id FROM samples WHERE label = 'ai_raw'")
def gen04_humanize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = samples(spark, sf_dir).filter("label = 'ai_raw'")
    return operators.rewritten(raw, operators.EchoGenerator, "ai_humanized_fake_").select("sample_id", "original_id")


@query()
def gen05_back_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = samples(spark, sf_dir).filter("label = 'ai_raw'")
    return operators.rewritten(raw, operators.EchoGenerator, "ai_humanized_backtranslate_")


@query()
def gen06_augmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    human = samples(spark, sf_dir).filter("label = 'human'")
    return operators.rewritten(human, operators.EchoGenerator, "human_backtranslate_", "human")


@query(f"WITH {SAMPLES_SQL} SELECT s.sample_id, p.url FROM samples s JOIN pages p ON p.page_id = s.doc_id WHERE s.label = 'ai_raw'")
def gen08_manual_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
    return samples(spark, sf_dir).filter("label = 'ai_raw'").join(files, "doc_id").select("sample_id", "url")


@query("SELECT 'ai_raw_local_' || item_id AS sample_id, '[generated] ' || text AS text FROM benchmark")
def gen03_local_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("ai_raw_local_"), F.col("item_id").cast("string")).alias("sample_id"), F.col("text").alias("prompt"))
    return operators.generated(asked, operators.RefusesLongBatches, batch=8)


@query(f"WITH {SAMPLES_SQL}, r AS (SELECT unnest(['gemini', 'openai', 'llama', 'transformers']) AS service) SELECT 'ai_humanized_' || service || '_' || sample_id AS sample_id, sample_id AS original_id, '[generated] Rewrite in about 200 words: ' || text AS text FROM samples, r WHERE label = 'ai_raw'")
def gen07_rewriters(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = samples(spark, sf_dir).filter("label = 'ai_raw'")
    parts = [operators.rewritten_by(raw, service, 200) for service in operators.REWRITERS]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


@query("WITH p AS (SELECT DISTINCT text AS prompt FROM benchmark), l AS (SELECT prompt, row_number() OVER (ORDER BY prompt) - 1 AS i FROM p), n AS (SELECT unnest(range(0, 100)) AS id) SELECT 'ai_raw_fake_' || lpad(CAST(id AS VARCHAR), 4, '0') AS sample_id, md5('[generated] ' || prompt) AS text_md5 FROM n JOIN l ON i = id % (SELECT count(*) FROM p)")
def gen09_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection that was broken off after 30 of 100 texts and goes on."""
    prompts = table(spark, sf_dir, "benchmark").select(F.col("text").alias("prompt")).distinct()
    have = operators.generated(operators.plan(spark, prompts, 30, "fake"), operators.EchoGenerator)
    return operators.collect(spark, prompts, have, 100, "fake", operators.EchoGenerator).select("sample_id", F.md5("text").alias("text_md5"))
