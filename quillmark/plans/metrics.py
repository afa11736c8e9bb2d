"""Queries of the evaluation aggregates (EVA1-EVA17)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators import metrics as operators
from quillmark.plans.base import PREDICTIONS_SQL, predictions, query, r6, table
from quillmark.sources.connectors import markdown

_P = f"WITH {PREDICTIONS_SQL}"


def _classes(by: str = "") -> str:
    k = by + ", " if by else ""
    return f"""c AS (SELECT {k}y, yhat, count(*) AS n FROM predictions GROUP BY ALL), s AS (SELECT {k}y AS class, n AS support, 0 AS predicted, CASE WHEN y = yhat THEN n ELSE 0 END AS tp FROM c UNION ALL SELECT {k}yhat AS class, 0 AS support, n AS predicted, 0 AS tp FROM c),
 f AS (SELECT {k}class, sum(support) AS support, sum(predicted) AS predicted, sum(tp) AS tp FROM s GROUP BY ALL), m AS (SELECT *, CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * tp / (support + predicted) END AS f1 FROM f)"""


_SUMMARY = "round(sum(tp) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, CAST(sum(support) AS BIGINT) AS n"
_OVR = "o AS (" + " UNION ALL ".join(f"SELECT {c} AS class, p_{c} AS p, CASE WHEN y = {c} THEN 1 ELSE 0 END AS t FROM predictions" for c in range(3)) + ")"


def _shown(rows: DataFrame, *names: str) -> DataFrame:
    return rows.select(*(r6(F.col(c)).alias(c) if kind == "double" else F.col(c) for c, kind in rows.dtypes if not names or c in names))


@query(f"{_P}, {_classes()} SELECT {_SUMMARY} FROM m")
def eva01_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(operators.summary(predictions(spark, sf_dir)))


@query(f"{_P} SELECT y, yhat, count(*) AS n FROM predictions GROUP BY 1, 2")
def eva01_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.confusion(predictions(spark, sf_dir))


@query(f"{_P}, {_OVR}, g AS (SELECT class, p, sum(t) AS pos, sum(1 - t) AS neg FROM o GROUP BY 1, 2), b AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY class ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT class, round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM b GROUP BY 1")
def eva01_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(operators.auc(predictions(spark, sf_dir)))


@query(f"{_P}, {_classes()} SELECT '| ' || class || ' | ' || CAST(support AS BIGINT) || ' | ' || CAST(tp AS BIGINT) || ' |' AS line FROM m")
def eva02_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown(operators.per_class(predictions(spark, sf_dir)).select("class", "support", "tp"))


@query(f"{_P}, {_classes('generator')} SELECT generator, {_SUMMARY} FROM m GROUP BY 1")
def eva03_by_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(operators.summary(predictions(spark, sf_dir), "generator"))


@query(f"{_P}, {_classes('generator')} SELECT '| ' || generator || ' | ' || CAST(sum(support) AS BIGINT) || ' | ' || CAST(sum(tp) AS BIGINT) || ' |' AS line FROM m GROUP BY generator")
def eva04_generator_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = operators.per_class(predictions(spark, sf_dir), "generator")
    return markdown(c.groupBy("generator").agg(F.sum("support").alias("n"), F.sum("tp").alias("tp")))


@query(f"{_P}, {_OVR} SELECT class, round(avg((p - t) * (p - t)), 6) AS brier FROM o GROUP BY 1")
def eva05_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(operators.brier(predictions(spark, sf_dir)))


@query(f"{_P}, {_OVR} SELECT class, CAST(len(list_filter([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9], lambda e: CAST(e AS DOUBLE) < p)) AS BIGINT) AS bin, round(avg(p), 6) AS mean_p, round(avg(t), 6) AS mean_t, count(*) AS n FROM o GROUP BY 1, 2")
def eva06_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(operators.reliability(predictions(spark, sf_dir)))


@query(f"{_P}, t AS (SELECT greatest(p_0, p_1, p_2) AS p FROM predictions) SELECT round(avg(p), 6) AS mean, round(quantile_cont(p, 0.5), 6) AS median, round(avg(CASE WHEN p > 0.99 THEN 1 ELSE 0 END), 6) AS over_99, round(avg(CASE WHEN p > 0.999 THEN 1 ELSE 0 END), 6) AS over_999 FROM t")
def eva07_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(operators.confidence(predictions(spark, sf_dir), F.greatest("p_0", "p_1", "p_2")))


@query(f"{_P}, a AS (SELECT generator, avg(CASE WHEN y = yhat THEN 1 ELSE 0 END) AS before, avg(CASE WHEN (y = 0) = (yhat = 0) THEN 1 ELSE 0 END) AS after FROM predictions GROUP BY 1) SELECT generator, round(before, 6) AS before, round(after, 6) AS after, round(after - before, 6) AS delta FROM a")
def eva09_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    strict = p.groupBy("generator").agg(F.avg((F.col("y") == F.col("yhat")).cast("int")).alias("value"))
    binary = p.groupBy("generator").agg(F.avg(((F.col("y") == 0) == (F.col("yhat") == 0)).cast("int")).alias("value"))
    return _shown(operators.compared(strict, binary, "generator"))


@query(f"{_P}, c AS (SELECT y, yhat, count(*) AS n FROM predictions GROUP BY 1, 2) SELECT round(100 * sum(n) FILTER ((y = 1 AND yhat = 2) OR (y = 2 AND yhat = 1)) / sum(n) FILTER (y IN (1, 2)), 6) AS mixed_percent FROM c")
def eva12_mixed_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = operators.confusion(predictions(spark, sf_dir))
    mixed = F.sum(F.when(F.expr("(y = 1 AND yhat = 2) OR (y = 2 AND yhat = 1)"), F.col("n")))
    return c.agg(r6(100 * mixed / F.sum(F.when(F.col("y").isin(1, 2), F.col("n")))).alias("mixed_percent"))


@query(f"{_P}, c AS (SELECT y, yhat, count(*) AS n FROM predictions GROUP BY 1, 2) SELECT y, yhat, n, round(n / sum(n) OVER (PARTITION BY y), 6) AS share FROM c")
def eva13_row_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(operators.row_shares(predictions(spark, sf_dir)))


@query(f"{_P}, {_OVR}, g AS (SELECT class, p, sum(t) AS pos, sum(1 - t) AS neg FROM o GROUP BY 1, 2) SELECT class, round(p, 6) AS p, round(sum(neg) OVER (PARTITION BY class ORDER BY p DESC) / sum(neg) OVER (PARTITION BY class), 6) AS fpr, round(sum(pos) OVER (PARTITION BY class ORDER BY p DESC) / sum(pos) OVER (PARTITION BY class), 6) AS tpr FROM g")
def eva14_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(operators.roc(predictions(spark, sf_dir)))


@query()
def eva15_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", array_to_vector("embedding").alias("v"))
    p = vector_to_array(F.col("p"))
    return PCA(k=2, inputCol="v", outputCol="p").fit(rows).transform(rows).select("vec_id", "label", p[0].alias("x"), p[1].alias("y"))


@query(f"{_P}, f AS (SELECT vec_id % 5 AS fold, avg(CASE WHEN y = yhat THEN 1 ELSE 0 END) AS value FROM predictions GROUP BY 1) SELECT 'accuracy' AS metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM f")
def eva16_fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = predictions(spark, sf_dir).groupBy((F.col("vec_id") % 5).alias("fold")).agg(F.avg((F.col("y") == F.col("yhat")).cast("int")).alias("value"))
    return _shown(operators.fold_summary(folds.withColumn("metric", F.lit("accuracy"))))
