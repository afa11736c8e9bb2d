"""Queries of estimators (MOD), attribution (XAI), scoring (INF) and composed
evaluations (EVA8, EVA10, EVA11, EVA17)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.operators import attribution, corpus, inference, metrics, splits
from quillmark.operators import models as operators
from quillmark.plans.base import query, r6, samples, table
from quillmark.plans.corpus import SCORES_SQL, _z
from quillmark.sources import connectors
from quillmark.sources.connectors import scratch


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, y, generator, fold, x, features): whole embeddings, the class and
    the generator that the table's label and key stand for."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(
        F.col("vec_id").alias("key"),
        (F.col("label") % 3).cast("double").alias("y"),
        F.when(F.col("vec_id") % 4 == 0, "human").when(F.col("vec_id") % 4 == 1, "qwen").when(F.col("vec_id") % 4 == 2, "gpt4o_mini").otherwise("claude_sonnet5").alias("generator"),
        (F.col("vec_id") % 3).cast("int").alias("fold"),
        F.transform("embedding", lambda v: v.cast("double")).alias("x"),
    )
    return operators.vectors(rows)


def _width(rows: DataFrame) -> int:
    return rows.select(F.size("x")).first()[0]


def _logreg():
    return operators.estimator("logreg", 0)


def _forest():
    return operators.estimator("forest", 0)


def _parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to fit on, and held-out rows."""
    return rows.filter("key % 5 <> 0"), rows.filter("key % 5 = 0")


@query()
def mod01_factory_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _parts(matrix(spark, sf_dir))
    return operators.calibrated_cv(train, test, _logreg, "key")


@query()
def mod02_estimators(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _parts(matrix(spark, sf_dir))
    n = _width(train)
    parts = [operators.scored(operators.estimator(name, n).fit(train), test).select(F.lit(name).alias("model"), "y", "yhat") for name in ("logreg", "forest", "boosting", "mlp")]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return metrics.summary(whole, "model")


@query("WITH c AS (SELECT label % 3 AS y, count(*) AS n FROM embeddings GROUP BY 1) SELECT CAST(y AS DOUBLE) AS y, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM c")
def mod03_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.balanced_weights(matrix(spark, sf_dir)).select("y", r6(F.col("weight")).alias("weight")).distinct()


@query()
def mod04_isotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    oof = operators.out_of_fold(matrix(spark, sf_dir), _logreg)
    rows = [(c, float(a), float(v)) for c, f in enumerate(operators.calibrators(oof)) for a, v in zip(f.boundaries, f.predictions, strict=True)]
    return spark.createDataFrame(rows, "class int, boundary double, value double")


@query()
def mod05_stacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _parts(matrix(spark, sf_dir))
    n = _width(train)
    makes = {name: (lambda name=name: operators.estimator(name, n)) for name in ("logreg", "forest", "mlp")}
    return operators.stacked(train, test, makes, "key").select("key", "y", "yhat", "p_0", "p_1", "p_2")


@query()
def mod06_stacking_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _parts(matrix(spark, sf_dir))
    config = {"common": {"maxIter": 20}, "logreg": {"regParam": 0.1}, "mlp": {"maxIter": 10}, "stacking": {"base_models": ["logreg", "mlp"], "meta_learner": "logreg", "passthrough": True}}
    makes, meta, passthrough = operators.stacking_from_config(config, _width(train))
    return operators.stacked(train, test, makes, "key", meta_make=meta, passthrough=passthrough).select("key", "y", "yhat", "p_0", "p_1", "p_2")


@query()
def mod07_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matrix(spark, sf_dir)
    return operators.cascade(rows.filter("key % 5 <> 0"), rows.filter("key % 5 = 0"), lambda k: _logreg(), "key")


@query()
def mod08_cascade_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matrix(spark, sf_dir)
    folds = [operators.cascade(rows.filter(F.col("fold") != f), rows.filter(F.col("fold") == f), lambda k: _logreg(), "key").withColumn("fold", F.lit(f)) for f in range(3)]
    return metrics.summary(folds[0].unionByName(folds[1]).unionByName(folds[2]), "fold")


@query()
def mod09_cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_fold = metrics.summary(operators.out_of_fold(matrix(spark, sf_dir), _logreg), "fold")
    long = by_fold.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("accuracy", "macro_f1", "weighted_f1")))).alias("s")).select("s.metric", "s.value")
    return metrics.fold_summary(long)


@query()
def mod10_save_and_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.classification import LogisticRegressionModel

    rows, path = matrix(spark, sf_dir), scratch(spark, "model")
    _logreg().fit(rows).save(path)
    return operators.scored(LogisticRegressionModel.load(path), rows).select("key", "yhat")


def _macro_f1(rows: DataFrame) -> float:
    return metrics.summary(rows).first().macro_f1


@query()
def mod11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matrix(spark, sf_dir)
    found = operators.search(rows, "logreg", _width(rows), _macro_f1, trials=8, startup=4)
    return spark.createDataFrame([(str(sorted(p.items())), float(s)) for p, s in found], "params string, score double")


@query()
def mod12_search_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best setting of each of two seeded studies of the classifier's
    space over the rows."""
    rows = matrix(spark, sf_dir)
    found = [(seed, *operators.search(rows, "logreg", _width(rows), _macro_f1, trials=3, seed=seed)[0]) for seed in (1, 2)]
    return spark.createDataFrame([(seed, float(p["C"]), p["penalty"], float(s)) for seed, p, s in found], "seed int, C double, penalty string, score double")


@query()
def mod14_tune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best setting of a study, written and read back as JSON."""
    import json

    rows, path = matrix(spark, sf_dir), scratch(spark, "tuned")
    best, score = operators.search(rows, "logreg", _width(rows), _macro_f1, trials=6, startup=3)[0]
    spark.createDataFrame([(json.dumps({"model": "logreg", "params": best, "score": score}),)], "value string").write.text(path)
    return spark.read.text(path).select(F.from_json("value", "model string, params map<string,string>, score double").alias("r")).select("r.*").select("model", F.to_json("params").alias("params"), "score")


@query()
def mod13_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matrix(spark, sf_dir).filter("key % 5 <> 0")
    even = splits.balanced(rows.withColumn("label", F.col("y").cast("string")), "label", "key")
    return metrics.summary(operators.scored(_logreg().fit(even), matrix(spark, sf_dir).filter("key % 5 = 0")))


#: A linear model given by its weights, so that both engines explain the same.
_WEIGHT_SQL = "CASE WHEN i % 3 = 0 THEN 0.5 WHEN i % 3 = 1 THEN -1.0 ELSE 2.0 END"


def _phi(spark: SparkSession, sf_dir: str, fitted: bool = True) -> DataFrame:
    """Attributions of class 1's score by a fitted model, or by given weights."""
    rows = matrix(spark, sf_dir)
    n = _width(rows)
    weights = operators.unwrapped(_logreg().fit(rows)).coefficientMatrix.toArray()[1].tolist() if fitted else [(0.5, -1.0, 2.0)[i % 3] for i in range(n)]
    means = [r.m for r in rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).orderBy("i").collect()]  # a row for each feature
    return operators.linear_attribution(rows.select("key", "x"), weights, means, [f"dim_{i}" for i in range(n)], "x", "key")


_XAI = f"""x AS (SELECT vec_id, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), m AS (SELECT i, avg(x) AS m FROM x GROUP BY 1),
 phi AS (SELECT vec_id, i, ({_WEIGHT_SQL}) * (x - m) AS phi FROM x JOIN m USING (i))"""


@query()
def xai02_tree_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's Shapley values in a forest fitted on four rows in five: parts
    of the class probabilities, the features that matter at all."""
    rows = matrix(spark, sf_dir)
    names = [f"dim_{i}" for i in range(_width(rows))]
    return attribution.tree_attribution(rows, _forest().fit(_parts(rows)[0]), names, "x", "key").filter("phi <> 0")


@query(f"WITH {_XAI} SELECT vec_id AS key, 'dim_' || i AS feature, round(phi, 6) AS phi FROM phi")
def xai02_linear_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phi(spark, sf_dir, False).select("key", "feature", r6(F.col("phi")).alias("phi"))


@query()
def xai01_unwrapped_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributions through a pipeline's first inner model."""
    from pyspark.ml import Pipeline

    rows = matrix(spark, sf_dir)
    inner = operators.unwrapped(Pipeline(stages=[_logreg()]).fit(rows))
    return spark.createDataFrame([(i, float(w)) for i, w in enumerate(inner.coefficientMatrix.toArray()[1])], "i int, weight double")


@query()
def xai03_local_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phi(spark, sf_dir).select("key", "feature", "phi")


@query(f"WITH {_XAI} SELECT 'dim_' || i AS feature, round(avg(abs(phi)), 6) AS importance FROM phi GROUP BY 1 ORDER BY avg(abs(phi)) DESC LIMIT 20")
def xai04_global_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.importance(_phi(spark, sf_dir, False)).orderBy(F.desc("importance")).limit(20).select("feature", r6(F.col("importance")).alias("importance"))


@query(f"""WITH {_XAI}, i AS (SELECT vec_id % 4 AS generator, 'dim_' || i AS feature, avg(abs(phi)) AS importance FROM phi GROUP BY 1, 2), r AS (SELECT feature, rank() OVER (PARTITION BY generator ORDER BY importance DESC) AS rank FROM i)
 SELECT feature, bool_and(rank <= 20) AS consistent FROM r GROUP BY 1""")
def xai05_consistent_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_generator = operators.importance(_phi(spark, sf_dir, False).join(matrix(spark, sf_dir).select("key", "generator"), "key"), "generator")
    ranked = by_generator.withColumn("rank", F.rank().over(Window.partitionBy("generator").orderBy(F.desc("importance"))))
    return operators.consistent(ranked, "generator", 20)


@query(f"WITH {_XAI} SELECT 'dim_' || i AS feature, round(avg(abs(phi)), 6) AS importance FROM phi GROUP BY 1")
def xai06_class_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.importance(_phi(spark, sf_dir, False)).select("feature", r6(F.col("importance")).alias("importance"))


def _built(spark: SparkSession, sf_dir: str, variant: str) -> str:
    """Artefacts of a variant, fitted on the samples outside the holdout."""
    folder = scratch(spark, "artefacts")
    inference.build(samples(spark, sf_dir).filter("NOT holdout"), folder, variant)
    return folder


@query()
def inf01_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts, without their labels, through saved artefacts."""
    engine = inference.get_engine(spark, _built(spark, sf_dir, "production"))
    return engine.predict(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "label", "probabilities", "token_count", "sentence_count", "burstiness", "warnings")


@query()
def src22_artefacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_built(spark, sf_dir, 'production')}/production"
    scaler, residuals = spark.read.parquet(f"{path}/scaler"), spark.read.parquet(f"{path}/length_residualizer")
    return scaler.join(residuals, "feature").select("feature", "centre", "scale", "slope", "intercept")


@query(SCORES_SQL)
def inf03_export_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores as lines of JSON, written and read back."""
    path = scratch(spark, "scores")
    connectors.write_jsonl(corpus.secondary_scores(_z(spark, sf_dir), "sample_id"), path)
    found = connectors.read_jsonl(spark, path, "sample_id string, llm_distance double, anomaly_heatmap map<string,double>")
    return found.select("sample_id", "llm_distance", F.explode("anomaly_heatmap").alias("feature", "z"))


@query()
def eva08_leave_one_generator_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matrix(spark, sf_dir).withColumn("label", F.when(F.col("generator") == "human", "human").otherwise("ai"))
    people = splits.human_split(rows.drop("features"), "key").filter("test")
    parts = []
    for name in ("qwen", "gpt4o_mini", "claude_sonnet5"):
        train, test = splits.leave_one_out(rows, name, people, "key")
        parts.append(metrics.summary(operators.scored(_logreg().fit(train), test)).withColumn("held_out", F.lit(name)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query()
def eva10_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matrix(spark, sf_dir)
    done = operators.scored(_logreg().fit(rows.filter("key % 5 <> 0")), rows.filter("key % 5 = 0"))
    return metrics.summary(done, "generator").unionByName(metrics.summary(done).withColumn("generator", F.lit("all")).select("generator", "accuracy", "macro_f1", "weighted_f1", "n"))


@query()
def eva11_calibration_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brier scores of held-out rows, with and without calibration."""
    train, test = _parts(matrix(spark, sf_dir))
    before = operators.scored(_forest().fit(train), test)
    after = operators.calibrated_cv(train, test, _forest, "key")
    return metrics.compared(metrics.brier(before).withColumnRenamed("brier", "value"), metrics.brier(after).withColumnRenamed("brier", "value"), "class")


@query()
def eva17_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = operators.out_of_fold(matrix(spark, sf_dir), _logreg)
    return metrics.auc(done).join(metrics.brier(done), "class")


@query()
def inf02_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts through the engine of each variant."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = [inference.get_engine(spark, _built(spark, sf_dir, v), v).predict(docs).select(F.lit(v).alias("variant"), "doc_id", "label") for v in inference.VARIANTS]
    return parts[0].unionByName(parts[1])
