"""Estimators: registry, calibration, stacking, cascade, search, attribution.

All on MLlib; folds and holdouts are columns; only coefficients, thresholds and
metrics reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.operators import tuning

#: Search space of the tuner (fixed values: names, kinds and ranges).
SEARCH_SPACE = {
    "xgboost": {"max_depth": ("int", 3, 10), "n_estimators": ("int", 100, 600), "eta": ("log", 0.01, 0.3), "colsample_bytree": ("float", 0.5, 1.0), "min_child_weight": ("int", 1, 10)},
    "catboost": {"depth": ("int", 4, 10), "learning_rate": ("log", 0.01, 0.3), "iterations": ("int", 200, 1000)},
    "mlp": {"n_layers": ("int", 1, 4), "n_units": ("int", 64, 512), "learning_rate": ("log", 1e-4, 1e-2), "epochs": ("int", 30, 100)},
    "logreg": {"C": ("log", 1e-3, 1e2), "penalty": ("choice", "l1", "l2")},
}


def space_of(name: str) -> dict[str, tuple]:
    if name not in SEARCH_SPACE:
        raise ValueError(f"no search space for: {name}")
    return SEARCH_SPACE[name]


def laid_out(name: str, params: dict[str, object]) -> dict[str, object]:
    """A setting with the layers that its numbers stand for."""
    if name != "mlp":
        return params
    return {"hidden_layers": [params["n_units"]] * params["n_layers"], **{k: v for k, v in params.items() if k not in ("n_layers", "n_units")}}


def translated(name: str, params: dict[str, object], n_features: int, n_classes: int, n_rows: int = 1000) -> tuple[str, dict[str, object]]:
    """Registry name and parameters for those of the search space."""
    if name == "logreg":
        return name, {"regParam": 1 / (params.get("C", 1.0) * n_rows), "elasticNetParam": 1.0 if params.get("penalty") == "l1" else 0.0}
    if name == "mlp":
        return name, {"layers": [n_features, *params.get("hidden_layers", [32]), n_classes], "stepSize": params.get("learning_rate", 0.03), "maxIter": params.get("epochs", 30)}
    names = {"max_depth": "maxDepth", "depth": "maxDepth", "n_estimators": "maxIter", "iterations": "maxIter", "eta": "stepSize", "learning_rate": "stepSize", "min_child_weight": "minInstancesPerNode"}
    found = {names[k]: v for k, v in params.items() if k in names}
    if "colsample_bytree" in params:
        found["featureSubsetStrategy"] = str(params["colsample_bytree"])
    return "boosting", found


def estimator(name: str, n_features: int, n_classes: int = 3, **params: object) -> Estimator:
    """Registry: logreg, forest, boosting (one against the rest), mlp; xgboost
    and catboost with their own parameter names, as boosting."""
    if name in ("xgboost", "catboost"):
        name, params = translated(name, params, n_features, n_classes)
    if name == "logreg":
        return LogisticRegression(featuresCol="features", labelCol="y", **({"regParam": 0.01, "maxIter": 50} | params))
    if name == "forest":
        return RandomForestClassifier(featuresCol="features", labelCol="y", seed=42, **({"numTrees": 20, "maxDepth": 5} | params))
    if name == "boosting":
        base = GBTClassifier(featuresCol="features", labelCol="y", seed=42, **({"maxIter": 10, "maxDepth": 3} | params))
        return base if n_classes == 2 else OneVsRest(classifier=base, featuresCol="features", labelCol="y")
    if name == "mlp":
        return MultilayerPerceptronClassifier(featuresCol="features", labelCol="y", seed=42, **({"layers": [n_features, 32, n_classes], "maxIter": 30} | params))
    raise ValueError(f"unknown model: {name}")


def balanced_weights(rows: DataFrame, label: str = "y") -> DataFrame:
    """``weight`` = n / (k n_label)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    whole = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    return rows.join(F.broadcast(counts.crossJoin(whole)), label).withColumn("weight", F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_n", "_all", "_k")  # a row for each class


def vectors(rows: DataFrame, array: str = "x") -> DataFrame:
    return rows.withColumn("features", array_to_vector(array))


def scored(model: Model, rows: DataFrame, k: int = 3) -> DataFrame:
    """``rows`` with p_0.. and yhat.  Models without probabilities give their
    raw scores through the logistic function, normalised."""
    out = model.transform(rows)
    if "probability" in out.columns:
        p = vector_to_array("probability")
    else:
        raw = F.transform(vector_to_array("rawPrediction"), lambda r: 1 / (1 + F.exp(-r)))
        p = F.transform(raw, lambda r: r / F.aggregate(raw, F.lit(1e-12), lambda a, x: a + x))
    out = out.withColumns({f"p_{c}": F.get(p, F.lit(c)) for c in range(k)}).withColumn("yhat", F.col("prediction").cast("int"))
    return out.drop("probability", "rawPrediction", "prediction")


def out_of_fold(rows: DataFrame, make: Callable[[], Estimator], k: int = 3, fold: str = "fold") -> DataFrame:
    """Each row scored by the model fitted without its fold."""
    folds = sorted(r[0] for r in rows.select(fold).distinct().collect())  # a row for each fold
    parts = [scored(make().fit(rows.filter(F.col(fold) != f)), rows.filter(F.col(fold) == f), k) for f in folds]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def calibrators(oof: DataFrame, k: int = 3) -> list[Model]:
    """Isotonic fit of each class's out-of-fold score."""
    return [IsotonicRegression(featuresCol="_p", labelCol="_t").fit(oof.select(F.col(f"p_{c}").alias("_p"), (F.col("y") == c).cast("double").alias("_t"))) for c in range(k)]


def calibrated(rows: DataFrame, fits: list[Model]) -> DataFrame:
    """Scores through their step functions (as columns), normalised."""

    def through(p: Column, fit: Model) -> Column:
        edges, values = list(fit.boundaries), list(fit.predictions)
        knots = F.array(*(F.struct(F.lit(float(a)).alias("a"), F.lit(float(v)).alias("v")) for a, v in zip(edges, values, strict=True)))
        below, above = F.filter(knots, lambda q: q["a"] <= p), F.filter(knots, lambda q: q["a"] > p)
        low, high = F.try_element_at(below, F.lit(-1)), F.get(above, F.lit(0))
        between = low["v"] + (high["v"] - low["v"]) * (p - low["a"]) / (high["a"] - low["a"])
        return F.when(F.size(below) == 0, F.lit(float(values[0]))).when(F.size(above) == 0, F.lit(float(values[-1]))).otherwise(between)

    k = len(fits)
    staged = rows.withColumns({f"_c{c}": through(F.col(f"p_{c}"), f) for c, f in enumerate(fits)})
    total = sum((F.col(f"_c{c}") for c in range(k)), F.lit(0.0))
    staged = staged.withColumns({f"p_{c}": F.when(total > 0, F.col(f"_c{c}") / total).otherwise(1.0 / k) for c in range(k)})
    best = F.array_position(F.array(*(F.col(f"p_{c}") for c in range(k))), F.greatest(*(F.col(f"p_{c}") for c in range(k)))) - 1
    return staged.withColumn("yhat", best.cast("int")).drop(*(f"_c{c}" for c in range(k)))


def calibrated_cv(train: DataFrame, test: DataFrame, make: Callable[[], Estimator], key: str, k: int = 3, fold: str = "fold") -> DataFrame:
    """``test`` scored by one calibrated model for each fold - fitted without
    the fold, calibrated on it - and the mean of their scores."""
    folds = sorted(r[0] for r in train.select(fold).distinct().collect())  # a row for each fold
    parts = []
    for f in folds:
        model = make().fit(train.filter(F.col(fold) != f))
        fits = calibrators(scored(model, train.filter(F.col(fold) == f), k), k)
        parts.append(calibrated(scored(model, test, k), fits).select(key, "y", *(f"p_{c}" for c in range(k))))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    mean = whole.groupBy(key, "y").agg(*(F.avg(f"p_{c}").alias(f"p_{c}") for c in range(k)))
    columns = [F.col(f"p_{c}") for c in range(k)]
    return mean.withColumn("yhat", (F.array_position(F.array(*columns), F.greatest(*columns)) - 1).cast("int"))


def stacked(train: DataFrame, test: DataFrame, makes: dict[str, Callable[[], Estimator]], key: str, k: int = 3, meta_make: Callable[[int], Estimator] | None = None, passthrough: bool = False) -> DataFrame:
    """Base models' out-of-fold scores feed a meta model (logistic unless one
    is given), with the features themselves if ``passthrough``; base models
    are fitted again on all training rows for the test rows."""

    def meta(parts: dict[str, DataFrame], rows: DataFrame) -> DataFrame:
        whole = None
        for name, part in parts.items():
            slim = part.select(key, "y", *(F.col(f"p_{c}").alias(f"{name}_{c}") for c in range(k)))
            whole = slim if whole is None else whole.join(slim.drop("y"), key)
        inputs = F.array(*(F.col(f"{n}_{c}").cast("double") for n in parts for c in range(k)))
        if passthrough:
            whole = whole.join(rows.select(key, vector_to_array("features").alias("_own")), key)
            inputs = F.concat(inputs, "_own")
        return whole.withColumn("features", array_to_vector(inputs))

    inner = meta({n: out_of_fold(train, m, k) for n, m in makes.items()}, train)
    outer = meta({n: scored(m().fit(train), test, k) for n, m in makes.items()}, test)
    make = meta_make or (lambda n: estimator("logreg", n, k))
    width = len(makes) * k + (len(train.select("features").first().features) if passthrough else 0)
    return scored(make(width).fit(inner), outer, k)


def stacking_from_config(config: dict, n_features: int, n_classes: int = 3) -> tuple[dict[str, Callable[[], Estimator]], Callable[[int], Estimator], bool]:
    """Base models, meta model and passthrough of a configuration: each model
    has the common parameters, and its own over them."""
    stacking, common = config.get("stacking", {}), config.get("common", {})

    def make(name: str, n: int) -> Estimator:
        return estimator(name, n, n_classes, **{**common, **config.get(name, {})})

    bases = stacking.get("base_models", ["xgboost", "catboost", "mlp", "logreg"])
    meta = stacking.get("meta_learner", "logreg")
    return {n: (lambda n=n: make(n, n_features)) for n in bases}, lambda n: make(meta, n), stacking.get("passthrough", False)


def cascade(train: DataFrame, test: DataFrame, make: Callable[[int], Estimator], key: str) -> DataFrame:
    """Human or not, then raw or rewritten for rows called machine."""
    first = make(2).fit(train.withColumn("y", (F.col("y") > 0).cast("double")))
    second = make(2).fit(train.filter("y > 0").withColumn("y", (F.col("y") - 1).cast("double")))
    a = scored(first, test, 2).select(key, "y", F.col("yhat").alias("_a"))
    b = scored(second, test, 2).select(key, F.col("yhat").alias("_b"))
    return a.join(b, key).select(key, "y", F.when(F.col("_a") == 0, 0).otherwise(1 + F.col("_b")).alias("yhat"))


def search(rows: DataFrame, name: str, n_features: int, score: Callable[[DataFrame], float], trials: int = 50, n_classes: int = 3, batch: int = 4, seed: int = 42, startup: int = tuning.STARTUP) -> list[tuple[dict, float]]:
    """Settings of the model's search space with their out-of-fold score, best
    first, by a guided study of ``trials`` trials, ``batch`` at a time."""
    n_rows = rows.count()

    def tried(params: dict) -> float:
        kind, own = translated(name, laid_out(name, params), n_features, n_classes, n_rows)
        return score(out_of_fold(rows, lambda: estimator(kind, n_features, n_classes, **own), n_classes))

    return tuning.study(space_of(name), tried, trials, batch, seed, startup)


def unwrapped(model: Model) -> Model:
    """The innermost model of a pipeline or a one-against-the-rest model, its
    first where there are several."""
    while True:
        if hasattr(model, "stages"):
            model = model.stages[-1]
        elif hasattr(model, "models"):
            model = model.models[0]
        else:
            return model


def linear_attribution(rows: DataFrame, weights: list[float], means: list[float], names: list[str], array: str, key: str) -> DataFrame:
    """(key, feature, phi): w (x - mean), exact for a linear model."""
    terms = F.array(*(F.struct(F.lit(n).alias("feature"), (F.lit(float(w)) * (F.get(array, F.lit(i)) - float(m))).alias("phi")) for i, (n, w, m) in enumerate(zip(names, weights, means, strict=True))))
    return rows.select(key, F.explode(terms).alias("t")).select(key, "t.feature", "t.phi")


def importance(phi: DataFrame, *by: str) -> DataFrame:
    return phi.groupBy(*by, "feature").agg(F.avg(F.abs("phi")).alias("importance"))


def consistent(ranks: DataFrame, by: str, most: int) -> DataFrame:
    """(feature, consistent): within the first ``most`` of every group."""
    return ranks.groupBy("feature").agg(F.bool_and(F.col("rank") <= most).alias("consistent"))
