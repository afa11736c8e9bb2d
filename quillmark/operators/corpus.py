"""Corpus-level fits and their application: lexicons, scaling, residuals,
selection, embedding geometry, secondary scores.

Fits return small tables (a row for each feature) or d x d matrices; what they
are applied to stays distributed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.context import cut
from quillmark.operators.features import gram_counts
from quillmark.operators.ordered import quantiles

NOISE_TOKEN = r"^[,.\-:;]+$"


def is_noise(gram: Column) -> Column:
    return F.contains(F.lower(gram), F.lit("cid")) | F.contains(gram, F.lit("�")) | F.exists(F.split(gram, " "), lambda t: F.rlike(t, F.lit(NOISE_TOKEN)))


def mined_counts(docs: DataFrame, orders: tuple[int, ...] = (2, 3)) -> DataFrame:
    return gram_counts(docs, orders).filter(~is_noise(F.col("g")))


def log_odds(a: DataFrame, b: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(g, score) over the union of two count tables (g, n)."""
    return odds_of(a.withColumnRenamed("n", "na").join(b.withColumnRenamed("n", "nb"), "g", "full").select("g", F.coalesce("na", F.lit(0)).alias("na"), F.coalesce("nb", F.lit(0)).alias("nb")), alpha)


def mined_odds(docs: DataFrame, a: str, b: str, alpha: float = 0.5) -> DataFrame:
    """(g, score) of the n-grams of two kinds of documents, counted in one pass
    and written: totals, and whoever orders the scores, read them again."""
    counts = gram_counts(docs, (2, 3), a=a, b=b).filter(~is_noise(F.col("g")))
    return odds_of(cut(counts.withColumnsRenamed({"n_a": "na", "n_b": "nb"}), "odds"), alpha)


def odds_of(both: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(g, score) of n-grams with their counts (g, na, nb)."""
    size = both.agg(F.count("*").alias("v"), F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    joined = both.crossJoin(F.broadcast(size))  # one row
    return joined.select("g", (F.log((F.col("na") + alpha) / (F.col("ta") + alpha * F.col("v"))) - F.log((F.col("nb") + alpha) / (F.col("tb") + alpha * F.col("v")))).alias("score"))


def lexicons(scores: DataFrame, k: int = 300) -> tuple[DataFrame, DataFrame]:
    """The k most telling n-grams of either side; ties by the n-gram."""
    return scores.orderBy(F.desc("score"), "g").limit(k), scores.orderBy(F.asc("score"), "g").limit(k)


def long_form(rows: DataFrame, features: list[str], *keys: str) -> DataFrame:
    """(keys, feature, x); NaN is null."""
    pairs = F.array(*(F.struct(F.lit(f).alias("feature"), F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")).alias("x")) for f in features))
    return rows.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.feature", "p.x")


def fit_zscore(rows: DataFrame, features: list[str], train: str = "true") -> DataFrame:
    return long_form(rows.filter(train), features).groupBy("feature").agg(F.avg("x").alias("centre"), F.coalesce(F.nullif(F.stddev_pop("x"), F.lit(0.0)), F.lit(1.0)).alias("scale"))


def fit_robust(rows: DataFrame, features: list[str], train: str = "true") -> DataFrame:
    found = quantiles(long_form(rows.filter(train), features), "feature", "x", [0.25, 0.5, 0.75])
    return found.select("feature", F.get("q", F.lit(1)).alias("centre"), F.coalesce(F.nullif(F.get("q", F.lit(2)) - F.get("q", F.lit(0)), F.lit(0.0)), F.lit(1.0)).alias("scale"))


SCALERS = {"zscore": fit_zscore, "robust": fit_robust}


def standardize(rows: DataFrame, features: list[str], method: str = "zscore", train: str = "true") -> DataFrame:
    """Features scaled by a fit on the training rows; missing values become 0."""
    if method not in SCALERS:
        raise ValueError(f"unknown method: {method}")
    fitted = {r.feature: (r.centre, r.scale) for r in SCALERS[method](rows, features, train).collect()}  # a row for each feature
    return rows.withColumns({f: F.coalesce((F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")) - fitted[f][0]) / fitted[f][1], F.lit(0.0)) if fitted[f][0] is not None else F.lit(0.0) for f in features})


def fit_residualizer(rows: DataFrame, features: list[str], tokens: str, train: str = "true", least: int = 10) -> DataFrame:
    """Least squares of each feature on ln(1 + tokens); (0, 0) for few values."""
    pairs = long_form(rows.filter(train), features, tokens).filter("x IS NOT NULL").withColumn("l", F.log1p(tokens))
    enough = F.count("*") >= least
    return pairs.groupBy("feature").agg(F.when(enough, F.coalesce(F.regr_slope("x", "l"), F.lit(0.0))).otherwise(0.0).alias("slope"), F.when(enough, F.coalesce(F.regr_intercept("x", "l"), F.lit(0.0))).otherwise(0.0).alias("intercept"))


def residualize(rows: DataFrame, fitted: DataFrame, tokens: str) -> DataFrame:
    """Features minus what the length explains; missing values stay."""
    columns = {}
    for r in fitted.collect():  # a row for each feature
        if r.feature in rows.columns:
            columns[r.feature] = F.col(r.feature) - (r.slope * F.log1p(tokens) + r.intercept)
    return rows.withColumns(columns)


def fuse(left: DataFrame, vectors: DataFrame, features: list[str], key: str, column: str, train: str = "true") -> DataFrame:
    """Scaled features and scaled vector components as one array, joined by
    key (rows without a partner go); both scalers are fitted on training rows."""
    scaled = standardize(left, features, "zscore", train).select(key, "label", F.array(*features).alias("_f"))
    long = vectors.join(left.filter(train).select(key), key, "left_semi").select(F.posexplode(column).alias("i", "x"))
    fitted = long.groupBy("i").agg(F.avg("x").alias("m"), F.coalesce(F.nullif(F.stddev_pop("x"), F.lit(0.0)), F.lit(1.0)).alias("s")).orderBy("i").collect()  # a row for each component
    mean, scale = F.array(*(F.lit(float(r.m)) for r in fitted)), F.array(*(F.lit(float(r.s)) for r in fitted))
    z = F.transform(column, lambda x, i: F.coalesce((x - F.get(mean, i)) / F.get(scale, i), F.lit(0.0)))
    return scaled.join(vectors.select(key, z.alias("_v")), key).select(key, "label", F.concat("_f", "_v").alias("features"))


def gram_matrix(rows: DataFrame, column: str, centred: bool = False) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sum, sum of outer products) of an array column, one partial matrix
    for each task; d x d values reach the driver."""

    def partial(frames):
        n, total, outer = 0, None, None
        for frame in frames:
            if len(frame):
                x = np.stack(frame[column].to_numpy()).astype(np.float64)
                n += len(x)
                total = x.sum(0) if total is None else total + x.sum(0)
                outer = x.T @ x if outer is None else outer + x.T @ x
        if n:
            d = len(total)
            yield pd.DataFrame({"i": np.repeat(np.arange(-1, d), d), "j": np.tile(np.arange(d), d + 1), "v": np.concatenate([total, outer.ravel()]), "n": n})

    cells = rows.select(column).mapInPandas(partial, "i int, j int, v double, n long").groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).toPandas()
    if not len(cells):
        return 0, np.zeros(0), np.zeros((0, 0))
    d, n = int(cells["j"].max()) + 1, int(cells["n"].iloc[0])
    whole = np.zeros((d + 1, d))
    whole[cells["i"].to_numpy() + 1, cells["j"].to_numpy()] = cells["v"].to_numpy()
    total, outer = whole[0], whole[1:]
    return n, total, outer - np.outer(total, total) / n if centred else outer


def vif(gram: np.ndarray) -> np.ndarray:
    """Variance inflation of each column, without a constant: its squares over
    those the other columns leave unexplained (infinite if they leave none)."""
    out = np.ones(len(gram))
    for i in range(len(gram)):
        others = [j for j in range(len(gram)) if j != i]
        if not others:
            continue
        g = gram[others, i]
        left = gram[i, i] - g @ np.linalg.lstsq(gram[np.ix_(others, others)], g, rcond=None)[0]
        out[i] = gram[i, i] / left if left > 1e-10 * gram[i, i] else np.inf
    return out


def filter_by_vif(gram: np.ndarray, threshold: float = 10.0) -> list[int]:
    """Columns left after dropping the worst again and again; no further pass."""
    kept = list(range(len(gram)))
    while len(kept) > 1:
        scores = vif(gram[np.ix_(kept, kept)])
        worst = int(np.argmax(scores))
        if scores[worst] <= threshold:
            break
        kept.pop(worst)
    return kept


def cluster_columns(gram: np.ndarray, eps: float = 0.2) -> np.ndarray:
    """Complete-linkage clusters of columns by cosine distance up to ``eps``."""
    norms = np.sqrt(np.maximum(np.diag(gram), 1e-30))
    distance = 1 - gram / np.outer(norms, norms)
    groups = [[i] for i in range(len(gram))]
    while len(groups) > 1:
        best = min(((max(distance[a, b] for a in x for b in y), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j), default=None)
        if best is None or best[0] > eps:
            break
        groups[best[1]] += groups.pop(best[2])
    out = np.zeros(len(gram), int)
    for number, group in enumerate(sorted(groups, key=min)):
        out[group] = number
    return out


def representatives(variances: DataFrame) -> DataFrame:
    """Of (cluster, feature, variance), each cluster's most varying feature."""
    return variances.groupBy("cluster").agg(F.max(F.struct("variance", F.col("feature"))).alias("m")).select("cluster", "m.feature")


def pooled(tokens: Column, mask: Column, how: str) -> Column:
    """Token vectors (array of arrays) to one: first, masked mean or maximum."""
    if how == "cls":
        return F.get(tokens, F.lit(0))
    kept = F.transform(F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda p: p["m"] == 1), lambda p: p["t"])
    if how == "mean":
        sums = F.aggregate(kept, F.transform(F.get(tokens, F.lit(0)), lambda x: F.lit(0.0)), lambda a, t: F.zip_with(a, t, lambda x, y: x + y))
        return F.transform(sums, lambda x: x / F.size(kept))
    if how == "max":
        return F.aggregate(F.slice(kept, F.lit(2), F.size(kept)), F.get(kept, F.lit(0)), lambda a, t: F.zip_with(a, t, lambda x, y: F.greatest(x, y)))
    raise ValueError(f"unknown pooling: {how}")


def unit(vector: Column) -> Column:
    norm = F.greatest(F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x)), F.lit(1e-10))
    return F.get(F.transform(F.array(norm), lambda n: F.transform(vector, lambda x: x / n)), F.lit(0))


def anisotropy(rows: DataFrame, column: str) -> DataFrame:
    """Mean cosine of different rows, from the sum of unit vectors alone."""
    units = rows.select(unit(F.col(column)).alias("u"))
    size = units.agg(F.count("*").alias("n"), F.sum(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x)).alias("own"))
    sums = units.select(F.posexplode("u").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("total"))
    n = F.col("n")
    return size.crossJoin(sums).select(F.when(n < 2, 0.0).otherwise((F.col("total") - F.col("own")) / (n * (n - 1))).alias("anisotropy"))  # one row each


def direction_collapse(rows: DataFrame, column: str) -> float:
    """Share of the variance along the first principal direction."""
    _, _, centred = gram_matrix(rows, column, centred=True)
    values = np.linalg.eigvalsh(centred)
    return 1.0 if values.sum() <= 1e-12 else float(values[-1] / values.sum())


def human_reference(rows: DataFrame, features: list[str], human: str) -> DataFrame:
    """(feature, mean, std): sample deviation, null for fewer than two values."""
    return long_form(rows.filter(human), features).groupBy("feature").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))


def anomalies(rows: DataFrame, features: list[str], reference: DataFrame, *keys: str) -> DataFrame:
    """(keys, feature, z); null where the value or the deviation is unknown,
    and a deviation of 0 counts as 1."""
    scale = F.when(F.col("std") == 0, 1.0).otherwise(F.col("std"))
    return long_form(rows, features, *keys).join(F.broadcast(reference), "feature").select(*keys, "feature", ((F.col("x") - F.col("mean")) / scale).alias("z"))  # a row for each feature


def distance(z: DataFrame, *keys: str) -> DataFrame:
    """Root mean square of the z; unknown ones count in the divisor only."""
    return z.groupBy(*keys).agg(F.sqrt(F.coalesce(F.sum(F.col("z") * F.col("z")), F.lit(0.0)) / F.count("*")).alias("llm_distance"))


def secondary_scores(z: DataFrame, *keys: str) -> DataFrame:
    """Distance and the map of known z, rounded to 4 digits."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("z").isNotNull(), F.struct("feature", F.round("z", 4).alias("z"))))))
    packed = z.groupBy(*keys).agg(pairs.alias("anomaly_heatmap"))
    return distance(z, *keys).withColumn("llm_distance", F.round("llm_distance", 4)).join(packed, list(keys))
