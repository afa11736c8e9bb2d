"""Evaluation aggregates: everything follows from grouped counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.ordered import quantiles, running_sums


def confusion(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by, "y", "yhat").agg(F.count("*").alias("n"))


def per_class(rows: DataFrame, *by: str) -> DataFrame:
    """(by, class, support, predicted, tp, f1); 0 for 0 / 0."""
    cells = confusion(rows, *by)
    sides = cells.select(*by, F.explode(F.array(F.struct(F.col("y").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("yhat").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")))).alias("s"))
    sums = sides.groupBy(*by, "s.class").agg(*(F.sum(f"s.{c}").alias(c) for c in ("support", "predicted", "tp")))
    return sums.withColumn("f1", F.when(F.col("support") + F.col("predicted") == 0, 0.0).otherwise(2 * F.col("tp") / (F.col("support") + F.col("predicted"))))


def summary(rows: DataFrame, *by: str) -> DataFrame:
    """(by, accuracy, macro_f1, weighted_f1, n) over the classes present."""
    classes = per_class(rows, *by)
    return classes.groupBy(*by).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
        F.sum("support").alias("n"),
    )


def one_vs_rest(rows: DataFrame, k: int = 3) -> DataFrame:
    """(class, p, t): score of each class and whether it is the true one."""
    pairs = F.array(*(F.struct(F.lit(c).alias("class"), F.col(f"p_{c}").alias("p"), (F.col("y") == c).cast("int").alias("t")) for c in range(k)))
    return rows.select(F.explode(pairs).alias("s")).select("s.class", "s.p", "s.t")


def auc(rows: DataFrame, k: int = 3) -> DataFrame:
    """(class, auc) by rank sums over the distinct scores; null without rows of
    either kind."""
    by_score = one_vs_rest(rows, k).groupBy("class", "p").agg(F.sum("t").alias("pos"), F.sum(1 - F.col("t")).alias("neg"))
    counted = running_sums(by_score, ["class"], "p", "neg").withColumn("below", F.col("sum_neg") - F.col("neg"))
    area = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    return counted.groupBy("class").agg(F.try_divide(area, F.sum("pos") * F.sum("neg")).alias("auc"))


def brier(rows: DataFrame, k: int = 3) -> DataFrame:
    return one_vs_rest(rows, k).groupBy("class").agg(F.avg((F.col("p") - F.col("t")) * (F.col("p") - F.col("t"))).alias("brier"))


def reliability(rows: DataFrame, bins: int = 10, k: int = 3) -> DataFrame:
    """(class, bin, mean score, share of true ones, n) of non-empty bins; a bin
    is the number of inner edges below the score."""
    edges = F.array(*(F.lit(i / bins) for i in range(1, bins)))
    number = F.size(F.filter(edges, lambda e: e < F.col("p")))
    return one_vs_rest(rows, k).groupBy("class", number.cast("long").alias("bin")).agg(F.avg("p").alias("mean_p"), F.avg("t").alias("mean_t"), F.count("*").alias("n"))


def confidence(rows: DataFrame, top: Column) -> DataFrame:
    share = lambda x: F.avg((top > x).cast("int"))
    median = quantiles(rows.select(F.lit(0).alias("all"), top.alias("p")), "all", "p", [0.5]).select(F.get("q", F.lit(0)).alias("median"))
    return rows.agg(F.avg(top).alias("mean"), share(0.99).alias("over_99"), share(0.999).alias("over_999")).join(median, how="left").select("mean", "median", "over_99", "over_999")  # one row each


def row_shares(rows: DataFrame) -> DataFrame:
    return confusion(rows).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("y")))


def roc(rows: DataFrame, k: int = 3) -> DataFrame:
    """(class, p, fpr, tpr) at every distinct score, highest first."""
    by_score = one_vs_rest(rows, k).groupBy("class", "p").agg(F.sum("t").alias("pos"), F.sum(1 - F.col("t")).alias("neg"))
    down = running_sums(by_score.withColumn("_down", -F.col("p")), ["class"], "_down", "pos", "neg")
    whole = by_score.groupBy("class").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    return down.join(F.broadcast(whole), "class").select("class", "p", F.try_divide("sum_neg", "_neg").alias("fpr"), F.try_divide("sum_pos", "_pos").alias("tpr"))  # a row for each class


def fold_summary(scores: DataFrame) -> DataFrame:
    """Mean and population deviation of (metric, value) over folds."""
    return scores.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def compared(before: DataFrame, after: DataFrame, *by: str) -> DataFrame:
    joined = before.withColumnRenamed("value", "before").join(after.withColumnRenamed("value", "after"), list(by))
    return joined.select(*by, "before", "after", (F.col("after") - F.col("before")).alias("delta"))
