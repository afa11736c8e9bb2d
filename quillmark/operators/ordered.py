"""Numbers, ranks, running sums and quantiles in a global order, without a task
that sees all rows or all rows of a group: rows are ranged by the order, and
what stands before a range comes from one row for each range and group.

Ranged rows are written with their range before they are read twice: borders of
ranges are sampled and ranges may be merged as a plan runs, so a plan that ranges
rows twice can range them in two ways."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.sources.connectors import scratch


def _ranged(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` with their range, their group and their place in both."""
    group = F.struct(*by) if by else F.lit(0)  # fields that are null are equal in a struct
    path = scratch(rows.sparkSession, "ranged")
    rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    ranged = rows.sparkSession.read.parquet(path).withColumn("_group", group)
    return ranged.withColumn("_row", F.row_number().over(Window.partitionBy("_part", "_group").orderBy(*order)))


def _earlier(ranged: DataFrame, **sums: str) -> DataFrame:
    """For each range and group, sums over the ranges before it."""
    totals = ranged.groupBy("_part", "_group").agg(*(F.expr(s).alias(name) for name, s in sums.items()))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_part", "_group", *(F.coalesce(F.sum(name).over(before), F.lit(0)).alias(name) for name in sums))


def placed(rows: DataFrame, by: list[str], *order: str, name: str = "n") -> DataFrame:
    """``rows`` with consecutive numbers from 0 in each group (all rows if
    ``by`` is empty) in the given order."""
    ranged = _ranged(rows, by, list(order))
    joined = ranged.join(_earlier(ranged, _before="count(*)"), ["_part", "_group"])
    return joined.withColumn(name, F.col("_before") + F.col("_row") - 1).drop("_part", "_group", "_row", "_before")


def numbered(rows: DataFrame, *order: str, name: str = "n") -> DataFrame:
    return placed(rows, [], *order, name=name)


def running_sums(rows: DataFrame, by: list[str], order: str, *columns: str) -> DataFrame:
    """``rows`` with ``sum_<column>``: sums over a group up to and with the row,
    in the order of a column without ties in the group."""
    ranged = _ranged(rows, by, [order])
    joined = ranged.join(_earlier(ranged, **{f"_before_{c}": f"sum({c})" for c in columns}), ["_part", "_group"])
    inside = Window.partitionBy("_part", "_group").orderBy("_row")
    return joined.withColumns({f"sum_{c}": F.col(f"_before_{c}") + F.sum(c).over(inside) for c in columns}).drop("_part", "_group", "_row", *(f"_before_{c}" for c in columns))


def quantiles(rows: DataFrame, by: str, value: str, shares: list[float]) -> DataFrame:
    """(by, q): exact quantiles of each group as an array, interpolated between
    neighbours; nulls don't count.  Values are picked by their number in order."""
    known = rows.filter(F.col(value).isNotNull()).select(by, value)
    sizes = known.groupBy(by).agg(F.count("*").alias("_k"))
    at = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(s) * (F.col("_k") - 1)).alias("h")) for i, s in enumerate(shares))))
    asked = sizes.select(by, at.alias("_a")).select(by, "_a.i", "_a.h")
    ends = asked.select(by, "i", F.explode(F.array(F.struct(F.floor("h").alias("n"), (1 - (F.col("h") - F.floor("h"))).alias("w")), F.struct((F.floor("h") + 1).alias("n"), (F.col("h") - F.floor("h")).alias("w")))).alias("e")).select(by, "i", "e.n", "e.w").filter("w > 0")
    picked = placed(known, [by], value).join(ends, [by, "n"])
    each = picked.groupBy(by, "i").agg(F.sum(F.col(value) * F.col("w")).alias("x"))
    return each.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("q"))
