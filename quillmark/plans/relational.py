"""Queries of the relational verbs (REL1-REL28), over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.plans.base import SAMPLES_SQL, query, r6, samples, table


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


@query("SELECT o_orderkey, o_totalprice, o_custkey FROM orders")
def rel01_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey")


@query("SELECT n_nationkey AS emb_n_nationkey, n_name AS emb_n_name FROM nation")
def rel02_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return n.withColumnsRenamed({c: f"emb_{c}" for c in n.columns})


@query("SELECT c_custkey, c_mktsegment FROM customer")
def rel03_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    return c.drop(*(x for x in c.columns if x not in ("c_custkey", "c_mktsegment")))


@query("SELECT event_id, user_id FROM events")
def rel04_drop_incomplete_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), "user_id")
    missing = rows.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in rows.columns)).first()
    return rows.select(*(c for c in rows.columns if not missing[c]))


@query("SELECT DISTINCT event_type, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS code FROM events")
def rel05_value_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).when(F.col("event_type") == "purchase", 2).otherwise(3)
    return _t(spark, sf_dir, "events").select("event_type", code.alias("code")).distinct()


@query(f"WITH {SAMPLES_SQL} SELECT CASE WHEN label = 'human' THEN 'human' ELSE 'ai' END AS binary_label, count(*) AS n FROM samples GROUP BY 1")
def rel06_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).groupBy(F.when(F.col("label") == "human", "human").otherwise("ai").alias("binary_label")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_discount BETWEEN 0.02 AND 0.05")
def rel07_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").filter("l_quantity > 45 AND l_discount BETWEEN 0.02 AND 0.05").select("l_orderkey", "l_linenumber")


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def rel08_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id").join(_t(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def rel09_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return _t(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def rel10_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return _t(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query(f"WITH {SAMPLES_SQL} SELECT s.sample_id, o.source AS parent FROM samples s JOIN samples o ON s.original_id = o.sample_id")
def rel11_lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    parents = s.select(F.col("sample_id").alias("original_id"), F.col("source").alias("parent"))
    return s.join(parents, "original_id").select("sample_id", "parent")


@query("SELECT d.doc_id, p.url FROM documents d JOIN pages p ON d.doc_id = p.page_id")
def rel12_existence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
    return _t(spark, sf_dir, "documents").select("doc_id").join(p, "doc_id")


@query("WITH a AS (SELECT o_custkey AS k, count(*) AS na FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS nb FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1) SELECT k, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM a FULL JOIN b USING (k)")
def rel13_full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    a, b = (o.filter(f"o_orderkey % {m} = 0").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias(n)) for m, n in ((2, "na"), (3, "nb")))
    return a.join(b, "k", "full").select("k", F.coalesce("na", F.lit(0)).alias("na"), F.coalesce("nb", F.lit(0)).alias("nb"))


@query("SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10) GROUP BY 1")
def rel14_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").filter("p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    return _t(spark, sf_dir, "lineitem").join(p, "l_partkey", "left_semi").groupBy("l_partkey").agg(F.count("*").alias("n"))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def rel15_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "nation").select("n_nationkey")
    return n.select(F.col("n_nationkey").alias("a")).join(n.select(F.col("n_nationkey").alias("b")), F.expr("a < b"))  # 25 rows


@query("SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS change FROM events")
def rel16_adjacent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _t(spark, sf_dir, "events").select("event_id", r6(F.col("value") - F.lag("value").over(w)).alias("change"))


@query("SELECT doc_id, quality, label FROM labels JOIN embeddings ON doc_id = vec_id")
def rel17_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return _t(spark, sf_dir, "labels").select("doc_id", "quality").join(e, "doc_id")


@query("SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey AS k FROM supplier")
def rel18_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).unionByName(_t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier")
def rel19_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(_t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 48")
def rel20_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = _t(spark, sf_dir, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("k"))
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).subtract(sold)


_SETS = "list_distinct(list_filter(string_split(%s, ' '), lambda w: w <> ''))"


@query(f"WITH s AS (SELECT item_id, {_SETS % 'text'} AS a, {_SETS % 'lower(text)'} AS b FROM benchmark) SELECT item_id, CAST(len(a) AS BIGINT) AS n_a, CAST(len(list_intersect(a, b)) AS BIGINT) AS n_both, CAST(len(list_distinct(list_concat(a, b))) AS BIGINT) AS n_any FROM s")
def rel21_array_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    def words(c):
        return F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))

    s = _t(spark, sf_dir, "benchmark").select("item_id", words(F.col("text")).alias("a"), words(F.lower("text")).alias("b"))
    return s.select("item_id", F.size("a").cast("long").alias("n_a"), F.size(F.array_intersect("a", "b")).cast("long").alias("n_both"), F.size(F.array_union("a", "b")).cast("long").alias("n_any"))


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
def rel22_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def rel23_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS r FROM orders) WHERE r <= 3")
def rel24_k_smallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    return _t(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w)).filter("r <= 3").select("o_custkey", "o_orderkey")


@query("SELECT CAST(len(list_filter([0.02, 0.04, 0.06, 0.08], lambda e: CAST(e AS DOUBLE) < CAST(l_discount AS DOUBLE))) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def rel25_range_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = F.array(*(F.lit(e) for e in (0.02, 0.04, 0.06, 0.08)))
    number = F.size(F.filter(edges, lambda e: e < F.col("l_discount").cast("double"))).cast("long")
    return _t(spark, sf_dir, "lineitem").groupBy(number.alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def rel26_group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types FROM events")
def rel27_distinct_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("types"))


@query("SELECT p_partkey, CAST(floor(rank() OVER (PARTITION BY p_size ORDER BY p_retailprice DESC) + (count(*) OVER (PARTITION BY p_size, p_retailprice) - 1) / 2) AS BIGINT) AS r FROM part")
def rel28_average_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.rank().over(Window.partitionBy("p_size").orderBy(F.desc("p_retailprice")))
    ties = F.count("*").over(Window.partitionBy("p_size", "p_retailprice"))
    return _t(spark, sf_dir, "part").select("p_partkey", F.floor(rank + (ties - 1) / 2).alias("r"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(CAST(l_quantity AS DOUBLE)), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def ext01_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_quantity").cast("double")), 2).alias("quantity"))
