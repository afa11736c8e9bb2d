"""Queries of the corpus-level operators (NUM1-NUM33)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import annotate, arrays, stylometry
from quillmark.operators import corpus as operators
from quillmark.operators import features, neighbours
from quillmark.plans.base import SAMPLES_SQL, TOKENS_SQL, WORDS_SQL, query, r6, samples, table, tokenised
from quillmark.sources.connectors import scratch

#: A small feature table that both engines can make: three features and the
#: token count of each sample.
BASE = ["ttr", "mean_word_len", "double_space_rate"]
BASE_SQL = f"""{SAMPLES_SQL}, t AS (SELECT doc_id, sample_id, original_id, label, holdout, text, {TOKENS_SQL} AS tokens FROM samples),
 f AS (SELECT doc_id, sample_id, original_id, label, holdout, len(tokens) AS token_count, len(list_distinct(tokens)) / len(tokens) AS ttr,
   list_sum(list_transform(tokens, lambda w: length(w))) / len(tokens) AS mean_word_len, CASE WHEN len({WORDS_SQL}) = 0 THEN 0 ELSE len(regexp_extract_all(text, '  +')) / len({WORDS_SQL}) END AS double_space_rate FROM t WHERE len(tokens) > 0)"""
LONG_SQL = BASE_SQL + ", lf AS (" + " UNION ALL ".join(f"SELECT doc_id, sample_id, label, holdout, token_count, '{n}' AS feature, CAST({n} AS DOUBLE) AS x FROM f" for n in BASE) + ")"


def base_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = features.nonempty(tokenised(spark, sf_dir), "tokens")
    n = F.size("tokens")
    return t.select(
        "doc_id", "sample_id", "original_id", "label", "holdout", n.cast("long").alias("token_count"),
        (F.size(F.array_distinct("tokens")) / n).alias("ttr"),
        stylometry.mean_word_len(F.col("tokens")).alias("mean_word_len"),
        stylometry.double_space_rate(F.col("text")).alias("double_space_rate"),
    )


@query(f"WITH t AS (SELECT doc_id, {TOKENS_SQL} AS tokens FROM documents WHERE doc_id % 10 < 4), tok AS (SELECT unnest(tokens) AS w FROM t) SELECT w, round(count(*) / sum(count(*)) OVER (), 6) AS freq FROM tok GROUP BY 1")
def num01_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokenised(spark, sf_dir).filter("label = 'human'").withColumn("counts", arrays.run_counts(F.col("tokens")))
    return features.reference_freqs(t).select("w", r6(F.col("q")).alias("freq"))


_G = f"""t AS (SELECT doc_id, doc_id % 10 AS kind, (doc_id // 10) % 5 = 0 AS holdout, {TOKENS_SQL} AS tokens FROM documents), g AS (SELECT kind, holdout, tokens[i] || ' ' || tokens[i + 1] AS g FROM (SELECT kind, holdout, tokens, unnest(range(1, len(tokens))) AS i FROM t WHERE len(tokens) >= 2)
 UNION ALL SELECT kind, holdout, tokens[i] || ' ' || tokens[i + 1] || ' ' || tokens[i + 2] AS g FROM (SELECT kind, holdout, tokens, unnest(range(1, len(tokens) - 1)) AS i FROM t WHERE len(tokens) >= 3)),
 clean AS (SELECT * FROM g WHERE NOT contains(lower(g), 'cid') AND NOT contains(g, chr(65533)) AND NOT regexp_matches(g, '(^| )[,.:;-]+( |$)'))"""


@query(f"WITH {_G} SELECT g, count(*) AS n FROM clean WHERE kind < 4 GROUP BY 1")
def num02_ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.mined_counts(tokenised(spark, sf_dir).filter("kind < 4")).select("g", "n")


@query(f"WITH {_G} SELECT count(*) AS noisy FROM (SELECT DISTINCT g FROM g WHERE kind < 4) WHERE contains(lower(g), 'cid') OR contains(g, chr(65533)) OR regexp_matches(g, '(^| )[,.:;-]+( |$)')")
def num03_noise_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = features.gram_rows(tokenised(spark, sf_dir).filter("kind < 4"), (2, 3)).select("g").distinct()
    return grams.filter(operators.is_noise(F.col("g"))).agg(F.count("*").alias("noisy"))


_ODDS = f"""WITH {_G}, a AS (SELECT g, count(*) AS na FROM clean WHERE kind >= 4 AND NOT holdout GROUP BY 1), b AS (SELECT g, count(*) AS nb FROM clean WHERE kind < 4 AND NOT holdout GROUP BY 1),
 u AS (SELECT g, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM a FULL JOIN b USING (g)), z AS (SELECT count(*) AS v, sum(na) AS ta, sum(nb) AS tb FROM u),
 s AS (SELECT g, ln((na + 0.5) / (ta + 0.5 * v)) - ln((nb + 0.5) / (tb + 0.5 * v)) AS score, na + nb AS k FROM u, z)"""


def _odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokenised(spark, sf_dir).filter("NOT holdout")
    return operators.mined_odds(t, "kind >= 4", "kind < 4")


@query(_ODDS + " SELECT round(score, 6) AS score, count(*) AS n FROM s GROUP BY 1")
def num04_log_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _odds(spark, sf_dir).groupBy(r6(F.col("score")).alias("score")).agg(F.count("*").alias("n"))


@query(_ODDS + ", r AS (SELECT g, round(score, 6) AS score FROM s) (SELECT 'ai' AS side, g, score FROM r ORDER BY score DESC, g LIMIT 300) UNION ALL (SELECT 'human' AS side, g, score FROM r ORDER BY score, g LIMIT 300)")
def num05_lexicons(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _odds(spark, sf_dir).withColumn("score", r6(F.col("score")))
    ai, human = operators.lexicons(scores, 300)
    return ai.select(F.lit("ai").alias("side"), "g", "score").unionByName(human.select(F.lit("human").alias("side"), "g", "score"))


_ZFIT = "p AS (SELECT feature, avg(x) AS m, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS s FROM lf WHERE NOT holdout GROUP BY 1)"


@query(f"WITH {LONG_SQL}, {_ZFIT}, z AS (SELECT sample_id, feature, (x - m) / s AS z FROM lf JOIN p USING (feature)) SELECT sample_id, " + ", ".join(f"round(max(z) FILTER (feature = '{n}'), 6) AS {n}" for n in BASE) + " FROM z GROUP BY 1")
def num06_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = operators.standardize(base_features(spark, sf_dir), BASE, "zscore", "NOT holdout")
    return scaled.select("sample_id", *(r6(F.col(c)).alias(c) for c in BASE))


@query(f"WITH {LONG_SQL}, q AS (SELECT feature, quantile_cont(x, 0.5) AS m, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS s FROM lf WHERE NOT holdout GROUP BY 1) SELECT feature, round(m, 6) AS centre, round(CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS scale FROM q")
def num07_robust_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.fit_robust(base_features(spark, sf_dir), BASE, "NOT holdout").select("feature", r6(F.col("centre")).alias("centre"), r6(F.col("scale")).alias("scale"))


@query(f"WITH {LONG_SQL}, q AS (SELECT feature, quantile_cont(x, 0.5) AS m, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS s FROM lf WHERE NOT holdout GROUP BY 1), z AS (SELECT sample_id, feature, (x - m) / CASE WHEN s = 0 THEN 1 ELSE s END AS z FROM lf JOIN q USING (feature)) SELECT sample_id, " + ", ".join(f"round(max(z) FILTER (feature = '{n}'), 6) AS {n}" for n in BASE) + " FROM z GROUP BY 1")
def num08_standardize_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = operators.standardize(base_features(spark, sf_dir), BASE, "robust", "NOT holdout")
    return scaled.select("sample_id", *(r6(F.col(c)).alias(c) for c in BASE))


_RES = "r AS (SELECT feature, regr_slope(x, ln(1 + token_count)) AS a, regr_intercept(x, ln(1 + token_count)) AS b FROM lf WHERE NOT holdout GROUP BY 1)"


@query(f"WITH {LONG_SQL}, {_RES} SELECT feature, round(a, 6) AS slope, round(b, 6) AS intercept FROM r")
def num09_residual_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = operators.fit_residualizer(base_features(spark, sf_dir), BASE, "token_count", "NOT holdout")
    return fitted.select("feature", r6(F.col("slope")).alias("slope"), r6(F.col("intercept")).alias("intercept"))


_APPLIED = f"WITH {LONG_SQL}, {_RES}, z AS (SELECT sample_id, feature, x - (a * ln(1 + token_count) + b) AS z FROM lf JOIN r USING (feature)) SELECT sample_id, " + ", ".join(f"round(max(z) FILTER (feature = '{n}'), 6) AS {n}" for n in BASE) + " FROM z GROUP BY 1"


@query(_APPLIED)
def num10_residualize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base_features(spark, sf_dir)
    return operators.residualize(rows, operators.fit_residualizer(rows, BASE, "token_count", "NOT holdout"), "token_count").select("sample_id", *(r6(F.col(c)).alias(c) for c in BASE))


@query(f"SELECT * FROM ({_APPLIED}) WHERE sample_id = 'human_rechunked_1'")
def num11_residualize_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return num10_residualize(spark, sf_dir).filter("sample_id = 'human_rechunked_1'")


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return operators.fuse(base_features(spark, sf_dir), vectors, BASE, "doc_id", "embedding", "NOT holdout")


@query(f"""WITH {LONG_SQL}, {_ZFIT}, e AS (SELECT vec_id, unnest(range(len(embedding))) AS j, unnest(embedding) AS x FROM embeddings),
 v AS (SELECT j, avg(x) AS m, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS s FROM e JOIN f ON vec_id = doc_id WHERE NOT holdout GROUP BY 1),
 parts AS (SELECT doc_id, label, list_position(['ttr', 'mean_word_len', 'double_space_rate'], feature) - 1 AS i, (x - m) / s AS z FROM lf JOIN p USING (feature) WHERE doc_id IN (SELECT vec_id FROM embeddings)
   UNION ALL SELECT doc_id, label, 3 + j AS i, (x - m) / s AS z FROM e JOIN v USING (j) JOIN f ON vec_id = doc_id)
 SELECT doc_id, label, CAST(i AS BIGINT) AS i, round(z, 4) AS z FROM parts""")
def num12_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fused(spark, sf_dir).select("doc_id", "label", F.posexplode("features").alias("i", "z"))
    return rows.select("doc_id", "label", F.col("i").cast("long").alias("i"), F.round("z", 4).alias("z"))


@query()
def num13_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector("embedding").alias("v"))
    return PCA(k=4, inputCol="v", outputCol="p").fit(rows).transform(rows).select("vec_id", vector_to_array("p").alias("components"))


@query("SELECT i AS position, CASE WHEN i < 3 THEN ['ttr', 'mean_word_len', 'double_space_rate'][i + 1] ELSE 'emb_table_dim_' || (i - 3) END AS name FROM (SELECT unnest(range(0, 3 + (SELECT max(len(embedding)) FROM embeddings))) AS i)")
def num14_feature_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    width = table(spark, sf_dir, "embeddings").agg(F.max(F.size("embedding")).alias("d"))
    names = F.concat(F.array(*(F.lit(n) for n in BASE)), F.transform(F.sequence(F.lit(0), F.col("d") - 1), lambda i: F.concat(F.lit("emb_table_dim_"), i.cast("string"))))
    return width.select(F.posexplode(names).alias("position", "name")).select(F.col("position").cast("long").alias("position"), "name")


def _frame(spark: SparkSession, values, schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


@query()
def num15_vif(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, gram = operators.gram_matrix(base_features(spark, sf_dir).select(F.array(*BASE, "token_count").alias("v")), "v")
    return _frame(spark, [(n, float(v)) for n, v in zip([*BASE, "token_count"], operators.vif(gram), strict=True)], "feature string, vif double")


@query()
def num16_filter_by_vif(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [*BASE, "token_count"]
    _, _, gram = operators.gram_matrix(base_features(spark, sf_dir).select(F.array(*names).alias("v")), "v")
    return _frame(spark, [(names[i],) for i in operators.filter_by_vif(gram)], "feature string")


def _digamma_sql(n: str) -> str:
    steps = " + ".join(f"1.0 / ({n} + {i})" for i in range(6))
    return f"(ln({n} + 6) - 1.0 / (2 * ({n} + 6)) - 1.0 / (12 * pow({n} + 6, 2)) + 1.0 / (120 * pow({n} + 6, 4)) - 1.0 / (252 * pow({n} + 6, 6)) - ({steps}))"


_MI = f"""WITH {LONG_SQL}, mm AS (SELECT feature, avg(x) AS m FROM lf GROUP BY 1), p AS (SELECT row_number() OVER () AS r, feature, label, coalesce(x, m) AS x, count(*) OVER (PARTITION BY feature, label) AS own FROM lf JOIN mm USING (feature) QUALIFY own > 1),
 g AS (SELECT a.r, a.feature, a.x, a.own, list_sort(list(abs(b.x - a.x)))[least(3, a.own - 1)] AS d FROM p a JOIN p b ON a.feature = b.feature AND a.label = b.label AND a.r <> b.r GROUP BY a.r, a.feature, a.x, a.own),
 c AS (SELECT g.r, g.feature, g.own, count(*) AS m FROM g JOIN p b ON b.feature = g.feature AND CASE WHEN d > 0 THEN b.x < g.x + d AND b.x > g.x - d ELSE b.x = g.x END GROUP BY g.r, g.feature, g.own),
 mi AS (SELECT feature, round(greatest(0, {_digamma_sql('count(*)')} + avg({_digamma_sql('least(3, own - 1)')}) - avg({_digamma_sql('own')}) - avg({_digamma_sql('m')})), 6) AS mi FROM c GROUP BY 1)"""


def _mi(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.mutual_information(base_features(spark, sf_dir), BASE, "label")
    return found.select("feature", r6(F.col("mi")).alias("mi"))


@query(_MI + " SELECT feature, mi FROM mi")
def num17_mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mi(spark, sf_dir)


@query(_MI + " SELECT feature FROM mi ORDER BY mi DESC, feature LIMIT 2")
def num18_select_by_mi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mi(spark, sf_dir).orderBy(F.desc("mi"), "feature").limit(2).select("feature")


@query(_MI + " SELECT feature, mi FROM mi ORDER BY mi DESC")
def num19_mi_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mi(spark, sf_dir).orderBy(F.desc("mi"))


@query()
def num20_cluster_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [*BASE, "token_count"]
    _, _, gram = operators.gram_matrix(base_features(spark, sf_dir).select(F.array(*names).alias("v")), "v")
    return _frame(spark, [(n, int(c)) for n, c in zip(names, operators.cluster_columns(gram), strict=True)], "feature string, cluster int")


@query(f"WITH {LONG_SQL}, v AS (SELECT feature, CASE feature WHEN 'ttr' THEN 0 ELSE 1 END AS cluster, var_pop(x) AS variance FROM lf GROUP BY 1, 2) SELECT cluster, arg_max(feature, variance) AS feature FROM v GROUP BY 1")
def num21_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = operators.long_form(base_features(spark, sf_dir), BASE)
    variances = long.groupBy("feature").agg(F.var_pop("x").alias("variance")).withColumn("cluster", F.when(F.col("feature") == "ttr", 0).otherwise(1))
    return operators.representatives(variances)


@query()
def num22_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through a store of vectors: equal texts are encoded once."""
    from quillmark.operators.generation import HashEncoder
    from quillmark.operators.vector_store import VectorStore

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    store = VectorStore(spark, scratch(spark, "vectors"), "hashed words", "mean")
    store.add(docs, HashEncoder, 16)
    return store.vectors(docs).select("doc_id", F.col("vector").alias("embedding"))


@query("""WITH t AS (SELECT vec_id, CAST(unnest(range(16)) AS INTEGER) AS i, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
 SELECT vec_id, i, round((e[i + 1] + e[i + 17] + e[i + 33]) / 3, 6) AS mean, round(greatest(e[i + 1], e[i + 17], e[i + 33]), 6) AS max, round(e[i + 1], 6) AS cls FROM t""")
def num23_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as four tokens of 16 components, the last of them masked."""
    e = table(spark, sf_dir, "embeddings").filter("embedding IS NOT NULL")
    d = F.transform("embedding", lambda x: x.cast("double"))
    tokens = F.array(*(F.slice(d, at, 16) for at in (1, 17, 33, 49)))
    mask = F.array(F.lit(1), F.lit(1), F.lit(1), F.lit(0))
    pooled = F.arrays_zip(*(operators.pooled(tokens, mask, how).alias(how) for how in ("mean", "max", "cls")))
    return e.select("vec_id", F.posexplode(pooled).alias("i", "p")).select("vec_id", "i", *(r6(F.col(f"p.{how}")).alias(how) for how in ("mean", "max", "cls")))


@query("""WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / greatest(sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y))), 1e-10)) AS u FROM embeddings), e AS (SELECT vec_id, unnest(u) AS x, unnest(range(0, len(u))) AS i FROM u),
 s AS (SELECT i, sum(x) AS s, sum(x * x) AS q FROM e GROUP BY 1), n AS (SELECT count(*) AS n FROM u) SELECT round((sum(s * s) - sum(q)) / (any_value(n) * (any_value(n) - 1)), 6) AS anisotropy FROM s, n""")
def num25_anisotropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.anisotropy(table(spark, sf_dir, "embeddings"), "embedding").select(r6(F.col("anisotropy")).alias("anisotropy"))


@query()
def num26_direction_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, [(operators.direction_collapse(table(spark, sf_dir, "embeddings"), "embedding"),)], "collapse double")


@query("""WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS u FROM embeddings),
 p AS (SELECT a.vec_id, list_inner_product(a.u, b.u) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.u, b.u) DESC) AS r FROM u a JOIN u b ON a.vec_id <> b.vec_id) SELECT vec_id, round(avg(s), 6) AS dispersion FROM p WHERE r <= 10 GROUP BY 1""")
def num27_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.neighbourhood_dispersion(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 10)
    return found.select("vec_id", r6(F.col("dispersion")).alias("dispersion"))


_REFZ = f"WITH {LONG_SQL}, ref AS (SELECT feature, avg(x) AS m, CASE WHEN stddev_samp(x) = 0 THEN 1 ELSE stddev_samp(x) END AS s FROM lf WHERE label = 'human' GROUP BY 1), z AS (SELECT sample_id, feature, (x - m) / s AS z FROM lf JOIN ref USING (feature))"


def _z(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base_features(spark, sf_dir)
    return operators.anomalies(rows, BASE, operators.human_reference(rows, BASE, "label = 'human'"), "sample_id")


@query(_REFZ + " SELECT sample_id, round(sqrt(sum(z * z) / count(*)), 6) AS llm_distance FROM z GROUP BY 1")
def num28_llm_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.distance(_z(spark, sf_dir), "sample_id").select("sample_id", r6(F.col("llm_distance")).alias("llm_distance"))


@query(_REFZ + " SELECT sample_id, feature, round(z, 6) AS z FROM z")
def num29_anomaly_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _z(spark, sf_dir).select("sample_id", "feature", r6(F.col("z")).alias("z"))


@query(f"WITH {BASE_SQL} SELECT c.sample_id, round(r.mean_word_len - c.mean_word_len, 6) AS drop_score FROM f c JOIN f r ON c.original_id = r.sample_id")
def num30_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base_features(spark, sf_dir)
    raw = rows.select(F.col("sample_id").alias("original_id"), F.col("mean_word_len").alias("raw"))
    return rows.join(raw, "original_id").select("sample_id", r6(F.col("raw") - F.col("mean_word_len")).alias("drop_score"))


SCORES_SQL = _REFZ + """, d AS (SELECT sample_id, round(sqrt(sum(z * z) / count(*)), 4) AS llm_distance FROM z GROUP BY 1)
 SELECT sample_id, llm_distance, feature, round(z, 4) AS z FROM z JOIN d USING (sample_id) WHERE z IS NOT NULL"""


@query(SCORES_SQL)
def num31_secondary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = operators.secondary_scores(_z(spark, sf_dir), "sample_id")
    return scores.select("sample_id", "llm_distance", F.explode("anomaly_heatmap").alias("feature", "z"))


@query(f"WITH {LONG_SQL} SELECT feature, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std FROM lf WHERE label = 'human' GROUP BY 1")
def num32_human_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = operators.human_reference(base_features(spark, sf_dir), BASE, "label = 'human'")
    return found.select("feature", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


@query(f"WITH {LONG_SQL}, {_ZFIT} SELECT feature, round(m, 6) AS centre, round(s, 6) AS scale FROM p")
def num33_zscore_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.fit_zscore(base_features(spark, sf_dir), BASE, "NOT holdout").select("feature", r6(F.col("centre")).alias("centre"), r6(F.col("scale")).alias("scale"))


@query()
def num01_reference_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    human = annotate.annotated(samples(spark, sf_dir).filter("label = 'human'"))
    return features.depth_totals(human, "doc_id").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("mean_depth"))
