"""Queries of the per-document features (FEA1-FEA33)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import annotate, arrays, stylometry
from quillmark.operators import context
from quillmark.operators import features as operators
from quillmark.plans.base import SAMPLES_SQL, TOKENS_SQL, WORDS_SQL, query, r6, samples, table, tokenised

_TOK = f"t AS (SELECT doc_id, {TOKENS_SQL} AS tokens, text FROM documents)"
_TC = f"""WITH {_TOK}, tok AS (SELECT doc_id, unnest(tokens) AS w FROM t), tc AS (SELECT doc_id, w, count(*) AS c FROM tok GROUP BY 1, 2),
 agg AS (SELECT doc_id, count(*) AS v, sum(c) AS n, count(*) FILTER (c = 1) AS h, sum(c * c) AS cc, sum(c * log2(c)) AS cl FROM tc GROUP BY 1)"""


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", arrays.tokens(F.col("text")).alias("tokens"))
    return operators.nonempty(d, "tokens").withColumn("counts", arrays.run_counts(F.col("tokens")))


def _each(column: Column, spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _counts(spark, sf_dir).select("doc_id", r6(column).alias(name))


@query(_TC + " SELECT doc_id, round(v / n, 6) AS ttr, round(h / n, 6) AS hapax_ratio, round(1e4 * (cc - n) / (n * n), 6) AS yule_k, round(log2(n) - cl / n + (v - 1) / (2 * n * ln(2)), 6) AS entropy_1gram FROM agg")
def fea01_lexical_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("counts")
    return _counts(spark, sf_dir).select("doc_id", r6(stylometry.ttr(c)).alias("ttr"), r6(stylometry.hapax_ratio(c)).alias("hapax_ratio"), r6(stylometry.yule_k(c)).alias("yule_k"), r6(stylometry.entropy(c)).alias("entropy_1gram"))


@query(_TC + " SELECT doc_id, round(h / n, 6) AS hapax_ratio FROM agg")
def fea02_hapax_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(stylometry.hapax_ratio(F.col("counts")), spark, sf_dir, "hapax_ratio")


@query(f"WITH {_TOK}, tok AS (SELECT doc_id, unnest(tokens) AS w FROM t) SELECT doc_id, round(avg(length(w)), 6) AS mean_word_len FROM tok GROUP BY 1")
def fea03_mean_word_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(stylometry.mean_word_len(F.col("tokens")), spark, sf_dir, "mean_word_len")


@query(f"WITH {_TOK}, tok AS (SELECT doc_id, unnest(tokens) AS w FROM t) SELECT doc_id, round(coalesce(stddev_samp(length(w)), 0), 6) AS word_len_std FROM tok GROUP BY 1")
def fea04_word_len_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(stylometry.word_len_std(F.col("tokens")), spark, sf_dir, "word_len_std")


@query(_TC + " SELECT doc_id, round(1e4 * (cc - n) / (n * n), 6) AS yule_k FROM agg")
def fea05_yule_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(stylometry.yule_k(F.col("counts")), spark, sf_dir, "yule_k")


def _entropy_sql(n: int) -> str:
    gram = " || ' ' || ".join(f"tokens[i + {k}]" for k in range(n))
    return f"""WITH {_TOK}, g AS (SELECT doc_id, {gram} AS g FROM (SELECT doc_id, tokens, unnest(range(1, len(tokens) - {n - 2})) AS i FROM t WHERE len(tokens) >= {n})),
 gc AS (SELECT doc_id, g, count(*) AS c FROM g GROUP BY 1, 2), a AS (SELECT doc_id, count(*) AS v, sum(c) AS n, sum(c * log2(c)) AS cl FROM gc GROUP BY 1)
 SELECT t.doc_id, coalesce(round(log2(n) - cl / n + (v - 1) / (2 * n * ln(2)), 6), 0.0) AS entropy_{n}gram FROM t LEFT JOIN a USING (doc_id) WHERE len(tokens) > 0"""


@query(_entropy_sql(2))
def fea06_entropy_bigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(stylometry.entropy_ngram(F.col("tokens"), 2), spark, sf_dir, "entropy_2gram")


@query(_entropy_sql(3))
def fea06_entropy_trigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(stylometry.entropy_ngram(F.col("tokens"), 3), spark, sf_dir, "entropy_3gram")


@query(_TC + " SELECT doc_id, w, round(c / sum(c) OVER (PARTITION BY doc_id), 6) AS freq FROM tc")
def fea07_word_freqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.word_freqs(_counts(spark, sf_dir)).select("doc_id", "w", r6(F.col("freq")).alias("freq"))


_REF = """, hum AS (SELECT w, sum(c) AS c FROM tc WHERE doc_id % 10 < 4 GROUP BY 1), ref AS (SELECT w, c / sum(c) OVER () AS q FROM hum),
 freq AS (SELECT doc_id, w, c / sum(c) OVER (PARTITION BY doc_id) AS p FROM tc)"""


@query(_TC + _REF + " SELECT doc_id, round(greatest(0, sum(p * ln(p / coalesce(q, 1e-10)))), 6) AS kl_div_word_freq FROM freq LEFT JOIN ref USING (w) GROUP BY 1")
def fea08_kl_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _counts(spark, sf_dir)
    reference = operators.reference_freqs(counts.filter("doc_id % 10 < 4"))
    return operators.kl_divergence(counts, reference).select("doc_id", r6(F.col("kl")).alias("kl_div_word_freq"))


@query(_TC + f""", {SAMPLES_SQL}, e AS (SELECT doc_id, log2(n) - cl / n + (v - 1) / (2 * n * ln(2)) AS h FROM agg)
 SELECT s.doc_id, round(a.h - b.h, 6) AS entropy_drop FROM samples s JOIN samples o ON s.original_id = o.sample_id JOIN e a ON a.doc_id = o.doc_id JOIN e b ON b.doc_id = s.doc_id""")
def fea09_entropy_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = operators.nonempty(tokenised(spark, sf_dir), "tokens").select("doc_id", "sample_id", "original_id", stylometry.entropy_ngram(F.col("tokens"), 1).alias("h"))
    return operators.entropy_drop(h).select("doc_id", r6(F.col("entropy_drop")).alias("entropy_drop"))


#: Sentences without look-behind, so that both engines can split alike.
_SENT = r"regexp_extract_all(text, '[^.!?]+[.!?]*')"
_SENT_SIZES = rf"s AS (SELECT doc_id, list_filter(list_transform({_SENT}, lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> ''))), lambda n: n > 0) AS sizes FROM documents)"


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = F.regexp_extract_all("text", F.lit(r"[^.!?]+[.!?]*"), F.lit(0))
    count = F.transform(pieces, lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != "")))
    return table(spark, sf_dir, "documents").select("doc_id", F.filter(count, lambda n: n > 0).alias("sizes"))


@query(f"WITH {_SENT_SIZES}, u AS (SELECT doc_id, unnest(sizes) AS n FROM s), a AS (SELECT doc_id, count(*) AS k, avg(n) AS m, stddev_samp(n) AS sd FROM u GROUP BY 1) SELECT doc_id, round(CASE WHEN sd + m = 0 THEN 0 ELSE (sd - m) / (sd + m) END, 6) AS burstiness FROM a WHERE k >= 2")
def fea10_burstiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.nonempty(_sizes(spark, sf_dir), "sizes").filter("size(sizes) >= 2").select("doc_id", r6(stylometry.burstiness(F.col("sizes"))).alias("burstiness"))


@query(f"WITH {_SENT_SIZES}, u AS (SELECT doc_id, unnest(sizes) AS n FROM s) SELECT doc_id, round(avg(n), 6) AS sent_len_mean, round(coalesce(var_samp(n), 0), 6) AS sent_len_var FROM u GROUP BY 1")
def fea11_sentence_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.nonempty(_sizes(spark, sf_dir), "sizes").select("doc_id", r6(arrays.mean(F.col("sizes"))).alias("sent_len_mean"), r6(arrays.sample_variance(F.col("sizes"))).alias("sent_len_var"))


@query()
def fea12_word_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = annotate.annotated(samples(spark, sf_dir))
    return parsed.select("doc_id", annotate.word_depths(F.col("dep_parse")).alias("depths"))


@query()
def fea13_mean_dep_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fea12_word_depths(spark, sf_dir).select("doc_id", arrays.mean(F.col("depths")).alias("mean_dep_depth"))


@query()
def fea14_dep_depth_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fea12_word_depths(spark, sf_dir).select("doc_id", F.sqrt(arrays.sample_variance(F.col("depths"))).alias("dep_depth_std"))


_UPOS = f"WITH {_TOK}, tg AS (SELECT doc_id, {annotate.UPOS_SQL} AS upos FROM (SELECT doc_id, unnest(tokens) AS w FROM t))"


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.nonempty(tokenised(spark, sf_dir), "tokens").select("doc_id", F.transform("tokens", annotate.upos).alias("tags"))


@query(_UPOS + " SELECT doc_id, " + ", ".join(f"round(count(*) FILTER (upos = '{t}') / count(*), 6) AS pos_{t.lower()}" for t in annotate.SHOWN_TAGS) + " FROM tg GROUP BY 1")
def fea15_pos_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tags(spark, sf_dir).select("doc_id", *(r6(stylometry.tag_share(F.col("tags"), (t,))).alias(f"pos_{t.lower()}") for t in annotate.SHOWN_TAGS))


@query()
def fea16_syntactic_depth_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = context.cut(operators.depth_totals(annotate.annotated(samples(spark, sf_dir)), "doc_id", "label"), "depths")  # texts are parsed once
    reference = means.filter("label = 'human'").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("reference"))
    return means.crossJoin(F.broadcast(reference)).select("doc_id", (arrays.ratio(F.col("total"), F.col("n")) - F.col("reference")).alias("syntactic_depth_shift"))  # one row


_CONJ = "count(*) FILTER (upos IN ('CCONJ', 'SCONJ')) / count(*)"


@query(_UPOS + f" SELECT doc_id, round({_CONJ}, 6) AS conjunction_density FROM tg GROUP BY 1")
def fea17_conjunction_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tags(spark, sf_dir).select("doc_id", r6(stylometry.tag_share(F.col("tags"), stylometry.CONJUNCTIONS)).alias("conjunction_density"))


@query(_UPOS + f", d AS (SELECT doc_id, {_CONJ} AS x FROM tg GROUP BY 1), r AS (SELECT avg(x) AS m FROM d WHERE doc_id % 10 < 4) SELECT doc_id, round(CASE WHEN m = 0 THEN 0 ELSE (x - m) / m END, 6) AS conjunction_deviation FROM d, r")
def fea18_conjunction_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    density = _tags(spark, sf_dir).select("doc_id", stylometry.tag_share(F.col("tags"), stylometry.CONJUNCTIONS).alias("x"))
    reference = density.filter("doc_id % 10 < 4").agg(F.avg("x").alias("m"))
    return density.crossJoin(F.broadcast(reference)).select("doc_id", r6(stylometry.deviation(F.col("x"), F.col("m"))).alias("conjunction_deviation"))  # one row


@query(_UPOS + " SELECT doc_id, round(count(*) FILTER (upos IN ('DET', 'PRON', 'ADP', 'AUX', 'PART', 'SCONJ', 'CCONJ', 'INTJ')) / count(*), 6) AS function_word_ratio FROM tg GROUP BY 1")
def fea19_function_word_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tags(spark, sf_dir).select("doc_id", r6(stylometry.tag_share(F.col("tags"), stylometry.FUNCTION_TAGS)).alias("function_word_ratio"))


_STOPS = ", ".join(f"'{w}'" for w in stylometry.STOP_WORDS)


@query(rf"""WITH p AS (SELECT doc_id, list_filter(list_transform({_SENT}, lambda x: list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')), lambda s: len(s) > 0) AS ss FROM documents),
 st AS (SELECT doc_id, list_transform(ss, lambda s: list_distinct(list_filter(list_transform(list_filter(s, lambda w: regexp_matches(w, '[^.,!?;:"''()]')), lambda w: lower(w)), lambda w: w NOT IN ({_STOPS})))) AS st FROM p),
 u AS (SELECT doc_id, unnest(st[:-2]) AS a, unnest(st[2:]) AS b FROM st WHERE len(st) >= 2), sc AS (SELECT doc_id, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS j FROM u WHERE len(a) + len(b) > 0)
 SELECT d.doc_id, round(avg(j), 6) AS lexical_coherence FROM documents d LEFT JOIN sc USING (doc_id) GROUP BY 1""")
def fea20_lexical_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = F.filter(F.regexp_extract_all("text", F.lit(r"[^.!?]+[.!?]*"), F.lit(0)), lambda s: F.size(arrays.words(s)) > 0)
    return table(spark, sf_dir, "documents").select("doc_id", r6(stylometry.lexical_coherence(pieces)).alias("lexical_coherence"))


_GRAM = f"""g AS (SELECT doc_id, tokens[i] || ' ' || tokens[i + 1] AS g FROM (SELECT doc_id, tokens, unnest(range(1, len(tokens))) AS i FROM t WHERE len(tokens) >= 2)
  UNION ALL SELECT doc_id, tokens[i] || ' ' || tokens[i + 1] || ' ' || tokens[i + 2] AS g FROM (SELECT doc_id, tokens, unnest(range(1, len(tokens) - 1)) AS i FROM t WHERE len(tokens) >= 3))"""


@query(f"WITH {_TOK}, {_GRAM}, lex AS (SELECT g FROM g WHERE doc_id % 10 >= 4 GROUP BY 1 ORDER BY count(*) DESC, g LIMIT 300) SELECT doc_id, round(count(lex.g) / count(*), 6) AS lexicon_density FROM g LEFT JOIN lex USING (g) GROUP BY 1")
def fea21_lexicon_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokenised(spark, sf_dir)
    lexicon = operators.gram_counts(t.filter("kind >= 4"), (2, 3)).orderBy(F.desc("n"), "g").limit(300).select("g")
    return operators.lexicon_density(t, lexicon).select("doc_id", r6(F.col("density")).alias("lexicon_density"))


@query(r"SELECT doc_id, round(len(regexp_extract_all(text, '!{2,}|\?{2,}|\.{2,}|,{2,}|[!?]{2,}')) / length(text), 6) AS double_sign_rate FROM documents WHERE length(text) > 0")
def fea22_double_sign_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("length(text) > 0").select("doc_id", r6(F.regexp_count("text", F.lit(r"!{2,}|\?{2,}|\.{2,}|,{2,}|[!?]{2,}")) / F.length("text")).alias("double_sign_rate"))


@query(r"SELECT doc_id, round(CASE WHEN length(text) = 0 THEN 0 ELSE len(regexp_extract_all(text, '!{2,}|\?{2,}|\.{2,}|,{2,}|[!?]{2,}')) / length(text) END, 6) AS punct_irregularity_rate FROM documents")
def fea22_punct_irregularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", r6(stylometry.punct_irregularity_rate(F.col("text"))).alias("punct_irregularity_rate"))


@query(f"SELECT doc_id, round(CASE WHEN len({WORDS_SQL}) = 0 THEN 0 ELSE len(regexp_extract_all(text, '  +')) / len({WORDS_SQL}) END, 6) AS double_space_rate FROM documents")
def fea23_double_space_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", r6(stylometry.double_space_rate(F.col("text"))).alias("double_space_rate"))


@query(r"WITH m AS (SELECT doc_id, len(regexp_extract_all(text, '[.!?]\s+[a-zçğıöşü]')) AS a, len(regexp_extract_all(text, '[.!?]\s+[a-zA-ZçğıöşüÇĞİÖŞÜ]')) AS b FROM documents) SELECT doc_id, round(CASE WHEN b = 0 THEN 0 ELSE a / b END, 6) AS post_punct_case_irregularity_rate FROM m")
def fea24_case_after_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", r6(stylometry.post_punct_case_irregularity_rate(F.col("text"))).alias("post_punct_case_irregularity_rate"))


_SYLL = "list_sum(list_transform(words, lambda w: greatest(1, length(w) - length(translate(w, 'aeıioöuüAEIİOÖUÜ', '')))))"


@query(f"WITH t AS (SELECT doc_id, {WORDS_SQL} AS words FROM documents) SELECT doc_id, CAST(coalesce({_SYLL}, 0) AS BIGINT) AS n_syllables FROM t")
def fea25_syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = arrays.words(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", arrays.total(F.transform(w, lambda x: stylometry.syllables(x).cast("double"))).cast("long").alias("n_syllables"))


_ATESMAN = f"""WITH t AS (SELECT doc_id, {WORDS_SQL} AS words, len(list_filter({_SENT}, lambda x: regexp_matches(x, '\\S'))) AS ns FROM documents)
 SELECT doc_id, round(CASE WHEN len(words) = 0 OR ns = 0 THEN 0 ELSE 198.825 - 40.175 * {_SYLL} / len(words) - 2.610 * len(words) / ns END, 6) AS %s FROM t"""


def _readability(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    pieces = F.filter(F.regexp_extract_all("text", F.lit(r"[^.!?]+[.!?]*"), F.lit(0)), lambda x: F.rlike(x, F.lit(r"\S")))
    return table(spark, sf_dir, "documents").select("doc_id", r6(stylometry.atesman(arrays.words(F.col("text")), F.size(pieces))).alias(name))


@query(_ATESMAN % "atesman")
def fea26_atesman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _readability(spark, sf_dir, "atesman")


@query(_ATESMAN % "bezirci_yilmaz")
def fea27_bezirci_yilmaz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _readability(spark, sf_dir, "bezirci_yilmaz")


_CUT = context.MOST_TOKENS
_PLACES = f"""WITH {_TOK}, h AS (SELECT doc_id, doc_id % 10 AS kind, tokens, tokens[1:{_CUT}] AS head FROM t WHERE len(tokens) > 0),
 whole AS (SELECT kind, CASE WHEN i > 1 THEN tokens[i - 1] ELSE '' END AS l, tokens[i] AS w, coalesce(tokens[i + 1], '') AS r FROM (SELECT kind, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM h)),
 q AS (SELECT doc_id, CASE WHEN i > 1 THEN head[i - 1] ELSE '' END AS l, head[i] AS w, coalesce(head[i + 1], '') AS r FROM (SELECT doc_id, head, unnest(range(1, len(head) + 1)) AS i FROM h))"""


def _masked_sql(name: str, training: str) -> str:
    """Tables of the model of some documents, and ``name`` (doc_id, p)."""
    both, single, k = context.BOTH, context.SINGLE / 2, context.SMOOTHING
    counts = ", ".join(f"{name}_{c} AS (SELECT {', '.join(c)}, count(*) AS c FROM {name}_t GROUP BY ALL)" for c in ("lwr", "lr", "lw", "l", "wr", "r", "w"))
    joins = " ".join(f"LEFT JOIN {name}_{c} c_{c} USING ({', '.join(c)})" for c in ("lwr", "lr", "lw", "l", "wr", "r", "w"))
    shares = [(both, "lwr", "lr"), (single, "lw", "l"), (single, "wr", "r")]
    mixed = " + ".join(f"CASE WHEN c_{of}.c > 0 THEN {w} * coalesce(c_{part}.c, 0) / c_{of}.c ELSE 0.0 END" for w, part, of in shares)
    rest = " + ".join(f"CASE WHEN c_{of}.c > 0 THEN {w} ELSE 0.0 END" for w, _, of in shares)
    return f"""{name}_t AS (SELECT l, w, r FROM whole WHERE {training}), {counts}, {name}_n AS (SELECT sum(c) AS n, count(*) AS v FROM {name}_w),
 {name} AS (SELECT doc_id, exp(-avg(ln({mixed} + (1 - ({rest})) * (coalesce(c_w.c, 0) + {k}) / (n + {k} * (v + 1))))) AS p FROM q {joins}, {name}_n GROUP BY 1)"""


def _model(spark: SparkSession, sf_dir: str, training: str) -> DataFrame:
    return context.two_sided_counts(_counts(spark, sf_dir).filter(training))


@query(f"{_PLACES}, {_masked_sql('m', 'kind < 4')} SELECT doc_id, round(p, 6) AS perplexity FROM m")
def fea28_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model of the human documents."""
    found = context.masked_perplexity(_counts(spark, sf_dir), _model(spark, sf_dir, "doc_id % 10 < 4"), _CUT)
    return found.select("doc_id", r6(F.col("perplexity")).alias("perplexity"))


@query(f"{_PLACES}, {_masked_sql('m', 'kind < 4')}, {_masked_sql('g', 'kind BETWEEN 4 AND 6')} SELECT doc_id, round(ln(m.p / g.p), 6) AS perplexity_ratio FROM m JOIN g USING (doc_id)")
def fea29_perplexity_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model of the human documents over that of the generated ones."""
    counts = _counts(spark, sf_dir)
    model = context.two_sided_counts(counts, human="doc_id % 10 < 4", generated="doc_id % 10 BETWEEN 4 AND 6")
    both = context.masked_perplexities(counts, model, ("human", "generated"), _CUT)
    return both.select("doc_id", r6(context.log_ratio(F.col("perplexity_human"), F.col("perplexity_generated"))).alias("perplexity_ratio"))


_RANK = f"""WITH {_TOK}, u AS (SELECT w, count(*) AS c FROM (SELECT unnest(tokens) AS w FROM t WHERE doc_id % 10 < 4) GROUP BY 1), r1 AS (SELECT w, c, rank() OVER (ORDER BY c DESC) AS r FROM u), v AS (SELECT count(*) + 1 AS vmax FROM u),
 s AS (SELECT l, w, count(*) AS c FROM (SELECT tokens[i] AS l, tokens[i + 1] AS w FROM (SELECT tokens, unnest(range(1, len(tokens))) AS i FROM t WHERE doc_id % 10 < 4)) GROUP BY 1, 2), sr AS (SELECT l, w, rank() OVER (PARTITION BY l ORDER BY c DESC) AS r FROM s),
 p AS (SELECT doc_id, tokens[i] AS l, tokens[i + 1] AS w, count(*) AS n FROM (SELECT doc_id, tokens, unnest(range(1, least(len(tokens), {_CUT}))) AS i FROM t) GROUP BY 1, 2, 3),
 o AS (SELECT DISTINCT l, w FROM p ANTI JOIN s USING (l, w)), oc AS (SELECT l, w, coalesce(c, 0) AS c, coalesce(r, vmax) AS r FROM o LEFT JOIN r1 USING (w), v),
 b AS (SELECT q.l, q.c, count(sc.c) AS k FROM (SELECT DISTINCT l, c FROM oc) q LEFT JOIN (SELECT l, r1.c FROM s JOIN r1 USING (w)) sc ON sc.l = q.l AND sc.c > q.c GROUP BY 1, 2), len AS (SELECT l, count(*) AS k FROM s GROUP BY 1),
 x AS (SELECT l, w, r FROM sr UNION ALL SELECT oc.l, oc.w, coalesce(len.k, 0) + oc.r - b.k FROM oc JOIN b ON b.l = oc.l AND b.c = oc.c LEFT JOIN len ON len.l = oc.l),
 dr AS (SELECT doc_id, r, n, vmax FROM p JOIN x USING (l, w), v), k AS (SELECT doc_id, least(floor(log2(r) / (log2(vmax) / 10)), 9) AS bucket, sum(n) AS n FROM dr GROUP BY 1, 2), h AS (SELECT doc_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS e FROM k GROUP BY 1),
 a AS (SELECT doc_id, sum(r * n) / sum(n) AS m, coalesce(sum(n) FILTER (r <= 1), 0) / sum(n) AS t1, coalesce(sum(n) FILTER (r <= 5), 0) / sum(n) AS t5, coalesce(sum(n) FILTER (r <= 10), 0) / sum(n) AS t10 FROM dr GROUP BY 1)"""


@query(_RANK + """ SELECT t.doc_id, round(coalesce(m, 0), 6) AS mean_token_rank, round(coalesce(t1, 0), 6) AS frac_rank_top1, round(coalesce(t5, 0), 6) AS frac_rank_top5, round(coalesce(t10, 0), 6) AS frac_rank_top10, round(coalesce(e, 0), 6) AS rank_entropy
 FROM t LEFT JOIN a USING (doc_id) LEFT JOIN h USING (doc_id) WHERE len(tokens) > 0""")
def fea30_token_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _counts(spark, sf_dir)
    found = context.context_ranks(counts, counts.filter("doc_id % 10 < 4"), _CUT)
    return found.select("doc_id", *(r6(F.col(c)).alias(c) for c in found.columns[1:]))


@query()
def fea31_all_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.all_features(samples(spark, sf_dir))


@query(f"{_PLACES}, {_masked_sql('m', 'kind < 4')} SELECT doc_id, round(p, 6) AS perplexity FROM m")
def fea32_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the rows have their perplexity, the others get it."""
    counts = _counts(spark, sf_dir)
    model = context.cut(_model(spark, sf_dir, "doc_id % 10 < 4"), "model")
    have = context.cut(context.masked_perplexity(counts.filter("doc_id % 3 = 0"), model, _CUT), "have")
    return operators.backfill(have, counts, "doc_id", lambda missing: context.masked_perplexity(missing, model, _CUT)).select("doc_id", r6(F.col("perplexity")).alias("perplexity"))


@query(f"WITH {_SENT_SIZES}, u AS (SELECT doc_id, unnest(sizes) AS n FROM s), a AS (SELECT doc_id, avg(n) AS m, stddev_samp(n) AS sd FROM u GROUP BY 1) SELECT s.doc_id, CAST(len(sizes) AS BIGINT) AS sentence_count, round(CASE WHEN len(sizes) < 2 THEN NULL WHEN sd + m = 0 THEN 0 ELSE (sd - m) / (sd + m) END, 6) AS burstiness FROM s LEFT JOIN a USING (doc_id)")
def fea33_patch_burstiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sizes(spark, sf_dir).select("doc_id", F.size("sizes").cast("long").alias("sentence_count"), r6(stylometry.burstiness(F.col("sizes"))).alias("burstiness"))
    return operators.patch_burstiness(rows.withColumn("burstiness", F.coalesce("burstiness", F.lit(0.0))))  # as older rows have it
