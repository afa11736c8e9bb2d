"""Corpus operators over texts: collection, filters, samples, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import arrays, cleaning
from quillmark.operators.ordered import numbered


def collected(files: DataFrame, source: str, least: int, most: int, target: int) -> DataFrame:
    """Chunks of files (path, doc_id, text) in path order, with running ids, up
    to ``target`` of them."""
    chunked = files.select("path", "doc_id", F.posexplode(cleaning.chunks(F.col("text"), least, most)).alias("pos", "chunk"))
    first = chunked.orderBy("path", "doc_id", "pos").limit(target)
    order = F.row_number().over(Window.orderBy("path", "doc_id", "pos")) - 1  # of ``target`` rows
    return first.select(F.format_string(f"human_{source}_%04d", order).alias("sample_id"), "path", F.col("chunk").alias("text"))


def rechunked(human: DataFrame, least: int, most: int) -> DataFrame:
    chunked = human.select("doc_id", F.col("sample_id").alias("rechunked_from"), F.posexplode(cleaning.chunks(F.col("text"), least, most)).alias("pos", "text"))
    return numbered(chunked, "doc_id", "pos").select(F.format_string("human_rechunked_%04d", "n").alias("sample_id"), "rechunked_from", "text")


def candidates(pages: DataFrame, language: str, last_year: int) -> DataFrame:
    """Pages of a language up to a year, with the journal their URL names."""
    host = F.regexp_extract("url", "^https?://([^/]+)/", 1)
    year = F.regexp_extract("url", "/([0-9]+)", 1)  # the number in the path stands for the year
    kept = pages.select("page_id", F.coalesce(F.nullif(host, F.lit("")), F.lit("unknown")).alias("journal"), F.regexp_extract("url", "/([a-z]{2})/", 1).alias("lang"), year.alias("year"))
    return kept.filter((F.col("lang") == language) & (F.col("year") != "") & (F.when(F.col("year") != "", F.col("year").cast("int")) <= last_year)).select("page_id", "journal", "year")


def first_link(pages: DataFrame, pattern: str) -> DataFrame:
    """(page_id, link): the first match of a page, under its site's English part."""
    base = F.split_part(F.split_part("url", F.lit("/en/"), F.lit(1)), F.lit("/tr/"), F.lit(1))
    return pages.filter(F.rlike("html", F.lit(pattern))).select("page_id", F.concat(base, F.lit("/en/"), F.regexp_extract("html", pattern, 0)).alias("link"))


def next_ids(rows: DataFrame) -> DataFrame:
    kind = F.split_part("sample_id", F.lit("_"), F.lit(1))
    number = F.regexp_extract("sample_id", r"_(\d+)$", 1).cast("long")
    return rows.groupBy(kind.alias("kind")).agg((F.max(number) + 1).alias("next_id"), F.count_distinct("source").alias("sources"))


def cache_key(model: str, pooling: str, text: Column) -> Column:
    return F.md5(F.concat_ws(chr(31), F.lit(model), F.lit(pooling), text))


def cascading_filter(rows: DataFrame, reject: Column) -> DataFrame:
    """``rejected``: a row that fails, or whose original does."""
    own = rows.withColumn("_own", reject)
    bad = own.filter("_own").select(F.col("sample_id").alias("original_id"), F.lit(True).alias("_parent"))
    return own.join(bad, "original_id", "left").withColumn("rejected", F.col("_own") | F.coalesce("_parent", F.lit(False))).drop("_own", "_parent")


def ascii_validity(text: Column, vocabulary: tuple[str, ...]) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    return F.when(F.size(found) < 30, 0.0).otherwise(F.size(F.filter(found, lambda w: w.isin(*vocabulary))) / F.size(found))


def short_sample(rows: DataFrame, group: str, order: str, each: int, total: int) -> DataFrame:
    """At most ``each`` rows of a group, of these ``total`` in hash order."""
    some = rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter(F.col("_n") <= each)
    return some.orderBy(F.md5(F.concat(F.col(order).cast("string"), F.lit("42")))).limit(total).drop("_n")


def quality_report(docs: DataFrame, language: str) -> DataFrame:
    n = arrays.word_count(F.col("text")).cast("long")
    main = docs.agg(F.count("*").alias("docs"), F.count_if(F.col("lang") != language).alias("other_language"), F.min(n).alias("min_words"), F.max(n).alias("max_words"), F.round(F.avg(n), 6).alias("avg_words"))
    repeated = docs.groupBy(F.substring("text", 1, 200).alias("head")).agg(F.count("*").alias("k")).filter("k > 1").agg(F.sum("k").alias("repeated"))
    return main.crossJoin(repeated)  # one row each


def language_report(named: DataFrame, language: str) -> DataFrame:
    """Of documents with ``detected_lang``, by source and language, how many
    there are and how many are kept."""
    kept = F.count_if(F.coalesce(F.col("detected_lang") == language, F.lit(False)))
    return named.groupBy("source", "detected_lang").agg(F.count("*").alias("n"), kept.alias("kept"))


def target_words(mean: float, deviation: float, least: int, most: int, seed: int) -> Column:
    return F.round(F.least(F.greatest(mean + deviation * F.randn(seed), F.lit(least)), F.lit(most))).cast("int")
