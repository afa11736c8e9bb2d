"""Language identification of texts by character trigrams: profiles counted
from labelled texts, a multinomial score for each language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.context import cut

#: Trigrams of a language's profile.
PROFILE = 3000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def trigrams(text: Column) -> Column:
    """Runs of three characters of a text between blanks; A-Z count as a-z, and
    runs of white space as a blank."""
    plain = F.concat(F.lit(" "), F.regexp_replace(F.translate(text, UPPER, LOWER), "[\\x09-\\x0D\\x20]+", " "), F.lit(" "))

    def runs(chars: Column) -> Column:
        whole = F.transform(F.sequence(F.lit(0), F.size(chars) - 3), lambda i: F.concat(F.get(chars, i), F.get(chars, i + 1), F.get(chars, i + 2)))
        return F.when(F.size(chars) >= 3, whole).otherwise(F.array().cast("array<string>"))

    return F.get(F.transform(F.array(F.split(plain, "")), runs), F.lit(0))


class Profiles:
    """The most frequent trigrams of each language, with what each adds to the
    score over an unlisted one (``gains``: g, a column for each language), and
    the score of an unlisted one."""

    def __init__(self, labelled: DataFrame, size: int = PROFILE) -> None:
        """``labelled``: (lang, text) of known language."""
        known = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.explode(trigrams(F.col("text"))).alias("g"))
        counts = cut(known.groupBy("lang", "g").agg(F.count("*").alias("c")), "trigrams")  # texts are read once for profiles and totals
        ranked = counts.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c"), "g"))).filter(F.col("k") <= size).select("lang", "g", "c")
        totals = {r.lang: r.total for r in counts.groupBy("lang").agg(F.sum("c").alias("total")).collect()}  # a row for each language
        self.languages = sorted(totals)
        self.unlisted = {lang: -F.log(F.lit(float(totals[lang] + size))) for lang in self.languages}
        gain = F.log(F.col("c").cast("double") + 1)  # over the same divisor
        self.gains = ranked.groupBy("g").agg(*(F.coalesce(F.max(F.when(F.col("lang") == lang, gain)), F.lit(0.0)).alias(f"gain_{i}") for i, lang in enumerate(self.languages)))

    def scored(self, docs: DataFrame, key: str) -> DataFrame:
        """(key, score_0, ...): the mean log probability of a document's
        trigrams in each language."""
        held = docs.select(key, F.explode_outer(F.array(trigrams(F.col("text")))).alias("_g"))
        each = held.select(key, F.size("_g").cast("long").alias("n"), F.explode("_g").alias("g"))  # a look-up costs less than a sort
        rows = each.join(F.broadcast(self.gains), "g", "left")  # PROFILE rows for each language at most
        sums = rows.groupBy(key).agg(F.max("n").alias("n"), *(F.sum(F.coalesce(f"gain_{i}", F.lit(0.0))).alias(f"s{i}") for i in range(len(self.languages))))
        return sums.select(key, *((F.col(f"s{i}") / F.col("n") + self.unlisted[lang]).alias(f"score_{i}") for i, lang in enumerate(self.languages)))

    def detected(self, docs: DataFrame, key: str) -> DataFrame:
        """(key, detected_lang): the language of the highest score, the first by
        name of equal ones; null for texts without a trigram."""
        best = F.array_max(F.array(*(F.struct(F.round(f"score_{i}", 9).alias("s"), F.lit(-i).alias("i")) for i in range(len(self.languages)))))
        named = self.scored(docs, key).select(key, F.element_at(F.array(*(F.lit(lang) for lang in self.languages)), 1 - best["i"]).alias("detected_lang"))
        return docs.select(key).join(named, key, "left")


def split(docs: DataFrame, detected: DataFrame, key: str, language: str) -> tuple[DataFrame, DataFrame]:
    """Documents detected as of the language, and the rest with
    ``detected_lang``."""
    named = docs.join(detected, key)
    inside = F.coalesce(F.col("detected_lang") == language, F.lit(False))
    return named.filter(inside).drop("detected_lang"), named.filter(~inside)
