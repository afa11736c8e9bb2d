"""Stylometric features of a token array, a sentence array or a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions.arrays import bound, mean, ngrams, ratio, run_counts, sample_variance, total, words

#: Vowels; readability's constant, and its weights of syllables
#: per word and words per sentence.
VOWELS = "aeıioöuüAEIİOÖUÜ"
READABILITY = (198.825, 40.175, 2.610)
#: Closed-class tags, coherence stop words.
CONJUNCTIONS = ("CCONJ", "SCONJ")
FUNCTION_TAGS = ("DET", "PRON", "ADP", "AUX", "PART", "SCONJ", "CCONJ", "INTJ")
STOP_WORDS = (
    "ve", "ile", "bir", "bu", "şu", "o", "da", "de", "ki", "mi", "mı", "mu", "mü", "gibi", "çok", "daha", "en", "ama", "fakat", "ancak", "veya", "ya", "ise",
    "için", "olan", "olarak", "kadar", "göre", "sonra", "önce", "ne", "ben", "sen", "biz", "siz", "onlar", "var", "yok", "her", "hiç", "tüm", "bütün", "diğer",
    "böyle", "şöyle", "öyle", "nasıl", "neden", "niçin", "üzere",
)


#: Words of these signs alone don't count for coherence, and the
#: patterns of irregular orthography.
NOT_ONLY_SIGNS = r"""[^.,!?;:"'()]"""
REPEATED_SIGNS = r"([!?.,])\1+|[!?]{2,}|\.{4,}"
BLANK_RUN = "  +"
LOWER_AFTER_END = r"[.!?]\s+[a-zçğıöşü]"
LETTER_AFTER_END = r"[.!?]\s+[a-zA-ZçğıöşüÇĞİÖŞÜ]"


def ttr(counts: Column) -> Column:
    return ratio(F.size(counts), total(counts))


def hapax_ratio(counts: Column) -> Column:
    return ratio(F.size(F.filter(counts, lambda c: c == 1)), total(counts))


def yule_k(counts: Column) -> Column:
    n = total(counts)
    return ratio(1e4 * (total(F.transform(counts, lambda c: c * c)) - n), n * n)


def entropy(counts: Column) -> Column:
    """Shannon bits with the Miller-Madow correction.  Counts are bound: named
    several times, they would be counted as often."""

    def over(c: Column, n: Column) -> Column:
        plogp = total(F.transform(c, lambda x: x * F.log2(x.cast("double"))))
        return F.when(n == 0, 0.0).otherwise(F.log2(n) - plogp / n + (F.size(c) - 1) / (2 * n * F.log(F.lit(2.0))))

    return bound(counts, lambda c: bound(total(c), lambda n: over(c, n)))


def entropy_ngram(tokens: Column, n: int) -> Column:
    return entropy(run_counts(ngrams(tokens, n)))


def lengths(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.length(w))


def mean_word_len(tokens: Column) -> Column:
    return mean(lengths(tokens))


def word_len_std(tokens: Column) -> Column:
    return F.sqrt(sample_variance(lengths(tokens)))


def burstiness(sizes: Column) -> Column:
    """(s - m) / (s + m) of sentence sizes; null for fewer than two."""
    m, s = mean(sizes), F.sqrt(sample_variance(sizes))
    return F.when(F.size(sizes) < 2, F.lit(None).cast("double")).otherwise(ratio(s - m, s + m))


def tag_share(tags: Column, wanted: tuple[str, ...]) -> Column:
    return ratio(F.size(F.filter(tags, lambda t: t.isin(*wanted))), F.size(tags))


def deviation(value: Column, reference: Column) -> Column:
    return F.when(reference == 0, 0.0).otherwise((value - reference) / reference)


def lexical_coherence(sentences: Column) -> Column:
    """Mean Jaccard similarity of neighbouring sentences' word sets.  Words
    keep their punctuation; pairs of empty sets are passed over."""

    def word_set(s: Column) -> Column:
        kept = F.filter(words(s), lambda w: F.rlike(w, F.lit(NOT_ONLY_SIGNS)))
        lowered = F.transform(kept, lambda w: F.lower(w))
        return F.array_distinct(F.filter(lowered, lambda w: ~w.isin(*STOP_WORDS)))

    def over(sets: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(sets) - 1), lambda i: F.struct(F.get(sets, i - 1).alias("a"), F.get(sets, i).alias("b")))
        filled = F.filter(pairs, lambda p: F.size(F.array_union(p["a"], p["b"])) > 0)
        scores = F.transform(filled, lambda p: F.size(F.array_intersect(p["a"], p["b"])) / F.size(F.array_union(p["a"], p["b"])))
        return F.when(F.size(scores) > 0, mean(scores))

    found = F.get(F.transform(F.array(F.transform(sentences, word_set)), over), F.lit(0))
    return F.when(F.size(sentences) >= 2, found)


def punct_irregularity_rate(text: Column) -> Column:
    return ratio(F.regexp_count(text, F.lit(REPEATED_SIGNS)), F.length(text))


def double_space_rate(text: Column) -> Column:
    return ratio(F.regexp_count(text, F.lit(BLANK_RUN)), F.size(words(text)))


def post_punct_case_irregularity_rate(text: Column) -> Column:
    lower = F.regexp_count(text, F.lit(LOWER_AFTER_END))
    return ratio(lower, F.regexp_count(text, F.lit(LETTER_AFTER_END)))


def syllables(word: Column) -> Column:
    return F.greatest(F.lit(1), F.length(word) - F.length(F.translate(word, VOWELS, "")))


def atesman(words_: Column, n_sentences: Column) -> Column:
    """Readability from syllables per word and words per sentence."""
    n = F.size(words_)
    per_word = ratio(total(F.transform(words_, lambda w: syllables(w).cast("double"))), n)
    return F.when((n == 0) | (n_sentences == 0), 0.0).otherwise(READABILITY[0] - READABILITY[1] * per_word - READABILITY[2] * ratio(n, n_sentences))
