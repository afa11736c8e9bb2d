"""Text cleaning, chunking and filters as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions.arrays import bound, sentences, word_count, words

CJK = r"[一-鿿぀-ヿ가-퟿]"
#: Validity stop words and citation pattern.
VALIDITY_WORDS = (
    "ve", "bir", "bu", "için", "ile", "de", "da", "olarak", "olan", "gibi", "en", "çok", "daha", "ancak", "ise",
    "ama", "veya", "ki", "mi", "mu", "ne", "her", "tüm", "sonra", "önce", "kadar", "göre", "ya", "yani",
)
CITATION = r"\(\d{4}\)|\d{4}\)\.|pp\.\s*\d|ss\.\s*\d"
#: Header patterns.
HEADER_WORDS = r"(?iU)\b(cilt|say[ıi]|issn|vol\.|pp\.|ss\.|s\.\s*\d|dergisi|abstract|özet/abstract|öğr\.?\s*gör\.?|doç\.?\s*dr\.?|prof\.?\s*dr\.?|to cite this article|curr res)\b"
PAGE_RANGE = r"^\s*\d+[-–]\d+\s*$"
FOOTNOTE = r"^\s*[*\d]+\.?\s*[A-ZÇĞİÖŞÜ]"
MANY_FOOTNOTES = r"\d+\s+[A-ZÇĞİÖŞÜ][a-zçğıöşüi]+,"
CITED_PAGES = r"\(\d+\)[,:]?\s*\d+[-–]\d+"


#: What is dropped or replaced, in this order.
MARKS = "[\\uFEFF\\x00]"
CONTROLS = r"[\x01-\x08\x0B\x0C\x0E-\x1F\x7F]"
BLANKS = r"[ \t]+"
EMPTY_LINES = r"\n{3,}"
BROKEN_WORD = r"-\n(?=[a-zA-ZğüşıöçĞÜŞİÖÇ])"
#: Parts of an id and the generators they stand for.
GENERATORS = {"_transformers_": "qwen", "_openai_": "gpt4o_mini", "_anthropic_": "claude_sonnet5"}


def _nfc(text: Column) -> Column:
    @F.pandas_udf("string")
    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))

    return normal(text)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def without_noise(text: Column) -> Column:
    """The cleaning steps after normalisation, in their order."""
    for pattern, to in ((MARKS, ""), (CONTROLS, ""), (BLANKS, " "), (EMPTY_LINES, "\n\n"), (BROKEN_WORD, "")):
        text = F.regexp_replace(text, pattern, to)
    return strip(text)


def clean_text(text: Column) -> Column:
    """Normalise (only rows with other than ASCII characters go through
    Python), then remove noise."""
    normal = F.when(F.rlike(text, F.lit(r"[^\x00-\x7F]")), _nfc(F.when(F.rlike(text, F.lit(r"[^\x00-\x7F]")), text))).otherwise(text)
    return without_noise(normal)


def chunks(text: Column, least: int, most: int) -> Column:
    """Sentences packed into chunks of at most ``most`` words; a last chunk of
    fewer than ``least`` joins the one before; a long sentence stays whole.
    Words of a sentence are counted once, before the fold."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))

    def step(s: Column, counted: Column) -> Column:
        sentence, n = counted["sentence"], counted["n"]
        full = (s["n"] > 0) & (s["n"] + n > most)
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]).alias("done"),
            F.when(full | (s["n"] == 0), sentence).otherwise(F.concat_ws(" ", s["now"], sentence)).alias("now"),
            F.when(full, n).otherwise(s["n"] + n).alias("n"),
        )

    def finish(s: Column) -> Column:
        every = F.when(s["n"] > 0, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"])
        short = (F.size(s["done"]) > 0) & (s["n"] < least)
        head = F.slice(s["done"], 1, F.size(s["done"]) - 1)
        return F.when(short, F.concat(head, F.array(F.concat_ws(" ", F.element_at(s["done"], -1), s["now"])))).otherwise(every)

    counted = F.transform(sentences(text), lambda x: F.struct(x.alias("sentence"), word_count(x).alias("n")))
    return F.aggregate(counted, start, step, finish)


def translation_pieces(text: Column, most: int = 80) -> Column:
    return bound(chunks(text, 1, most), lambda found: F.when(F.size(found) == 0, F.array(text)).otherwise(found))


def truncated(text: Column, limit: int = 500, longest: int = 100) -> Column:
    """First ``limit`` words; sentences of over ``longest`` words are cut."""
    cut = F.when(word_count(text) > limit, F.concat_ws(" ", F.slice(words(text), 1, limit))).otherwise(text)

    def recut(sentence: Column) -> Column:
        w = words(sentence)
        parts = F.transform(F.sequence(F.lit(1), F.size(w), F.lit(longest)), lambda i: F.concat_ws(" ", F.slice(w, i, F.lit(longest))))
        return F.when(F.size(w) > longest, parts).otherwise(F.array(sentence))

    return F.array_join(F.flatten(F.transform(F.split(cut, r"\. "), recut)), ". ")


def cjk_ratio(text: Column) -> Column:
    return F.when(F.length(text) == 0, 0.0).otherwise(F.regexp_count(text, F.lit(CJK)) / F.length(text))


def validity_ratio(text: Column, vocabulary: tuple[str, ...] = VALIDITY_WORDS) -> Column:
    """Share of stop words; 0 for fewer than 30 words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-zA-ZçÇğĞıİöÖşŞüÜ]+"), F.lit(0))
    return F.when(F.size(found) < 30, 0.0).otherwise(F.size(F.filter(found, lambda w: w.isin(*vocabulary))) / F.size(found))


def bibliography_ratio(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: strip(x) != "")
    return F.when(F.size(lines) == 0, 0.0).otherwise(F.size(F.filter(lines, lambda x: F.rlike(x, F.lit(CITATION)))) / F.size(lines))


def looks_like_header(text: Column, expected_language: Column) -> Column:
    """Nine rules against running heads, footnotes and reference lists;
    ``expected_language`` is the (outside) language test."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return (
        (letters == 0)
        | (F.regexp_count(text, F.lit(r"\p{Lu}")) > 0.4 * letters)
        | F.rlike(text, F.lit(HEADER_WORDS))
        | F.rlike(text, F.lit(PAGE_RANGE))
        | F.rlike(text, F.lit(FOOTNOTE))
        | (F.regexp_count(text, F.lit(MANY_FOOTNOTES)) >= 2)
        | F.rlike(text, F.lit(CITED_PAGES))
        | (bibliography_ratio(text) > 0)
        | ((word_count(text) >= 6) & ~expected_language)
    )


def generator(sample_id: Column) -> Column:
    """Which generator an id names; an unknown id is an error."""
    named = F.when(F.startswith(sample_id, F.lit("human")), "human")
    for part, name in GENERATORS.items():
        named = named.when(F.contains(sample_id, F.lit(part)), name)
    return named.otherwise(F.raise_error(F.concat(F.lit("no generator in id "), sample_id)))


def slug(title: Column, index: Column) -> Column:
    """File name of an article: its number and the safe part of its title."""
    safe = F.substring(F.regexp_replace(F.regexp_replace(title, "[^a-zA-Z0-9_-]+", "_"), "^_+|_+$", ""), 1, 60)
    head = F.concat(F.lit("wikipedia_tr_"), F.lpad(index.cast("string"), 5, "0"))
    return F.concat(head, F.when(safe != "", F.concat(F.lit("_"), safe)).otherwise(""), F.lit(".txt"))
