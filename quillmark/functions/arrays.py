"""Array building blocks: everything stays inside the row, so no feature of a
document needs a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def tokens(text: Column) -> Column:
    """Words (letters and digits) and single signs."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def words(text: Column) -> Column:
    """Runs between Unicode white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def ngrams(items: Column, n: int) -> Column:
    """Runs of n items joined by blanks; none if there are fewer items."""
    if n == 1:
        return items
    whole = F.transform(F.sequence(F.lit(0), F.size(items) - n), lambda i: F.concat_ws(" ", *(F.get(items, i + k) for k in range(n))))
    return F.when(F.size(items) >= n, whole).otherwise(F.array().cast("array<string>"))


def run_counts(items: Column) -> Column:
    """How often each distinct item occurs, in the items' order: sort, find
    where runs begin, and take differences."""

    def counts(ordered: Column) -> Column:
        n = F.size(ordered)
        heads = F.filter(F.transform(ordered, lambda x, i: F.when((i == 0) | (x != F.get(ordered, i - 1)), i)), lambda i: i.isNotNull())
        return F.get(F.transform(F.array(heads), lambda h: F.transform(h, lambda x, i: F.coalesce(F.get(h, i + 1), n) - x)), F.lit(0))

    return F.get(F.transform(F.array(F.sort_array(items)), counts), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is nothing to divide by."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole)


def mean(values: Column) -> Column:
    return ratio(total(F.transform(values, lambda x: x.cast("double"))), F.size(values))


def sample_variance(values: Column) -> Column:
    """Sample variance, 0 for fewer than two values."""
    m = mean(values)
    squares = F.get(F.transform(F.array(m), lambda mu: total(F.transform(values, lambda x: (x - mu) * (x - mu)))), F.lit(0))
    return F.when(F.size(values) < 2, F.lit(0.0)).otherwise(squares / (F.size(values) - 1))


def sentences(text: Column) -> Column:
    """Split after . ! ? and white space; stripped, without blanks."""
    parts = F.split(text, r"(?U)(?<=[.!?])\s+")
    stripped = F.transform(parts, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    return F.filter(stripped, lambda s: s != "")
