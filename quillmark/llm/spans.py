"""Places of regular-expression matches, and rewriting them, in DataFrame
functions only.

Spark gives the matches of a pattern and the pieces between them, but not
their places; both come from the same leftmost scan, so running sums of
lengths give the places in code points.  A fold that appends to an array
copies it, so folds run over blocks: what is copied stays short, however many
matches a text has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,ord:int,end:int,kind:string>>"
_HIT = "struct<start:int,ord:int,end:int,kind:string,hit:string>"
#: Items that a fold handles at a time.
BLOCK = 256


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once: functions with lambdas
    compute what they refer to anew for every element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def blocks(items: Column) -> Column:
    """An array (a bound one) cut into arrays of up to BLOCK items."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(BLOCK)), lambda at: F.slice(items, at, BLOCK))


def running(items: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Array of ``kind``: ``step(at, item)`` gives the next place and an array
    of what to append; the first place is 0."""

    def over(state: Column, block: Column) -> Column:
        def one(inner: Column, item: Column) -> Column:
            at, out = step(inner["at"], item)
            return F.struct(at.alias("at"), F.concat(inner["out"], out).alias("out"))

        start = F.struct(state["at"].alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return bound(F.aggregate(block, start, one), lambda end: F.struct(end["at"].alias("at"), F.concat(state["out"], F.array(end["out"])).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return bound(items, lambda held: F.flatten(F.aggregate(blocks(held), start, over)["out"]))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<gap, hit>>: the text before each match, and the match."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"))


def spans(found: Column, kind: str, order: int) -> Column:
    """SPAN of ``matches``, with the text of each match as ``hit``."""

    def step(at: Column, pair: Column) -> tuple[Column, Column]:
        low = at + F.length(pair["gap"])
        high = low + F.length(pair["hit"])
        span = F.struct(low.alias("start"), F.lit(order).alias("ord"), high.alias("end"), F.lit(kind).alias("kind"), pair["hit"].alias("hit"))
        return high, F.array(span)

    return running(found, _HIT, step)


def joined(places: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(places, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def replaced(text: Column, places: Column, word: str) -> Column:
    """``text`` with each run of overlapping spans (sorted) replaced by ``word``."""

    def over(state: Column, block: Column) -> Column:
        """State: place reached, the text from there on, pieces before it."""
        end = F.greatest(state["at"], F.array_max(F.transform(block, lambda s: s["end"])))

        def inner(piece: Column) -> Column:
            def step(s: Column, span: Column) -> Column:
                fresh = F.array(F.substring(piece, s["at"] - state["at"] + 1, span["start"] - s["at"]), F.lit(word))
                return F.struct(F.greatest(s["at"], span["end"]).alias("at"), F.when(span["start"] >= s["at"], F.concat(s["out"], fresh)).otherwise(s["out"]).alias("out"))

            return F.array_join(F.aggregate(block, F.struct(state["at"].alias("at"), F.array().cast("array<string>").alias("out")), step)["out"], "")

        piece = F.substring(state["rest"], F.lit(1), end - state["at"])
        return F.struct(end.alias("at"), F.substring(state["rest"], end - state["at"] + 1, F.length(state["rest"])).alias("rest"), F.concat(state["out"], F.array(bound(piece, inner))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), text.alias("rest"), F.array().cast("array<string>").alias("out"))
    whole = bound(places, lambda held: bound(F.aggregate(blocks(held), start, over), lambda s: F.concat(F.array_join(s["out"], ""), s["rest"])))
    return F.when(F.size(places) == 0, text).otherwise(whole)
