"""Secret scan in DataFrame functions only.

Three patterns (assignments, access keys, hexadecimal strings) give the base
spans.  On top, candidate strings - runs of base64 or hexadecimal characters -
are scored by the Shannon entropy of a sliding window: the counts of the
window's characters, and the sum of c log2 c over them, are updated for the
one character that enters and the one that leaves.  Each character class has
its own threshold; candidates that the allow-list matches are not reported.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import free_names
from quillmark.llm.spans import bound, joined, matches, replaced, spans

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 12
#: Maximal runs, so the least length may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{%d,}+={0,2}" % WINDOW
#: Bits per character of a window: strings of hexadecimal digits, all others.
HEX_BITS = 3.0
BASE64_BITS = 3.8
#: Candidates that are no secrets, besides paths of plain words and one
#: character repeated: no digit or no letter at all, UUIDs, documentation
#: examples.  No pattern repeats a group, which the regular-expression engine
#: would do by recursion.
ALLOW = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i:example|placeholder|changeme|dummy|x{8})",
)


def _plain(hit: Column) -> Column:
    """Words of small letters, each set off by one of ``/_-``, with a number of
    up to four digits at the end; or one character repeated."""
    path = F.rlike(hit, F.lit("^[a-z/][a-z/_-]*[0-9]{1,4}/?$")) & ~F.rlike(hit, F.lit("[/_-]{2}[a-z]|[/_-]{3}"))
    return path | (F.replace(hit, F.substring(hit, 1, 1), F.lit("")) == "")


def _entropy_window(text: Column, window: int, bits: Column) -> Column:
    """struct<low, high>: from the first to the last window of at least
    ``bits`` (a bound value), as character places; low is null if there is none.

    The sum of c log2 c over a window's counts changes by what the character
    that enters adds to its own count, and the one that leaves takes from its
    own; both counts are taken in the window alone."""
    gains = [(n + 1) * math.log2(n + 1) - (n * math.log2(n) if n else 0.0) for n in range(window)]
    gain = F.array(*(F.lit(g) for g in gains))
    codes = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c))

    def changes(held: Column) -> Column:
        def count(low: Column, length: Column, code: Column) -> Column:
            return F.size(F.filter(F.slice(held, F.greatest(low, F.lit(1)), length), lambda x: x == code))

        def change(code: Column, i: Column) -> Column:
            enters = F.get(gain, count(i - window + 2, F.least(i, F.lit(window - 1)), code))
            leaves = F.get(gain, count(i - window + 1, F.lit(window), F.get(held, i - window)) - 1)
            return enters - F.when(i >= window, leaves).otherwise(F.lit(0.0))

        return F.transform(held, change)

    start = F.struct(F.lit(0.0).alias("total"), F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("high"), F.lit(0).alias("at"))

    def step(state: Column, change: Column) -> Column:
        total, at = state["total"] + change, state["at"] + 1
        hot = (at >= window) & (F.lit(math.log2(window)) - total / window >= bits - 1e-9)
        return F.struct(
            total.alias("total"),
            F.when(hot, F.coalesce(state["low"], at - window)).otherwise(state["low"]).alias("low"),
            F.when(hot, at).otherwise(state["high"]).alias("high"),
            at.alias("at"),
        )

    return F.aggregate(bound(codes, changes), start, step, lambda end: F.struct(end["low"].alias("low"), end["high"].alias("high")))


#: New columns of ``with_spans``: the base spans of each kind, candidate
#: strings, all base spans, all spans.
COLUMNS = ("_assign", "_access", "_hex", "_candidates", "_base", "_all")


def with_spans(docs: DataFrame, window: int = WINDOW, hex_bits: float = HEX_BITS, base64_bits: float = BASE64_BITS, allow: tuple[str, ...] = ALLOW, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """``docs`` with sorted arrays of spans (start, ord, end, kind), end
    exclusive, in code points, in new columns of the names ``columns``."""
    a, b, c, d, e, f = columns
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string,hit:string>>")

    def found(pattern: str, kind: str, order: int, cheap: Column) -> Column:
        return F.when(cheap, spans(matches(text, pattern), kind, order)).otherwise(none)

    assign = F.filter(found(ASSIGN, "assign", 0, F.rlike(text, F.lit(ASSIGN))), lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= ASSIGN_VALUE)
    access = found(ACCESS, "access", 1, F.contains(text, F.lit("AKIA")))
    hexes = found(HEX, "hex", 2, F.rlike(text, F.lit(HEX)))
    candidates = found(CANDIDATE, "entropy", 3, F.rlike(text, F.lit(CANDIDATE)))
    candidates = F.filter(candidates, lambda s: ~_plain(s["hit"]))
    if allow:
        candidates = F.filter(candidates, lambda s: ~F.rlike(s["hit"], F.lit("|".join(f"(?:{p})" for p in allow))))

    def scored(span: Column) -> Column:
        def by_class(is_hex: Column) -> Column:
            place = bound(F.when(is_hex, F.lit(hex_bits)).otherwise(F.lit(base64_bits)), lambda bits: _entropy_window(span["hit"], window, bits))
            return bound(place, lambda p: F.struct(
                (span["start"] + p["low"]).alias("start"),
                F.when(is_hex, 3).otherwise(4).alias("ord"),
                (span["start"] + p["high"]).alias("end"),
                F.when(is_hex, F.lit("entropy_hex")).otherwise(F.lit("entropy_base64")).alias("kind"),
            ))

        return bound(F.rlike(span["hit"], F.lit("^[0-9a-fA-F]+$")), by_class)

    plain = "array<struct<start:int,ord:int,end:int,kind:string>>"

    def bare(places: Column) -> Column:
        return F.transform(places, lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), s["kind"].alias("kind"))).cast(plain)

    staged = docs.withColumns({a: bare(assign), b: bare(access), c: bare(hexes), d: candidates})
    entropy = F.filter(F.transform(d, scored), lambda s: s["start"].isNotNull()).cast(plain)
    base = F.array_sort(F.concat(a, b, c))
    return staged.withColumns({e: base, f: F.array_sort(F.concat(a, b, c, entropy))}).drop(d)


def scan(docs: DataFrame, **options: object) -> DataFrame:
    """Secrets in whole texts: doc_id, counts of base spans by kind, digest of
    the base spans, and all spans as kind:start:end by start.

    Null texts are empty; rows without id and repeated rows are rows like any
    other; other columns are ignored; an empty table gives no rows.
    """
    found = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), **options)
    return found.select(
        "doc_id",
        F.size("_assign").cast("long").alias("n_assign"),
        F.size("_access").cast("long").alias("n_access"),
        F.size("_hex").cast("long").alias("n_hex"),
        F.sha2(joined(F.col("_base")), 256).alias("base_sha256"),
        joined(F.col("_all")).alias("spans"),
    )


def redact(docs: DataFrame, word: str = "[SECRET]", **options: object) -> DataFrame:
    """``docs`` with every span replaced by ``word``.

    Null texts stay null and empty ones empty; repeated rows, rows without id
    and other columns stay as they are; an empty table stays empty.
    """
    columns = free_names(docs, *COLUMNS)
    found = with_spans(docs, columns=tuple(columns), **options)
    return found.withColumn("text", F.when(F.col("text").isNull(), F.col("text")).otherwise(replaced(F.col("text"), F.col(columns[-1]), word))).select(*docs.columns)
