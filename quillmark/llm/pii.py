"""Personal data replaced by format-preserving pseudonyms, in DataFrame
functions only.

Values found by pattern are validated (card numbers by Luhn, IBANs by the
remainder 97, dates by the calendar, addresses and numbers by their ranges)
and then permuted by a keyed Feistel network *inside their format*, so the
same value has the same pseudonym in every document and different values have
different ones.  Network halves are either residues (dates, IP addresses,
social security numbers) or strings in which every digit stays a digit and
every letter a letter of its case (cards, phones, mail names, IBANs).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.spans import matches, running

ROUNDS = 8
#: Digits at the end of a telephone number that are permuted (all, if fewer).
PHONE_DIGITS = 10

#: Characters of an IBAN by country (SWIFT registry; fixed values).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG YE", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
#: The length is the country's, so that a word after the value isn't taken in;
#: other countries' values are taken by their groups.
_IBANS = "|".join(f"(?:{'|'.join(names.split())})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, names in IBAN_LENGTHS.items())

#: Leftmost match wins, so longer kinds come first.  Every repetition is
#: bounded or possessive: no text makes the scan quadratic.
PATTERNS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})(?:\.[A-Za-z0-9-]{1,63}){1,8}"),
    ("ip", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"),
    ("date", r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9]|[/.-][0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"),
    ("iban", rf"(?<![A-Za-z0-9])(?:{_IBANS}|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)(?![A-Za-z0-9])"),
    ("phone", r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])|(?<![0-9A-Za-z+.-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9]|[.-][0-9])"),
    ("card", r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:(?: [0-9]{4}){3}|(?:-[0-9]{4}){3})|[0-9]{4}(?: [0-9]{6} |-[0-9]{6}-)[0-9]{5})(?![0-9A-Za-z])"),
)
_EVERY = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: What any of them needs, to pass over texts without it.
_CHEAP = r"@|[0-9][0-9 .()/+-]{4}"

#: Days of 1900-01-01 to 2099-12-31 are 229 * 319.
_FIRST_DAY, _DAY_LEFT, _DAY_RIGHT = "1900-01-01", 229, 319
_AREAS, _GROUPS, _SERIALS = 898, 99, 9999


def _rounds() -> Column:
    return F.array(*(F.lit(i) for i in range(ROUNDS)))


def _hash(key: str, kind: str, number: Column, *parts: Column) -> Column:
    """HMAC-SHA-256 (RFC 2104) of the round and what it depends on, in hex."""
    block = key.encode()
    block = (hashlib.sha256(block).digest() if len(block) > 64 else block).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    message = F.concat_ws("\x1f", F.lit(kind), number.cast("string"), *parts).cast("binary")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def _residue(digest: Column, modulus: int) -> Column:
    return F.conv(F.substring(digest, 1, 14), 16, 10).cast("long") % modulus


def _each(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _feistel_residues(left: Column, right: Column, moduli: tuple[int, int], key: str, kind: str) -> Column:
    """struct<l, r>: the permuted pair."""

    def turn(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        by = _hash(key, kind, i, F.when(odd, s["l"]).otherwise(s["r"]).cast("string"))
        return F.struct(
            F.when(odd, s["l"]).otherwise((s["l"] + _residue(by, moduli[0])) % moduli[0]).alias("l"),
            F.when(odd, (s["r"] + _residue(by, moduli[1])) % moduli[1]).otherwise(s["r"]).alias("r"),
        )

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(_rounds(), start, turn)


def _shifted(half: Column, digest: Column) -> Column:
    """Every digit and letter of ``half`` moved within its class, each by
    two characters of the digest (which is repeated as needed)."""
    chars = F.regexp_extract_all(half, F.lit("(?s)."), F.lit(0))

    def move(c: Column, i: Column) -> Column:
        by = F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int") + i.bitwiseAND(-32)
        code = F.ascii(c)

        def turned(low: str, n: int) -> Column:
            return F.chr((code - ord(low) + by) % n + ord(low))

        return F.when(c.between("0", "9"), turned("0", 10)).when(c.between("a", "z"), turned("a", 26)).when(c.between("A", "Z"), turned("A", 26)).otherwise(c)

    return F.array_join(F.transform(chars, move), "")


def _shape(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), "[a-z]", "a"), "[A-Z]", "A")


def _feistel_string(value: Column, key: str, kind: str) -> Column:
    """Permuted string of the same shape (positions of digits, letters, signs)."""
    half = F.floor(F.length(value) / 2).cast("int")
    shape = _shape(value)

    def turn(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        moved = _shifted(F.when(odd, s["r"]).otherwise(s["l"]), _hash(key, kind, i, F.when(odd, s["l"]).otherwise(s["r"]), s["shape"]))
        return F.struct(F.when(odd, s["l"]).otherwise(moved).alias("l"), F.when(odd, moved).otherwise(s["r"]).alias("r"), s["shape"].alias("shape"))

    start = F.struct(F.substring(value, F.lit(1), half).alias("l"), F.substring(value, half + 1, F.length(value)).alias("r"), shape.alias("shape"))
    return F.aggregate(_rounds(), start, turn, lambda s: F.concat(s["l"], s["r"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, the last digit undoubled."""
    chars = F.regexp_extract_all(F.reverse(digits), F.lit("."), F.lit(0))
    twice = F.transform(chars, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(twice, F.lit(0), lambda a, x: a + x)


def _poured(shape: Column, digits: Column) -> Column:
    """The digits of ``shape`` replaced, in order, by ``digits``."""
    chars = F.regexp_extract_all(shape, F.lit("(?s)."), F.lit(0))
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def step(s: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(F.when(digit, s["at"] + 1).otherwise(s["at"]).alias("at"), F.concat(s["out"], F.when(digit, F.substring(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(chars, start, step)["out"]


def _card(value: Column, key: str) -> Column:
    body = _each(_digits(value), lambda d: F.substring(d, F.lit(1), F.length(d) - 1))

    def finish(b: Column) -> Column:
        check = (10 - _luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10
        return F.concat(b, check.cast("string"))

    return _poured(value, _each(_feistel_string(body, key, "card"), finish))


def _iban_rest(value: Column) -> Column:
    """Remainder by 97 of an IBAN without blanks, its head moved to the end."""
    moved = F.concat(F.substring(value, F.lit(5), F.length(value)), F.substring(value, 1, 4))
    return F.aggregate(
        F.regexp_extract_all(moved, F.lit("."), F.lit(0)),
        F.lit(0),
        lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )


def _iban(value: Column, key: str) -> Column:
    plain = F.regexp_replace(value, " ", "")
    body = _feistel_string(F.substring(plain, F.lit(5), F.length(plain)), key, "iban")

    def finish(whole: Column) -> Column:
        check = F.lpad((98 - _iban_rest(F.concat(F.substring(whole, 1, 2), F.lit("00"), F.substring(whole, F.lit(5), F.length(whole)))))
                       .cast("string"), 2, "0")
        return F.concat(F.substring(whole, 1, 2), check, F.substring(whole, F.lit(5), F.length(whole)))

    made = _each(F.concat(F.substring(plain, 1, 4), body), finish)
    chars = F.regexp_extract_all(value, F.lit("."), F.lit(0))
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def put(s: Column, c: Column) -> Column:
        return F.struct(F.when(c == " ", s["at"]).otherwise(s["at"] + 1).alias("at"), F.concat(s["out"], F.when(c == " ", c).otherwise(F.substring(made, s["at"], F.lit(1)))).alias("out"))

    return F.aggregate(chars, start, put)["out"]


def _octets(value: Column) -> Column:
    return F.transform(F.split(value, r"\."), lambda o: o.cast("int"))


def _ip(value: Column, key: str) -> Column:
    o = _octets(value)
    pair = _feistel_residues(F.get(o, F.lit(0)) * 256 + F.get(o, F.lit(1)), F.get(o, F.lit(2)) * 256 + F.get(o, F.lit(3)), (65536, 65536), key, "ip")
    return _each(pair, lambda s: F.concat_ws(".", *((F.floor(s[h] / 256) if top else s[h] % 256).cast("string") for h in ("l", "r") for top in (True, False))))


def _day(value: Column) -> Column:
    """The calendar day of a date string, null if there is none such."""
    parts = F.split(value, "[-/.]")
    year_first = F.length(F.get(parts, F.lit(0))) == 4
    a, b, c = (F.get(parts, F.lit(i)) for i in range(3))
    text = F.when(year_first, F.concat_ws("-", a, b, c)).when(b.cast("int") > 12, F.concat_ws("-", c, a, b)).otherwise(F.concat_ws("-", c, b, a))
    day = F.try_to_date(text, "yyyy-MM-dd")
    return F.when(F.year(day).between(1900, 2099), day)


def _month_days() -> list[str]:
    """MM-dd of the days over 12 of a common year (221 of them)."""
    lengths = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
    return [f"{m + 1:02d}-{d:02d}" for m, n in enumerate(lengths) for d in range(13, n + 1)]


def _month_first(value: Column, key: str) -> Column:
    """Dates that are only valid month first (the day is over 12), permuted
    among themselves; 29 February stays, its year moves among leap years."""
    parts = F.split(value, "[-/.]")
    a, b, c = (F.get(parts, F.lit(i)) for i in range(3))
    sign = F.regexp_extract(value, "[-/.]", 0)
    days = F.array(*(F.lit(d) for d in _month_days()))
    place = (F.array_position(days, F.concat_ws("-", a, b)) - 1).cast("int")
    pair = _feistel_residues(c.cast("int") - 1900, place, (200, len(_month_days())), key, "month-first")
    common = _each(pair, lambda s: F.concat(F.replace(F.get(days, s["r"].cast("int")), F.lit("-"), sign), sign, (s["l"] + 1900).cast("string")))
    leap = F.floor((c.cast("int") - 1904) / 4)  # the 49 leap years from 1904 to 2096
    years = _feistel_residues(F.floor(leap / 7), leap % 7, (7, 7), key, "leap-day")
    february = _each(years, lambda s: F.concat(a, sign, b, sign, (1904 + 4 * (s["l"] * 7 + s["r"])).cast("string")))
    return F.when(place >= 0, common).otherwise(february)


def _date(value: Column, key: str) -> Column:
    number = F.datediff(_day(value), F.lit(_FIRST_DAY).cast("date"))
    pair = _feistel_residues(F.floor(number / _DAY_RIGHT), number % _DAY_RIGHT, (_DAY_LEFT, _DAY_RIGHT), key, "date")

    def shown(s: Column) -> Column:
        day = F.date_add(F.lit(_FIRST_DAY).cast("date"), (s["l"] * _DAY_RIGHT + s["r"]).cast("int"))
        sign = F.regexp_extract(value, "[-/.]", 0)
        year, month, dom = (F.date_format(day, f) for f in ("yyyy", "MM", "dd"))
        return F.when(value.rlike("^[0-9]{4}"), F.concat(year, sign, month, sign, dom)).otherwise(F.concat(dom, sign, month, sign, year))

    only_month_first = ~value.rlike("^[0-9]{4}") & (F.get(F.split(value, "[-/.]"), F.lit(1)).cast("int") > 12)
    return F.when(only_month_first, _month_first(value, key)).otherwise(_each(pair, shown))


def _ssn_parts(value: Column) -> tuple[Column, Column, Column]:
    parts = F.split(value, "-")
    return tuple(F.get(parts, F.lit(i)).cast("int") for i in range(3))


def _ssn(value: Column, key: str) -> Column:
    area, group, serial = _ssn_parts(value)
    index = F.when(area > 666, area - 2).otherwise(area - 1)  # 1-899 without 666
    pair = _feistel_residues(index * _GROUPS + group - 1, serial - 1, (_AREAS * _GROUPS, _SERIALS), key, "ssn")

    def shown(s: Column) -> Column:
        area = F.floor(s["l"] / _GROUPS) + 1
        area = F.when(area >= 666, area + 1).otherwise(area)
        return F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad((s["l"] % _GROUPS + 1).cast("string"), 2, "0"), F.lpad((s["r"] + 1).cast("string"), 4, "0"))

    return _each(pair, shown)


def _email(value: Column, key: str) -> Column:
    at = F.instr(value, "@")
    return F.concat(_feistel_string(F.substring(value, F.lit(1), at - 1), key, "email"), F.substring(value, at, F.length(value)))


def _phone(value: Column, key: str) -> Column:
    """The last digits are permuted by themselves, so every notation of a
    number, with its country's code or without, has the same ones."""

    def made(digits: Column) -> Column:
        head = F.greatest(F.length(digits) - PHONE_DIGITS, F.lit(0))
        return F.concat(F.substring(digits, F.lit(1), head), _feistel_string(F.substring(digits, head + 1, F.length(digits)), key, "phone"))

    return _poured(value, _each(_digits(value), made))


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(_octets(value), lambda o: o <= 255)
    if kind == "date":
        return _day(value).isNotNull()
    if kind == "ssn":
        area, group, serial = _ssn_parts(value)
        return (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    if kind == "iban":
        return _iban_rest(F.regexp_replace(value, " ", "")) == 1
    if kind == "card":
        return (_luhn_sum(_digits(value)) % 10 == 0) & ~value.rlike("^[0 -]*$")
    if kind == "phone":
        return F.length(_digits(value)).between(7, 15)
    return F.lit(True)


_MAKERS = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "iban": _iban, "phone": _phone, "card": _card}


def with_pseudonyms(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with ``_pii``: array<struct<gap, kind, hit, made>> of the
    matches of a text without nulls; kind is null where a match isn't valid."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.array().cast("array<struct<gap:string,hit:string>>")
    found = F.when(F.rlike(text, F.lit(_CHEAP)), matches(text, _EVERY)).otherwise(none)

    def named(m: Column) -> Column:
        kind = F.lit(None).cast("string")
        for name, pattern in reversed(PATTERNS):
            # lookarounds saw the whole text when it matched; the value alone has nothing around it
            kind = F.when(F.rlike(m["hit"], F.lit(f"^(?:{pattern})$")), F.when(_valid(name, m["hit"]), F.lit(name)).otherwise(kind)).otherwise(kind)
        return F.struct(m["gap"].alias("gap"), kind.alias("kind"), m["hit"].alias("hit"))

    def made(m: Column) -> Column:
        value: Column = m["hit"]
        for name, maker in _MAKERS.items():
            value = F.when(m["kind"] == name, maker(m["hit"], key)).otherwise(value)
        return F.struct(m["gap"].alias("gap"), m["kind"].alias("kind"), m["hit"].alias("hit"), value.alias("made"))

    staged = docs.withColumn("_pii", F.transform(found, named))
    return staged.withColumn("_pii", F.transform("_pii", made))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """Under a secret key: doc_id, text with pseudonyms, n_found, and found (kind, place and
    pseudonym of every value; place is the code point where the value began).

    Null texts stay null, with nothing found; matches that aren't valid values
    stay as they are; rows without id and repeated rows are rows like any
    other; other columns are ignored; an empty table gives no rows.
    """
    found = with_pseudonyms(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), key)
    def step(at: Column, m: Column) -> tuple[Column, Column]:
        low = at + F.length(m["gap"])
        high = low + F.length(m["hit"])
        one = F.array(F.struct(m["kind"].alias("kind"), low.alias("start"), high.alias("end"), m["made"].alias("made")))
        return high, F.filter(one, lambda x: x["kind"].isNotNull())

    places = running(F.col("_pii"), "struct<kind:string,start:int,end:int,made:string>", step)
    size = F.aggregate("_pii", F.lit(0), lambda n, m: n + F.length(m["gap"]) + F.length(m["hit"]))
    staged = found.withColumns({"_found": places, "_size": size})
    rest = F.substring(F.col("text"), F.col("_size") + 1, F.length("text"))
    joined = F.concat(F.array_join(F.transform("_pii", lambda m: F.concat(m["gap"], m["made"])), ""), rest)
    return staged.select(
        "doc_id",
        F.when(F.size("_pii") == 0, F.col("text")).otherwise(joined).alias("text"),
        F.size("_found").cast("long").alias("n_found"),
        F.col("_found").alias("found"),
    )
