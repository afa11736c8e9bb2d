import hmac
import re

from quillmark.llm import pii

KEY = "a test key"


def luhn(value):
    digits = [int(c) for c in value if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


def iban(value):
    plain = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def shape(value):
    return re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "9", value)))


VALUES = [
    ("card", "4111 1111 1111 1111"), ("card", "5500005555555559"), ("card", "3782-822463-10005"),
    ("email", "jane.doe+x@mail5.example.com"), ("email", "x@y.org"), ("ip", "192.168.0.255"), ("ip", "8.8.8.8"),
    ("date", "2024-02-29"), ("date", "31.12.1999"), ("date", "12/31/1999"), ("date", "1987/05/04"),
    ("ssn", "123-45-6789"), ("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432"),
    ("phone", "+1 (663) 555-6869"), ("phone", "555-123-4567"), ("phone", "+49 30 1234 5678"),
]
KEPT = ["4111 1111 1111 1112", "999.1.1.1", "2023-02-29", "666-12-3456", "DE88370400440532013000", "version 1.2.3", "12345", "a@b", "0000000000000000", "1850-01-01"]


def found(spark, texts):
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_found int")
    return {r.doc_id: r for r in pii.pseudonymise(docs, KEY).collect()}


def test_values_keep_format_and_validity_and_link(spark):
    texts = [f"é😀 before {v}, after" for _, v in VALUES] + [f"{v}\n" for _, v in VALUES]
    got = found(spark, texts)
    made = []
    for i, (kind, value) in enumerate(VALUES):
        row, again = got[i], got[i + len(VALUES)]
        assert row.n_found == 1 and row.found[0].kind == kind, (value, row)
        new = row.found[0].made
        assert new != value and row.text == texts[i].replace(value, new) and again.text == f"{new}\n"
        assert texts[i][row.found[0].start : row.found[0].end] == value
        if kind in ("card", "email", "ssn", "phone", "date"):
            assert shape(new) == shape(value)
        if kind == "card":
            assert luhn(new)
        if kind == "iban":
            assert iban(new) and new[:2] == value[:2]
        if kind == "ip":
            assert all(0 <= int(o) <= 255 for o in new.split("."))
        if kind == "email":
            assert new.split("@")[1] == value.split("@")[1]
        made.append(new)
    assert len(set(made)) == len(made)


def test_invalid_values_and_other_texts_stay(spark):
    texts = [f"x {v} y" for v in KEPT] + [None, "", "plain words", "a" * 200_000, "1 " * 50_000, "a." * 50_000 + "@"]
    for i, row in found(spark, texts).items():
        assert row.text == texts[i] and row.n_found == 0, texts[i] and texts[i][:50]


def test_permutations_are_one_to_one(spark):
    days = [f"{y}-{m:02d}-{d:02d}" for y in (1900, 2000, 2099) for m in range(1, 13) for d in range(1, 29)]
    got = [r.found[0].made for r in found(spark, days).values()]
    assert len(set(got)) == len(days) and all(1900 <= int(d[:4]) <= 2099 for d in got)
    slashed = [f"{a:02d}/{b:02d}/{y}" for y in (1904, 2000, 2001) for a in range(1, 13) for b in range(1, 29)] + ["02/29/2000", "02/29/1904", "01/31/2001"]
    assert len({r.found[0].made for r in found(spark, slashed).values()}) == len(slashed)
    hosts = [f"10.0.{a}.{b}" for a in range(5) for b in range(50)]
    assert len({r.found[0].made for r in found(spark, hosts).values()}) == len(hosts)
    numbers = [f"{a:03d}-{b:02d}-0001" for a in (1, 665, 667, 899) for b in range(1, 60)]
    got = [r.found[0].made for r in found(spark, numbers).values()]
    assert len(set(got)) == len(numbers) and not any(g.startswith(("000", "666", "9")) for g in got)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.pseudonymise(docs, KEY).collect() == []


def test_iban_before_a_short_word(spark):
    cases = [("ES91 2100 0418 4502 0005 1332", "EUR"), ("AT61 1904 3002 3457 3201", "BIC"), ("BE68539007547034", "2021"), ("NO93 8601 1117 947", "X"), ("DE89 3704 0044 0532 0130 00", "ABCD")]
    for i, row in found(spark, [f"to {v} {word}" for v, word in cases]).items():
        value, word = cases[i]
        assert row.n_found == 1 and row.found[0].kind == "iban", value
        made = row.found[0].made
        assert iban(made) and shape(made) == shape(value) and made != value
        assert row.text == f"to {made} {word}"


def permuted(value, kind):
    """The network on a string, in plain code."""
    kinds = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")

    def shifted(half, digest):
        out = ""
        for i, c in enumerate(half):
            by = int(digest[i % 32 * 2 : i % 32 * 2 + 2], 16) + i // 32 * 32
            letters = next((k for k in kinds if c in k), None)
            out += letters[(letters.index(c) + by) % len(letters)] if letters else c
        return out

    left, right = value[: len(value) // 2], value[len(value) // 2 :]
    for i in range(8):
        fixed = left if i % 2 else right
        digest = hmac.new(KEY.encode(), "\x1f".join([kind, str(i), fixed, shape(value)]).encode(), "sha256").hexdigest()
        left, right = (left, shifted(right, digest)) if i % 2 else (shifted(left, digest), right)
    return left + right


def test_strings_by_brute_force(spark):
    mails = ["jane.doe+x@mail5.example.com", "x@y.org", "A" * 40 + "b1@z.net"]
    got = found(spark, mails)
    for i, mail in enumerate(mails):
        name, _, host = mail.partition("@")
        assert got[i].text == f"{permuted(name, 'email')}@{host}"


def test_notations_of_a_number_link(spark):
    same = ["+1 (663) 555-6869", "663-555-6869", "+1 663 555 6869", "(663) 555-6869"]
    tails = {re.sub("[^0-9]", "", r.found[0].made)[-10:] for r in found(spark, same).values()}
    assert tails == {permuted("6635556869", "phone")}


def test_another_key_gives_other_pseudonyms(spark):
    docs = spark.createDataFrame([(1, "x@y.org jane@mail.example.com")], "doc_id long, text string")
    assert pii.pseudonymise(docs, "other").first().text != pii.pseudonymise(docs, KEY).first().text
