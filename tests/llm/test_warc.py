import gzip
import hashlib
import io
import random

from quillmark.llm import warc
from quillmark.llm.common import fresh_path


def want(pages):
    first = {}
    for page, _, html in pages:
        data = (html or "").encode()
        if len(data) >= 100 and page is not None:
            first[data] = min(first.get(data, page), page)
    out = []
    for page, _, html in pages:
        data = (html or "").encode()
        refers = first.get(data)
        refers = None if refers == page else refers
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def corpus():
    rnd = random.Random(1)
    big = "".join(rnd.choice("<html>é😀 abc") for _ in range(40_000))
    pages = [(i, f"http://x.org/{i}?q=a b\r\nX: y", "".join(rnd.choice("abc<>é\n") for _ in range(rnd.choice([0, 5, 99, 100, 3000])))) for i in range(120)]
    pages += [(500 + i, None, big) for i in range(30)] + [(-3, "u", big), (700, "u", "short"), (701, "u", "short"), (702, None, None), (None, "u", "no id"), (None, "u", big), (703, "u", "x" * 100), (703, "u", "x" * 100), (704, "u", "WARC/1.1\r\n\r\n" * 50)]
    return pages


def test_roundtrip_with_tiny_ranges(spark):
    pages = corpus()
    df = spark.createDataFrame([(*p, 7) for p in pages], "page_id long, url string, html string, length int").repartition(3)
    for split in (777, 1 << 24):
        got = [tuple(r)[:5] for r in warc.roundtrip(df, split).collect()]
        assert sorted(got, key=str) == want(pages)


def test_archives_are_plain_gzip(spark):
    folder = fresh_path(spark, "archives")
    warc.write(spark.createDataFrame(corpus(), "page_id long, url string, html string"), folder)
    files = [r.path for r in spark.read.format("binaryFile").load(folder).select("path").collect() if r.path.endswith(".warc.gz")]
    assert files
    for path in files:
        with gzip.open(warc._open(path)) as f:
            assert f.read(10) == b"WARC/1.1\r\n"


def test_false_magic_and_large_members_are_passed():
    big = bytes(random.Random(2).randbytes(17 << 20))
    inner = b"".join([warc.MAGIC, b"\x00" * 7, b"WARC/1.0 no header", warc._member([("WARC-Type", "response")], b"nested"), big])
    data = warc._member([("WARC-Type", "resource")], inner) + b"junk" + warc.MAGIC + b"junk" + warc._member([("WARC-Type", "metadata")], b"second")
    got = list(warc.records(io.BytesIO(data), 0, len(data)))
    assert [(f["WARC-Type"], b) for _, f, b in got] == [("resource", inner), ("metadata", b"second")]
    cut = len(data) - 40
    assert list(warc.records(io.BytesIO(data), cut, len(data))) == []


def test_every_split_point_gives_each_record_once():
    data = b"".join(warc._member([("WARC-Type", "resource")], b"%d" % i * 30) for i in range(20))
    for cut in range(0, len(data), 7):
        got = [b for a, b in ((0, cut), (cut, len(data))) for _, _, b in warc.records(io.BytesIO(data), a, b)]
        assert got == [b"%d" % i * 30 for i in range(20)]


def test_empty_table(spark):
    assert warc.roundtrip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_very_long_urls_are_read(spark):
    rnd = random.Random(6)
    pages = [(1, "http://x.org/" + "".join(rnd.choice("abcdefgh0123456789é ") for _ in range(400_000)), "a"), (2, "u", "b"), (3, "é" * 100_000, "c")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for split in (5000, 1 << 24):
        assert sorted((tuple(r)[:5] for r in warc.roundtrip(df, split).collect()), key=str) == want(pages)
