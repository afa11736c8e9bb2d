"""WARC archives: a writer with payload deduplication and a splittable reader.

Every record is a gzip member of its own.  Archives are written by Spark's own
committer (so a lost or repeated task leaves no partial file) as raw bytes:
the text sink puts a separator after each row, and the separator chosen, one
zero byte, *is* the last byte of every member, which is left off the row.

The reader plans byte ranges of any length over all archives.  A task scans
its range for the gzip magic, accepts a candidate only if its data decodes to
a WARC header, and owns the records that start inside its range, reading past
its end to finish the last one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import fresh_path, materialize

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 16 << 20
READ_BYTES = 1 << 18
#: Equal payloads of at least so many bytes are written once.
LEAST_SHARED = 100
#: A member's last byte is the high byte of its length, 0 up to 16 MB; larger
#: records are followed by this empty member, which readers pass over.
_EMPTY = zlib.compress(b"", 6, 31)

RECORDS = "type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary, archive string, offset long"
_RECORDS = pa.schema(
    [("type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_length", pa.int64()), ("payload", pa.binary()), ("archive", pa.string()), ("offset", pa.int64())]
)


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    data = packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()
    return data if data[-1] == 0 else data + _EMPTY


def record(kind: str, name: str, uri: str | None, payload: bytes | None, digest: str, length: int, refers_to: str | None) -> bytes:
    """A response or revisit record.  Revisits have HTTP headers only."""
    headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if uri is not None:
        headers.append(("WARC-Target-URI", quote(uri, safe="!#$%&'()*+,/:;=?@[]~")))
    if refers_to is not None:
        headers += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    headers += [("X-Payload-Length", str(length)), ("Content-Type", "application/http; msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    return _member(headers, http + (payload or b""))


def deduplicated(pages: DataFrame) -> DataFrame:
    """(name, uri, payload, digest, length, refers_to) of each page; refers_to
    is the smallest page_id with the payload where that isn't the page's own."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("uri"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("length", F.octet_length("payload").cast("long"))
    long = rows.filter(F.col("length") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL")
    # read back from a table, so that a hot digest can be split in the join
    shared = materialize(long.select(F.col("digest").alias("_digest"), "first"), "shared")
    joined = rows.join(shared, (F.col("digest") == F.col("_digest")) & (F.col("length") >= LEAST_SHARED), "left")
    return joined.select("page_id", "uri", "payload", "digest", "length", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str) -> None:
    """One record for each row of ``pages`` (page_id, url, html), in archives
    ``*.warc.gz`` under ``folder``, each beginning with a warcinfo record."""
    spark = pages.sparkSession

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:info>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
        held, size = [info[:-1]], len(info)
        begun = False
        for batch in batches:
            for row in range(batch.num_rows):
                page, uri, payload, digest, length, refers = (batch.column(i)[row].as_py() for i in range(6))
                kind = "response" if refers is None else "revisit"
                data = record(kind, "" if page is None else str(page), uri, payload if refers is None else None, digest, length, None if refers is None else str(refers))
                held.append(data[:-1])
                size += len(data)
                begun = True
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])
                    held, size = [], 0
        if begun and held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])

    members = deduplicated(pages).mapInArrow(pack, "value binary")
    members.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").text(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(path(folder)):
        name = status.getPath().getName()
        if name.startswith("part-"):
            files.rename(status.getPath(), path(folder, re.sub(r"\.txt$", "", name) + ".warc.gz"))


def _open(uri: str):
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return open(unquote(parsed.path), "rb")
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def _header(data: bytes) -> dict[str, str] | None:
    """Fields of a WARC header at the start of decoded data, else None."""
    head, sep, _ = data.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"WARC/1."):
        return None
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    return fields if fields.get("Content-Length", "").isdigit() and "WARC-Type" in fields else None


class _Source:
    """Random access to a file through a window of its bytes."""

    def __init__(self, file) -> None:
        self.file, self.at, self.data = file, 0, b""

    def from_(self, offset: int, least: int = 1) -> bytes:
        """Bytes from ``offset`` on, at least so many unless the file ends."""
        if not self.at <= offset <= self.at + len(self.data):
            self.at, self.data = offset, b""
        if self.at + len(self.data) - offset < least:
            self.file.seek(self.at + len(self.data))
            self.data = self.data[offset - self.at :] + self.file.read(max(READ_BYTES, least))
            self.at = offset
        return self.data[offset - self.at :]


def _is_record(source: _Source, at: int) -> bool:
    """Whether a member with a WARC header begins at ``at``: decoded until the
    header ends, however long it is, or until it can't be one."""
    unpacker, data, offset = zlib.decompressobj(31), bytearray(), at
    while True:
        piece = source.from_(offset)[:READ_BYTES]
        offset += len(piece)
        try:
            while piece:
                done = len(data)
                data += unpacker.decompress(piece, 1 << 16)
                piece = unpacker.unconsumed_tail
                if not data.startswith(b"WARC/1."[: len(data)]):
                    return False
                if data.find(b"\r\n\r\n", max(0, done - 3)) >= 0:
                    return _header(bytes(data)) is not None
                if unpacker.eof:
                    return False
        except zlib.error:
            return False
        if not source.from_(offset):
            return False


def records(file, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header, block) of the records that start in [start, end)."""
    source = _Source(file)
    at = start
    while at < end:
        window = source.from_(at, READ_BYTES)
        found = window.find(MAGIC)
        if found < 0:
            if len(window) < READ_BYTES:
                return
            at += len(window) - len(MAGIC) + 1
            continue
        at += found
        if at >= end:
            return
        if not _is_record(source, at):
            at += 1
            continue
        unpacker, parts, offset = zlib.decompressobj(31), [], at
        while not unpacker.eof:
            piece = source.from_(offset)
            if not piece:
                raise ValueError(f"archive ends inside the record at byte {at}")
            parts.append(unpacker.decompress(piece))
            offset += len(piece) - len(unpacker.unused_data)
        data = b"".join(parts)
        fields = _header(data)
        body = data.index(b"\r\n\r\n") + 4
        yield at, fields, data[body : body + int(fields["Content-Length"])]
        at = offset


def _payload(fields: dict[str, str], block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2] if fields.get("Content-Type", "").startswith("application/http") else block


def read(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of all ``*.warc.gz`` archives under ``folder`` (RECORDS)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "length").filter("length > 0")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    total = files.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // split_bytes))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _open(row["path"]) as file:
                    held, size = [], 0
                    for offset, fields, block in records(file, row["start"], min(row["length"], row["start"] + split_bytes)):
                        digest = fields.get("WARC-Payload-Digest", "")
                        held.append(
                            {
                                "type": fields["WARC-Type"],
                                "record_id": fields.get("WARC-Record-ID"),
                                "target_uri": fields.get("WARC-Target-URI"),
                                "refers_to": fields.get("WARC-Refers-To"),
                                "payload_digest": digest.removeprefix("sha256:") or None,
                                "payload_length": int(fields["X-Payload-Length"]) if fields.get("X-Payload-Length", "").isdigit() else None,
                                "payload": None if fields["WARC-Type"] == "revisit" else _payload(fields, block),
                                "archive": row["path"],
                                "offset": offset,
                            }
                        )
                        size += len(block)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=_RECORDS)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=_RECORDS)

    return ranges.repartition(tasks).mapInArrow(scan, RECORDS)


def roundtrip(pages: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Write every page as a record and read the archives back.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to,
    archive, offset.  Responses are measured on the payload that was read;
    revisits carry their payload's length and digest.  Null html is an empty
    payload, a null url no target; rows with a null page_id are never referred
    to by it, and rows that repeat the smallest page_id of a payload are all
    responses; other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    write(pages, folder)
    found = read(spark, folder, split_bytes).filter("type IN ('response', 'revisit')")
    response = F.col("type") == "response"

    def number(name: str):
        return F.regexp_extract(name, "^<urn:page:(-?[0-9]+)>$", 1)

    def as_long(name: str):
        return F.when(number(name) != "", number(name).cast("long"))

    return found.select(
        as_long("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        as_long("refers_to").alias("refers_to"),
        "archive",
        "offset",
    )

