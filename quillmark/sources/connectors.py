"""Sources and sinks: JSON lines, Parquet, text files, CSV, Markdown, XML."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_SAMPLE = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "text", "label", "source")] + [T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])
SUPPORTED = (".txt", ".pdf", ".docx")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One record a line; blank lines are passed over, NaN literals allowed."""
    reader = spark.read.option("allowNonNumericNumbers", "true")
    return (reader.schema(schema) if schema else reader).json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.select(*columns) if columns else rows


def write_parquet(rows: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    rows.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def read_texts(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(path, text) of whole text files; other kinds are an error."""
    if not pattern.endswith(".txt"):
        raise ValueError(f"unsupported kind of file: {pattern}")
    return spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _document_text(name: str, content: bytes) -> str:
    """Text of a file by its ending: UTF-8 text, or the paragraphs of a Word
    document.  PDF needs a library that isn't there."""
    import io
    import zipfile
    from xml.etree import ElementTree

    kind = name.lower().rpartition(".")[2]
    if kind == "txt":
        return content.decode("utf-8", "ignore")
    if kind == "docx":
        space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            root = ElementTree.fromstring(archive.read("word/document.xml"))
        return "\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))
    raise ValueError(f"unsupported kind of file: {name}")


def extract_text(files: DataFrame) -> DataFrame:
    """(path, text) of files (path, content), one batch of files at a time."""

    @F.arrow_udf("string")
    def text(paths, contents):
        import pyarrow as pa

        return pa.array([_document_text(p, c) for p, c in zip(paths.to_pylist(), contents.to_pylist(), strict=True)], pa.string())

    return files.select("path", text("path", "content").alias("text"))


def supported_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files of a folder that text can be taken from, by
    name; none if there is no such folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "path string, length long")
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return files.filter(F.rlike(F.lower("path"), F.lit(r"\.(txt|pdf|docx)$"))).orderBy("path")


def prompts(lines: DataFrame, column: str) -> DataFrame:
    """Stripped lines without blanks and comments."""
    stripped = lines.select(F.trim(column).alias("prompt"))
    return stripped.filter((F.col("prompt") != "") & ~F.startswith("prompt", F.lit("#")))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)


def markdown(rows: DataFrame) -> DataFrame:
    """A table's rows as Markdown lines (column ``line``)."""
    cells = F.concat(F.lit("| "), F.array_join(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in rows.columns)), " | "), F.lit(" |"))
    return rows.select(cells.alias("line"))


def oai_records(pages: DataFrame, column: str) -> DataFrame:
    """Identifier, status, language, date, type and URL of the records of saved
    harvest pages, and the token that the next page is asked for with (null at
    the end)."""
    record = "STRUCT<header: STRUCT<identifier: STRING, _status: STRING>, metadata: STRUCT<language: STRING, date: STRING, type: STRING, identifier: STRING>>"
    page = F.from_xml(F.col(column), f"ListRecords STRUCT<record: ARRAY<{record}>, resumptionToken: STRING>")
    listed = pages.select(page.alias("_page")).select(F.explode("_page.ListRecords.record").alias("r"), F.nullif("_page.ListRecords.resumptionToken", F.lit("")).alias("next_token"))
    return listed.select("r.header.identifier", F.col("r.header._status").alias("status"), "r.metadata.language", "r.metadata.date", "r.metadata.type", F.col("r.metadata.identifier").alias("url"), "next_token")


def oai_address(base: str, token: str | None) -> str:
    """Address of the first page of a harvest, or of the one a token names."""
    return f"{base}?verb=ListRecords&" + (f"resumptionToken={token}" if token else "metadataPrefix=oai_dc")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share."""
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="quillmark-")
    return f"{shared.rstrip('/')}/quillmark/{name}-{uuid.uuid4().hex}"


def roundtrip_jsonl(rows: DataFrame) -> DataFrame:
    path = scratch(rows.sparkSession, "jsonl")
    write_jsonl(rows, path)
    return read_jsonl(rows.sparkSession, path, rows.schema)
