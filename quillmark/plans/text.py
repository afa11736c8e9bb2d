"""Queries of sources (SRC) and text operators (TXT)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import annotate, arrays, cleaning
from quillmark.operators import language
from quillmark.operators import text as operators
from quillmark.operators.features import nonempty
from quillmark.plans.base import GENERATOR_SQL, SAMPLES_SQL, WORDS_SQL, query, r6, samples, table
from quillmark.sources import connectors


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("SELECT doc_id, lang, source FROM documents")
def src01_jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connectors.roundtrip_jsonl(_docs(spark, sf_dir).select("doc_id", "lang", "source"))


@query("SELECT doc_id, lang FROM documents WHERE lang = 'de'")
def src03_read_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connectors.read_parquet(spark, f"{sf_dir}/documents.parquet", ["doc_id", "lang"]).filter("lang = 'de'")


@query("SELECT doc_id, text, lang FROM documents")
def src02_write_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = connectors.scratch(spark, "written")
    rows = _docs(spark, sf_dir).select("doc_id", "text", "lang")
    connectors.write_jsonl(rows, path)
    return spark.read.text(path).select(F.from_json("value", rows.schema).alias("r")).select("r.*")


@query("SELECT doc_id, text, lang FROM documents")
def src04_write_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = connectors.scratch(spark, "written")
    connectors.write_parquet(_docs(spark, sf_dir).select("doc_id", "text", "lang"), path, ("lang",))
    return connectors.read_parquet(spark, path, ["doc_id", "text", "lang"])


@query("SELECT doc_id, replace(text, chr(13), '') AS text FROM documents WHERE text IS NOT NULL")
def src05_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as Word files, and their text back."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    @F.udf("binary")
    def word_file(text: str) -> bytes:
        space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        body = "".join(f"<w:p><w:r><w:t>{escape(line)}</w:t></w:r></w:p>" for line in text.replace("\r", "").split("\n"))
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as archive:
            archive.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>')
        return held.getvalue()

    files = _docs(spark, sf_dir).filter("text IS NOT NULL").select(F.format_string("%d.docx", "doc_id").alias("path"), word_file("text").alias("content"))
    return connectors.extract_text(files).select(F.regexp_extract("path", "[0-9]+", 0).cast("long").alias("doc_id"), "text")


@query("SELECT DISTINCT lang || '.txt' AS name FROM documents ORDER BY 1")
def src06_supported_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = connectors.scratch(spark, "files")
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for row in _docs(spark, sf_dir).select("lang").distinct().collect():  # a row for each language
        for name in (f"{row.lang}.txt", f"{row.lang}.csv"):
            held = files.create(spark._jvm.org.apache.hadoop.fs.Path(path, name))
            held.writeBytes(name)
            held.close()
    return connectors.supported_files(spark, path).select(F.regexp_extract("path", "[^/]+$", 0).alias("name"))


#: Pages of a harvest made of the pages table: ten records each, the number of
#: the next page as token, none on the last.
@query("""WITH p AS (SELECT page_id, url, page_id // 10 AS n FROM pages) SELECT 'oai:' || page_id AS identifier, CASE WHEN page_id % 7 = 0 THEN 'deleted' END AS status, 'tr' AS language, url,
 CASE WHEN n < (SELECT max(n) FROM p) THEN CAST(n + 1 AS VARCHAR) END AS next_token FROM p""")
def src11_harvest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.floor(F.col("page_id") / 10).alias("n"))
    last = p.agg(F.max("n").alias("last"))
    safe = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    status = F.when(F.col("page_id") % 7 == 0, ' status="deleted"').otherwise("")
    record = F.concat(F.lit("<record><header"), status, F.lit("><identifier>oai:"), F.col("page_id").cast("string"), F.lit("</identifier></header><metadata><language>tr</language><identifier>"), safe, F.lit("</identifier></metadata></record>"))
    token = F.when(F.col("n") < F.col("last"), (F.col("n") + 1).cast("string")).otherwise("")
    pages = p.groupBy("n").agg(F.array_join(F.collect_list(record), "").alias("records")).crossJoin(F.broadcast(last))  # ten records a page; one row
    saved = pages.select(F.concat(F.lit("<OAI-PMH><ListRecords>"), "records", F.lit("<resumptionToken>"), token, F.lit("</resumptionToken></ListRecords></OAI-PMH>")).alias("xml"))
    return connectors.oai_records(saved, "xml").select("identifier", "status", "language", "url", "next_token")


@query("SELECT '| ' || lang || ' | ' || count(*) || ' |' AS line FROM documents GROUP BY lang")
def src21_markdown_and_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = connectors.scratch(spark, "table")
    connectors.write_csv(_docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n")), path)
    return connectors.markdown(spark.read.option("header", "true").csv(path))


#: Oracle form of chunking by sentence packing over pieces without look-behind.
@query()
def src07_collect_from_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.collected(_docs(spark, sf_dir).select(F.col("source").alias("path"), "doc_id", "text"), "manual_corpus", 30, 850, 200)


@query(f"SELECT doc_id, CAST(len({WORDS_SQL}) AS BIGINT) AS n_words FROM documents WHERE len({WORDS_SQL}) >= 30 ORDER BY doc_id LIMIT 50")
def src09_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", arrays.word_count(F.col("text")).cast("long").alias("n_words"))
    return d.filter("n_words >= 30").orderBy("doc_id").limit(50)


@query("SELECT page_id, 'wikipedia_tr_' || lpad(CAST(page_id AS VARCHAR), 5, '0') || CASE WHEN s = '' THEN '' ELSE '_' || s END || '.txt' AS file_name FROM (SELECT page_id, substring(regexp_replace(regexp_replace(url, '[^a-zA-Z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 60) AS s FROM pages)")
def src10_safe_file_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", cleaning.slug(F.col("url"), F.col("page_id")).alias("file_name"))


@query(r"""WITH c AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/]+)/', 1) AS host, regexp_extract(url, '/([a-z]{2})/', 1) AS lang, regexp_extract(url, '/([0-9]+)', 1) AS year FROM pages)
 SELECT page_id, coalesce(nullif(host, ''), 'unknown') AS journal, year FROM c WHERE lang = 'en' AND year <> '' AND CAST(year AS INTEGER) <= 500""")
def src12_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.candidates(table(spark, sf_dir, "pages"), "en", 500)


@query('''SELECT page_id, split_part(split_part(url, '/en/', 1), '/tr/', 1) || '/en/' || regexp_extract(html, '/[A-Z][a-z]+', 0) AS link FROM pages WHERE regexp_matches(html, '/[A-Z][a-z]+')''')
def src13_first_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.first_link(table(spark, sf_dir, "pages"), r"/[A-Z][a-z]+")


@query(r"SELECT split_part(sample_id, '_', 1) AS kind, max(CAST(regexp_extract(sample_id, '_(\d+)$', 1) AS BIGINT)) + 1 AS next_id, count(DISTINCT source) AS sources FROM samples GROUP BY 1".replace("SELECT split", f"WITH {SAMPLES_SQL} SELECT split", 1))
def src17_next_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.next_ids(samples(spark, sf_dir))


@query(r"SELECT DISTINCT trim(line) AS prompt FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark) WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')")
def src18_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "\n")).alias("line"))
    return connectors.prompts(lines, "line").distinct()


@query("SELECT doc_id, md5('berturk' || chr(31) || 'mean' || chr(31) || text) AS cache_key FROM documents WHERE doc_id % 2 = 1 AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0)")
def src20_embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", operators.cache_key("berturk", "mean", F.col("text")).alias("cache_key"))
    return d.filter("doc_id % 2 = 1").join(d.filter("doc_id % 2 = 0"), "cache_key", "left_anti").select("doc_id", "cache_key")


_CLEAN_SQL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(65279), ''), chr(0), ''), '[\x01-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '-\n([a-zA-ZğüşıöçĞÜŞİÖÇ])', '\1', 'g'), '^\s+|\s+$', '', 'g')"


@query(f"SELECT doc_id, md5({_CLEAN_SQL}) AS cleaned_md5 FROM documents")
def txt01_remove_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(cleaning.without_noise(F.col("text"))).alias("cleaned_md5"))


@query()
def txt01_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", cleaning.clean_text(F.col("text")).alias("cleaned_text"))


@query(f"SELECT doc_id, CAST(len({WORDS_SQL}) AS BIGINT) AS n_words FROM documents")
def txt02_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", arrays.word_count(F.col("text")).cast("long").alias("n_words"))


@query(f"SELECT doc_id FROM documents WHERE len({WORDS_SQL}) >= 0.5 * 30")
def txt03_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).filter(arrays.word_count(F.col("text")) >= 0.5 * 30).select("doc_id")


_TRUNC = rf"""WITH w AS (SELECT doc_id, CASE WHEN len({WORDS_SQL}) > 500 THEN array_to_string(list_slice({WORDS_SQL}, 1, 500), ' ') ELSE text END AS cut FROM documents),
 s AS (SELECT doc_id, i, parts[i] AS sent, list_filter(regexp_split_to_array(parts[i], '\s+'), lambda w: w <> '') AS sw FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(cut, '. ') AS parts FROM w))),
 p AS (SELECT doc_id, i, 0 AS j, sent AS piece FROM s WHERE len(sw) <= 100 UNION ALL SELECT doc_id, i, j, array_to_string(list_slice(sw, j + 1, j + 100), ' ') AS piece FROM (SELECT doc_id, i, sw, unnest(range(0, len(sw), 100)) AS j FROM s WHERE len(sw) > 100))
 SELECT doc_id, md5(string_agg(piece, '. ' ORDER BY i, j)) AS truncated_md5 FROM p GROUP BY 1"""


@query(_TRUNC)
def txt04_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(cleaning.truncated(F.col("text"))).alias("truncated_md5"))


@query(f"SELECT doc_id FROM documents WHERE len({WORDS_SQL}) BETWEEN 30 AND 850")
def txt05_length_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).filter(arrays.word_count(F.col("text")).between(30, 850)).select("doc_id")


@query()
def txt06_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.annotated(_docs(spark, sf_dir)).select("doc_id", "sentences", "tokens", "pos_tags", "dep_parse")


@query()
def txt07_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txt06_analyze(spark, sf_dir).select("doc_id", F.size("sentences").alias("n_sentences"), F.size("tokens").alias("n_tokens"), "pos_tags")


@query(r"SELECT doc_id, CAST(len(list_filter(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda x: regexp_matches(x, '\S'))) AS BIGINT) AS n_pieces FROM documents")
def txt08_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = F.filter(F.regexp_extract_all("text", F.lit(r"[^.!?]+[.!?]*"), F.lit(0)), lambda x: F.rlike(x, F.lit(r"\S")))
    return _docs(spark, sf_dir).select("doc_id", F.size(pieces).cast("long").alias("n_pieces"))


@query()
def txt08_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", arrays.sentences(F.col("text")).alias("sentences"))


@query()
def txt09_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(cleaning.chunks(F.col("text"), 30, 850)).alias("pos", "chunk"))


@query()
def txt10_rechunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.rechunked(samples(spark, sf_dir).filter("label = 'human'"), 30, 850)


@query()
def txt11_translation_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = _docs(spark, sf_dir).select("doc_id", cleaning.translation_pieces(F.col("text"), 80).alias("pieces"))
    return nonempty(pieces, "pieces").select("doc_id", F.posexplode("pieces").alias("pos", "piece"))


_CJK = "len(regexp_extract_all(text, '[一-鿿぀-ヿ가-퟿]'))"


@query(f"SELECT doc_id, round(CASE WHEN length(text) = 0 THEN 0 ELSE {_CJK} / length(text) END, 6) AS cjk_ratio FROM documents")
def txt12_cjk_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", r6(cleaning.cjk_ratio(F.col("text"))).alias("cjk_ratio"))


@query(f"WITH {SAMPLES_SQL}, bad AS (SELECT sample_id FROM samples WHERE contains(text, '|')), cjk AS (SELECT sample_id FROM samples WHERE length(text) > 0 AND {_CJK} / length(text) > 0.01) SELECT sample_id, CASE WHEN sample_id IN (SELECT sample_id FROM bad) OR original_id IN (SELECT sample_id FROM bad) THEN true ELSE false END AS rejected, CASE WHEN sample_id IN (SELECT sample_id FROM cjk) OR original_id IN (SELECT sample_id FROM cjk) THEN true ELSE false END AS cjk_rejected FROM samples")
def txt13_cascading_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the CJK share, and by a sign that the tables do have."""
    by_sign = operators.cascading_filter(samples(spark, sf_dir), F.contains("text", F.lit("|"))).withColumnRenamed("rejected", "by_sign")
    found = operators.cascading_filter(by_sign, cleaning.cjk_ratio(F.col("text")) > 0.01)
    return found.select("sample_id", F.col("by_sign").alias("rejected"), F.col("rejected").alias("cjk_rejected"))


_ASCII_WORDS = "regexp_extract_all(lower(text), '[a-z]+')"


@query(f"SELECT doc_id, round(CASE WHEN len({_ASCII_WORDS}) < 30 THEN 0 ELSE len(list_filter({_ASCII_WORDS}, lambda w: w IN ('the', 'of', 'and', 'to', 'in'))) / len({_ASCII_WORDS}) END, 6) AS validity FROM documents")
def txt14_validity_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return d.select("doc_id", r6(operators.ascii_validity(F.col("text"), ("the", "of", "and", "to", "in"))).alias("validity"))


@query()
def txt14_turkish_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", cleaning.validity_ratio(F.col("text")).alias("validity"))


#: Profiles come from the labels of four documents in five, and name all.
_LANG = rf"""WITH x AS (SELECT doc_id, lang, source, string_split(' ' || regexp_replace(translate(text, '{language.UPPER}', '{language.LOWER}'), '[\x09-\x0D\x20]+', ' ', 'g') || ' ', '') AS x FROM documents WHERE text IS NOT NULL),
 c AS (SELECT doc_id, any_value(lang) AS lang, g, count(*) AS c FROM (SELECT doc_id, lang, x[i] || x[i + 1] || x[i + 2] AS g FROM (SELECT doc_id, lang, x, unnest(range(1, len(x) - 1)) AS i FROM x WHERE len(x) >= 3)) GROUP BY doc_id, g),
 m AS (SELECT lang, g, sum(c) AS c FROM c WHERE doc_id % 5 <> 0 AND lang IS NOT NULL GROUP BY 1, 2), tot AS (SELECT lang, sum(c) AS t FROM m GROUP BY 1), p AS (SELECT lang, g, c FROM m QUALIFY row_number() OVER (PARTITION BY lang ORDER BY c DESC, g) <= {language.PROFILE}),
 n AS (SELECT doc_id, sum(c) AS n FROM c GROUP BY 1), s AS (SELECT c.doc_id, tot.lang, sum(c.c * coalesce(ln(p.c + 1), 0)) / any_value(n.n) - ln(any_value(t) + {language.PROFILE}) AS score FROM c CROSS JOIN tot LEFT JOIN p ON p.lang = tot.lang AND p.g = c.g JOIN n ON n.doc_id = c.doc_id GROUP BY 1, 2),
 det AS (SELECT doc_id, lang AS detected_lang FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, lang) = 1), d AS (SELECT documents.doc_id, source, detected_lang FROM documents LEFT JOIN det USING (doc_id))"""


def _profiles(spark: SparkSession, sf_dir: str) -> language.Profiles:
    return language.Profiles(_docs(spark, sf_dir).filter("doc_id % 5 <> 0").select("lang", "text"))


@query(_LANG + " SELECT doc_id, lang, round(score, 6) AS score FROM s")
def txt15_language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = _profiles(spark, sf_dir)
    every = F.array(*(F.struct(F.lit(lang).alias("lang"), r6(F.col(f"score_{i}")).alias("score")) for i, lang in enumerate(profiles.languages)))
    return profiles.scored(_docs(spark, sf_dir), "doc_id").select("doc_id", F.explode(every).alias("s")).select("doc_id", "s.lang", "s.score")


@query(_LANG + " SELECT doc_id, coalesce(detected_lang = 'de', false) AS is_language FROM d")
def txt15_is_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the text alone; the column ``lang`` only labels the training texts."""
    named = _profiles(spark, sf_dir).detected(_docs(spark, sf_dir), "doc_id")
    return named.select("doc_id", F.coalesce(F.col("detected_lang") == "de", F.lit(False)).alias("is_language"))


_BIB = r"CASE WHEN len(lines) = 0 THEN 0 ELSE len(list_filter(lines, lambda x: regexp_matches(x, '\(\d{4}\)|\d{4}\)\.|pp\.\s*\d|ss\.\s*\d'))) / len(lines) END"
_LINES = r"l AS (SELECT doc_id, text, lang, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')) AS lines FROM documents)"


@query(f"WITH {_LINES} SELECT doc_id, round({_BIB}, 6) AS bibliography_ratio FROM l")
def txt16_bibliography_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", r6(cleaning.bibliography_ratio(F.col("text"))).alias("bibliography_ratio"))


@query()
def txt17_looks_like_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", cleaning.looks_like_header(F.col("text"), F.col("lang") == "en").alias("header"))


@query("WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) SELECT doc_id, source FROM r WHERE rn <= 3 ORDER BY md5(CAST(doc_id AS VARCHAR) || '42') LIMIT 25")
def txt18_short_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.short_sample(_docs(spark, sf_dir), "source", "doc_id", 3, 25).select("doc_id", "source")


@query(f"""WITH d AS (SELECT *, len({WORDS_SQL}) AS n FROM documents) SELECT count(*) AS docs, count(*) FILTER (lang <> 'en') AS other_language, min(n) AS min_words, max(n) AS max_words, round(avg(n), 6) AS avg_words,
 CAST((SELECT sum(k) FROM (SELECT count(*) AS k FROM documents GROUP BY substring(text, 1, 200) HAVING count(*) > 1)) AS BIGINT) AS repeated FROM d""")
def txt19_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.quality_report(_docs(spark, sf_dir), "en")


@query(_LANG + " SELECT source, detected_lang, count(*) AS n, count(*) FILTER (detected_lang = 'en') AS kept FROM d GROUP BY 1, 2")
def txt20_language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _docs(spark, sf_dir).select("doc_id", "source").join(_profiles(spark, sf_dir).detected(_docs(spark, sf_dir), "doc_id"), "doc_id")
    return operators.language_report(named, "en")


@query()
def txt21_target_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", operators.target_words(1750, 487, 100, 2000, 42).alias("target_words"))


@query("SELECT item_id, text || ' (' || CAST(100 + item_id % 50 AS VARCHAR) || ' words)' AS prompt FROM benchmark")
def txt22_length_instruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.format_string("%s (%d words)", "text", F.lit(100) + F.col("item_id") % 50).alias("prompt"))


@query(f"WITH {SAMPLES_SQL} SELECT sample_id, {GENERATOR_SQL} AS generator FROM samples")
def txt23_infer_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("sample_id", cleaning.generator(F.col("sample_id")).alias("generator"))
