"""Queries of the training-data operators: each applies one operator, with
production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import ann, licenses, pii, quality, secrets, toxicity, warc
from quillmark.llm.common import read_table
from quillmark.llm.decontamination import SLOP, contamination
from quillmark.llm.importance import resample
from quillmark.llm.ngram_join import near_duplicates
from quillmark.llm.packing import pack
from quillmark.llm.repeats import without_repeats
from quillmark.llm.search import search


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), size=4, percent=85).drop("n_copies")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), slop=SLOP)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(read_table(spark, sf_dir, "pages")).drop("archive", "offset")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(read_table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the tables are made up; real ones need a secret in the session's configuration
    return pii.pseudonymise(read_table(spark, sf_dir, "documents"), spark.conf.get("spark.quillmark.pii.key", "key of the test tables"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=50)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), percent=25, min_words=20, seed=7)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(read_table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_warc, op2_ngram_join, op3_quality, op4_toxicity, op5_licenses, op6_pii, op7_packing, op8_decontamination, op9_secrets, op10_ann, op11_lexical_search, op12_importance_resampling, op13_substring_dedup)
}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = rf"regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+')"
_SIGNLESS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP1 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS n, sha256(h) AS d, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM q"""

_OP2 = f"""WITH RECURSIVE w AS (SELECT doc_id, {_SPACED} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
g AS (SELECT doc_id, unnest(s) AS g FROM s),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * c >= 85 * (len(a.s) + len(b.s) - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.c = e.x),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM s JOIN m USING (doc_id)"""

_OP8 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SIGNLESS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SIGNLESS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT DISTINCT item, k, w[i:i + k - 1] AS ws FROM (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, i, k, w[i:i + k - 1] AS ws FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
occ AS (SELECT r, i, k, ws FROM dw WHERE ws IN (SELECT ws FROM win)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM occ) GROUP BY 1),
items AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM occ JOIN win USING (ws) GROUP BY 1),
dp AS (SELECT r, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d), totals AS (SELECT t, count(*) AS c FROM dp GROUP BY 1),
wt AS (SELECT ws, unnest(ws) AS t, unnest(range(len(ws))) AS place FROM (SELECT DISTINCT ws FROM win)),
rare AS (SELECT ws, arg_min(t, coalesce(c, 0) * 1000 + place) AS t FROM wt LEFT JOIN totals USING (t) GROUP BY 1),
near AS (SELECT DISTINCT dp.r, rare.ws FROM rare JOIN dp USING (t) JOIN d ON d.r = dp.r WHERE list_has_all(d.w[greatest(dp.p - {SLOP}, 1):dp.p + {SLOP}], rare.ws)),
close AS (SELECT r, count(DISTINCT item) AS near_items FROM near JOIN win USING (ws) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(near_items, 0) AS near_items
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r) LEFT JOIN close USING (r)"""

_OP11 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SIGNLESS} AS w FROM documents),
size AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest({_SIGNLESS}) AS t FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT r, doc_id, t, count(*) AS tf, any_value(k) AS k FROM (SELECT r, doc_id, len(w) AS k, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, doc_id, t),
df AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, size GROUP BY t, n),
s AS (SELECT item_id, r, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * k * n) // l)))) AS BIGINT) AS score FROM q JOIN p USING (t) JOIN df USING (t), size GROUP BY item_id, r)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM s WHERE score > 0) WHERE k <= 50"""

_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x) + 1, 2), lambda i: (strpos('0123456789ABCDEF', x[i:i]) - 1) * 16 + strpos('0123456789ABCDEF', x[i + 1:i + 1]) - 1)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))"
_OP12 = f"""WITH tab AS (SELECT list_transform(range(256), lambda v: list_reduce(list_prepend(v, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
w AS (SELECT row_number() OVER () AS r, doc_id, {_SIGNLESS} AS w FROM documents), b AS (SELECT {_SIGNLESS} AS w FROM benchmark),
f AS (SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
fb AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b),
h AS (SELECT f, xor({_CRC}, 4294967295) % 10000 AS bucket FROM (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM f UNION SELECT f FROM fb)), tab),
s AS (SELECT bucket, count(*) AS s FROM f JOIN h USING (f) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM fb JOIN h USING (f) GROUP BY 1),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * ((SELECT count(*) FROM f) + 10000) AS DOUBLE) / CAST((coalesce(s, 0) + 1) * ((SELECT count(*) FROM fb) + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket)),
d AS (SELECT r, count(*) AS n, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM f JOIN h USING (f) JOIN g USING (bucket) GROUP BY 1),
u AS (SELECT *, ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h FROM w),
sc AS (SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM u LEFT JOIN d USING (r)),
k AS (SELECT doc_id, n_words, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS n FROM sc WHERE n_words >= 20)
SELECT sc.doc_id, n_features, weight, score, CASE WHEN k <= 25 * n // 100 THEN k END AS rank FROM sc LEFT JOIN k ON k.doc_id = sc.doc_id"""
_OP13 = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13 AND doc_id IS NOT NULL)),
first AS (SELECT g, min(doc_id) AS lo FROM g GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM g JOIN first USING (g) WHERE lo < doc_id),
kept AS (SELECT r, count(gone.p) AS n, string_agg(t, ' ' ORDER BY p) FILTER (gone.p IS NULL) AS k FROM (SELECT r, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d) LEFT JOIN gone USING (r, p) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""

#: Models, compression, keyed pseudonyms, entropy windows, packing and
#: approximate search have no SQL form; tests hold them against brute force,
#: exact round trips or held-out accuracy.
ORACLES: dict[str, str] = {"op1_warc": _OP1, "op2_ngram_join": _OP2, "op8_decontamination": _OP8, "op11_lexical_search": _OP11, "op12_importance_resampling": _OP12, "op13_substring_dedup": _OP13}
