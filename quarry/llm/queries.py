"""The thin queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, compaction, decontaminate, jaccard, langid, licenses, media, packing, toxicity, warc
from .shared import fresh_path, table


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.captures_of_pages(table(spark, sf_dir, "pages")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws(": ", e["key"], e["value"])))
    return found.select(
        "record_id", "url_key", "status", F.coalesce("resolved_id", F.lit(-1)).alias("resolved_id"), F.array_join(lines, "; ").alias("header_lines"),
        F.coalesce(F.md5("payload"), F.lit("")).alias("payload_md5"), F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long").alias("payload_bytes"),
    )


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stored = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), media.text_image(F.col("text")).alias("media"))
    read = media.media_tiles(stored)
    return read.select(
        "doc_id", "n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, octet_length(samples) - 63, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat("dhash", F.lit("-"), F.sha2("tile", 256)).alias("feature"),
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), usable=~held_out)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(0, 2, 1, 1).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("<|im_end|><|im_start|>assistant ok").alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.read_back(chat.format_windows(rows, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), in_order=True)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = compaction.ShardStore(spark, fresh_path(spark, "shards"))
    docs = table(spark, sf_dir, "documents")
    store.append(docs.withColumn("arrival", compaction.arrival_of("source")), arrival_col="arrival", rows_per_shard=2000)
    store.compact()
    store.vacuum(keep=0)  # nobody else reads this store
    return store.read().select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.licences(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_matches", F.array_join("licences", ",").alias("licences"), "best", F.round("best_dice", 6).alias("best_dice"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.train(docs, public_tokenizers.path("piece_bpe_32k.model"), usable=~held_out)
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_revisits": op1_warc_revisits,
    "op2_media_columns": op2_media_columns,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_toxicity": op4_toxicity,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_sharding": op6_sharding,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_license_scans": op8_license_scans,
    "op9_language_id": op9_language_id,
    "op10_decontaminate": op10_decontaminate,
}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_TEMPLATES = ", ".join(f"({_text(name)}, {_text(text)})" for name, text in sorted(licenses.TEMPLATES.items()))
_PAIRS = "list_distinct(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))"
_SITE = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?]*)"

ORACLES: dict[str, str] = {
    "op1_warc_revisits": rf"""
WITH p AS (SELECT page_id, url, html, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag, 'bytes-' || octet_length(encode(coalesce(html, ''))) AS dated,
  octet_length(encode(coalesce(html, ''))) AS n, regexp_replace(url, '#.*$', '') AS whole FROM pages),
q AS (SELECT *, regexp_replace(lower(regexp_extract(whole, '{_SITE}', 1)), '^www\.|:(80|443)$', '') AS host, regexp_replace(whole, '{_SITE}', '') AS rest FROM p),
r AS (SELECT *, regexp_replace(regexp_extract(rest, '^[^?]*', 0), '/+$', '') AS path,
  array_to_string(list_sort(list_filter(string_split(regexp_replace(rest, '^[^?]*[?]?', ''), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{warc.TRACKING}'))), '&') AS params FROM q),
k AS (SELECT *, host || path || CASE WHEN params <> '' THEN '?' || params ELSE '' END AS url_key FROM r),
f AS (SELECT page_id * 2 AS record_id, url_key, page_id * 2 AS ts, tag, dated, html FROM k),
v AS (SELECT page_id * 2 + 1 AS record_id, page_id, url_key, page_id * 2 + n AS ts, dated,
  CASE WHEN contains(url, '#') THEN 'W/' || tag WHEN contains(url, '?') THEN NULL ELSE tag END AS etag FROM k),
j AS (SELECT v.*, f.record_id AS prior, f.tag AS ptag, f.dated AS pdated, f.html AS phtml,
  row_number() OVER (PARTITION BY v.record_id ORDER BY f.ts DESC, f.record_id DESC) AS rn
  FROM v LEFT JOIN f ON f.url_key = v.url_key AND (f.ts < v.ts OR (f.ts = v.ts AND f.record_id < v.record_id))),
s AS (SELECT *, CASE WHEN prior IS NULL THEN 'no_prior' WHEN CASE WHEN etag IS NOT NULL THEN regexp_replace(etag, '^W/', '') = ptag ELSE dated = pdated END THEN 'resolved' ELSE 'mismatch' END AS status FROM j WHERE rn = 1)
SELECT record_id, url_key, status, CASE WHEN status = 'resolved' THEN prior ELSE -1 END AS resolved_id,
  array_to_string(list_sort(list_filter([CASE WHEN etag IS NOT NULL THEN 'etag: ' || etag WHEN status = 'resolved' THEN 'etag: ' || ptag END, 'last-modified: ' || dated, 'cache-control: max-age=' || page_id,
    CASE WHEN status = 'resolved' THEN 'server: origin' ELSE 'server: edge' END, CASE WHEN status = 'resolved' THEN 'content-type: text/html' ELSE 'content-length: 0' END], lambda x: x IS NOT NULL)), '; ') AS header_lines,
  CASE WHEN status = 'resolved' THEN coalesce(md5(phtml), '') ELSE '' END AS payload_md5, CASE WHEN status = 'resolved' THEN CAST(coalesce(octet_length(encode(phtml)), 0) AS BIGINT) ELSE 0 END AS payload_bytes
FROM s""",
    "op6_sharding": "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents",
    "op8_license_scans": f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS unit, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE text IS NOT NULL),
u AS (SELECT * FROM l UNION ALL SELECT doc_id, text, 0 FROM documents WHERE contains(text, chr(10))),
w AS (SELECT doc_id, line, string_split(trim(regexp_replace(lower(unit), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM u),
b AS (SELECT doc_id, line, own, len(own) AS n FROM (SELECT doc_id, line, {_PAIRS} AS own FROM w) WHERE len(own) BETWEEN 1 AND 400),
t AS (SELECT template, own AS other, len(own) AS m FROM (SELECT template, {_PAIRS} AS own FROM (SELECT template, string_split(trim(regexp_replace(lower(body), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM (VALUES {_TEMPLATES}) AS x(template, body))) WHERE len(own) > 0),
c AS (SELECT doc_id, line, template, n, m, count(*) AS common FROM (SELECT doc_id, line, n, unnest(own) AS g FROM b) JOIN (SELECT template, m, unnest(other) AS g FROM t) USING (g) GROUP BY ALL),
d AS (SELECT doc_id, line, template, 2 * common / (n + m) AS dice FROM c WHERE 2 * common / (n + m) >= {licenses.THRESHOLD} - 1e-12),
a AS (SELECT doc_id, count(*) AS n_matches, string_agg(DISTINCT template, ',' ORDER BY template) AS licences, arg_min(template, (-dice, template)) AS best, max(dice) AS best_dice FROM d GROUP BY 1)
SELECT doc_id, coalesce(n_matches, 0) AS n_matches, coalesce(licences, '') AS licences, best, round(coalesce(best_dice, 0.0), 6) AS best_dice FROM documents LEFT JOIN a USING (doc_id)""",
    "op10_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least(13, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[p + 1 : p + k], ' ') AS win FROM (SELECT *, unnest(range(0, len(w) - k + 1)) AS p FROM i)),
dw AS (SELECT doc_id, p, k, array_to_string(w[p + 1 : p + k], ' ') AS win
       FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)),
h AS (SELECT doc_id, p, dw.k AS k, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.win = iw.win),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS pos FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
}
