"""Queries of sources, sinks, benchmark rows and the research flow, over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as o
from .functions import text as tx
from .operators import bench, evidence, ingest, verify
from .plans import dialogue, research
from .queries import _articles, register, table
from .sources import articles as src
from .sources import packs
from .storage import fresh

# sources: what a reader gives for a table that is written first


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return rows.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("title"), "text", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("u"), F.col("doc_id").cast("string"))).alias("url"), "lang")


def _read(rows: DataFrame) -> DataFrame:
    return rows.select("title", "url", F.size("paras").alias("n_paras"), F.md5(F.array_join("paras", "|")).alias("digest"))


_READ = f"""WITH d AS (SELECT doc_id, {o.paragraphs("coalesce(text, '')")} AS p FROM documents)
SELECT 'd' || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN 'u' || doc_id END AS url, CAST(len(p) AS INT) AS n_paras, md5(array_to_string(p, '|')) AS digest FROM d"""


@register(_READ)
def source_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "corpus")
    _corpus(spark, sf_dir).write.parquet(path)
    return _read(src.read_parquet_articles(spark, src.expand(spark, [f"{path}/*.parquet"])))


@register(_READ)
def source_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "corpus")
    _corpus(spark, sf_dir).write.json(path)
    return _read(src.read_jsonl_articles(spark, path))


@register("SELECT 'q' || item_id AS id, text AS question, item_id % 3 = 0 AS expect_abstain FROM benchmark")
def source_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "questions")
    rows = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("id"), F.col("text").alias("question"), (F.col("item_id") % 3 == 0).alias("expect_abstain"))
    rows.select(F.explode(F.array(F.lit("// a note"), F.lit("  "), F.to_json(F.struct("id", "question", "expect_abstain")))).alias("value")).write.text(path)
    return src.read_questions(spark, path).select("id", "question", "expect_abstain")


@register("SELECT CAST(event_id AS VARCHAR) AS id, event_type AS category, value > 50 AS answer_match, CAST(floor(value) AS BIGINT) AS total_ms, 0 AS claims_checkable, 0 AS n_sources FROM events")
def source_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "results")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("category"), (F.col("value") > 50).alias("answer_match"), F.floor("value").alias("total_ms"))
    bench._filled(rows).write.json(path)
    return src.read_results(spark, path, bench.RESULT).select("id", "category", "answer_match", "total_ms", "claims_checkable", F.size("sources").alias("n_sources"))


@register(f"""WITH {o.PASSAGES} SELECT doc_id, count(*) AS n, CAST(sum(len(body)) AS BIGINT) AS chars FROM ps WHERE ord < 3 GROUP BY 1""")
def pack_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "pack")
    packs.write_passages(_articles(spark, sf_dir), path)
    return packs.sql(spark, path, "SELECT doc_id, count(*) AS n, sum(length(text)) AS chars FROM {chunks} WHERE ord < :most GROUP BY doc_id", most=3)


@register(f"""WITH {o.PASSAGES}, tk AS (SELECT chunk_id, unnest({o.index_tokens("title")}) AS word, 6.0 AS weight FROM ps UNION ALL SELECT chunk_id, unnest({o.index_tokens("body")}), 1.0 FROM ps), vocab AS (SELECT word FROM tk), {o.stem_sql("vocab")}
SELECT stem AS term, count(DISTINCT chunk_id) AS n, sum(weight) AS freq FROM tk JOIN stems USING (word) GROUP BY 1""")
def pack_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "pack")
    packs.write_passages(_articles(spark, sf_dir), path)
    return spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.count("*").alias("n"), F.sum("freq").alias("freq"))


@register(f"WITH {o.PASSAGES} SELECT chunk_id, row_number() OVER (ORDER BY doc_id, ord) AS id FROM ps")
def dense_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.dense_ids(ingest.passages(_articles(spark, sf_dir)).select("chunk_id", "doc_id", "ord"), ["doc_id", "ord"]).select("chunk_id", "id")


# text


@register("SELECT doc_id, CAST(floor((len(coalesce(text, '')) + 3) / 4) AS INT) AS tokens FROM documents")
def estimated_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.estimate_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))


@register(rf"""SELECT item_id, CASE WHEN len({o.words("text")}) > 0 THEN '"' || array_to_string({o.words("text")}, ' ') || '"' END AS phrase,
  array_to_string(list_transform({o.distinct_in_order(o.content("text"))}, lambda x: '"' || x || '"'), ' OR ') AS any_term FROM benchmark""")
def match_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", tx.match_phrase(F.col("text")).alias("phrase"), tx.match_terms(tx.content_words(F.col("text")), "OR").alias("any_term"))


@register("SELECT conv_id, turn, md5(trim(coalesce(text, ''))) AS plain FROM conversations")
def citations_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = F.concat(F.coalesce("text", F.lit("")), F.lit(" ["), F.col("turn").cast("string"), F.lit("] [2, 4–6]"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(tx.strip_citations(cited)).alias("plain"))


@register("SELECT doc_id, '[' || doc_id || '] ' || source || CASE WHEN lang <> 'en' THEN ' — ' || lang ELSE '' END || chr(10) || substr(text, 1, 50) AS shown FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def evidence_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").filter("lang is not null and source is not null")
    return rows.select("doc_id", tx.render_evidence(F.col("doc_id"), F.col("source"), F.when(F.col("lang") != "en", F.col("lang")), F.substring("text", 1, 50)).alias("shown"))


@register("""SELECT l_orderkey, l_linenumber, CASE WHEN m < 1000 THEN CAST(CAST(m AS BIGINT) AS VARCHAR) || ' ms' ELSE printf('%.1f s', m / 1000.0) END AS took,
  CASE WHEN b >= 1073741824 THEN printf('%.2f GB', b / 1073741824.0) WHEN b >= 1048576 THEN printf('%.0f MB', b / 1048576.0) ELSE printf('%.0f KB', b / 1024.0) END AS size
FROM (SELECT l_orderkey, l_linenumber, l_partkey * 10 + 3 AS m, CAST(l_partkey AS DOUBLE) * l_suppkey * 1001 + 0.37 AS b FROM lineitem)""")
def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("l_partkey").cast("double") * F.col("l_suppkey") * 1001 + F.lit(0.37)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tx.format_ms(F.col("l_partkey") * 10 + 3).alias("took"), tx.format_bytes(size).alias("size"))


# the flow around retrieval


@register("""WITH a AS (SELECT conv_id, list(substr(text, 1, 12) ORDER BY turn) AS a FROM conversations WHERE role = 'assistant' AND trim(text) <> '' GROUP BY 1)
SELECT conv_id, regexp_replace(replace(CASE WHEN len(a) > 1 THEN replace('Who met #1 near #2 or #3?', '#1', a[1]) ELSE replace('Who met #1 near #2 or #3?', '#1', a[1]) END, '#2', coalesce(a[2], '#2')), '#\\d', 'it', 'g') AS question FROM a""")
def hop_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter("role = 'assistant' and trim(text) <> ''")
    by = rows.groupBy("conv_id").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("turn", F.substring("text", 1, 12).alias("a")))), 1, 2), lambda x: x["a"]).alias("a"))
    return by.select("conv_id", research.substitute(F.lit("Who met #1 near #2 or #3?"), F.col("a")).alias("question"))


_STEMMED = "vocab AS (SELECT DISTINCT unnest({}) AS word FROM {}), {}, mp AS (SELECT map(list(word), list(stem)) AS sx FROM stems)"


@register(f"""WITH c AS (SELECT item_id, text, CASE WHEN item_id % 2 = 0 THEN array_to_string(string_split(text, ' ')[1:4], ' ') ELSE 'granite lighthouse of ' || array_to_string(string_split(text, ' ')[1:2], ' ') END AS answer FROM benchmark),
bt AS (SELECT text || ' ' || answer AS t FROM c), {_STEMMED.format(o.content("t"), "bt", o.stem_sql("vocab"))},
s AS (SELECT item_id, list_distinct({o.stem_list("answer")}) AS a, {o.stem_list("text")} AS q FROM c, mp)
SELECT item_id, len(a) BETWEEN 1 AND 6 AND len(list_filter(a, lambda x: NOT list_contains(q, x))) = 0 AS echo FROM s""")
def echo_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.split("text", " ")
    answer = F.when(F.col("item_id") % 2 == 0, F.array_join(F.slice(w, 1, 4), " ")).otherwise(F.concat(F.lit("granite lighthouse of "), F.array_join(F.slice(w, 1, 2), " ")))
    return table(spark, sf_dir, "benchmark").select("item_id", "text", answer.alias("answer")).select("item_id", research.echoes(F.col("answer"), F.col("text")).alias("echo"))


@register("""SELECT qid, type, CASE WHEN type = 'COMPARISON' THEN 'What is oak?|What is elm?|What is ash?' ELSE '' END AS subquestions, CASE WHEN type = 'COMPARISON' THEN 'oak|elm|ash' ELSE 'Vienna|salt' END AS queries
FROM (SELECT item_id AS qid, CASE WHEN item_id % 2 = 0 THEN 'COMPARISON' ELSE 'LOOKUP' END AS type FROM benchmark)""")
def fallback_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("item_id") % 2 == 0
    rows = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("qid"), F.when(even, "COMPARISON").otherwise("LOOKUP").alias("type"), F.lit("Compare the oak and elm with a ash?").alias("question"),
        F.when(even, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.lit("Vienna"), F.lit("salt"))).alias("entities"),
    )
    plan = research.fallback_plan(rows)
    return rows.select("qid", "type").join(plan, "qid").select("qid", "type", F.array_join("subquestions", "|").alias("subquestions"), F.array_join("queries", "|").alias("queries"))


@register(f"""SELECT item_id, 'The library holds too little on this for a reliable answer.' || chr(10) || 'Looked for: ' || CASE WHEN item_id % 2 = 0 THEN 'Vienna, salt' ELSE array_to_string({o.content("text")}[1:6], ', ') END
  || CASE WHEN item_id % 3 = 0 THEN chr(10) || 'Nearest articles: Sea, Bay' ELSE '' END AS told FROM benchmark""")
def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.expr("cast(array() as array<string>)")
    named = F.when(F.col("item_id") % 2 == 0, F.array(F.lit("Vienna"), F.lit("salt"))).otherwise(none)
    near = F.when(F.col("item_id") % 3 == 0, F.array(F.lit("Sea"), F.lit("Bay"))).otherwise(none)
    return table(spark, sf_dir, "benchmark").select("item_id", dialogue.refusal(named, tx.content_words(F.col("text")), near).alias("told"))


@register("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Correction: ' || p_size || ' + 1 = ' || (p_size + 1) || ', not ' || p_size || '.5.' END AS told FROM part""")
def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size").cast("double")
    one = F.struct(F.concat(F.col("p_size").cast("string"), F.lit(" + 1")).alias("expression"), (n + 0.5).alias("claimed"), (n + 1).alias("actual"), (F.col("p_size") % 2 == 1).alias("ok"))
    right = F.struct(F.lit("1 + 1").alias("expression"), F.lit(2.0).alias("claimed"), F.lit(2.0).alias("actual"), F.lit(True).alias("ok"))
    return table(spark, sf_dir, "part").select("p_partkey", dialogue.correction(F.array(right, one)).alias("told"))


# claims made of order lines: a verdict by the line's supplier

_KINDS = ["SUPPORTED", "WEAK", "UNSUPPORTED", "UNCITED", "NOT_A_CLAIM", "COMPUTED"]
_CLAIMS = f"""c AS (SELECT l_orderkey AS aid, l_linenumber - 1 AS pos, {_KINDS}[l_suppkey % 6 + 1] AS verdict, l_quantity > 10 AS numbers_ok, CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END AS wrong FROM lineitem)"""


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("aid"), (F.col("l_linenumber") - 1).alias("pos"), F.lit("claim").alias("claim"), F.array(F.col("l_linenumber").cast("int")).alias("cites"),
        F.get(F.array(*map(F.lit, _KINDS)), F.col("l_suppkey") % 6).alias("verdict"), (F.col("l_quantity") > 10).alias("numbers_ok"),
        F.when(F.col("l_partkey") % 5 == 0, F.array(F.lit(9))).otherwise(F.expr("cast(array() as array<int>)")).alias("invalid"),
    )


@register(f"""WITH {_CLAIMS} SELECT aid, count(*) FILTER (verdict <> 'NOT_A_CLAIM') AS checkable, count(*) FILTER (verdict IN ('SUPPORTED', 'COMPUTED')) AS supported, count(*) FILTER (verdict IN ('UNSUPPORTED', 'UNCITED')) AS unsupported,
  CAST(sum(wrong) AS BIGINT) AS citation_errors, round(CASE WHEN count(*) FILTER (verdict <> 'NOT_A_CLAIM') > 0 THEN count(*) FILTER (verdict IN ('SUPPORTED', 'COMPUTED')) / count(*) FILTER (verdict <> 'NOT_A_CLAIM') ELSE 1.0 END, 6) AS support_rate FROM c GROUP BY 1""")
def claim_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.report(_claims(spark, sf_dir)).withColumn("support_rate", F.round("support_rate", 6))


@register(f"WITH {_CLAIMS} SELECT aid, pos, CAST(k AS INT) AS k FROM (SELECT aid, pos, row_number() OVER (PARTITION BY aid ORDER BY pos) - 1 AS k FROM c WHERE verdict IN ('WEAK', 'UNSUPPORTED', 'UNCITED')) WHERE k < 2")
def claims_for_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.to_model_check(_claims(spark, sf_dir), 2).select("aid", "pos", "k")


@register(f"WITH {_CLAIMS} SELECT aid, pos, CAST(k AS INT) AS k FROM (SELECT aid, pos, row_number() OVER (PARTITION BY aid ORDER BY pos) AS k FROM c WHERE verdict IN ('UNSUPPORTED', 'UNCITED')) WHERE k <= 4")
def claims_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.flagged(_claims(spark, sf_dir)).select("aid", "pos", "k")


@register(f"""WITH {_CLAIMS}, s AS (SELECT aid, pos, row_number() OVER (PARTITION BY aid ORDER BY pos) - 1 AS k FROM c WHERE verdict IN ('WEAK', 'UNSUPPORTED', 'UNCITED')),
v AS (SELECT aid, pos, ['S', 'U', 'S'][k + 1] AS v FROM s WHERE k < 3)
SELECT c.aid AS aid, c.pos AS pos, CASE WHEN v IS NULL THEN verdict WHEN v = 'S' AND numbers_ok AND verdict <> 'UNCITED' THEN 'SUPPORTED' WHEN v = 'S' THEN verdict ELSE 'UNSUPPORTED' END AS verdict FROM c LEFT JOIN v ON v.aid = c.aid AND v.pos = c.pos""")
def model_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = _claims(spark, sf_dir)
    letters = checked.select("aid").distinct().withColumn("letters", F.lit("SUS"))
    return verify.apply_model_verdicts(checked, dialogue.to_model_check(checked), letters).select("aid", "pos", "verdict")


@register(f"""WITH {_CLAIMS}, s AS (SELECT aid, pos, row_number() OVER (PARTITION BY aid ORDER BY pos) - 1 AS k FROM c WHERE verdict IN ('WEAK', 'UNSUPPORTED', 'UNCITED')),
e AS (SELECT l_orderkey AS aid, 2 * l_linenumber AS n FROM lineitem), m AS (SELECT e.aid AS aid, e.n AS n, EXISTS (SELECT 1 FROM s WHERE s.aid = e.aid AND s.pos + 1 = e.n AND k < 12) AS cited FROM e WHERE aid IN (SELECT aid FROM s))
SELECT aid, n FROM (SELECT *, max(CAST(cited AS INT)) OVER (PARTITION BY aid) AS any_cited FROM m) WHERE cited OR any_cited = 0""")
def evidence_for_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    proof = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("aid"), (2 * F.col("l_linenumber")).alias("n"))
    return dialogue.evidence_for_check(dialogue.to_model_check(_claims(spark, sf_dir)), proof).select("aid", "n")


@register("SELECT event_id, CASE lower(m) WHEN 'quick' THEN 'QUICK' WHEN 'deep' THEN 'DEEP' ELSE 'AUTO' END AS mode FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Quick' WHEN 1 THEN 'DEEP' WHEN 2 THEN NULL ELSE event_type END AS m FROM events)")
def mode_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    return table(spark, sf_dir, "events").select("event_id", dialogue.mode_of(F.when(k == 0, "Quick").when(k == 1, "DEEP").when(k == 3, F.col("event_type"))).alias("mode"))


@register("""WITH m AS (SELECT l_orderkey AS qid, l_partkey AS chunk_id, l_discount AS score, 0 AS p, CAST(l_linenumber AS DOUBLE) AS o FROM lineitem WHERE l_linenumber <= 2
  UNION ALL SELECT l_orderkey, l_partkey, l_tax, 1, l_linenumber FROM lineitem WHERE l_linenumber = 3 UNION ALL SELECT l_orderkey, l_partkey, l_tax, 2, -l_tax FROM lineitem),
f AS (SELECT qid, chunk_id, p, o, score, row_number() OVER (PARTITION BY qid, chunk_id ORDER BY p, o, score DESC) AS k FROM m)
SELECT qid, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY p, o, score DESC, chunk_id) AS INT) AS place FROM f WHERE k = 1""")
def merged_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("chunk_id"), "l_linenumber", F.col("l_discount").cast("double").alias("d"), F.col("l_tax").cast("double").alias("t"))
    main = rows.filter("l_linenumber <= 2").select("qid", "chunk_id", F.col("l_linenumber").alias("rank"), F.col("d").alias("score"))
    hops = rows.filter("l_linenumber = 3").select("qid", "chunk_id", F.col("l_linenumber").alias("hop"), F.col("t").alias("score"))
    out = research.merge_hits(main, hops, rows.select("qid", "chunk_id", F.col("t").alias("score")))
    return out.select("qid", "chunk_id", F.round("score", 6).alias("score"), "place")


@register("""WITH s AS (SELECT l_orderkey AS qid, l_partkey AS src, l_linenumber AS idx, max(CAST(l_discount AS DOUBLE)) AS score, max(CAST(l_tax AS DOUBLE)) AS sim FROM lineitem GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, src, idx) AS k FROM s), w AS (SELECT *, CASE WHEN k <= 3 THEN sim END AS x FROM k),
b AS (SELECT *, min(x) OVER (PARTITION BY qid) AS lo, max(x) OVER (PARTITION BY qid) AS hi FROM w)
SELECT qid, src, idx, round(score + coalesce(0.35 * (x - lo) / (hi - lo + 1e-6), 0), 6) AS score FROM b""")
def semantic_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("src"), F.col("l_linenumber").alias("idx"))
    rows = one.agg(F.max(F.col("l_discount").cast("double")).alias("score"), F.max(F.col("l_tax").cast("double")).alias("similarity"))
    out = evidence.rerank_semantically(rows.drop("similarity"), rows.drop("score"), most=3)
    return out.select("qid", "src", "idx", F.round("score", 6).alias("score"))


@register("SELECT event_id, event_type || ' [DONE] ' || CAST(floor(value) AS BIGINT) || 'ms user ' || user_id AS line FROM events")
def step_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", research.step_line(F.col("event_type"), F.lit("DONE"), F.floor("value"), F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("line"))


@register("""SELECT item_id, md5('Sources:' || chr(10) || '[1] x' || chr(10) || chr(10) || CASE WHEN item_id % 2 = 0 THEN 'Found so far:' || chr(10) || 'note' || chr(10) || chr(10) ELSE '' END || 'Question: ' || text || chr(10) || 'Answer from the sources alone in at most 90 words, and cite them as [n].') AS prompt,
  md5('Earlier question: why' || chr(10) || 'Earlier answer: ' || substr(text, 1, 600) || chr(10) || 'Follow-up: and when?' || chr(10) || 'Write the follow-up as one question that stands alone.') AS rewrite FROM benchmark""")
def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.when(F.col("item_id") % 2 == 0, "note")
    return table(spark, sf_dir, "benchmark").select(
        "item_id", F.md5(research.answer_prompt(F.col("text"), F.lit("[1] x"), note, F.lit(90))).alias("prompt"),
        F.md5(research.rewrite_prompt(F.lit("and when?"), F.lit("why"), F.col("text"))).alias("rewrite"),
    )


# benchmark rows


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, n = F.split("text", " "), F.col("item_id") % 4
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("id"), F.concat(F.lit("c"), n.cast("string")).alias("category"), F.col("text").alias("question"), F.when(n != 1, F.array_join(F.slice(w, 2, 3), " ")).otherwise("").alias("answer"),
        F.array(F.lit("zzz qqq")).alias("accept"), F.array(F.array_join(F.slice(w, 1, 2), " "), F.lit("absent fact"), F.array_join(F.slice(w, 5, 2), " ")).alias("key_facts"), (n == 3).alias("expect_abstain"),
    )


_HAS = lambda t, x: f"contains(' ' || {t} || ' ', ' ' || {x} || ' ')"
_ANSWERED = f"""g AS (SELECT item_id AS id, item_id % 4 AS n, string_split(text, ' ') AS w, CASE WHEN item_id % 5 = 0 THEN 'I do not know' ELSE text END AS answer FROM benchmark),
t AS (SELECT id, n, answer, w, CASE WHEN n <> 1 THEN array_to_string(w[2:4], ' ') END AS target, array_to_string(w[1:2], ' ') AS f1, array_to_string(w[5:6], ' ') AS f2 FROM g)"""


@register(f"""WITH {_ANSWERED}, x AS (SELECT id, n, {o.norm_title("answer")} AS a, {o.norm_title("target")} AS t, {o.norm_title("f1")} AS f1, {o.norm_title("f2")} AS f2, id % 5 = 0 AS abstained FROM t)
SELECT id, CASE WHEN n = 3 THEN NULL ELSE coalesce(t <> '' AND {_HAS("a", "t")}, false) END AS answer_match, round((CAST({_HAS("a", "f1")} AS INT) + CAST({_HAS("a", "f2")} AS INT)) / 3, 6) AS key_fact_recall, CASE WHEN n = 3 THEN abstained ELSE NOT abstained END AS abstain_correct FROM x""")
def answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = _gold(spark, sf_dir)
    told = gold.select("id", F.when(F.col("id") % 5 == 0, "I do not know").otherwise(F.col("question")).alias("answer"), (F.col("id") % 5 == 0).alias("abstained"))
    return bench.score_answers(told, gold).withColumn("key_fact_recall", F.round("key_fact_recall", 6))


@register(f"""WITH {_ANSWERED} SELECT id, 'c' || n AS category, 'MEMORY' AS mode, answer = 'I do not know' AS abstained, CASE WHEN n = 3 THEN answer = 'I do not know' ELSE answer <> 'I do not know' END AS abstain_correct, 0 AS claims_checkable FROM t""")
def memory_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = _gold(spark, sf_dir)
    told = gold.select("id", F.when(F.col("id") % 5 == 0, "I do not know").otherwise(F.col("question")).alias("answer"))
    return bench.memory_results(gold, told).select(F.col("id").cast("long").alias("id"), "category", "mode", "abstained", "abstain_correct", "claims_checkable")


@register("SELECT CAST(item_id AS VARCHAR) AS id, 'failed ' || item_id AS error, '' AS answer, false AS abstained, CAST(0 AS BIGINT) AS total_ms FROM benchmark WHERE item_id % 7 = 0")
def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = _gold(spark, sf_dir)
    failed = gold.filter("id % 7 = 0").select("id", F.concat(F.lit("failed "), F.col("id").cast("string")).alias("error"))
    return bench.error_results(gold, failed).select("id", "error", "answer", "abstained", "total_ms")


def _result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    call = lambda name: F.struct(F.lit("answer").alias("step"), name.alias("model"))
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"), F.when(F.col("event_type") == "view", "obscure").otherwise(F.col("event_type")).alias("category"), F.when(F.col("event_id") % 6 > 0, v > 50).alias("answer_match"), (v / 100).alias("key_fact_recall"), (v > 10).alias("abstain_correct"),
        F.lit(2).alias("claims_checkable"), F.when(v > 20, 2).otherwise(1).alias("claims_supported"), F.floor(v).alias("total_ms"), F.when(v > 30, v).alias("answer_ttft_ms"), v.alias("answer_decode_tps"),
        F.when(v > 99, "slow").alias("error"), F.array(F.col("event_type")).alias("models_used"), F.floor(v * 10).alias("peak_rss_mb"),
    )
    return bench._filled(rows)


_ROWS = "r AS (SELECT CASE WHEN event_type = 'view' THEN 'obscure' ELSE event_type END AS category, CASE WHEN event_id % 6 > 0 THEN value > 50 END AS m, value / 100 AS f, value > 10 AS a, CASE WHEN value > 20 THEN 2 ELSE 1 END AS s, floor(value) AS ms, CASE WHEN value > 30 THEN value END AS t, value AS v FROM events)"
_LINE = "count(*) AS n, round(avg(CAST(m AS INT)), 6) AS match_rate, round(avg(f), 6) AS recall, round(avg(CAST(a AS INT)), 6) AS abstain_rate, round(sum(s) / (2 * count(*)), 6) AS grounded, round(median(ms) / 1000, 6) AS median_s, round(median(t) / 1000, 6) AS ttft_s, round(avg(v), 6) AS decode_tps, count(*) FILTER (v > 99) AS errors"


@register(f"""WITH {_ROWS}, u AS (SELECT category, {_LINE}, CASE WHEN category = 'obscure' THEN 0 ELSE 1 END AS g FROM r GROUP BY 1 UNION ALL SELECT '**all**', {_LINE}, 2 FROM r)
SELECT category, n, match_rate, recall, abstain_rate, grounded, median_s, ttft_s, decode_tps, errors, CAST(row_number() OVER (ORDER BY g, category) AS INT) AS place FROM u""")
def benchmark_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bench.summary(_result_rows(spark, sf_dir))
    return out.select("category", "n", *(F.round(c, 6).alias(c) for c in ("match_rate", "recall", "abstain_rate", "grounded", "median_s", "ttft_s", "decode_tps")), "errors", "place")


@register("SELECT CAST(max(floor(value * 10)) AS BIGINT) AS peak_rss_mb, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS models FROM events")
def benchmark_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bench.totals(_result_rows(spark, sf_dir)).select("peak_rss_mb", F.array_join("models", ",").alias("models"))
