"""Named queries over the test tables, and the same in DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import oracle as o
from .functions import scan
from .functions import text as tx
from .functions import vector as vx
from .functions.stem import stem_vocabulary
from .operators import analyze, bench, evidence, ingest, link, search, vectors, verify
from .plans import dialogue, research, retrieve
from .sources import packs, results
from .storage import cut, fresh, small, spread
from .streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql is not None:
            ORACLES[query.__name__] = sql
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.articles(spread(table(spark, sf_dir, "documents")))


def _index(spark: SparkSession, sf_dir: str) -> tuple[search.Index, DataFrame]:
    terms = search.question_terms(_questions(spark, sf_dir))
    return search.Index(ingest.passages(_articles(spark, sf_dir)), terms, places=False), terms


# corpus build


@register(f"WITH {o.ARTICLES} SELECT doc_id, title, CAST(len(paras) AS INT) AS n_paras, CAST(words AS INT) AS words FROM ar")
def ingest_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _articles(spark, sf_dir)
    return rows.select("doc_id", "title", F.size("paras").alias("n_paras"), ingest.count_all_words(F.col("paras")).alias("words"))


@register(rf"""WITH {o.ARTICLES}, ok AS (SELECT * FROM ar WHERE title <> '' AND words >= 40
  AND NOT (regexp_matches(substr(coalesce(paras[1], ''), 1, 300), '(?i)may (also )?refer to') AND words < 400))
SELECT doc_id, title, CAST(words AS INT) AS words FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY doc_id) AS k FROM ok) WHERE k = 1""")
def dedupe_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.accepted(_articles(spark, sf_dir)).select("doc_id", "title", "words")


@register(f"""WITH {o.ARTICLES} SELECT count(*) AS n_docs, CAST(sum(words) AS BIGINT) AS n_words, CAST(max(words) AS INT) AS most_words,
  round(sum(least(1.0, log10(greatest(10, words)) / 4.5)), 6) AS sum_prior FROM ar""")
def doc_stats_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ingest.count_all_words(F.col("paras"))
    rows = _articles(spark, sf_dir).select(words.alias("words"), ingest.prior(words).alias("prior"))
    return rows.agg(F.count("*").alias("n_docs"), F.sum("words").alias("n_words"), F.max("words").alias("most_words"), F.round(F.sum("prior"), 6).alias("sum_prior"))


@register()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.chunks(ingest.accepted(_articles(spark, sf_dir)))


@register()
def pack_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.page_articles(table(spark, sf_dir, "pages"))
    return ingest.doc_table(rows, ingest.chunks(rows))


@register(f"""WITH {o.ARTICLES}, p AS (SELECT doc_id, unnest(paras) AS par, generate_subscripts(paras, 1) - 1 AS ord FROM ar)
SELECT doc_id, CAST(ord AS INT) AS ord, {o.heading("par")} AS heading, CAST(len(par) AS INT) AS n_chars FROM p""")
def paragraph_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _articles(spark, sf_dir).select("doc_id", F.posexplode("paras").alias("ord", "par"))
    return rows.select("doc_id", "ord", tx.is_heading(F.col("par")).alias("heading"), F.length("par").alias("n_chars"))


@register(f"SELECT word, count(*) AS n FROM (SELECT unnest({o.content('text')}) AS word FROM documents) GROUP BY 1")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select(F.explode(tx.content_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@register(f"WITH vocab AS (SELECT DISTINCT unnest({o.words('text')}) AS word FROM documents), {o.stem_sql('vocab')} SELECT word, stem FROM stems")
def stem_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stem_vocabulary(spread(table(spark, sf_dir, "documents")).select(F.explode(tx.words(F.col("text"))).alias("word")))


@register(rf"""WITH t AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s*\([\s;,]*\)', '', 'g')) AS title FROM pages),
n AS (SELECT page_id, {o.norm_title("title")} AS norm, {o.norm_title("regexp_replace(title, '\\s*\\([^()]*\\)\\s*$', '')")} AS plain FROM t),
a AS (SELECT page_id, norm, 0 AS kind FROM n UNION SELECT page_id, plain, 2 FROM n WHERE plain <> norm UNION SELECT page_id, substr(norm, 5), 2 FROM n WHERE norm LIKE 'the %' AND len(norm) > 6)
SELECT norm, page_id AS doc_id, CAST(kind AS INT) AS kind FROM a WHERE norm <> ''""")
def norm_titles_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.title_table(ingest.page_articles(table(spark, sf_dir, "pages")))


@register(f"""SELECT doc_id, array_to_string(list_sort({o.numbers('text')}), ' ') AS found FROM documents WHERE len({o.numbers('text')}) > 0
UNION ALL SELECT p_partkey, array_to_string(list_sort({o.numbers("p_name || ' ' || p_retailprice")}), ' ') FROM part""")
def numbers_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "documents").select("doc_id", tx.numbers(F.col("text")).alias("n")).filter(F.size("n") > 0)
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), tx.numbers(F.concat_ws(" ", "p_name", F.col("p_retailprice").cast("string"))).alias("n"))
    return held.unionByName(parts).select("doc_id", F.array_join(F.array_sort("n"), " ").alias("found"))


@register(f"""WITH {o.PASSAGES}, tk AS (SELECT chunk_id, unnest({o.index_tokens("title")} || {o.index_tokens("body")}) AS word FROM ps), vocab AS (SELECT word FROM tk), {o.stem_sql("vocab")}
SELECT stem AS term, count(DISTINCT chunk_id) AS df FROM tk JOIN stems USING (word) GROUP BY 1 HAVING count(DISTINCT chunk_id) >= 2""")
def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.term_df(ingest.passages(_articles(spark, sf_dir)))


@register(f"""WITH {o.PASSAGES}, t AS (SELECT len({o.index_tokens("title")}) + len({o.index_tokens("body")}) AS n FROM ps)
SELECT count(*) AS n_chunks, round(avg(n), 6) AS avg_len FROM t""")
def postings_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = search.corpus_stats(ingest.passages(_articles(spark, sf_dir)))
    return stats.select("n_chunks", F.round("avg_len", 6).alias("avg_len"))


@register(r"""WITH w AS (SELECT string_split(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), ' ') AS w FROM documents),
g AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS gram FROM w),
b AS (SELECT gram, count(*) AS n FROM g GROUP BY 1 HAVING count(*) >= 4 ORDER BY n DESC, gram LIMIT 20000)
SELECT gram, n FROM (SELECT *, sum(octet_length(encode(gram)) + 1) OVER (ORDER BY n DESC, gram) AS used FROM b) WHERE used <= 32768""")
def zdict_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.ngram_dictionary(spread(table(spark, sf_dir, "documents")))


# retrieval


def _list(hits: DataFrame) -> DataFrame:
    return hits.select("qid", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


_LIST = "SELECT qid, chunk_id, rank, round(score, 6) AS score FROM"


@register(f'WITH {o.INDEX} SELECT qid, word, stem, df, round(idf, 6) AS idf, CAST("use" AS INT) AS use_order, CAST(rare AS INT) AS rare_order FROM ra')
def rare_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, terms = _index(spark, sf_dir)
    return search.rarity(index, terms).select("qid", "word", "stem", "df", F.round("idf", 6).alias("idf"), F.col("use").alias("use_order"), F.col("rare").alias("rare_order"))


@register(f"WITH {o.INDEX} {_LIST} ({o.OR_LIST})")
def bm25_or_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, terms = _index(spark, sf_dir)
    return _list(search.search_any(index, search.rarity(index, terms).filter("use <= 12"), 80))


@register(f"WITH {o.INDEX}, {o.AND_BASE} {_LIST} ({o.AND_LIST})")
def bm25_and_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, terms = _index(spark, sf_dir)
    return _list(search.search_all(index, search.rarity(index, terms).filter("rare <= 4"), 60))


_PHRASES = "ph AS (SELECT qid, list_transform(w[1:2], lambda z: map_extract(sx, z)[1]) AS st FROM (SELECT qid, {} AS w FROM qs), (SELECT map(list(word), list(stem)) AS sx FROM stems) WHERE len(w) >= 2)"


@register(f"""WITH {o.INDEX}, {_PHRASES.format(o.words("question"))},
al AS (SELECT chunk_id, n, col, weight, pos, stem FROM tk JOIN stems USING (word)),
hit AS (SELECT qid, a.chunk_id AS chunk_id, a.n AS n, a.weight AS weight FROM ph JOIN al a ON a.stem = st[1] JOIN al b ON b.chunk_id = a.chunk_id AND b.col = a.col AND b.pos = a.pos + 1 AND b.stem = st[2]),
f AS (SELECT qid, chunk_id, n, sum(weight) AS freq FROM hit GROUP BY ALL), d AS (SELECT qid, count(*) AS df FROM f GROUP BY 1),
s AS (SELECT qid, chunk_id, CASE WHEN ln((n_chunks - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_chunks - df + 0.5) / (df + 0.5)) END * freq * 2.2 / (freq + 1.2 * (0.25 + 0.75 * n / avg_len)) AS score FROM f JOIN d USING (qid), sm)
{_LIST} ({o.top("SELECT * FROM s", 20)})""")
def bm25_phrase_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _questions(spark, sf_dir).select("qid", F.posexplode(F.slice(tx.words(F.col("question")), 1, 2)).alias("pos", "word"))
    stems = first.join(stem_vocabulary(first), "word")
    phrases = stems.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "stem"))), lambda x: x["stem"]).alias("stems")).filter(F.size("stems") == 2)
    index = search.Index(ingest.passages(_articles(spark, sf_dir)), stems)
    return _list(search.search_phrase(index, phrases))


@register(f"""WITH {o.INDEX}, pt AS (SELECT qid, stem, pos + 1 AS u FROM qt WHERE pos < 10),
nd AS (SELECT qid, least(4, count(*)) AS need, count(*) AS n_terms FROM pt GROUP BY 1),
h AS (SELECT qid, chunk_id, sum(score) AS score, count(*) FILTER (u <= 4) AS n4, coalesce(sum(score) FILTER (u <= 4), 0) AS score4 FROM cb JOIN pt USING (stem) GROUP BY ALL)
{_LIST} ({o.top("SELECT qid, chunk_id, score + CASE WHEN n4 = need AND n_terms >= 2 THEN score4 ELSE 0 END AS score FROM h JOIN nd USING (qid)", 40)})""")
def bm25_planner_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, terms = _index(spark, sf_dir)
    return _list(search.search_planner(index, terms.withColumn("use", F.col("pos") + 1)))


@register(f"WITH {o.INDEX}, {o.FUSED} SELECT qid, chunk_id, round(rrf, 6) AS rrf, CAST(place AS INT) AS place FROM fu WHERE place <= 40")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, terms = _index(spark, sf_dir)
    fused = search.fuse(retrieve.lexical_lists(index, terms), retrieve.WEIGHTS, 40)
    return fused.select("qid", "chunk_id", F.round("rrf", 6).alias("rrf"), "place")


@register(f"""WITH {o.INDEX}, {o.RERANKED} SELECT qid, chunk_id, round(rrf, 6) AS rrf, round(coverage, 6) AS coverage, round(proximity, 6) AS proximity,
  round(title_overlap, 6) AS title_overlap, round(prior, 6) AS prior, round(score, 6) AS score FROM sc""")
def hybrid_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, terms = _index(spark, sf_dir)
    pool = cut(search.fuse(retrieve.lexical_lists(index, terms), retrieve.WEIGHTS, 40), "pool")
    rows = _articles(spark, sf_dir)
    docs = rows.select("doc_id", ingest.prior(ingest.count_all_words(F.col("paras"))).alias("prior"))
    out = search.rerank(pool, ingest.passages(rows), _questions(spark, sf_dir), docs)
    return out.select("qid", "chunk_id", *(F.round(c, 6).alias(c) for c in ("rrf", "coverage", "proximity", "title_overlap", "prior", "score")))


@register(f"WITH {o.INDEX}, {o.RERANKED}, {o.DIVERSE} SELECT qid, CAST(rank AS INT) AS rank, chunk_id, doc_id, round(score, 6) AS score FROM dv")
def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieve.retrieve(_questions(spark, sf_dir), _articles(spark, sf_dir))
    return found.select("qid", "rank", "chunk_id", "doc_id", F.round("score", 6).alias("score"))


@register(f"WITH {o.INDEX}, {o.RERANKED}, {o.DIVERSE} SELECT qid, CAST(rank AS INT) AS rank, chunk_id, doc_id, round(score, 6) AS score FROM dv")
def hybrid_retrieve_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as ``hybrid_retrieve`` from a pack that is written first."""
    path = fresh(spark, "pack")
    packs.write_passages(_articles(spark, sf_dir), path)
    found = retrieve.retrieve_from_packs(_questions(spark, sf_dir), {"all": path})
    return found.select("qid", "rank", "chunk_id", "doc_id", F.round("score", 6).alias("score"))


@register()
def hybrid_retrieve_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieve.retrieve(_questions(spark, sf_dir), _articles(spark, sf_dir), entities=True)
    return found.select("qid", "rank", "chunk_id", "doc_id", F.round("score", 6).alias("score"))


# vectors


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), vx.doubles(F.col("embedding")).alias("v"), "label")


def _vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 20."""
    return _vectors(spark, sf_dir).filter("id % 20 = 0").select(F.col("id").alias("qid"), "v")


_V = """v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), q AS (SELECT v AS qv, id AS qid FROM v WHERE id % 20 = 0)"""
_CODE = "list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform({}, lambda x: CAST(CASE WHEN x > 0 THEN 1 ELSE 0 END AS HUGEINT))), lambda a, b: a * 2 + b)"


@register(f"WITH {_V} SELECT id, CAST(bit_count({_CODE.format('v')}) AS INT) AS n_bits, CAST({_CODE.format('v')} % 4294967296 AS BIGINT) AS low FROM v")
def vec_sign_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.get(vx.sign_code(F.col("v"), 64), F.lit(0))
    return _vectors(spark, sf_dir).select("id", F.bit_count(code).cast("int").alias("n_bits"), code.bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"))


@register(f"""WITH {_V}, s AS (SELECT id, v, list_max(list_transform(v, lambda x: abs(x))) / 127.0 + 1e-12 AS scale FROM v)
SELECT id, round(scale, 6) AS scale, array_to_string(list_transform(v, lambda x: CAST(greatest(-127, least(127, round_even(x / scale, 0))) AS INTEGER)), ',') AS q FROM s""")
def vec_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("id", F.inline(F.array(vx.quantise(F.col("v"))))).select("id", F.round("scale", 6).alias("scale"), F.array_join(F.col("q").cast("array<string>"), ",").alias("q"))


@register(f"""WITH {_V}, s AS (SELECT qid, id, round(list_dot_product(qv, v), 9) AS s FROM q, v)
SELECT qid, id, CAST(rank AS INT) AS rank, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM s) WHERE rank <= 10""")
def vec_bruteforce_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.nearest(_vector_questions(spark, sf_dir), _vectors(spark, sf_dir))
    return found.select("qid", "id", "rank", F.round("score", 6).alias("score"))


@register(f"""WITH {_V}, h AS (SELECT qid, id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (qv[i] > 0) <> (v[i] > 0) THEN 1 ELSE 0 END)) AS ham FROM q, v)
SELECT qid, id, CAST(ham AS INT) AS ham FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ham, id) AS k FROM h) WHERE k <= 40""")
def vec_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _vector_questions(spark, sf_dir).select("qid", vx.sign_code(F.col("v"), 64).alias("qc"))
    return vectors.nearest_codes(q, spread(_vectors(spark, sf_dir)).select("id", vx.sign_code(F.col("v"), 64).alias("c")), k=40)


def _fixed_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).groupBy("label").agg(F.min_by("v", "id").alias("c")).select(F.col("label").alias("list_id"), "c")


@register(f"""WITH {_V}, c AS (SELECT label AS list_id, arg_min(v, id) AS c FROM v GROUP BY label), s AS (SELECT id, list_id, round(list_dot_product(v, c), 9) AS s FROM v, c)
SELECT id, CAST(list_id AS INT) AS list_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, list_id) AS k FROM s) WHERE k = 1""")
def ivf_assign_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.assign(_vectors(spark, sf_dir), _fixed_centroids(spark, sf_dir)).select("id", F.col("list_id").cast("int").alias("list_id"))


@register()
def ivf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(_vectors(spark, sf_dir))
    n = rows.count()
    nlist = vectors.list_count(n)
    centroids = vectors.train_centroids(rows, nlist)
    index = vectors.encode(rows, vectors.assign(rows, centroids), 64)
    return vectors.search(_vector_questions(spark, sf_dir), index, centroids, 64, **vectors.effort(n, nlist))


# questions, answers, benchmark


_TYPES = ["COMPARISON", "MULTIHOP", "SYNTHESIS", "EXPLANATION", "NUMERIC", "LOOKUP"]
# Made-up questions and answers, one of each kind.
ASKED = [
    (1, "Which is larger, the lake or the sea?"), (2, "Why does iron rust in water?"), (3, "How many years passed between 1901 and 1956?"), (4, "Who was the first mayor?"),
    (5, "Give an overview of the trade of salt"), (6, "Mercury"), (7, "Where was the author of the book about bees born?"), (8, "difference between tin and zinc"),
    (9, "compare steel and brass regarding weight"), (10, "and why?"), (11, "tea vs coffee?"), (12, "What year was the bridge built that joins the two towns which split?"),
]
ANSWERED = [
    (1, "The bridge was built in 1932 [1]. It spans the river [1, 2].\n- The river floods each spring [2-3]\nNobody knows the designer."),
    (2, "The sources do not mention the price. The tower has 1,250 steps [4]."),
    (3, "12 × 4 = 50 and (1 + 2) * 3 = 9. The library holds no information."),
]
PROVEN = [(1, 1, "Bridge", "The bridge was built in 1932 and spans the river."), (1, 2, "River", "The river floods each spring."), (2, 4, "Tower", "The tower has 250 steps inside.")]


def _values(rows: list[tuple], names: str) -> str:
    cells = lambda r: ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for x in r)
    return f"(VALUES {', '.join(f'({cells(r)})' for r in rows)}) AS t({names})"


def _type_sql(q: str, n_entities: str, n_words: str) -> str:
    """CASE over the scores of ``operators.analyze`` in SQL."""
    has = lambda p: f"regexp_matches({q}, '(?i){p}')".replace("''", "'")
    chain = f"regexp_matches({q}, '{analyze.CHAIN}')"
    outer = f"({chain} AND regexp_matches(regexp_replace({q}, '{analyze.CHAIN}', ''), '(?i){analyze.PREDICATE}'))"
    hop0 = f"CASE WHEN {has(analyze.MULTIHOP)} THEN 0.75 ELSE 0.0 END"
    hop1 = f"CASE WHEN {outer} OR ({chain} AND {has(analyze.GENERIC_CLAUSE)}) OR {has(analyze.NAMED_AFTER)} THEN 0.8 ELSE {hop0} END"
    hop = f"CASE WHEN len(regexp_extract_all({q}, '(?i){analyze.CLAUSE}')) >= 2 AND {hop1} < 0.6 THEN 0.6 ELSE {hop1} END"
    pairs = [
        f"CASE WHEN {has(analyze.COMPARE)} THEN 0.9 WHEN {n_entities} >= 2 AND regexp_matches({q}, '\\b(and|or)\\b') AND {has('^(which|who)\\b')} THEN 0.6 ELSE 0.0 END", hop,
        *(f"CASE WHEN {has(p)} THEN {s} ELSE 0.0 END" for p, s in ((analyze.SYNTHESIS, 0.7), (analyze.EXPLAIN, 0.75), (analyze.NUMERIC, 0.65), (analyze.LOOKUP, 0.6))),
    ]
    return ", ".join(f"{p} AS s{i}" for i, p in enumerate(pairs)) + f", {has(analyze.QUESTION)} OR {q} LIKE '%?' AS asks, {has(analyze.QUANTITY)} AS quantity, {has(analyze.LIST)} AS wants_list"


_CLASSIFIED = f"""a0 AS (SELECT item_id AS qid, trim(text) AS q FROM benchmark UNION ALL SELECT qid + 1000000, q FROM {_values(ASKED, "qid, q")}),
a1 AS (SELECT qid, q, len({o.content("q")}) AS n_words, len(regexp_extract_all(q, '["“]([^"”]{{2,80}})["”]')) AS n_ent FROM a0),
a2 AS (SELECT *, {_type_sql("q", "n_ent", "n_words")} FROM a1), a3 AS (SELECT *, greatest(s0, s1, s2, s3, s4, s5) AS best FROM a2),
a4 AS (SELECT *, CASE WHEN best = 0 THEN CASE WHEN n_words <= 2 AND NOT asks THEN 'AMBIGUOUS' ELSE 'LOOKUP' END {" ".join(f"WHEN s{i} = best THEN '{t}'" for i, t in enumerate(_TYPES))} END AS t0,
  CASE WHEN best = 0 THEN CASE WHEN n_words <= 2 AND NOT asks THEN 0.5 ELSE 0.4 END ELSE best END AS c0 FROM a3),
an AS (SELECT qid, CASE WHEN n_words <= 2 AND q NOT LIKE '%?%' AND n_ent <= 1 AND t0 = 'LOOKUP' THEN 'AMBIGUOUS' ELSE t0 END AS type,
  CASE WHEN n_words <= 2 AND q NOT LIKE '%?%' AND n_ent <= 1 AND t0 = 'LOOKUP' THEN 0.5 ELSE c0 END AS confidence, CAST(n_words AS INT) AS n_words, s4 > 0 OR quantity AS wants_number, wants_list FROM a4)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spark.createDataFrame([(i + 1_000_000, q) for i, q in ASKED], "qid long, question string")
    return _questions(spark, sf_dir).unionByName(made)


@register(f"WITH {_CLASSIFIED} SELECT qid, type, CAST(confidence AS DOUBLE) AS confidence, n_words, wants_number, wants_list FROM an")
def classify_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.analyze(_asked(spark, sf_dir), names=False).select("qid", "type", "confidence", "n_words", "wants_number", "wants_list")


@register(f"""WITH {_CLASSIFIED} SELECT qid, type, CASE WHEN type = 'AMBIGUOUS' OR (type = 'LOOKUP' AND NOT (confidence < 0.5 AND n_words >= 6)) THEN 'FAST' ELSE 'STRONG' END AS role,
  type IN ('COMPARISON', 'SYNTHESIS', 'MULTIHOP') OR (type IN ('EXPLANATION', 'NUMERIC') AND confidence < 0.6) AS plan, type = 'MULTIHOP' AS hops, type IN ('COMPARISON', 'SYNTHESIS', 'MULTIHOP', 'NUMERIC') AS verify,
  CASE type WHEN 'AMBIGUOUS' THEN 700 WHEN 'LOOKUP' THEN CASE WHEN confidence < 0.5 AND n_words >= 6 THEN 900 ELSE 550 END WHEN 'MULTIHOP' THEN 900 WHEN 'COMPARISON' THEN 1100 WHEN 'SYNTHESIS' THEN 1100 ELSE 1000 END AS evidence_tokens FROM an""")
def route_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.route(analyze.analyze(_asked(spark, sf_dir), names=False)).select("qid", "type", "role", "plan", "hops", "verify", "evidence_tokens")


_CUT = r"(?i)\s+(?:vs\.?|versus|and|or|with|to)\s+"


@register(rf"""WITH {_CLASSIFIED}, c0 AS (SELECT qid, q, regexp_extract(q, '(?i)(?:between|compare|comparing)\s+(.+?)(?:\?|$|\s+(?:in terms of|regarding|for|on)\s)', 1) AS a,
  regexp_extract(q, '(?i)^(?:is|are|was|were)?\s*(.+?)\s+(?:vs\.?|versus)\s+(.+?)(?:\?|$)', 1) AS l, regexp_extract(q, '(?i)^(?:is|are|was|were)?\s*(.+?)\s+(?:vs\.?|versus)\s+(.+?)(?:\?|$)', 2) AS r FROM a0),
c1 AS (SELECT qid, CASE WHEN a <> '' THEN a WHEN l <> '' THEN l || ' vs ' || r ELSE '' END AS span FROM c0),
c2 AS (SELECT qid, unnest(regexp_split_to_array(span, '{_CUT}')) AS p, generate_subscripts(regexp_split_to_array(span, '{_CUT}'), 1) AS i FROM c1),
c3 AS (SELECT qid, i, trim(regexp_replace(regexp_replace(regexp_replace(trim(p), '[?.]+$', ''), '^the ', ''), '^a ', '')) AS p FROM c2),
c4 AS (SELECT qid, p, row_number() OVER (PARTITION BY qid ORDER BY i) AS k, i FROM c3 WHERE p <> '' AND len({o.content("p")}) > 0)
SELECT a0.qid AS qid, coalesce(string_agg(p, '|' ORDER BY k) FILTER (k <= 4), '') AS things FROM a0 LEFT JOIN c4 ON c4.qid = a0.qid GROUP BY 1""")
def comparands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("qid", F.array_join(analyze.comparands(F.col("question")), "|").alias("things"))


@register()
def followups(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    names = F.filter(scan.name_spans(F.coalesce("question", F.lit(""))), lambda n: ~F.lower(n).isin(tx.QUESTION_WORDS))
    return turns.select("conv_id", "turn", analyze.is_follow_up(F.col("question"), F.size(names)).alias("follow_up"))


@register()
def entity_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = ingest.page_articles(table(spark, sf_dir, "pages"))
    asked = pages.select(F.col("doc_id").alias("qid"), F.concat(F.lit("What is "), "title", F.lit("?")).alias("question"))
    docs = pages.select("doc_id", ingest.prior(ingest.count_all_words(F.col("paras"))).alias("prior"))
    return link.link_entities(asked, ingest.title_table(pages), docs)


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _articles(spark, sf_dir)
    found = retrieve.retrieve(_questions(spark, sf_dir), rows).join(ingest.passages(rows).select("chunk_id", "title", "text"), "chunk_id")
    return evidence.sentence_scores(cut(found, "texts"), cut(analyze.analyze(_questions(spark, sf_dir)), "questions"))


@register()
def sentence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir)


@register()
def evidence_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.select(_evidence(spark, sf_dir))


@register()
def research_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.research(_questions(spark, sf_dir), _articles(spark, sf_dir))


def _answers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ANSWERED, "aid int, answer string")


@register(f"SELECT aid, array_to_string({o.citations('answer')}, ',') AS cites FROM {_values(ANSWERED, 'aid, answer')}")
def citations_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark).select("aid", F.array_join(tx.citations(F.col("answer")).cast("array<string>"), ",").alias("cites"))


@register()
def claim_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(1, "When was the bridge built?", False), (2, "How many steps?", False), (3, "Compute it", True)], "aid int, question string, numeric boolean")
    return verify.check(verify.claims(_answers(spark)), spark.createDataFrame(PROVEN, "aid int, n int, title string, text string"), asked)


@register()
def verify_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.report(claim_verdicts(spark, sf_dir))


@register()
def arithmetic_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark).select("aid", F.inline(scan.equation_checks("answer")))


@register(f"""WITH d AS (SELECT doc_id, {o.norm_title("text")} AS t, {o.words("text")} AS w FROM documents), i AS (SELECT item_id, {o.norm_title("text")} AS t, {o.words("text")}[1:3] AS k FROM benchmark)
SELECT item_id, doc_id FROM i JOIN d ON contains(' ' || d.t || ' ', ' ' || i.t || ' ') WHERE i.t <> ''""")
def lenient_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose words stand in a document in order: a phrase of eight words picks candidates by an
    equi-join; items of fewer words are compared with every text, inside the scan."""
    window = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 7, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, F.lit(8)), " ")))
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", F.inline(F.array(F.struct(tx.words(F.col("text")).alias("w")))))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.inline(F.array(F.struct(tx.words(F.col("text")).alias("w"))))).filter(F.size("w") > 0)
    keyed = items.select("item_id", F.array_join("w", " ").alias("t"), F.xxhash64(F.array_join(F.slice("w", 1, 8), " ")).alias("key"), F.size("w").alias("n"))
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    texts = docs.select("doc_id", F.array_join("w", " ").alias("d"))
    # the items' keys are broadcast where they are small: only hits leave the scan
    found = docs.filter(F.size("w") >= 8).select("doc_id", F.explode(F.array_distinct(window(F.col("w")))).alias("key")).join(small(keyed.filter("n >= 8").select("item_id", "t", "key")), "key")
    long = found.select("item_id", "t", "doc_id").join(texts, "doc_id").filter(F.contains(padded(F.col("d")), padded(F.col("t"))))
    # items under eight words meet each text where it is read
    short = texts.crossJoin(small(keyed.filter("n < 8").select("item_id", "t"))).filter(F.contains(padded(F.col("d")), padded(F.col("t"))))
    return long.select("item_id", "doc_id").unionByName(short.select("item_id", "doc_id")).distinct()


@register(f"SELECT aid, regexp_matches(substr(answer, 1, 400), '(?i){analyze.ABSTAIN}') AS abstained FROM {_values(ANSWERED, 'aid, answer')}")
def abstain_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark).select("aid", analyze.looks_abstained(F.col("answer")).alias("abstained"))


_RUNS = "r AS (SELECT event_id AS id, event_type AS category, value > 50 AS answer_match, value / 100 AS recall, value AS total_ms, CASE WHEN value > 20 THEN 1 ELSE 0 END AS supported, 1 AS checkable, CASE WHEN value > 99 THEN 'slow' END AS error FROM events)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("category"), (v > 50).alias("answer_match"), (v / 100).alias("recall"), v.alias("total_ms"),
        (v > 20).cast("int").alias("supported"), F.lit(1).alias("checkable"), F.when(v > 99, "slow").alias("error"),
    )


_SUMMARY = "count(*) AS n, round(avg(CAST(answer_match AS INT)), 6) AS match_rate, round(avg(recall), 6) AS recall, round(median(total_ms) / 1000, 6) AS median_s, round(sum(supported) / sum(checkable), 6) AS grounded, count(error) AS errors"


@register(f"WITH {_RUNS} SELECT category, {_SUMMARY} FROM r GROUP BY 1 UNION ALL SELECT '**all**', {_SUMMARY} FROM r")
def bench_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verify.bench_summary(_runs(spark, sf_dir))
    return out.select("category", "n", *(F.round(c, 6).alias(c) for c in ("match_rate", "recall", "median_s", "grounded")), "errors")


@register(f"WITH {_RUNS} SELECT category, list_sort(list(total_ms))[len(list(total_ms)) // 2 + 1] AS upper_median FROM r GROUP BY 1")
def bench_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.upper_median(_runs(spark, sf_dir), "category", "total_ms")


@register("""WITH a AS (SELECT user_id AS id, avg(value) AS ms FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id AS id, avg(value) AS ms FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT count(*) AS n, round(median(a.ms), 6) AS median_a, round(median(b.ms), 6) AS median_b FROM a JOIN b USING (id)""")
def bench_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = lambda kind: table(spark, sf_dir, "events").filter(F.col("event_type") == kind).groupBy(F.col("user_id").alias("id")).agg(F.avg("value").alias("total_ms"))
    out = bench.compare_runs(run("click"), run("view"))
    return out.select("n", F.round("median_a", 6).alias("median_a"), F.round("median_b", 6).alias("median_b"))


@register("SELECT l.doc_id AS id, 'Q' || l.doc_id AS question, CASE WHEN quality IS NOT NULL THEN 'quality ' || quality END AS answer, l.quality || ' | ' || l.toxic AS sources, substr(text, 1, 40) AS gold FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id")
def grading_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("Q"), F.col("doc_id").cast("string")).alias("question"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("answer"),
        F.array(F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("sources"),
    )
    gold = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 40).alias("answer"))
    return results.grading_rows(one, gold)


@register("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda name: table(spark, sf_dir, name).select(F.col("doc_id").alias("id"))
    return results.not_yet_done(ids("documents"), ids("labels")).withColumnRenamed("id", "doc_id")


@register(f"""WITH {o.ARTICLES}, t AS (SELECT doc_id FROM ar ORDER BY least(1.0, log10(greatest(10, words)) / 4.5) DESC, doc_id LIMIT 50)
SELECT doc_id * 1000000 + unnest(range(0, len(paras))) AS chunk_id FROM ar WHERE doc_id IN (SELECT doc_id FROM t) UNION SELECT doc_id * 1000000 FROM ar WHERE len(paras) > 0""")
def scope_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _articles(spark, sf_dir)
    docs = rows.select("doc_id", ingest.prior(ingest.count_all_words(F.col("paras"))).alias("prior"))
    return ingest.scope(ingest.passages(rows), docs, "top:50,lead:1")


@register(rf"""WITH t AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM documents)
SELECT doc_id, md5(array_to_string(CASE WHEN len(w) <= 300 THEN w ELSE w[1:100] || w[len(w) - 199 : len(w)] END, ' ')) AS cut FROM t""")
def prompt_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    held = table(spark, sf_dir, "documents").select("doc_id", F.inline(F.array(F.struct(w.alias("w")))))
    return held.select("doc_id", F.md5(F.array_join(tx.truncate_middle(F.col("w"), 300), " ")).alias("cut"))


@register("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = incremental.event_windows(table(spark, sf_dir, "events"))
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@register("SELECT event_type, s AS start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, unnest([date_trunc('hour', ts) - INTERVAL 1 HOUR, date_trunc('hour', ts)]) AS s FROM events) GROUP BY ALL")
def event_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of two hours, one begun every hour."""
    out = incremental.event_windows(table(spark, sf_dir, "events"), size="2 hours", slide="1 hour")
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@register("""WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = incremental.sessions(table(spark, sf_dir, "events"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@register(rf"""WITH q AS (SELECT item_id AS qid, {o.words("text")} AS w FROM benchmark), s AS (SELECT qid, w, unnest(range(1, 7)) AS n FROM q), p AS (SELECT qid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM s WHERE len(w) >= n),
g AS (SELECT qid, n, w[i : i + n - 1] AS g FROM p) SELECT DISTINCT qid, array_to_string(g, ' ') AS gram, CAST(n AS INT) AS n FROM g WHERE n > 1 AND g[1] NOT IN {o.STOP} AND g[-1] NOT IN {o.STOP}""")
def entity_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-grams of two to six words that entity linking looks up."""
    return link.question_grams(_questions(spark, sf_dir)).filter("n > 1").select("qid", "gram", "n").distinct()


# Made-up claims with citations, model outputs and file names.
CLAIMS = [(1, 0, "Built in 1932 [1]."), (1, 1, "It spans the river [1, 2]."), (1, 2, "Floods come each spring [2-3]."), (2, 0, "The tower has 250 steps [4]."), (2, 1, "No source.")]
OUTPUTS = [
    (1, 'Sure: {"type": "comparison", "subquestions": [" How tall is A? ", "B"], "queries": ["a", " "]}'), (2, "no plan"), (3, '{"type": "odd", "queries": ["x y"]}'),
    (4, "<think>first</think> The answer is 4."), (5, "late thoughts</think> Yes <think>no end"), (6, "plain"),
]
FILES = [(1, "Gemma-3n-E2B.gguf"), (2, "nomic-embed-v1.5.gguf"), (3, "qwen3-30b-a3b.gguf"), (4, "some-7b-chat.gguf"), (5, "mmproj-f16.gguf"), (6, "bge-reranker.gguf")]


@register(rf"""WITH c AS (SELECT aid, pos, unnest({o.citations("claim")}) AS n FROM {_values(CLAIMS, "aid, pos, claim")}), e AS (SELECT DISTINCT aid, n FROM {_values(PROVEN, "aid, n, title, text")})
SELECT c.aid AS aid, pos, c.n AS n, e.n IS NOT NULL AS valid FROM c LEFT JOIN e ON e.aid = c.aid AND e.n = c.n""")
def claims_citation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.cited(spark.createDataFrame(CLAIMS, "aid int, pos int, claim string"), spark.createDataFrame(PROVEN, "aid int, n int, title string, text string"))


@register(rf"""WITH d AS (SELECT doc_id, {o.norm_title("text")} AS t FROM documents), i AS (SELECT item_id, {o.norm_title("text")} AS t FROM benchmark),
f AS (SELECT item_id, count(*) AS n FROM i JOIN d ON contains(' ' || d.t || ' ', ' ' || i.t || ' ') WHERE i.t <> '' GROUP BY 1)
SELECT item_id, coalesce(n, 0) AS n_evidence, coalesce(n, 0) > 0 AS sufficient FROM i LEFT JOIN f USING (item_id)""")
def sufficiency_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with and without documents that hold them; a document that holds an item counts as a confident source."""
    n = lenient_match(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_evidence"))
    rows = table(spark, sf_dir, "benchmark").select("item_id").join(n, "item_id", "left").withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0)).cast("long"))
    return rows.withColumn("sufficient", research.sufficient(F.col("n_evidence"), F.lit(1.0), F.lit(0), F.lit(False)))


@register(f"""WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations
  WHERE role = 'assistant' AND text IS NOT NULL AND NOT regexp_matches(substr(text, 1, 400), '(?i){analyze.ABSTAIN}')) SELECT conv_id, turn, CAST(back AS INT) AS back FROM c WHERE back <= 2""")
def history_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    return dialogue.history(turns).select("conv_id", "turn", "back")


@register("""SELECT * FROM (VALUES (1, 'COMPARISON', 'How tall is A?', 'a'), (2, 'AMBIGUOUS', '', ''), (3, 'AMBIGUOUS', '', 'x y'), (4, 'AMBIGUOUS', '', ''), (5, 'AMBIGUOUS', '', ''), (6, 'AMBIGUOUS', '', '')) t(id, type, subquestions, queries)""")
def model_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = dialogue.parse_plan(F.col("output"))
    return spark.createDataFrame(OUTPUTS, "id int, output string").select("id", plan["type"].alias("type"), *(F.array_join(plan[c], "|").alias(c) for c in ("subquestions", "queries")))


@register(rf"""WITH x AS (SELECT *, strpos(output, '</think>') AS c, strpos(output, '<think>') AS b FROM {_values(OUTPUTS, "id, output")})
SELECT id, trim(regexp_replace(CASE WHEN c > 0 AND (b = 0 OR c < b) THEN substr(output, c + 8) ELSE output END, '(?s)<think>.*?(</think>|$)', '', 'g')) AS answer FROM x""")
def reasoning_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(OUTPUTS, "id int, output string").select("id", tx.strip_reasoning(F.col("output")).alias("answer"))


@register("SELECT * FROM (VALUES (1, 'FAST'), (2, 'EMBED'), (3, 'DEEP'), (4, 'STRONG'), (5, NULL), (6, 'EMBED')) t(id, role)")
def model_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(FILES, "id int, name string").select("id", tx.model_role(F.col("name")).alias("role"))


@register("""WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), m AS (SELECT *, list_avg(v) AS mu FROM v), z AS (SELECT id, mu, v, sqrt(list_avg(list_transform(v, lambda x: (x - mu) * (x - mu)))) + 1e-5 AS sd FROM m),
t AS (SELECT id, list_transform(v[1:32], lambda x: (x - mu) / sd) AS t FROM z), n AS (SELECT id, t, sqrt(list_sum(list_transform(t, lambda x: x * x))) AS l FROM t)
SELECT id, round(t[1] / l, 6) AS first, round(t[32] / l, 6) AS last, round(list_sum(t) / l, 6) AS total FROM n""")
def vec_matryoshka(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut_ = _vectors(spark, sf_dir).select("id", F.inline(F.array(F.struct(vx.matryoshka(F.col("v"), 32, layernorm=True).alias("t")))))
    total = F.aggregate("t", F.lit(0.0), lambda a, x: a + x)
    return cut_.select("id", F.round(F.get("t", F.lit(0)), 6).alias("first"), F.round(F.get("t", F.lit(31)), 6).alias("last"), F.round(total, 6).alias("total"))


@register("SELECT doc_id, md5('search_document: ' || source || ' — ' || lang || chr(10) || substr(coalesce(text, ''), 1, 1200)) AS digest FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND lang <> ''")
def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").filter("source IS NOT NULL AND lang IS NOT NULL AND lang <> ''")
    return rows.select("doc_id", F.md5(tx.embedding_text(F.col("source"), F.col("lang"), F.col("text"), "search_document: ")).alias("digest"))


@register("SELECT event_id AS id, event_type AS category FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events) WHERE k <= 2")
def questions_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of each category: the sample is the feature."""
    return results.select_questions(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("category")), per_category=2)


@register()
def signal_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, terms = _index(spark, sf_dir)
    held = search.signal_map(retrieve.lexical_lists(index, terms), retrieve.WEIGHTS)
    return held


from . import flow_queries  # noqa: E402, F401  (registers its queries)
