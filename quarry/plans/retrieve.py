"""Hybrid retrieval as one plan over a batch of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.stem import stem_arrays
from ..operators import analyze, ingest, link, search
from ..sources import packs as stored
from ..storage import cut, small

WEIGHTS = {"bm25_and": 1.0, "bm25_or": 0.8, "bm25_ent_and": 1.0, "bm25_phrase": 0.5, "title_lead": 1.1, "title_inner": 1.0, "dense": 1.0, "dense_q": 0.6}
MAX_QUERIES = 8


def lexical_lists(index: search.Index, terms: DataFrame) -> DataFrame:
    """The AND and OR lists of each question."""
    rare = search.rarity(index, terms)
    every = search.search_all(index, rare.filter("rare <= 4"), 60)
    some = search.search_any(index, rare.filter("use <= 12"), 80)
    return every.unionByName(some)


def entity_phrases(questions: DataFrame, most: int = 6) -> DataFrame:
    """``qid, eid, words, stems`` of the first names in each question."""
    named = analyze.analyze(questions).select("qid", F.posexplode(F.slice("entities", 1, most)).alias("eid", "entity"))
    return named.select("qid", "eid", tx.words(F.col("entity")).alias("words")).filter(F.size("words") > 0).withColumn("stems", stem_arrays("words"))


def prior_table(articles: DataFrame) -> DataFrame:
    return articles.select("doc_id", ingest.prior(ingest.count_all_words(F.col("paras"))).alias("prior"))


def planner_lists(index: search.Index, queries: DataFrame) -> DataFrame:
    """A list ``bm25_q<i>`` for each of a question's planner ``queries(qid, i, query)``: with two words or
    more (AND of the first four) OR (OR of ten), else the word."""
    keyed = queries.select(F.struct("qid", "i").alias("qid"), F.col("query").alias("question"))
    terms = search.question_terms(keyed).withColumn("use", F.col("pos") + 1)
    hits = search.search_planner(index, terms)
    return hits.select(F.col("qid.qid").alias("qid"), F.concat(F.lit("bm25_q"), F.col("qid.i").cast("string")).alias("signal"), "chunk_id", "rank", "score")


def ranked_lists(questions: DataFrame, terms: DataFrame, index: search.Index, *, phrases: DataFrame | None = None, titles: DataFrame | None = None, priors: DataFrame | None = None, leads: DataFrame | None = None, queries: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """All lists of hits in one index, with ``weight``, and the linked articles (``qid, doc_id``).

    With ``phrases`` names are searched as phrases and linked by ``titles``; ``leads(doc_id, chunk_id)``
    are the first chunks of articles.
    """
    lists = lexical_lists(index, terms).withColumn("weight", F.lit(1.0))
    if queries is not None:
        lists = lists.unionByName(planner_lists(index, queries).withColumn("weight", F.lit(1.0)))
    if phrases is None:
        return lists, None
    rare = search.rarity(index, terms)
    lists = lists.unionByName(search.search_entities(index, phrases, rare).withColumn("weight", F.lit(1.0)))
    linked = cut(link.link_entities(questions, titles, priors), "linked")
    lead = linked.join(leads, "doc_id").select("qid", F.lit("title_lead").alias("signal"), "chunk_id", F.lit(0).alias("rank"), F.lit(0.0).alias("score"), F.col("strength").alias("weight"))
    inner = search.search_inside(index, rare.filter("use <= 10"), linked.select("qid", "doc_id"))
    strength = linked.groupBy("qid").agg(F.max("strength").alias("weight"))
    return lists.unionByName(lead).unionByName(inner.join(small(strength), "qid")), linked


def _sought(questions: DataFrame, terms: DataFrame, entities: bool, queries: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """The stems that any list looks for, and the questions' phrases."""
    sought, phrases = terms.select("stem"), None
    if entities:
        phrases = cut(entity_phrases(questions), "phrases")
        sought = sought.unionByName(phrases.select(F.explode("stems").alias("stem")))
    if queries is not None:
        sought = sought.unionByName(search.question_terms(queries.select(F.struct("qid", "i").alias("qid"), F.col("query").alias("question"))).select("stem"))
    return sought, phrases


def retrieve(
    questions: DataFrame, articles: DataFrame, *, k: int = 10, max_per_doc: int = 2, entities: bool = False, dense: DataFrame | None = None, queries: DataFrame | None = None
) -> DataFrame:
    """``qid, rank, chunk_id, doc_id, ord, score`` and features, for ``questions(qid, question)``.

    With ``entities`` the names in a question are searched as phrases, and questions are linked to
    articles by title, which adds the lead and the best inner passages of each; ``dense(qid, signal,
    chunk_id, rank, score)`` adds lists of a vector index, ``queries(qid, i, query)`` those of a plan.
    """
    passages = ingest.passages(articles)
    terms = search.question_terms(questions)
    sought, phrases = _sought(questions, terms, entities, queries)
    index = search.Index(passages, sought, places=entities)
    priors = prior_table(articles)
    leads = passages.filter("ord = 0").select("doc_id", "chunk_id")
    lists, linked = ranked_lists(questions, terms, index, phrases=phrases, titles=ingest.title_table(articles), priors=priors, leads=leads, queries=queries)
    if dense is not None:
        lists = lists.unionByName(dense.withColumn("weight", F.lit(1.0)))
    # a bounded number of rows for each question, which several joins read
    pool = cut(search.fuse(lists, weights_of(queries), max(40, 4 * k)), "pool")
    index.release()
    return search.diversify(search.rerank(pool, passages, questions, priors, linked), k, max_per_doc)


def weights_of(queries: DataFrame | None) -> dict[str, float]:
    """The weights of the lists; those of a plan's queries share theirs."""
    return WEIGHTS if queries is None else WEIGHTS | {f"bm25_q{i}": 0.7 for i in range(MAX_QUERIES)}


def retrieve_from_packs(
    questions: DataFrame, packs: dict[str, str], *, k: int = 10, max_per_doc: int = 2, entities: bool = False, queries: DataFrame | None = None
) -> DataFrame:
    """The same from written packs, ``{pack id: folder}``: ``pack_id`` besides, and no text but the pool's is read.

    Every pack has its own statistics; lists of all packs are fused, and chunks and documents are
    known by pack and id.
    """
    spark = questions.sparkSession
    terms = search.question_terms(questions)
    sought, phrases = _sought(questions, terms, entities, queries)
    lists, linked, passages, docs, held = None, None, None, None, []
    both = lambda a, b: b if a is None else a if b is None else a.unionByName(b)
    for name, path in sorted(packs.items()):
        read = lambda t, path=path: spark.read.parquet(f"{path}/{t}")
        key = lambda c, name=name: F.struct(F.lit(name).alias("pack_id"), F.col(c).alias("id")).alias(c)
        index = search.Index.stored(read("chunks"), read("postings"), read("stats"), sought, places=entities)
        held.append(index)
        priors = read("docs").select(F.col("id").alias("doc_id"), "title", "prior")
        leads = read("chunks").filter("ord = 0").select("doc_id", "chunk_id")
        found, named = ranked_lists(questions, terms, index, phrases=phrases, titles=read("titles"), priors=priors.drop("title"), leads=leads, queries=queries)
        lists = both(lists, found.withColumn("chunk_id", key("chunk_id")))
        linked = both(linked, named and named.select("qid", key("doc_id")))
        docs = both(docs, priors.select(key("doc_id"), "prior"))
    pool = cut(search.fuse(lists, weights_of(queries), max(40, 4 * k)), "pool")
    for index in held:
        index.release()
    for name, path in sorted(packs.items()):
        own = stored.pack_passages(spark, path, pool.filter(F.col("chunk_id.pack_id") == name).select(F.col("chunk_id.id").alias("chunk_id")).distinct())
        key = lambda c, name=name: F.struct(F.lit(name).alias("pack_id"), F.col(c).alias("id")).alias(c)
        passages = both(passages, own.withColumns({c: key(c) for c in ("chunk_id", "doc_id")}))
    out = search.diversify(search.rerank(pool, passages, questions, docs, linked), k, max_per_doc)
    return out.withColumn("pack_id", F.col("chunk_id.pack_id")).withColumns({c: F.col(f"{c}.id") for c in ("chunk_id", "doc_id")})
