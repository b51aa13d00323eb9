"""The research flow over a batch of questions, with injected model functions.

Language and embedding models are plain callables; the defaults are deterministic
stand-ins (an extractive answer), not models.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.stem import stem_arrays
from ..operators import analyze, evidence, ingest, verify
from ..storage import cut
from . import retrieve

MIN_CONFIDENCE = 0.34


def substitute(question: Column, answers: Column) -> Column:
    """``#k`` in a hop's question becomes the answer of hop k; those without an answer become "it"."""
    filled = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.size(answers), F.lit(1))), question,
        lambda q, k: F.when(F.trim(F.coalesce(F.get(answers, k - 1), F.lit(""))) != "", F.replace(q, F.concat(F.lit("#"), k.cast("string")), F.get(answers, k - 1))).otherwise(q),
    )
    return F.regexp_replace(filled, r"#\d", "it")


def echoes(answer: Column, question: Column) -> Column:
    """Whether a short answer only repeats the question's stems."""
    a, q = F.array_distinct(stem_arrays(tx.content_words(tx.strip_citations(answer)))), stem_arrays(tx.content_words(question))
    return F.size(a).between(1, 6) & (F.size(F.array_except(a, q)) == 0)


def sufficient(n_evidence: Column, confidence: Column, n_linked: Column, hop_answered: Column) -> Column:
    return ~((n_evidence == 0) | ((confidence < MIN_CONFIDENCE) & (n_linked == 0) & ~hop_answered))


def merge_hits(main: DataFrame, hops: DataFrame, pool: DataFrame) -> DataFrame:
    """``qid, chunk_id, score, place``: the main hits (``rank``), then the best source of each hop
    (``hop``), then the pool by score; a chunk counts where it comes first."""
    parts = [
        main.select("qid", "chunk_id", "score", F.struct(F.lit(0).alias("p"), F.col("rank").cast("double").alias("o"), (-F.col("score")).alias("s")).alias("at")),
        hops.select("qid", "chunk_id", "score", F.struct(F.lit(1).alias("p"), F.col("hop").cast("double").alias("o"), (-F.col("score")).alias("s")).alias("at")),
        pool.select("qid", "chunk_id", "score", F.struct(F.lit(2).alias("p"), (-F.col("score")).cast("double").alias("o"), (-F.col("score")).alias("s")).alias("at")),
    ]
    first = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("qid", "chunk_id").agg(F.min("at").alias("at"), F.min_by("score", "at").alias("score"))
    return first.select("qid", "chunk_id", "score", F.row_number().over(Window.partitionBy("qid").orderBy("at", "chunk_id")).alias("place"))


def step_line(name: Column, status: Column, ms: Column, detail: Column) -> Column:
    """One line of a trace: ``name [STATUS] 12ms detail``."""
    return F.concat(name, F.lit(" ["), status, F.lit("] "), ms.cast("long").cast("string"), F.lit("ms "), F.coalesce(detail, F.lit("")))


def answer_prompt(question: Column, evidence_text: Column, notes: Column, words: Column) -> Column:
    """The text that a model is given: the evidence, what hops have found, the question, and how long to be."""
    found = F.when(F.coalesce(notes, F.lit("")) != "", F.concat(F.lit("Found so far:\n"), notes, F.lit("\n\n"))).otherwise("")
    return F.concat(F.lit("Sources:\n"), evidence_text, F.lit("\n\n"), found, F.lit("Question: "), question, F.lit("\nAnswer from the sources alone in at most "), words.cast("string"), F.lit(" words, and cite them as [n]."))


def rewrite_prompt(question: Column, last_question: Column, last_answer: Column) -> Column:
    """Asks for a follow-up as a question of its own; of the last answer the first 600 characters count."""
    return F.concat(F.lit("Earlier question: "), last_question, F.lit("\nEarlier answer: "), F.substring(last_answer, 1, 600), F.lit("\nFollow-up: "), question, F.lit("\nWrite the follow-up as one question that stands alone."))


def fallback_plan(analyzed: DataFrame) -> DataFrame:
    """``qid, subquestions, queries`` where no model plans: "What is X?" and a query for each comparand, else the entities."""
    things = analyze.comparands(F.col("question"), F.col("entities"))
    subs = F.when(F.col("type") == "COMPARISON", F.transform(things, lambda x: F.concat(F.lit("What is "), x, F.lit("?"))))
    return analyzed.select("qid", F.coalesce(subs, F.expr("cast(array() as array<string>)")).alias("subquestions"), F.when(F.col("type") == "COMPARISON", things).otherwise(F.col("entities")).alias("queries"))


def extractive_answer(found: DataFrame) -> DataFrame:
    """``aid, answer``: each question's best evidence text with its citation."""
    best = found.filter("n = 1")
    return best.select(F.col("qid").alias("aid"), F.concat(F.col("text"), F.lit(" [1]")).alias("answer"))


def research(questions: DataFrame, articles: DataFrame, *, budget: evidence.Budget = evidence.Budget(), answer: Callable[[DataFrame], DataFrame] = extractive_answer, k: int = 10) -> DataFrame:
    """``aid, answer, checkable, supported, unsupported, support_rate, citation_errors, abstained``."""
    analyzed = cut(analyze.analyze(questions), "questions")
    passages = ingest.passages(articles)
    hits = cut(retrieve.retrieve(questions, articles, k=k), "hits")
    texts = cut(hits.join(passages.select("chunk_id", "title", "text"), "chunk_id"), "texts")
    found = cut(evidence.select(evidence.sentence_scores(texts, analyzed, budget), budget), "evidence")
    named = found.join(texts.select("qid", (F.col("rank") - 1).alias("src"), "title"), ["qid", "src"])
    enough = questions.select("qid").join(hits.filter("rank = 1").select("qid", "coverage"), "qid", "left").join(found.groupBy("qid").agg(F.count("*").alias("n")), "qid", "left")
    gate = sufficient(F.coalesce("n", F.lit(0)), F.coalesce("coverage", F.lit(0.0)), F.lit(0), F.lit(False))
    enough = enough.select(F.col("qid").alias("aid"), gate.alias("ok"))
    answers = answer(found)
    checked = verify.check(
        verify.claims(answers), named.select(F.col("qid").alias("aid"), "n", "title", "text"), analyzed.select(F.col("qid").alias("aid"), "question", (F.col("type") == "NUMERIC").alias("numeric"))
    )
    return enough.join(answers, "aid", "left").join(verify.report(checked), "aid", "left").withColumn("abstained", ~F.col("ok") | F.col("answer").isNull()).drop("ok")
