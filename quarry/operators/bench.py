"""Benchmark rows: scores of answers against gold questions, result rows, error rows, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import analyze, verify

# How an answer from memory alone abstains, and the order of categories in a report.
MEMORY_ABSTAIN = r"(don't know|do not know|not sure|no information|cannot|can't|unable|not aware|doesn't exist|does not exist|no record|fictional)"
CATEGORY_ORDER = ["factual", "obscure", "multi_hop", "comparison", "explanation", "historical_analysis", "scientific", "technical", "numerical", "synthesis", "contradictory", "long_context", "hallucination_probe", "multi_source", "long_tail"]
#: Fields of a result row, in order.
RESULT = (
    "id string, category string, question string, standalone_question string, mode string, detected_type string, route string, answer_model string, models_used array<string>, answer string, "
    "abstained boolean, sources array<struct<n:int,pack:string,title:string,section:string,chunk_id:long,text:string>>, linked_articles array<string>, hops array<string>, answer_match boolean, "
    "key_fact_recall double, abstain_correct boolean, claims_checkable int, claims_supported int, claims_unsupported int, citation_errors int, verification_ran_llm boolean, total_ms long, "
    "retrieval_ms long, answer_ttft_ms double, answer_decode_tps double, answer_prefill_tps double, llm_calls array<struct<step:string,model:string,prompt_tokens:long,prefilled_tokens:long,"
    "reused_tokens:long,generated_tokens:long,prefill_ms:double,decode_ms:double,ttft_ms:double,prefill_tps:double,decode_tps:double>>, rss_mb long, peak_rss_mb long, steps array<string>, "
    "error string, device map<string,string>"
)


def memory_abstained(answer: Column) -> Column:
    return answer.rlike(f"(?i){MEMORY_ABSTAIN}")


def score_answers(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """``id, answer_match, key_fact_recall, abstain_correct`` for ``answers(id, answer, abstained)`` against
    ``questions(id, answer, accept, key_facts, expect_abstain)``.

    Without a target, or where the question is to be declined, there is no match to judge (null), and
    without key facts no recall.  Null lists count as empty, null flags as false.
    """
    none = F.expr("cast(array() as array<string>)")
    gold = questions.select(
        "id", F.concat(F.when(F.trim("answer") != "", F.array("answer")).otherwise(none), F.coalesce("accept", none)).alias("targets"),
        F.coalesce("key_facts", none).alias("facts"), F.coalesce("expect_abstain", F.lit(False)).alias("declines"),
    )
    both = answers.select("id", F.coalesce("answer", F.lit("")).alias("text"), F.coalesce("abstained", F.lit(False)).alias("abstained")).join(gold, "id")
    of = lambda c: F.transform(c, lambda t: F.struct(F.lit(c).alias("kind"), t.alias("target")))
    kinds = F.concat(of("targets"), of("facts"))
    judged = verify.matches(both.select("id", "text", F.inline(kinds)), "text")
    by = judged.groupBy("id").agg(F.max(F.when(F.col("kind") == "targets", F.col("ok"))).alias("met"), F.avg(F.when(F.col("kind") == "facts", F.col("ok").cast("double"))).alias("key_fact_recall"))
    return both.join(by, "id", "left").select("id", F.when(~F.col("declines"), F.col("met")).alias("answer_match"), "key_fact_recall", F.when(F.col("declines"), F.col("abstained")).otherwise(~F.col("abstained")).alias("abstain_correct"))


def _filled(rows: DataFrame) -> DataFrame:
    """All fields of ``RESULT``: those that the rows lack are null, lists and maps empty, counts zero."""
    spark = rows.sparkSession
    out = []
    for f in spark.createDataFrame([], RESULT).schema:
        kind = f.dataType.simpleString()
        value = F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)
        if kind.startswith("array"):
            value = F.coalesce(value, F.expr(f"cast(array() as {kind})"))
        elif kind.startswith("map"):
            value = F.coalesce(value, F.expr(f"cast(map() as {kind})"))
        elif f.name.startswith("claims_") or f.name in ("citation_errors", "total_ms", "retrieval_ms"):
            value = F.coalesce(value, F.lit(0).cast(f.dataType))
        out.append(value.alias(f.name))
    return rows.select(*out)


def to_results(questions: DataFrame, answers: DataFrame, sources: DataFrame | None = None, report: DataFrame | None = None, hops: DataFrame | None = None) -> DataFrame:
    """Result rows of ``questions`` that have an answer: ``answers(id, answer, ...)`` with any fields of
    ``RESULT``, ``sources(id, n, pack, title, section, chunk_id, text)``, ``report`` of ``verify`` by ``id`` and
    ``hops(id, pos, question, answer)``."""
    rows = questions.select("id", "category", "question").join(answers.drop("category", "question"), "id")
    if "abstained" not in rows.columns:
        rows = rows.withColumn("abstained", analyze.looks_abstained(F.coalesce("answer", F.lit(""))))
    rows = rows.join(score_answers(rows.select("id", "answer", "abstained"), questions), "id", "left")
    if sources is not None:
        one = F.struct(*(F.col(c) for c in ("n", "pack", "title", "section", "chunk_id", "text")))
        rows = rows.join(sources.groupBy("id").agg(F.array_sort(F.collect_list(one)).alias("sources")), "id", "left")
    if report is not None:
        named = report.select("id", F.col("checkable").alias("claims_checkable"), F.col("supported").alias("claims_supported"), F.col("unsupported").alias("claims_unsupported"), "citation_errors")
        rows = rows.join(named, "id", "left")
    if hops is not None:
        told = F.concat("question", F.lit(" => "), F.coalesce("answer", F.lit("NOT FOUND")))
        listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", told.alias("told")))), lambda h: h["told"])
        rows = rows.join(hops.groupBy("id").agg(listed.alias("hops")), "id", "left")
    if "llm_calls" in rows.columns and "models_used" not in rows.columns:
        rows = rows.withColumn("models_used", F.array_distinct(F.transform("llm_calls", lambda c: c["model"])))
    return _filled(rows)


def error_results(questions: DataFrame, errors: DataFrame) -> DataFrame:
    """Result rows of questions whose run failed, ``errors(id, error)``: no scores, the error's text."""
    rows = questions.select("id", "category", "question", F.col("question").alias("standalone_question")).join(errors.select("id", "error"), "id")
    return _filled(rows.withColumns({"answer": F.lit(""), "abstained": F.lit(False), "verification_ran_llm": F.lit(False)}))


def memory_results(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Result rows of a model that answers from memory alone: judged the same, but for how it abstains."""
    told = answers.withColumns({"abstained": memory_abstained(F.coalesce("answer", F.lit(""))), "mode": F.lit("MEMORY"), "route": F.lit("memory-only baseline")})
    return to_results(questions, told)


def summary(results: DataFrame, order: list[str] = CATEGORY_ORDER) -> DataFrame:
    """By category, and in total as ``**all**``, with ``place``: the given categories first, others by
    name, the total last.  Shares and means leave nulls out; medians are exact."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    out = results.rollup("category").agg(
        F.count("*").alias("n"), share("answer_match").alias("match_rate"), F.avg("key_fact_recall").alias("recall"), share("abstain_correct").alias("abstain_rate"),
        F.try_divide(F.sum("claims_supported"), F.sum("claims_checkable")).alias("grounded"), (F.median("total_ms") / 1000).alias("median_s"),
        (F.median("answer_ttft_ms") / 1000).alias("ttft_s"), F.avg("answer_decode_tps").alias("decode_tps"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"), F.grouping_id().alias("g"),
    )
    known = F.array_position(F.array(*map(F.lit, order)), F.col("category"))
    ranked = out.withColumn("key", F.struct("g", F.when(known > 0, known).otherwise(len(order) + 1).alias("k"), "category"))
    from pyspark.sql import Window

    placed = ranked.withColumn("place", F.row_number().over(Window.orderBy("key")))  # a row for each category
    return placed.withColumn("category", F.when(F.col("g") == 1, "**all**").otherwise(F.col("category"))).drop("g", "key")


def totals(results: DataFrame) -> DataFrame:
    """One row: ``peak_rss_mb`` and the sorted names of all models used."""
    peak = results.agg(F.max("peak_rss_mb").alias("peak_rss_mb"))
    models = results.select(F.explode("models_used").alias("m")).distinct().agg(F.array_sort(F.collect_list("m")).alias("models"))
    return peak.crossJoin(models)  # one row each


def compare_runs(first: DataFrame, second: DataFrame, value: str = "total_ms") -> DataFrame:
    """One row over the ids that both runs have: ``n`` and the medians of a value."""
    a, b = first.select("id", F.col(value).alias("a")), second.select("id", F.col(value).alias("b"))
    return a.join(b, "id").agg(F.count("*").alias("n"), F.median("a").alias("median_a"), F.median("b").alias("median_b"))
