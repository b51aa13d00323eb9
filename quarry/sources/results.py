"""Question filters, and sinks of benchmark runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def select_questions(questions: DataFrame, *, ids: list[str] | None = None, category: str | None = None, limit: int | None = None, per_category: int | None = None) -> DataFrame:
    """Benchmark questions by id, category or number; ``per_category`` takes the first of each, by id."""
    if ids:
        questions = questions.filter(F.col("id").isin(ids))
    if category is not None:
        questions = questions.filter(F.col("category") == category)
    if per_category is not None:
        questions = questions.withColumn("_k", F.row_number().over(Window.partitionBy("category").orderBy("id"))).filter(F.col("_k") <= per_category).drop("_k")
    return questions if limit is None else questions.orderBy("id").limit(limit)


def not_yet_done(questions: DataFrame, results: DataFrame) -> DataFrame:
    """Questions without a result, for a run that goes on."""
    return questions.join(results.select("id").distinct(), "id", "left_anti")


def append_results(results: DataFrame, path: str) -> None:
    results.write.mode("append").json(path)


def grading_rows(results: DataFrame, gold: DataFrame) -> DataFrame:
    """``results(id, question, answer, sources)`` beside the gold answers; sources are joined by bars."""
    named = F.concat_ws(" | ", "sources")
    return results.select("id", "question", "answer", named.alias("sources")).join(gold.select("id", F.col("answer").alias("gold")), "id", "left")


def write_grading_sheet(results: DataFrame, gold: DataFrame, path: str) -> None:
    """``grading_rows`` as CSV."""
    grading_rows(results, gold).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
