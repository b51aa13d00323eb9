"""Readers of article corpora, question sets and result files; all through Spark's own sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx

QUESTION_SCHEMA = "id string, category string, question string, answer string, accept array<string>, key_facts array<string>, expect_abstain boolean, mode string, notes string"
MANIFEST_SCHEMA = "format string, id string, name string, version string, license string, source string, created string, language string, docs long, chunks long, text_codec string, url_template string, files map<string,struct<bytes:long,sha256:string>>"


def expand(spark: SparkSession, patterns: list[str]) -> list[str]:
    """The files that glob patterns match, sorted within each pattern; a pattern without any is an error."""
    hadoop, out = spark._jvm.org.apache.hadoop.fs, []
    for pattern in patterns:
        at = hadoop.Path(pattern)
        found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
        names = sorted(s.getPath().toString() for s in found or [])
        if not names:
            raise FileNotFoundError(f"nothing matches {pattern}")
        out += names
    return out


def read_parquet_articles(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``title, paras, url``; only these columns are scanned."""
    return spark.read.parquet(*([path] if isinstance(path, str) else path)).select("title", tx.paragraphs(F.coalesce("text", F.lit(""))).alias("paras"), "url")


def read_jsonl_articles(spark: SparkSession, path: str) -> DataFrame:
    """``title, paras, url``; blank lines are skipped and a missing url is null."""
    rows = spark.read.schema("title string, text string, url string").json(path).filter("title is not null or text is not null")
    return rows.select("title", tx.paragraphs(F.coalesce("text", F.lit(""))).alias("paras"), "url")


def read_plain_titles(spark: SparkSession, path: str) -> DataFrame:
    """``title, paras`` of plain text files whose articles are set apart by title lines alone.

    A file is one row of lines, so its order is kept; title lines are found with the line
    after each, and a running count of titles groups lines into articles.  A file is one
    task's work: split a large dump into files first.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\n").alias("lines"))
    lines = files.select("file", F.posexplode("lines").alias("no", "line"))
    w = Window.partitionBy("file").orderBy("no")
    marked = lines.withColumn("title", tx.is_title(F.col("line"), F.coalesce(F.lead("line").over(w), F.lit(""))))
    grouped = marked.withColumn("article", F.sum(F.col("title").cast("int")).over(w)).filter("article > 0 and trim(line) <> ''")
    by = grouped.groupBy("file", "article").agg(F.array_sort(F.collect_list(F.struct("no", "line"))).alias("all"))
    body = F.transform(F.slice("all", 2, F.size("all")), lambda x: x["line"])
    return by.select(F.trim(F.get("all", F.lit(0))["line"]).alias("title"), body.alias("paras"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark questions from JSON lines; blank lines and lines that begin with // are skipped."""
    lines = spark.read.text(path).filter("trim(value) <> '' and not startswith(trim(value), '//')")
    return lines.select(F.from_json("value", QUESTION_SCHEMA).alias("q")).select("q.*")


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(path)
