"""A training-data pipeline over ``documents``: five stages, each one operator's decision.

``run(spark, sf_dir)`` applies ``STAGES`` in order.  Each stage gets all that the
one before kept, as a table written to the folder in spark.checkpoint.dir and
read again, so a lost executor never costs more than a stage's own work.  A stage's
working tables, and the table that it has read, are deleted when its own is written.

1.  toxicity: fitted on the labels of the documents at hand; documents predicted
    toxic go.
2.  language ID: fitted on their ``lang``; documents without a language (no
    letters, no language with at least half of the probability, or letters that
    look drawn at random) go.
3.  n-gram Jaccard join: of each class of near duplicates the row with the
    smallest id stays (a null id is the largest; of rows with that id, one).
    Rows are judged by their texts alone, also where an id is null or repeated.
4.  benchmark decontamination: contaminated documents go; from the others the
    spans that benchmark windows cover are cut, and ``n_chars`` follows.
5.  best-fit packing: the pieces of what is left, with their sequence and offset.

A document with a null or empty text is neither toxic nor a duplicate; it goes
in stage 2.  Extra columns of the input are carried through stages 1 to 4.  Empty
tables are no error: without documents there are no pieces, without labels none is
toxic, without languages all documents go in stage 2, without a benchmark none is cut.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, jaccard, langid, packing, toxicity
from quarry.llm.shared import delete, fresh_path, scratch, stash, table

#: SQL cannot express the fitted models; tests hold the stages against brute force.
ORACLE_SQL = None
MIN_LANGUAGE_SHARE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return langid.keep_known(docs, model, least=MIN_LANGUAGE_SHARE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # ids can be null, or stand for several texts: rows are told apart by their place in the stage's table
    keyed = docs.withColumn("__row", F.monotonically_increasing_id())
    linked = jaccard.near_duplicates(keyed, id_col="__row").filter("n_links > 0").select(F.col("doc_id").alias("__row"), "class_id")
    linked = stash(linked.join(keyed.select("__row", "doc_id"), "__row"), "linked")
    first = linked.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__row")).alias("kept"))
    extra = linked.join(first.select(F.col("kept.__row").alias("__row")), "__row", "left_anti").select("__row")
    return keyed.join(extra, "__row", "left_anti").select(*docs.columns)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_languages),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            delete(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
