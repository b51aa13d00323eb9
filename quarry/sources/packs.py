"""Knowledge packs: a folder of Parquet tables and a manifest with counts and checksums."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest, search
from ..storage import cut, small

TABLES = ("docs", "chunks", "titles", "term_df", "postings", "stats")


def write_pack(articles: DataFrame, path: str, name: str) -> None:
    """Builds and writes the tables of ``articles(doc_id, title, paras, url)``, then the manifest.

    Look-up tables are range-partitioned and sorted by their key, so a filter on it reads few row groups.
    """
    spark = articles.sparkSession
    rows = ingest.accepted(articles)
    ingest.chunks(rows).write.mode("overwrite").parquet(f"{path}/chunks")
    chunks = spark.read.parquet(f"{path}/chunks")
    ingest.doc_table(rows, chunks).write.mode("overwrite").parquet(f"{path}/docs")
    docs = spark.read.parquet(f"{path}/docs")
    kept = rows.join(docs.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    ingest.title_table(kept).repartitionByRange("norm").sortWithinPartitions("norm").write.mode("overwrite").parquet(f"{path}/titles")
    passages = chunks.join(docs.select(F.col("id").alias("doc_id"), "title"), "doc_id")
    write_postings(passages, path, passages.count())
    df = spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.count("*").alias("df")).filter("df >= 2")
    df.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/term_df")
    manifest = {"format": "quarry-pack-1", "id": name, "name": name, "language": "en", "docs": docs.count(), "chunks": chunks.count()}
    manifest["files"] = {r["path"]: {"bytes": r["length"], "sha256": r["sha256"]} for r in file_sums(spark, path).toLocalIterator()}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def write_postings(passages: DataFrame, path: str, n_chunks: int) -> None:
    """``postings``, dealt by ranges of terms and sorted by term, and the row of corpus statistics; the pack's
    ``chunks`` are there already.

    The texts are read once, and blocks of postings are shuffled once.  A token is in one posting, so their
    places are all tokens.
    """
    spark = passages.sparkSession
    parts = search.Parts(spark.read.parquet(f"{path}/chunks"), n_chunks)
    blocks = search.posting_blocks(passages, parts).repartitionById(parts.n, "part").sortWithinPartitions("term", F.get("ids", F.lit(0)))
    search.unblocked(blocks).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/postings")
    n_tokens = spark.read.parquet(f"{path}/postings").agg(F.sum(F.size("positions.pos"))).first()[0] or 0
    spark.createDataFrame([(n_chunks, n_tokens / n_chunks if n_chunks else None)], "n_chunks long, avg_len double").coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


def write_passages(articles: DataFrame, path: str) -> None:
    """A pack of ``articles`` as they are, with a chunk for each paragraph and without a manifest."""
    spark = articles.sparkSession
    ingest.passages(articles).drop("title").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/chunks")
    words = ingest.count_all_words(F.col("paras"))
    articles.select(F.col("doc_id").alias("id"), "title", ingest.prior(words).alias("prior")).write.mode("overwrite").parquet(f"{path}/docs")
    docs = spark.read.parquet(f"{path}/docs").select(F.col("id").alias("doc_id"), "title")
    ingest.title_table(docs).repartitionByRange("norm").sortWithinPartitions("norm").write.mode("overwrite").parquet(f"{path}/titles")
    write_postings(ingest.passages(articles), path, spark.read.parquet(f"{path}/chunks").count())


def pack_passages(spark: SparkSession, path: str, only: DataFrame | None = None) -> DataFrame:
    """``chunk_id, doc_id, ord, title, section, text`` of a written pack; with ``only(chunk_id)`` of those chunks, which
    are picked before their titles are joined."""
    docs = spark.read.parquet(f"{path}/docs").select(F.col("id").alias("doc_id"), "title")
    chunks = spark.read.parquet(f"{path}/chunks")
    if only is not None:
        chunks = cut(chunks.join(small(only), "chunk_id", "left_semi"), "chunks")
        docs = docs.join(small(chunks.select("doc_id").distinct()), "doc_id", "left_semi")
    return chunks.join(docs, "doc_id").select("chunk_id", "doc_id", "ord", "title", "section", "text")


def file_sums(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, sha256`` of a pack's Parquet files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def open_pack(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{path}/{t}") for t in TABLES}


def manifest(spark: SparkSession, path: str) -> DataFrame:
    from .articles import MANIFEST_SCHEMA

    return spark.read.text(f"{path}/manifest").select(F.from_json("value", MANIFEST_SCHEMA).alias("m")).select("m.*")


def sql(spark: SparkSession, path: str, query: str, **args: object) -> DataFrame:
    """A parameterised query over a pack's tables, which it names in braces: ``SELECT ... FROM {chunks} WHERE ord < :n``."""
    held = {t: spark.read.parquet(f"{path}/{t}") for t in TABLES if f"{{{t}}}" in query}
    return spark.sql(query, args=args, **held)


def lookup(table: DataFrame, keys: DataFrame, col: str) -> DataFrame:
    """Rows of a table whose key is among ``keys``."""
    return table.join(keys.select(col).distinct(), col, "left_semi")


def upsert_embedding(spark: SparkSession, path: str, embedding: dict) -> None:
    """Replaces the ``embedding`` entry of a pack's manifest; its other keys stay as they are."""
    held = json.loads(spark.read.text(f"{path}/manifest").first()["value"]) | {"embedding": embedding}
    spark.createDataFrame([(json.dumps(held),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest.new")
    # beside the old one first: a failure before the renames leaves the pack as it was
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = lambda name: hadoop.Path(f"{path}/{name}")
    fs = at("manifest").getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(at("manifest.old"), True)
    if not (fs.rename(at("manifest"), at("manifest.old")) and fs.rename(at("manifest.new"), at("manifest"))):
        raise RuntimeError(f"the manifest of {path} was not replaced; manifest.old and manifest.new hold both forms")
    fs.delete(at("manifest.old"), True)


def discover(spark: SparkSession, root: str) -> DataFrame:
    """``path, id, docs, chunks, total_bytes, error`` for each folder in ``root``: a pack's manifest and
    the size of its files, or why it can't be read.  Folders are listed by the driver, in order."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for s in sorted((s for s in fs.listStatus(hadoop.Path(root)) if s.isDirectory()), key=lambda s: s.getPath().toString()):
        path = s.getPath().toString()
        try:
            m = manifest(spark, path).first()
            out.append((path, m["id"], m["docs"], m["chunks"], fs.getContentSummary(s.getPath()).getLength(), None if m["id"] else "the manifest has no id"))
        except Exception as e:  # a pack that can't be read is a row of its own
            out.append((path, None, None, None, fs.getContentSummary(s.getPath()).getLength(), str(e).splitlines()[0][:200]))
    return spark.createDataFrame(out, "path string, id string, docs long, chunks long, total_bytes long, error string")


def storage_bytes(spark: SparkSession, path: str) -> int:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
