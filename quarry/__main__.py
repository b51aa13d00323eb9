"""Command line: ``python -m quarry build | retrieve | score | info``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import ingest, verify
from .plans import retrieve
from .sources import articles, packs

RESULT = "id string, category string, answer_match boolean, recall double, total_ms double, supported long, checkable long, error string"


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry")
    sub = p.add_subparsers(dest="command", required=True)
    build = sub.add_parser("build", help="a pack from articles (doc_id, title, text, url)")
    build.add_argument("input")
    build.add_argument("pack")
    build.add_argument("--name", default="pack")
    found = sub.add_parser("retrieve", help="ranked passages for questions")
    found.add_argument("input", nargs="?", help="articles; or give packs")
    found.add_argument("--pack", action="append", default=[], help="a written pack; several are searched together")
    found.add_argument("--question", action="append", required=True)
    found.add_argument("--k", type=int, default=10)
    found.add_argument("--no-entities", action="store_true")
    score = sub.add_parser("score", help="summary of a result file by category")
    score.add_argument("results")
    info = sub.add_parser("info", help="manifest and size of packs")
    info.add_argument("--pack", action="append", required=True)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("quarry").getOrCreate()
    if args.command == "retrieve" and bool(args.input) == bool(args.pack):
        raise SystemExit("retrieve takes articles or packs")
    if args.command == "build" or args.command == "retrieve" and args.input:
        rows = ingest.articles(spark.read.parquet(args.input))
    if args.command == "build":
        packs.write_pack(rows, args.pack, args.name)
    elif args.command == "retrieve":
        asked = spark.createDataFrame(list(enumerate(args.question)), "qid long, question string")
        if args.pack:
            hits = retrieve.retrieve_from_packs(asked, {p: p for p in args.pack}, k=args.k, entities=not args.no_entities)
            titles = None
            for p in args.pack:
                own = spark.read.parquet(f"{p}/docs").select(F.lit(p).alias("pack_id"), F.col("id").alias("doc_id"), "title")
                titles = own if titles is None else titles.unionByName(own)
            named = hits.join(titles, ["pack_id", "doc_id"]).select("qid", "rank", "pack_id", "title", F.round("score", 4).alias("score"))
        else:
            hits = retrieve.retrieve(asked, rows, k=args.k, entities=not args.no_entities)
            named = hits.join(rows.select("doc_id", "title"), "doc_id").select("qid", "rank", "title", F.round("score", 4).alias("score"))
        named.orderBy("qid", "rank").show(args.k * len(args.question), truncate=False)
    elif args.command == "score":
        verify.bench_summary(articles.read_results(spark, args.results, RESULT)).orderBy("category").show(truncate=False)
    else:
        for path in args.pack:
            packs.manifest(spark, path).withColumn("total_bytes", F.lit(packs.storage_bytes(spark, path))).show(vertical=True, truncate=False)


if __name__ == "__main__":
    main()
