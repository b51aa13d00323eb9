import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_retrieval import DOCS, _articles

from quarry.__main__ import main
from quarry.operators import bench, evidence, ingest, vectors, verify
from quarry.plans import research, retrieve
from quarry.sources import articles as src
from quarry.sources import packs


def _hits(frame):
    return sorted((r["qid"], r["rank"], r["chunk_id"], r["doc_id"], round(r["score"], 9)) for r in frame.collect())


def test_packs_give_what_articles_give(spark, tmp_path):
    rows = _articles(spark)
    asked = spark.createDataFrame([(1, "When was the lighthouse of Corva completed?"), (2, "salt barges on the River Teal"), (3, "")], "qid long, question string")
    plan = spark.createDataFrame([(2, 0, "copper kettles"), (2, 1, "salt")], "qid long, i int, query string")
    packs.write_passages(rows, f"file://{tmp_path}/all")
    for how in ({}, {"entities": True}, {"queries": plan}):
        got = retrieve.retrieve_from_packs(asked, {"all": f"file://{tmp_path}/all"}, **how)
        assert _hits(got) == _hits(retrieve.retrieve(asked, rows, **how)) and {r["pack_id"] for r in got.collect()} == {"all"}
    assert {r["doc_id"] for r in retrieve.retrieve(asked, rows, queries=plan).filter("qid = 2").collect()} >= {3, 4}


def test_several_packs_have_their_own_statistics(spark, tmp_path):
    asked = spark.createDataFrame([(1, "salt barges and repairs after the storm")], "qid long, question string")
    halves = [_articles(spark).filter(f"doc_id % 2 = {k}") for k in (0, 1)]
    for k, rows in enumerate(halves):
        packs.write_passages(rows, f"file://{tmp_path}/p{k}")
    got = retrieve.retrieve_from_packs(asked, {f"p{k}": f"file://{tmp_path}/p{k}" for k in (0, 1)}, entities=True).collect()
    assert {(r["pack_id"], r["doc_id"]) for r in got} >= {("p0", 4), ("p1", 1)} and all((r["doc_id"] % 2 == 0) == (r["pack_id"] == "p0") for r in got)


def test_discovery_and_manifests(spark, tmp_path, capsys):
    long = _articles(spark).withColumn("paras", F.concat("paras", "paras", "paras"))
    packs.write_pack(long, f"file://{tmp_path}/packs/good", "tiny")
    (tmp_path / "packs/broken").mkdir()
    packs.upsert_embedding(spark, f"file://{tmp_path}/packs/good", {"dim": 8})
    held = json.loads(spark.read.text(f"file://{tmp_path}/packs/good/manifest").first()["value"])
    assert held["embedding"] == {"dim": 8} and held["id"] == "tiny" and not (tmp_path / "packs/good/manifest.old").exists()
    found = packs.discover(spark, f"file://{tmp_path}/packs").collect()
    assert [(r["path"].rsplit("/", 1)[1], r["id"], r["error"] is None) for r in found] == [("broken", None, False), ("good", "tiny", True)] and found[1]["total_bytes"] > 0
    main(["retrieve", "--pack", f"file://{tmp_path}/packs/good", "--question", "Where is the River Teal?", "--k", "2"], spark)
    assert "River Teal" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["retrieve", "--question", "x"], spark)


def test_expand_sorts_and_fails_on_nothing(spark, tmp_path):
    for n in ("b.txt", "a.txt", "c.md"):
        (tmp_path / n).write_text("x")
    assert [p.rsplit("/", 1)[1] for p in src.expand(spark, [f"{tmp_path}/*.md", f"{tmp_path}/*.txt"])] == ["c.md", "a.txt", "b.txt"]
    with pytest.raises(FileNotFoundError):
        src.expand(spark, [f"{tmp_path}/*.none"])


def test_vectors_of_empty_tables_and_in_blocks(spark, tmp_path):
    none = spark.createDataFrame([], "id long, v array<double>")
    centroids = vectors.train_centroids(none, 4)
    assert centroids.count() == 0 and vectors.assign(none, centroids).count() == 0
    x = np.random.default_rng(3).normal(size=(300, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "id long, v array<double>").repartition(5)
    asked = rows.filter("id % 20 = 0 and id < 300").withColumnRenamed("id", "qid")
    truth = {q: sorted(range(300), key=lambda i: (-round(float(x[q] @ x[i]), 9), i))[:7] for q in range(0, 300, 20)}
    for block in (4, 1000):
        got = {}
        for r in vectors.nearest(asked, rows, k=7, block=block).orderBy("qid", "rank").collect():
            got.setdefault(r["qid"], []).append(r["id"])
        assert got == truth
    centroids = vectors.train_centroids(rows, 10)
    c = {r["list_id"]: np.array(r["c"]) for r in centroids.collect()}
    lists = vectors.assign(rows, centroids)
    assert {r["id"]: r["list_id"] for r in lists.collect()} == {i: max(c, key=lambda j: (round(float(x[i] @ c[j]), 9), -j)) for i in range(300)}
    vectors.write_index(vectors.encode(rows.filter("v is not null"), lists, 16), f"file://{tmp_path}/index")
    index = spark.read.parquet(f"file://{tmp_path}/index")
    hits = vectors.search(asked, index, centroids, 16, k=1, nprobe=10, rerank=300).collect()
    assert sum(r["id"] == truth[r["qid"]][0] for r in hits) >= 14
    with pytest.raises(Exception, match="differ in length"):
        vectors.train_centroids(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, v array<double>"), 1)


def test_an_anaphor_takes_the_sentence_before_it(spark):
    text = "Not now! It has a red lighthouse on the harbour wall of Corva town."
    found = spark.createDataFrame([(1, 1, "Corva", 0, text, 2.5)], "qid long, rank int, title string, ord int, text string, score double")
    asked = spark.createDataFrame([(1, "red lighthouse of Corva", "LOOKUP", False, ["Corva"])], "qid long, question string, type string, wants_number boolean, entities array<string>")
    scored = evidence.sentence_scores(found, asked)
    got = evidence.select(scored, start_at=4).first()
    assert got["text"] == text and got["n"] == 4 and got["score"] == 2.5
    assert evidence.select(scored.limit(0)).count() == 0
    near = spark.createDataFrame([(1, 0, 1, 0.9)], "qid long, src int, idx int, similarity double")
    assert evidence.rerank_semantically(scored, near).filter("score is not null").count() == 1


def test_lenient_matches(spark):
    rows = [("The Bridge of 1932 was long.", "bridge of 1932"), ("They built bridges in 1932", "1932 bridge building"), ("in 1933", "1932"), ("x", ""), ("x", None), (None, "x"), ("two rivers meet", "the river meeting")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, answer string, target string")
    got = {r["id"]: r["ok"] for r in verify.matches(frame).collect()}
    assert [got[i] for i in range(len(rows))] == [True, False, False, False, False, False, True]


def test_result_rows(spark):
    gold = spark.createDataFrame([("a", "factual", "Who?", "Ada", ["Ada Winter"], ["reef", "1871"], False), ("b", "x", "What?", "", None, None, True)], "id string, category string, question string, answer string, accept array<string>, key_facts array<string>, expect_abstain boolean")
    told = spark.createDataFrame([("a", "Ada Winter lit it in 1871.", 1200), ("b", "The sources do not mention it.", 10)], "id string, answer string, total_ms long")
    proof = spark.createDataFrame([("a", 1, "p", "Corva", "", 7, "text")], "id string, n int, pack string, title string, section string, chunk_id long, text string")
    hops = spark.createDataFrame([("a", 0, "Where?", None), ("a", 1, "Who?", "Ada")], "id string, pos int, question string, answer string")
    rows = {r["id"]: r for r in bench.to_results(gold, told, proof, hops=hops).collect()}
    assert (rows["a"]["answer_match"], rows["a"]["key_fact_recall"], rows["a"]["abstain_correct"], rows["a"]["hops"]) == (True, 0.5, True, ["Where? => NOT FOUND", "Who? => Ada"])
    assert rows["a"]["sources"][0]["chunk_id"] == 7 and (rows["b"]["answer_match"], rows["b"]["key_fact_recall"], rows["b"]["abstained"], rows["b"]["abstain_correct"]) == (None, None, True, True)
    assert len(rows["a"]) == 33 and bench.summary(bench.to_results(gold, told)).count() == 3


def test_dense_ids_of_any_type(spark):
    names = [f"k{(i * 37) % 101:03}" for i in range(101)]
    got = ingest.dense_ids(spark.createDataFrame([(n,) for n in names], "key string").repartition(6), ["key"]).collect()
    assert {r["key"]: r["id"] for r in got} == {n: i + 1 for i, n in enumerate(sorted(names))}
    assert ingest.dense_ids(spark.createDataFrame([], "key string"), ["key"]).count() == 0
    chunked = ingest.chunks(spark.createDataFrame([(d, [f"Some words that go on {i}. " * 30 for i in range(6)]) for d in (1, 2)], "doc_id long, paras array<string>"), lead_only_after=1)
    n = {r["doc_id"]: r["count"] for r in chunked.groupBy("doc_id").count().collect()}
    assert n[2] == 2 < n[1]
    with pytest.raises(ValueError):
        ingest.scope(chunked, chunked, "best:3")


def test_research_over_documents(spark):
    asked = spark.createDataFrame([(1, "When was the lighthouse of Corva completed?"), (2, "Which quasar rotates?")], "qid long, question string")
    out = {r["aid"]: r for r in research.research(asked, _articles(spark)).collect()}
    assert "1871" in out[1]["answer"] and len(DOCS) == 4
