import sqlite3

import numpy as np
from pyspark.sql import functions as F

from quarry import queries
from quarry.operators import analyze, evidence, ingest, search, vectors, verify
from quarry.plans import research, retrieve
from quarry.sources import articles as src
from quarry.sources import packs

DOCS = [
    (1, "Lighthouse of Corva\nThe lighthouse of Corva was completed in 1871 by Ada Winter. It guides ships past the northern reef every night of the year.\nRepairs took place after the storm."),
    (2, "River Teal\nThe River Teal flows from the hills to the bay. It floods the meadows each spring and fills the old mill pond near the bridge."),
    (3, "Copper\nCopper is a metal that conducts heat well. Smiths use copper for kettles and for the bells of the harbour chapel near the lighthouse."),
    (4, "Salt trade\nThe salt trade linked the bay with inland towns. Barges on the River Teal carried salt until the railway was built through the hills."),
]


def _articles(spark):
    return ingest.articles(spark.createDataFrame(DOCS, "doc_id long, text string"))


def test_bm25_equals_sqlite(spark):
    rows = ingest.passages(_articles(spark)).select("chunk_id", "title", "section", "text").collect()
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(title, section, body, tokenize='porter unicode61 remove_diacritics 2')")
    db.executemany("insert into f(rowid, title, section, body) values (?, ?, ?, ?)", [tuple(r) for r in rows])
    expected = dict(db.execute("select rowid, -bm25(f, 6.0, 2.0, 1.0) from f where f match '\"lighthouse\" OR \"salt\" OR \"river\"'").fetchall())
    q = spark.createDataFrame([(1, "lighthouse salt river")], "qid long, question string")
    terms = search.question_terms(q)
    index = search.Index(ingest.passages(_articles(spark)), terms)
    got = {r["chunk_id"]: r["score"] for r in search.search_any(index, terms, 50).collect()}
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)
    phrase = dict(db.execute("select rowid, -bm25(f, 6.0, 2.0, 1.0) from f where f match '\"river teal\"'").fetchall())
    stems = spark.createDataFrame([(1, ["river", "teal"])], "qid long, stems array<string>")
    index = search.Index(ingest.passages(_articles(spark)), stems.select(F.explode("stems").alias("stem")))
    got = {r["chunk_id"]: r["score"] for r in search.search_phrase(index, stems).collect()}
    assert got.keys() == phrase.keys() and all(abs(got[k] - phrase[k]) < 1e-9 for k in got)


def test_research_finds_the_year(spark):
    q = spark.createDataFrame([(1, "When was the lighthouse of Corva completed?")], "qid long, question string")
    hits = retrieve.retrieve(q, _articles(spark), entities=True).collect()
    assert hits[0]["doc_id"] == 1 or min(hits, key=lambda r: r["rank"])["doc_id"] == 1
    assert all(sum(h["doc_id"] == d for h in hits) <= 2 for d in {h["doc_id"] for h in hits})
    out = research.research(q, _articles(spark)).first()
    assert "1871" in out["answer"] and not out["abstained"] and out["citation_errors"] == 0


def test_chunks_keep_words_and_sections():
    paras = ["Intro text here. " * 5, "History", "word " * 240 + ". Next one.", "References", "gone", "Later Part", "kept text."]
    got = list(ingest.chunk_paragraphs(paras))
    assert [s for s, _ in got][0] == "" and "History" in {s for s, _ in got} and "gone" not in " ".join(t for _, t in got)
    assert got[-1] == ("Later Part", "kept text.")


def test_question_types(spark):
    asked = [("Which is larger, the lake or the sea?", "COMPARISON"), ("Why does iron rust?", "EXPLANATION"), ("Mercury", "AMBIGUOUS"), ("Who was the first mayor?", "LOOKUP"), ("How many years passed between the wars?", "NUMERIC"), ("Give an overview of the salt trade", "SYNTHESIS"), ("Where was the author of the book about bees born?", "MULTIHOP")]
    rows = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(asked)], "qid int, question string")
    got = {r["qid"]: r["type"] for r in analyze.analyze(rows).collect()}
    assert [got[i] for i in range(len(asked))] == [t for _, t in asked]
    routes = {r["qid"]: r for r in analyze.route(analyze.analyze(rows)).collect()}
    assert routes[6]["hops"] and not routes[3]["plan"] and routes[0]["role"] == "STRONG"


def test_verdicts(spark):
    answers = spark.createDataFrame([(1, "The bridge was built in 1932 [1]. The bridge was built in 1950 [1]. Purple elephants dance weekly [1]. It stands [9].")], "aid int, answer string")
    proof = spark.createDataFrame([(1, 1, "Bridge", "The bridge was built in 1932.")], "aid int, n int, title string, text string")
    asked = spark.createDataFrame([(1, "When was it built?", False)], "aid int, question string, numeric boolean")
    got = verify.check(verify.claims(answers), proof, asked).orderBy("pos").collect()
    assert [r["verdict"] for r in got] == ["SUPPORTED", "UNSUPPORTED", "UNSUPPORTED", "NOT_A_CLAIM"] and got[3]["invalid"] == [9]


def test_vector_search_ranks_the_query_first(spark):
    rows = spark.createDataFrame([(10, [1.0] + [0.0] * 15), (20, [0.0, 1.0] + [0.0] * 14), (30, [0.6, 0.8] + [0.0] * 14)], "id long, v array<double>")
    centroids = vectors.train_centroids(rows, 1)
    index = vectors.encode(rows, vectors.assign(rows, centroids), 16)
    q = spark.createDataFrame([(1, [0.0, 1.0] + [0.0] * 14)], "qid long, v array<double>")
    got = vectors.search(q, index, centroids, 16, k=2, nprobe=1, rerank=3).orderBy("rank").collect()
    assert [r["id"] for r in got] == [20, 30]


def test_pack_round_trip(spark, tmp_path):
    rows = _articles(spark).withColumn("paras", F.concat("paras", "paras", "paras"))
    packs.write_pack(rows, f"file://{tmp_path}/pack", "tiny")
    held = packs.open_pack(spark, f"file://{tmp_path}/pack")
    assert held["docs"].count() == 4 and held["chunks"].count() >= 4
    m = packs.manifest(spark, f"file://{tmp_path}/pack").first()
    assert m["docs"] == 4 and len(m["files"]) > 4
    assert packs.lookup(held["titles"], spark.createDataFrame([("river teal",)], "norm string"), "norm").first()["doc_id"] == 2


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"title": "A", "text": "x\\n\\ny"}\n\n')
    assert [r["paras"] for r in src.read_jsonl_articles(spark, f"file://{tmp_path}/a.jsonl").collect()] == [["x", "y"]]
    (tmp_path / "plain.txt").write_text("Blue Whale\nThe blue whale is a very large animal that lives in the ocean and eats krill.\nIt sings.\nOak Tree\nAn oak tree is a plant with strong wood, and it gives acorns in autumn each year.\n")
    got = {r["title"]: len(r["paras"]) for r in src.read_plain_titles(spark, f"file://{tmp_path}/plain.txt").collect()}
    assert got == {"Blue Whale": 2, "Oak Tree": 1}
    (tmp_path / "q.jsonl").write_text('// note\n{"id": "q1", "question": "Why?", "extra": 1}\n\n')
    assert src.read_questions(spark, f"file://{tmp_path}/q.jsonl").first()["question"] == "Why?"


def test_streaming_ingest_is_incremental(spark, tmp_path):
    from quarry.streaming import incremental

    schema = "doc_id long, text string"
    for i, d in enumerate(DOCS[:2]):
        spark.createDataFrame([d], schema).write.mode("append").parquet(f"{tmp_path}/in")
        incremental.ingest_new_files(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out").select("doc_id").distinct().count() == i + 1


def test_vector_search_recall(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    nlist = vectors.list_count(len(x))
    centroids = vectors.train_centroids(rows, nlist)
    index = vectors.encode(rows, vectors.assign(rows, centroids), 64)
    asked = rows.filter("id % 20 = 0").withColumnRenamed("id", "qid")
    truth = {q: set(np.argsort(-(x @ x[q]))[:10].tolist()) for q in range(0, len(x), 20)}
    for shares, least in (({}, 0.9), ({"probe_share": 1, "rerank_share": 1}, 0.97)):
        found = {}
        for r in vectors.search(asked, index, centroids, 64, **vectors.effort(len(x), nlist, **shares)).collect():
            found.setdefault(r["qid"], set()).add(r["id"])
        assert sum(len(truth[q] & found[q]) for q in truth) >= least * 10 * len(truth)


def test_comparands_of_all_questions(spark, tmp_path):
    asked = [(1, "compare iron and gold"), (2, "tea vs milk?"), (3, "Who was it?")]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["qid"]: r["things"] for r in queries.QUERIES["comparands"](spark, str(tmp_path)).collect()}
    assert len(got) == len(asked) + len(queries.ASKED) and got[1] == "iron|gold" and got[2] == "tea|milk" and not got[3]
