"""What leaves a task stays small, and results stay those of the plain forms."""

import re

import numpy as np
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.functions import vector as vx
from quarry.operators import ingest, link, search, vectors
from quarry.sources import packs


def _copies(spark, n=300):
    rows = [(i, f"Reef\nlight on the reef {'storm ' * (i % 3)}and salt") for i in range(n)]
    return ingest.passages(ingest.articles(spark.createDataFrame(rows, "doc_id long, text string")))


def test_tasks_send_their_best_hits_alone(spark):
    passages = _copies(spark)
    terms = search.question_terms(spark.createDataFrame([(1, "reef storm salt"), (2, "light storm")], "qid long, question string"))
    index = search.Index(passages, terms)
    asked = search.Asked(index, terms)
    sent = search._scored_lists(index, asked, 5, lambda need, n, score, n1, score1: (n > 0, score))
    assert sent.count() <= 2 * 5 * index.coded.rdd.getNumPartitions() < 600
    every = index.scored(index.coded).join(terms, "stem").groupBy("qid", "chunk_id").agg(F.sum("score").alias("score")).collect()
    for q in (1, 2):
        best = sorted((-round(r["score"], 9), r["chunk_id"]) for r in every if r["qid"] == q)[:5]
        got = search.search_any(index, terms, 5).filter(F.col("qid") == q).orderBy("rank").collect()
        assert [r["chunk_id"] for r in got] == [c for _, c in best]


def test_tasks_send_their_best_phrase_hits_alone(spark):
    phrases = spark.createDataFrame([(1, ["on", "the", "reef"]), (2, ["salt", "reef"])], "qid long, stems array<string>")
    index = search.Index(_copies(spark), phrases.select(F.explode("stems").alias("stem")))
    assert search._phrase_lists(index, phrases, {"p": 5}).count() <= 5 * index.coded.rdd.getNumPartitions() < 300
    got = search.search_phrase(index, phrases, 5).collect()
    assert {r["qid"] for r in got} == {1} and sorted(r["chunk_id"] for r in got) == [1 + i * 3 * ingest.CHUNKS_PER_DOC for i in range(5)]


def test_postings_are_made_without_a_shuffle(spark):
    rows = search.postings(_copies(spark, 6))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    row = rows.filter("term = 'reef'").orderBy("chunk_id").collect()
    assert [tuple(p) for p in row[1]["positions"]] == [("text", 3), ("title", 0)] and row[1]["freq"] == 7 and row[0]["freq"] == 7


def test_fold_of_plain_and_other_texts(spark):
    rows = spark.createDataFrame([("Émile ÀB",), ("ABC d",), ("İx",), (None,)], "t string").select(tx.fold(F.col("t")).alias("a"), tx._fold(F.col("t")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows) and rows[0]["a"] == "emile ab"


def test_vectors_of_codes_and_lists_in_parts(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(240, 8)), 1)
    x[100:160] = x[0]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(4)
    q = rows.filter("id % 20 = 0").select(F.col("id").alias("qid"), "v")
    coded = q.select("qid", vx.sign_code(F.col("v"), 8).alias("qc"))
    found = vectors.nearest_codes(coded, rows.select("id", vx.sign_code(F.col("v"), 8).alias("c")), k=7, block=5)
    ham = ((x[:, None] > 0) != (x[None] > 0)).sum(2)
    assert {(r["qid"], r["id"], r["ham"]) for r in found.collect()} == {(i, int(j), int(ham[i, j])) for i in range(0, 240, 20) for j in np.lexsort((np.arange(240), ham[i]))[:7]}
    # the first ``rerank`` by distance, place of the list and id, with many equal vectors
    centroids = vectors.train_centroids(rows, 6)
    lists = {r["id"]: r["list_id"] for r in vectors.assign(rows, centroids).collect()}
    index = vectors.encode(rows, vectors.assign(rows, centroids), 8)
    c = {r["list_id"]: np.array(r["c"]) for r in centroids.collect()}
    step = np.abs(x).max(1, keepdims=True) / 127 + 1e-12
    near = np.round(x / step) * step
    got = {}
    for r in vectors.search(q, index, centroids, 8, k=60, nprobe=3, rerank=60).collect():
        got.setdefault(r["qid"], set()).add(r["id"])
    for i in range(0, 240, 20):
        order = sorted(c, key=lambda k: (-round(float(x[i] @ c[k]), 9), k))[:3]
        few = sorted((int(ham[i, j]), order.index(lists[j]), j) for j in range(240) if lists[j] in order)[:60]
        assert got[i] == {j for *_, j in few}
    assert near.shape == x.shape


def test_titles_of_many_articles_are_two_rows(spark):
    titles = spark.createDataFrame([("iron tower", i, 0) for i in range(200)] + [("iron tower", 900, 2)], "norm string, doc_id long, kind int")
    docs = spark.createDataFrame([(i, i / 1000) for i in range(200)], "doc_id long, prior double")
    asked = spark.createDataFrame([(i, "Where is the Iron Tower?") for i in range(50)], "qid long, question string")
    assert link.candidates(asked, titles, docs).count() == 100
    got = link.link_entities(asked, titles, docs).collect()
    assert len(got) == 50 and {(r["doc_id"], r["gram"], r["place"]) for r in got} == {(199, "iron tower", 0)}


def test_pack_passages_of_some_chunks(spark, tmp_path):
    rows = ingest.articles(spark.createDataFrame([(i, f"T{i}\nbody {i}") for i in range(5)], "doc_id long, text string"))
    packs.write_passages(rows, f"file://{tmp_path}/p")
    only = spark.createDataFrame([(3 * ingest.CHUNKS_PER_DOC + 1,)], "chunk_id long")
    assert [(r["title"], r["text"]) for r in packs.pack_passages(spark, f"file://{tmp_path}/p", only).collect()] == [("T3", "body 3")]


ODD = ["Émile ÀB’s café—ok", "", None, "a b", "  x1 ", "ß straße İx", "日本 語x", "tail", "q" * 70 + " 7-8_9", "naïve😀smile"]


def test_words_of_bytes_are_index_tokens(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "chunk_id long, text string").withColumns({"title": F.lit("Ti-tle É"), "section": F.lit(None).cast("string")})
    want = {r["chunk_id"]: r["w"] for r in rows.select("chunk_id", search.index_tokens(F.col("text")).alias("w")).collect()}
    for batch in search._slices(search._token_texts(rows.coalesce(1).orderBy("chunk_id")).toArrow().to_batches(), rows=3, most=40):
        assert batch.num_rows <= 3
        length, words = search._words(batch.column("text"))
        at = np.concatenate([[0], np.cumsum(length)])
        assert [words.to_pylist()[a:b] for a, b in zip(at, at[1:])] == [want[i] for i in batch.column("chunk_id").to_pylist()]


def test_postings_are_shuffled_as_blocks(spark, tmp_path):
    texts = {i: f"Salt {i % 7}\n" + " ".join(["reef"] * (i % 3 + 1) + [f"w{i % 50}", "storms"]) for i in range(400)}
    rows = ingest.articles(spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(2))
    packs.write_passages(rows, f"file://{tmp_path}/p")
    held = spark.read.parquet(f"file://{tmp_path}/p/postings")
    want = {}
    for r in ingest.passages(rows).select("chunk_id", *(search.index_tokens(F.col(c)).alias(c) for c in search.WEIGHTS)).collect():
        for c in search.WEIGHTS:
            for pos, w in enumerate(r[c]):
                want.setdefault((search.stem(w), r["chunk_id"]), []).append((c, pos))
    got = {(r["term"], r["chunk_id"]): (r["len"], r["freq"], [tuple(p) for p in r["positions"]]) for r in held.collect()}
    size = {}
    for (_, c), places in want.items():
        size[c] = size.get(c, 0) + len(places)
    assert got == {k: (size[k[1]], sum(search.WEIGHTS[c] for c, _ in v), sorted(v)) for k, v in want.items()} and held.count() == len(want)
    n, avg = spark.read.parquet(f"file://{tmp_path}/p/stats").first()
    assert (n, avg) == (800, sum(size.values()) / 800)
    blocks = search.posting_blocks(ingest.passages(rows))
    assert blocks.count() < len(want) / 4 and blocks.agg(F.max(F.size("ids"))).first()[0] == search._BLOCK
    # a term that most chunks have is dealt over several parts, and every file is in order
    parts = search.Parts(spark.read.parquet(f"file://{tmp_path}/p/chunks"), 800)
    dealt = {r["term"]: r["n"] for r in search.posting_blocks(ingest.passages(rows), parts).groupBy("term").agg(F.countDistinct("part").alias("n")).collect()}
    assert max(dealt.values()) > 1 and min(dealt.values()) == 1
    files = {}
    for r in held.select(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("k"), "term").orderBy("k").collect():
        files.setdefault(r["f"], []).append(r["term"])
    assert all(t == sorted(t) for t in files.values())


def test_titles_of_a_pack_need_no_texts(spark, tmp_path):
    rows = ingest.articles(spark.createDataFrame([(i, f"The Title {i} (x)\nbody") for i in range(5)], "doc_id long, text string"))
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    packs.write_passages(rows.mapInArrow(count, rows.schema), f"file://{tmp_path}/p")
    assert read.value == 3 * 5  # for chunks, documents and postings
    got = spark.read.parquet(f"file://{tmp_path}/p/titles").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, ingest.title_table(rows).collect()))


def _plain_dictionary(texts, top, min_count, max_bytes):
    counts = {}
    for t in texts:
        w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", t or "") if x]
        for n in (2, 3):
            for i in range(len(w) - n + 1):
                counts[" ".join(w[i : i + n])] = counts.get(" ".join(w[i : i + n]), 0) + 1
    used, out = 0, []
    for g, n in sorted(((g, n) for g, n in counts.items() if n >= min_count), key=lambda x: (-x[1], x[0].encode()))[:top]:
        used += len(g.encode()) + 1
        if used <= max_bytes:
            out.append((g, n))
    return out, counts


def test_only_frequent_grams_are_shuffled(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" \n".join(f"w{int(x)}" for x in rng.zipf(1.6, 60) % 500) + "\té ß\x0b x" for _ in range(300)] + [None, "", "  ", "one", " a b"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    for top, least, size in ((20_000, 4, 32_768), (20_000, 4, 300), (25, 4, 32_768), (40, 1, 10**6), (10**6, 1, 10**9)):
        got = [tuple(r) for r in ingest.ngram_dictionary(rows, top=top, min_count=least, max_bytes=size).orderBy(F.desc("n"), "gram").collect()]
        assert got == _plain_dictionary(texts, top, least, size)[0]
    want, counts = _plain_dictionary(texts, 25, 4, 32_768)
    met = ingest._gram_counters(rows)
    assert met.sum() == sum(counts.values())
    sent = ingest._grams(rows, met >= np.sort(met)[::-1][25])
    assert sent.count() < 60 < len(counts) / 10
    # counters that say too much put the least count too high at first; it goes down until the result is whole
    full = met.copy()
    full[np.flatnonzero(met == 0)[:100]] = 10**6
    monkeypatch.setattr(ingest, "_gram_counters", lambda _: full)
    assert sorted(map(tuple, ingest.ngram_dictionary(rows, top=25).collect())) == sorted(want)
    empty = spark.createDataFrame([], "text string")
    monkeypatch.undo()
    assert ingest.ngram_dictionary(empty).count() == 0
