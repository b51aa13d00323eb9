import sqlite3
import zlib

import pytest
from pyspark.sql import functions as F

from quarry.__main__ import main
from quarry.functions import text as tx
from quarry.functions import vector as vx
from quarry.operators import analyze, ingest, search, vectors, verify
from quarry.plans import dialogue, research, retrieve
from quarry.sources import foreign, results


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, kept",
    [("<think>a</think> b", "b"), ("a</think>b<think>c", "b"), ("plain ", "plain"), ("<think>a</think> b </think> c", "b </think> c"), ("<think>only", ""), (None, None)],
)
def test_strip_reasoning(spark, text, kept):
    assert one(spark, tx.strip_reasoning(F.col("t").cast("string")), t=text) == kept


def test_strip_citations(spark):
    assert one(spark, tx.strip_citations(F.col("t")), t="It is red [1], or blue [2-3].") == "It is red, or blue."


def test_substitute_and_echo(spark):
    answers = F.array(F.lit("Oslo"), F.lit(" "))
    assert one(spark, research.substitute(F.col("q"), answers), q="Where is #1, near #2 and #3?") == "Where is Oslo, near it and it?"
    assert one(spark, research.echoes(F.col("a"), F.col("q")), a="the bridge [1]", q="When was the bridge built?")
    assert not one(spark, research.echoes(F.col("a"), F.col("q")), a="", q="When was the bridge built?")


def test_follow_up_counts_words(spark):
    assert one(spark, analyze.is_follow_up(F.col("q"), F.lit(0)), q="tea - or - coffee?")
    assert not one(spark, analyze.is_follow_up(F.col("q"), F.lit(0)), q="Name four large northern rivers")


def test_model_output(spark):
    plan = one(spark, dialogue.parse_plan(F.col("o")), o='Plan {"type": "multihop", "subquestions": ["  Who? ", "no"], "queries": ["q", ""]}')
    assert (plan["type"], plan["subquestions"], plan["queries"]) == ("MULTIHOP", ["Who?"], ["q"])
    assert one(spark, dialogue.parse_plan(F.col("o").cast("string")), o=None)["type"] == "AMBIGUOUS"
    assert one(spark, dialogue.parse_titles(F.col("o")), o='Try: ["Salt", "x", "Iron ", "Tin", "Zinc"]') == ["Salt", "Iron", "Tin"]
    assert one(spark, dialogue.parse_titles(F.col("o")), o="none") == []


def test_hops(spark):
    answers = F.array(F.lit("Ada"), F.lit("Bern"))
    got = lambda q, before: one(spark, dialogue.hop_entities(F.col("q"), answers, F.col("b").cast("string")), q=q, b=before)
    assert got("Where did #1 live?", None) == ["Ada"]
    assert got("Where was the author born?", "Who was the author?") == ["Bern"] and got("How tall is it?", "Who was the author?") == []
    note = dialogue.hop_note(F.col("q"), F.col("a"), F.array(F.lit("T"), F.lit("T"), F.lit("U"), F.lit("V")))
    assert one(spark, note, q="Who?", a="Ada [1].") == "Who? → Ada. (from: T; U)"
    told = one(spark, dialogue.refusal(F.array().cast("array<string>"), F.array(F.lit("salt")), F.array(F.lit("Sea"))), q="")
    assert "salt" in told and "Sea" in told


def test_correction(spark):
    checks = F.array(*(F.struct(F.lit(e).alias("expression"), F.lit(c).alias("claimed"), F.lit(a).alias("actual"), F.lit(ok).alias("ok")) for e, c, a, ok in [("12 × 4", 50.0, 48.0, False), ("1 + 1", 2.0, 2.0, True)]))
    assert one(spark, dialogue.correction(checks), q="") == "Correction: 12 × 4 = 48, not 50."
    assert one(spark, dialogue.correction(F.filter(checks, lambda c: c["ok"])), q="") is None


def test_history_and_model_check(spark):
    turns = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (1, 5, "The sources do not mention it."), (1, 7, "c"), (2, 1, None)], "conv_id int, turn int, answer string")
    assert sorted((r["turn"], r["back"]) for r in dialogue.history(turns).collect()) == [(3, 2), (7, 1)]
    checked = spark.createDataFrame([(1, 0, "x", [1], "WEAK"), (1, 1, "y", [], "SUPPORTED"), (1, 2, "z", [], "UNCITED"), (2, 0, "w", [], "UNCITED")], "aid int, pos int, claim string, cites array<int>, verdict string")
    sent = dialogue.to_model_check(checked)
    assert sorted((r["aid"], r["pos"], r["k"]) for r in sent.collect()) == [(1, 0, 0), (1, 2, 1), (2, 0, 0)]
    proof = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (3, 1)], "aid int, n int")
    assert sorted(map(tuple, dialogue.evidence_for_check(sent, proof).collect())) == [(1, 1), (2, 1), (2, 2)]
    assert dialogue.flagged(checked).count() == 2
    after = verify.apply_model_verdicts(checked.withColumn("numbers_ok", F.lit(True)), sent.select("aid", "pos", "k"), spark.createDataFrame([(1, "SU")], "aid int, letters string"))
    assert {(r["aid"], r["pos"]): r["verdict"] for r in after.collect()} == {(1, 0): "SUPPORTED", (1, 1): "SUPPORTED", (1, 2): "UNSUPPORTED", (2, 0): "UNCITED"}


def test_matryoshka_has_length_one(spark):
    v = F.array(*(F.lit(float(x)) for x in [3, 1, -2, 5]))
    got = one(spark, vx.matryoshka(v, 2, layernorm=True), q=0)
    assert len(got) == 2 and abs(sum(x * x for x in got) - 1) < 1e-9 and got[0] > 0 > got[1]
    assert one(spark, vx.l2_normalise(F.array(F.lit(0.0), F.lit(0.0))), q=0) == [0.0, 0.0]


def test_sqlite_pack(spark, tmp_path):
    words = b"river bridge salt"
    pack = zlib.compressobj(9, zlib.DEFLATED, 15, 9, zlib.Z_DEFAULT_STRATEGY, words)
    with sqlite3.connect(tmp_path / "p.sqlite") as db:
        db.executescript("CREATE TABLE meta(key TEXT PRIMARY KEY, value BLOB); CREATE TABLE chunks(id INTEGER PRIMARY KEY, doc_id INT, ord INT, section TEXT, text BLOB); CREATE TABLE titles(norm TEXT, doc_id INT, kind INT)")
        db.execute("INSERT INTO meta VALUES ('zdict', ?)", (words,))
        db.executemany("INSERT INTO chunks VALUES (?, 1, ?, '', ?)", [(1, 0, pack.compress(b"salt of the river") + pack.flush()), (5, 1, None)])
        db.execute("INSERT INTO titles VALUES ('salt', 1, 0)")
    got = foreign.read_sqlite_pack(spark, str(tmp_path / "p.sqlite"), "chunks", rows=2).orderBy("id")
    assert [(r["id"], r["text"]) for r in got.collect()] == [(1, "salt of the river"), (5, "")]
    assert foreign.read_sqlite_pack(spark, str(tmp_path / "p.sqlite"), "titles").first()["norm"] == "salt"


@pytest.mark.parametrize("dim", [16, 72])
def test_vector_file_round_trip(spark, tmp_path, dim):
    rows = spark.createDataFrame([(10 * i, [float((i * j) % 7 - 3) + 0.5 for j in range(1, dim + 1)]) for i in range(1, 8)], "id long, v array<double>")
    centroids = vectors.train_centroids(rows, 2)
    index = vectors.encode(rows, vectors.assign(rows, centroids), dim).cache()
    foreign.write_vector_file(index, centroids, str(tmp_path / "v.kvec"), dim)
    back, c = foreign.read_vector_file(spark, str(tmp_path / "v.kvec"), rows=3)
    key = lambda df: {r["id"]: (r["list_id"], list(r["code"]), list(r["q"]), round(r["scale"], 6)) for r in df.collect()}
    assert key(back) == key(index) and c.count() == centroids.count()
    (tmp_path / "bad").write_bytes(b"x" * 40)
    with pytest.raises(ValueError):
        foreign.layout(str(tmp_path / "bad"))


def test_results_and_command_line(spark, tmp_path, capsys):
    asked = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "id string, category string")
    assert [r["id"] for r in results.select_questions(asked, per_category=1).orderBy("id").collect()] == ["a", "c"]
    results.append_results(asked.filter("id = 'a'"), f"{tmp_path}/r")
    assert results.not_yet_done(asked, spark.read.json(f"{tmp_path}/r")).count() == 2
    done = spark.createDataFrame([("a", "q", 'say "x"', ["s", "t"])], "id string, question string, answer string, sources array<string>")
    results.write_grading_sheet(done, spark.createDataFrame([("a", "g")], "id string, answer string"), f"{tmp_path}/sheet")
    row = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/sheet").first()
    assert row["sources"] == "s | t" and row["gold"] == "g" and row["answer"] == 'say "x"'
    text = "\n".join(f"The river meets the salt sea near the town {i}." for i in range(20))
    spark.createDataFrame([(1, f"Rivers\n{text}", "en", "s", 10)], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/docs")
    main(["build", f"{tmp_path}/docs", f"{tmp_path}/pack", "--name", "tiny"], spark)
    main(["info", "--pack", f"{tmp_path}/pack"], spark)
    main(["retrieve", f"{tmp_path}/docs", "--question", "Where is the salt sea?", "--k", "2"], spark)
    assert "tiny" in capsys.readouterr().out


def test_entity_lists(spark):
    docs = [(1, "Castles\nThe Iron Tower stands on a hill."), (2, "Metals\nIron is a metal. A tower of salt."), (3, "Hills\nThe hill is green."), (4, "Old\nThey saw the iron tower once.")]
    rows = ingest.articles(spark.createDataFrame(docs, "doc_id long, text string"))
    asked = spark.createDataFrame([(7, "Where does the Iron Tower stand on a hill?")], "qid int, question string")
    phrases, terms, passages = retrieve.entity_phrases(asked), search.question_terms(asked), ingest.passages(rows)
    assert [r["words"] for r in phrases.collect()] == [["iron", "tower"]]
    index = search.Index(passages, terms)
    got = search.search_entities(index, phrases, search.rarity(index, terms, share=2.0, min_df=1))
    texts = {r["chunk_id"]: r["doc_id"] for r in passages.collect()}
    found = {}
    for r in got.collect():
        found.setdefault(r["signal"], set()).add(texts[r["chunk_id"]])
        assert r["qid"] == 7
    assert found == {"bm25_phrase": {1, 4}, "bm25_ent_and": {1}}
    assert retrieve.retrieve(asked, rows, k=2, entities=True).filter("rank = 1").first()["doc_id"] == 1
