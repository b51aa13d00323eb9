import hypothesis.strategies as st
import pytest
from hypothesis import given
from pyspark.sql import functions as F

from quarry.functions import scan, stem
from quarry.functions import text as tx
from quarry.functions import vector as vx


@pytest.mark.parametrize(
    ("word", "expected"),
    [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("digitizer", "digit"), ("adjustable", "adjust"), ("controlling", "control"), ("by", "by"), ("straße", "straße"), ("ties", "ti"), ("archaeology", "archaeolog"), ("geology", "geologi")],
)
def test_stem(word, expected):
    assert stem.stem(word) == expected


def test_sentences_keep_abbreviations_and_initials():
    assert scan.sentences("Dr. Smith met J. R. R. Tolkien. They spoke! Was it 3.5 m?\nA line") == ["Dr. Smith met J. R. R. Tolkien.", "They spoke!", "Was it 3.5 m?", "A line"]
    assert scan.sentences("He lives in the U.S. He works.") == ["He lives in the U.S.", "He works."]
    assert scan.sentences("") == []


def test_names():
    assert scan.names("Who signed the Treaty of Versailles, and when did Marie Curie die?") == ["Treaty of Versailles", "Marie Curie"]


@pytest.mark.parametrize(("text", "value"), [("10 − 4", 6.0), ("2 × 3^2", 18.0), ("(1 + 2) * 3", 9.0), ("-2^2", 4.0), ("8/2/2", 2.0), ("1,000 + 1", 1001.0)])
def test_evaluate(text, value):
    assert scan.evaluate(text) == value


@pytest.mark.parametrize("text", ["", "1 +", "a", "1 2 )", "*3"])
def test_evaluate_rejects(text):
    with pytest.raises(ValueError):
        scan.evaluate(text)


def test_equations():
    assert [e[3] for e in scan.equations("2 + 2 = 4 but 3 × 3 = 11")] == [True, False]
    assert scan.equations("born 1999-05-01") == []
    assert scan.equations("1939–1945 = 6")[0][3]


@given(st.text(alphabet="aàéñüAÉ b'", max_size=30))
def test_fold_is_idempotent(text):
    assert scan.fold(scan.fold(text)) == scan.fold(text)


def test_columns(spark):
    row = spark.sql("select \"Einstein's théorie of_1905 costs 1,234.50 or 007\" as t, 'As [1, 3] and [2-4] but [4-2]' as c, 'a <think>x</think>b<think>y' as r")
    got = row.select(
        tx.words(F.col("t")).alias("words"), tx.content_words(F.col("t")).alias("content"), F.array_sort(tx.numbers(F.col("t"))).alias("numbers"), tx.norm_title(F.col("t")).alias("norm"),
        tx.citations(F.col("c")).alias("cites"), tx.strip_reasoning(F.col("r")).alias("bare"), tx.estimate_tokens(F.lit("abcde")).alias("tokens"),
    ).first()
    assert got["words"][:3] == ["einstein", "theorie", "of"]
    assert "of" not in got["content"] and "theorie" in got["content"]
    assert got["numbers"] == ["1234.5", "1905", "7"]
    assert got["norm"].startswith("einstein theorie of 1905")
    assert got["cites"] == [1, 3, 2, 3, 4]
    assert got["bare"] == "a b" and got["tokens"] == 2


def test_vectors(spark):
    got = spark.sql("select array(1d, -1d, 0.5d, 0d) as v").select(vx.sign_code(F.col("v"), 4).alias("code"), vx.quantise(F.col("v")).alias("q"), vx.dot(vx.l2_normalise(F.col("v")), vx.l2_normalise(F.col("v"))).alias("one")).first()
    assert got["code"] == [0b1010] and got["q"]["q"] == [127, -127, 63, 0] or got["q"]["q"] == [127, -127, 64, 0]
    assert abs(got["one"] - 1) < 1e-12
