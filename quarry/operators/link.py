"""Entity linking: word n-grams of questions looked up in a title table."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scan
from ..functions import text as tx
from ..storage import small

# Words that do not need a capital inside a name.
CONNECTING = ["of", "the", "and", "de", "von", "van", "da", "in", "on", "for"]
MAX_GRAM, MAX_LINKED = 6, 6


def question_grams(questions: DataFrame) -> DataFrame:
    """``qid, gram, n, capitalised, strength, single``: n-grams of 1 to 6 words that neither begin nor
    end with a stopword; ``single`` marks words in lower case.  No Python."""
    raw = F.regexp_extract_all(F.coalesce("question", F.lit("")), F.lit(tx.WORD), F.lit(0))
    held = questions.select("qid", tx.words(F.coalesce("question", F.lit(""))).alias("w"), raw.alias("raw"))
    sized = held.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(MAX_GRAM)))).filter(F.size("w") >= F.col("n"))
    placed = sized.select("qid", "w", "raw", "n", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("at"))
    own = placed.select("qid", "n", F.slice("w", F.col("at"), F.col("n")).alias("g"), F.slice("raw", F.col("at"), F.col("n")).alias("r"))
    own = own.filter(~F.get("g", F.lit(0)).isin(tx.STOPWORDS) & ~F.element_at("g", -1).isin(tx.STOPWORDS))
    upper = F.forall(F.zip_with("g", "r", lambda w, r: F.coalesce(r.rlike(r"^[\p{Lu}\p{Nd}]"), F.lit(False)) | w.isin(CONNECTING)), lambda x: x)
    own = own.withColumn("capitalised", upper).filter((F.col("n") > 1) | F.col("capitalised") | (F.length(F.get("g", F.lit(0))) >= 3))
    single = (F.col("n") == 1) & ~F.col("capitalised")
    strength = F.when(single, 0.3).otherwise(F.least(F.lit(1.0), 0.35 + 0.2 * F.col("n") + F.when(F.col("capitalised"), 0.3).otherwise(0.0)))
    return own.select("qid", F.array_join("g", " ").alias("gram"), "n", "capitalised", strength.alias("strength"), single.alias("single"))


def candidates(questions: DataFrame, titles: DataFrame, docs: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """``qid, gram, n, strength, single, doc_id, kind, prior``: grams that are titles or aliases.

    ``entities(qid, entity)`` are looked up with full strength.  Where a question names something
    (a capitalised gram or an entity), its words in lower case are not looked up.
    """
    grams = question_grams(questions)
    if entities is not None:
        given = entities.select("qid", tx.norm_title(F.col("entity")).alias("gram"), F.lit(True).alias("capitalised"), F.lit(1.0).alias("strength"), F.lit(False).alias("single"))
        grams = grams.unionByName(given.withColumn("n", F.size(F.split("gram", " "))))
    by = Window.partitionBy("qid")
    merged = grams.groupBy("qid", "gram", "n").agg(F.max("strength").alias("strength"), F.max("capitalised").alias("named"), F.max("single").alias("single"))
    usable = merged.withColumn("any_named", F.max("named").over(by)).filter("not (single and any_named)")
    # of one title only the first two readings can be chosen, and none of an alias for a word in lower case, which come
    # after all of kind 0: so two rows of a title go on, whatever its number of articles
    sought = titles.join(small(usable.select(F.col("gram").alias("norm")).distinct()), "norm", "left_semi")
    priors = docs.select("doc_id", "prior").join(small(sought.select("doc_id").distinct()), "doc_id", "left_semi")
    read = sought.join(priors, "doc_id", "left").withColumn("prior", F.coalesce("prior", F.lit(0.0)))
    w = Window.partitionBy("norm").orderBy("kind", F.desc("prior"), "doc_id")
    first = read.withColumn("k", F.row_number().over(w)).filter("k <= 2").drop("k")
    hits = first.join(small(usable), first["norm"] == usable["gram"]).filter("kind = 0 or not single")
    return hits.select("qid", "gram", "n", "strength", "single", "doc_id", "kind", "prior")


def _choose(rows: list[dict]) -> list[dict]:
    """The articles of a question's ``n, strength, gram, kind, prior, doc_id``: longer and surer grams first."""
    rows = sorted(rows, key=lambda r: (-(r["n"] * 10 + r["strength"]), r["gram"], r["kind"], -r["prior"], r["doc_id"]))
    met: list[str] = []
    out: dict[int, tuple[float, str]] = {}
    for (_, gram), own in itertools.groupby(rows, key=lambda r: (r["n"] * 10 + r["strength"], r["gram"])):
        if any(gram in m and gram != m for m in met):  # inside a longer one that matched
            continue
        met.append(gram)
        read = list(own)
        first = list({r["doc_id"]: r for r in reversed(read)}.values())[::-1][: 1 if read[0]["kind"] == 0 else 2]
        for r in first:
            out.setdefault(r["doc_id"], (r["strength"] * (0.7 if r["kind"] == 2 else 1.0), gram))
    return [{"doc_id": d, "gram": g, "strength": s, "place": i} for i, (d, (s, g)) in enumerate(list(out.items())[:MAX_LINKED])]


_CHOSEN = [("doc_id", T.LongType()), ("gram", T.StringType()), ("strength", T.DoubleType()), ("place", T.IntegerType())]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(*f) for f in _CHOSEN])))
def _chosen(rows: pd.Series) -> pd.Series:
    return rows.map(_choose)


def link_entities(questions: DataFrame, titles: DataFrame, docs: DataFrame, *, spans: bool = True) -> DataFrame:
    """``qid, doc_id, gram, strength, place``: up to six articles that each question names."""
    entities = None
    if spans:
        entities = questions.select("qid", F.explode(scan.name_spans(F.coalesce("question", F.lit("")))).alias("entity")).filter(~F.lower("entity").isin(tx.QUESTION_WORDS))
    found = candidates(questions, titles, docs, entities)
    held = found.groupBy("qid").agg(F.collect_list(F.struct("n", "strength", "gram", "kind", "prior", "doc_id")).alias("rows"))
    return held.select("qid", F.inline(_chosen("rows")))
