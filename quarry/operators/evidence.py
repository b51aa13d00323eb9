"""Evidence: sentences of retrieved passages, scored against the question and chosen under a token budget."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scan
from ..functions import text as tx
from ..functions.stem import stem_arrays

# Openings that point back to the sentence before, and date-like text.
ANAPHOR = r"(?i)^(he|she|it|they|this|these|that|those|its|his|her|their|the latter|the former|such|however|in addition|also)\b"
DATE_WANTED = r"(?i)^when\b|\b(what|which) (year|date|century|decade)\b|\bin what year\b"


@dataclass(frozen=True)
class Budget:
    max_tokens: int = 550
    max_sources: int = 5
    min_per_source: int = 1
    relative_floor: float = 0.5
    neighbours: bool = True


def sentence_scores(retrieved: DataFrame, analyzed: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """``qid, src, idx, sentence, score, source`` (the passage's own score) for ``retrieved(qid, rank, title, ord, text, score)`` and
    ``analyzed`` of ``analyze``; a question has few passages, so the rows of a question are few."""
    by = Window.partitionBy("qid")
    src = retrieved.filter(F.col("rank") <= 2 * budget.max_sources).withColumn("top", F.greatest(F.max("score").over(by), F.lit(1e-9)))
    src = src.select("qid", (F.col("rank") - 1).alias("src"), "title", "ord", F.col("score").alias("source"), (F.col("score") / F.col("top")).alias("chunk"), scan.split_sentences(F.coalesce("text", F.lit(""))).alias("ss"))
    each = src.select("qid", "src", "ord", "chunk", "source", stem_arrays(tx.content_words(F.coalesce("title", F.lit("")))).alias("ts"), F.posexplode("ss").alias("idx", "sentence"))
    each = each.withColumn("own", F.array_distinct(stem_arrays(tx.content_words(F.col("sentence"))))).withColumn("n", F.count("*").over(by))
    q = analyzed.select(
        "qid", "type", "wants_number", F.array_distinct(stem_arrays(tx.content_words(F.col("question")))).alias("qs"),
        F.array_distinct(stem_arrays(tx.content_words(F.array_join("entities", " ")))).alias("es"), F.col("question").rlike(DATE_WANTED).alias("wants_date"),
    )
    met = each.select("qid", F.explode("own").alias("stem")).groupBy("qid", "stem").agg(F.count("*").alias("df"))
    total = each.select("qid", "n").distinct()
    weights = q.select("qid", F.explode("qs").alias("stem")).join(met, ["qid", "stem"]).join(total, "qid").groupBy("qid").agg(
        F.map_from_entries(F.collect_list(F.struct("stem", F.log(1 + F.col("n") / F.col("df")).alias("w")))).alias("qw")
    )
    rows = each.join(q, "qid").join(weights, "qid", "left")
    empty = F.expr("cast(map() as map<string,double>)")
    qw = F.coalesce("qw", empty)
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda n, s: n + F.coalesce(F.element_at(qw, s), F.lit(0.0)))
    whole = F.greatest(F.aggregate(F.map_values(qw), F.lit(0.0), lambda n, x: n + x), F.lit(1e-9))
    own = add(F.array_intersect("qs", "own")) / whole
    titled = add(F.array_except(F.array_intersect("qs", "ts"), F.col("own"))) / whole
    entity = F.when(F.size("es") > 0, F.size(F.array_intersect("es", F.array_union("own", "ts"))) / F.size("es")).otherwise(0.0)
    number = F.when((F.col("wants_number") | F.col("wants_date")) & F.col("sentence").rlike(r"\d"), 0.12).otherwise(0.0)
    definitional = F.col("type").isin("LOOKUP", "AMBIGUOUS", "EXPLANATION", "COMPARISON")
    lead = F.when((F.col("ord") == 0) & (F.col("idx") == 0), F.when(definitional, 0.12).otherwise(0.04)).otherwise(0.0)
    length = F.when(F.length("sentence").between(40, 600), 0.0).otherwise(0.1)
    score = 0.55 * own + 0.15 * titled + 0.1 * entity + number + lead + 0.15 * F.col("chunk") - length
    # sentences without content are no candidates (no score), but an anaphor may point back to them
    return rows.select("qid", "src", "idx", "sentence", F.when(F.size("own") > 0, score).alias("score"), "source")


def rerank_semantically(scored: DataFrame, similarities: DataFrame, *, most: int = 48, weight: float = 0.35) -> DataFrame:
    """``scored`` with the similarities ``(qid, src, idx, similarity)`` of a question's best ``most`` sentences,
    scaled to 0..1, added with ``weight``; questions without any keep their scores."""
    by = Window.partitionBy("qid")
    place = F.row_number().over(by.orderBy(F.col("score").desc_nulls_last(), "src", "idx"))
    met = scored.withColumn("__k", F.when(F.col("score").isNotNull(), place)).join(similarities, ["qid", "src", "idx"], "left")
    known = F.when(F.col("__k") <= most, F.col("similarity"))
    low, high = F.min(known).over(by), F.max(known).over(by)
    return met.withColumn("score", F.col("score") + F.coalesce(weight * (known - low) / (high - low + 1e-6), F.lit(0.0))).drop("__k", "similarity")


def _choose(budget: Budget, start_at: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "src", "idx"], ascending=[False, True, True])
        text = {(s, i): t for s, i, t in zip(rows["src"], rows["idx"], rows["sentence"])}
        whole, rows = rows, rows[rows["score"].notna()]
        usable = rows[rows["src"] < budget.max_sources]
        best = rows["score"].max()
        chosen: set[tuple[int, int]] = set()
        used = 0

        def take(src: int, idx: int, back: bool) -> bool:
            nonlocal used
            if (src, idx) in chosen:
                return True
            new = [(src, idx)]
            if budget.neighbours and back and (src, idx - 1) in text and (src, idx - 1) not in chosen:
                new.append((src, idx - 1))
            cost = sum((len(text[n]) + 3) // 4 + 2 for n in new)
            if used + cost > budget.max_tokens:
                return False
            chosen.update(new)
            used += cost
            return True

        first = usable.groupby("src", sort=True).head(budget.min_per_source).sort_values(["src", "score"], ascending=[True, False])
        for r in first[first["score"] >= 0.8 * budget.relative_floor * best].itertuples():
            take(r.src, r.idx, r.back)
        for r in usable[usable["score"] >= max(0.12, budget.relative_floor * best)].itertuples():
            if not take(r.src, r.idx, r.back) and used > 0.95 * budget.max_tokens:
                break
        held = whole[[(s, i) in chosen for s, i in zip(whole["src"], whole["idx"])]]
        out = []
        for src, own in held.groupby("src"):
            parts, last = [], None
            for r in own.sort_values("idx").itertuples():
                if last is not None and r.idx != last + 1:
                    parts.append("…")
                parts.append(r.sentence)
                last = r.idx
            best = own["score"].max()
            out.append((best, src, " ".join(parts), max(best, own["source"].iloc[0])))
        out.sort(key=lambda x: (-x[0], x[1]))
        return pd.DataFrame({"qid": [whole["qid"].iloc[0]] * len(out), "n": range(start_at, start_at + len(out)), "src": [x[1] for x in out], "text": [x[2] for x in out], "score": [x[3] for x in out]})

    return run


def select(scored: DataFrame, budget: Budget = Budget(), *, start_at: int = 1) -> DataFrame:
    """``qid, n, src, text, score``: evidence numbered from ``start_at``, best source first; a score is the best
    sentence's or the passage's own, the larger.  A group is one question's sentences, of at most
    twice ``max_sources`` passages."""
    kind = scored.schema["qid"].dataType.simpleString()
    rows = scored.withColumn("back", F.col("sentence").rlike(ANAPHOR))
    return rows.groupBy("qid").applyInPandas(_choose(budget, start_at), f"qid {kind}, n int, src int, text string, score double")
