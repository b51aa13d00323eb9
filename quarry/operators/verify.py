"""Checking answers: claims, citations, support in evidence, verdicts, lenient matching, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scan
from ..functions import text as tx
from ..functions.stem import stem_arrays

# Calculation marks, headings, and statements about the sources themselves.
CALC = r"(?i)[=×÷*/+]|\b(times|divided|multiplied|minus|plus|approximately|about|roughly|total|sum|difference|ratio|per cent|percent)\b"
HEADING = r"^(#+\s|\*\*[^*]+\*\*:?$|[-|: ]+$)"
META = r"(?i)\b(the )?(provided |available |offline |cited )?(sources?|text|passages?|documents?|library)\b.{0,60}\b(do(es)? not|don't|doesn't|not|no|lack|omit|fail|missing|mention)|\b(not (stated|mentioned|specified|given|provided)|no information|cannot (be )?determined|is missing)\b"


def claims(answers: DataFrame) -> DataFrame:
    """``aid, pos, claim``: sentences, list items and whole table rows of ``answers(aid, answer)``."""
    bare = F.transform(F.split(F.coalesce("answer", F.lit("")), r"\r?\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(x), "^- ", ""), r"^\* ", ""), "^• ", "")))
    lines = answers.select("aid", F.posexplode(F.filter(bare, lambda x: x != "")).alias("line", "text"))
    units = F.when(F.col("text").startswith("|"), F.array("text")).otherwise(scan.split_sentences("text"))
    each = lines.select("aid", "line", F.posexplode(units).alias("i", "claim"))
    return each.groupBy("aid").agg(F.array_sort(F.collect_list(F.struct("line", "i", "claim"))).alias("c")).select("aid", F.posexplode("c").alias("pos", "x")).select("aid", "pos", F.col("x.claim").alias("claim"))


def cited(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """Citations of ``rows(aid, pos, claim)``: ``aid, pos, n, valid`` against ``evidence(aid, n)``."""
    each = rows.select("aid", "pos", F.explode(tx.citations(F.col("claim"))).alias("n"))
    known = evidence.select("aid", F.col("n").cast("int").alias("n"), F.lit(True).alias("known")).distinct()
    return each.join(known, ["aid", "n"], "left").select("aid", "pos", "n", F.coalesce("known", F.lit(False)).alias("valid"))


def check(rows: DataFrame, evidence: DataFrame, questions: DataFrame) -> DataFrame:
    """``aid, pos, claim, cites, invalid, support, numbers_ok, verdict`` for claims, with
    ``evidence(aid, n, title, text)`` and ``questions(aid, question, numeric)``.

    An answer's evidence is bounded by its budget, so it is one array per answer.
    """
    ref = evidence.groupBy("aid").agg(F.array_sort(F.collect_list(F.struct(F.col("n").cast("int").alias("n"), F.concat_ws(" ", "title", "text").alias("ref")))).alias("refs"))
    rows = rows.join(ref, "aid", "left").join(questions, "aid", "left").withColumn("refs", F.coalesce("refs", F.expr("cast(array() as array<struct<n:int,ref:string>>)")))
    claim = F.col("claim")
    body = F.trim(F.replace(F.regexp_replace(claim, tx.CITATION, " "), F.lit("**"), F.lit("")))
    rows = rows.withColumn("cites", tx.citations(claim)).withColumn("body", body)
    known = F.transform("refs", lambda r: r["n"])
    rows = rows.withColumn("invalid", F.filter("cites", lambda c: ~F.array_contains(known, c))).withColumn("ok", F.filter("refs", lambda r: F.array_contains("cites", r["n"])))
    rows = rows.withColumn("ref", F.array_join(F.transform(F.when(F.size("ok") > 0, F.col("ok")).otherwise(F.col("refs")), lambda r: r["ref"]), " "))
    rows = rows.withColumn("stems", stem_arrays(tx.content_words(F.col("body")))).withColumn("ref_stems", stem_arrays(tx.content_words(F.col("ref"))))
    support = F.size(F.filter("stems", lambda s: F.array_contains("ref_stems", s))) / F.greatest(F.size("stems"), F.lit(1))
    nums = F.array_except(tx.numbers(F.col("body")), tx.numbers(F.coalesce("question", F.lit(""))))
    rows = rows.withColumn("support", support).withColumn("nums", nums).withColumn("ref_nums", tx.numbers(F.col("ref")))
    near = lambda n: F.exists("ref_nums", lambda r: (r == n) | r.startswith(F.concat(n, F.lit("."))) | n.startswith(F.concat(r, F.lit("."))))
    rows = rows.withColumn("numbers_ok", F.forall("nums", near))
    other = (F.size("stems") < 2) | claim.rlike(HEADING) | F.col("body").rlike(META)
    verdict = (
        F.when(other, "NOT_A_CLAIM").when(F.coalesce("numeric", F.lit(False)) & ~F.col("numbers_ok") & F.col("body").rlike(CALC), "COMPUTED")
        .when((F.size("cites") == 0) & (F.col("support") >= 0.8) & F.col("numbers_ok"), "WEAK").when(F.size("cites") == 0, "UNCITED")
        .when(~F.col("numbers_ok"), "UNSUPPORTED").when(F.col("support") >= 0.6, "SUPPORTED").when(F.col("support") >= 0.35, "WEAK").otherwise("UNSUPPORTED")
    )
    return rows.select("aid", "pos", "claim", "cites", "invalid", F.when(other, 0.0).otherwise(F.col("support")).alias("support"), (other | F.col("numbers_ok")).alias("numbers_ok"), verdict.alias("verdict"))


def apply_model_verdicts(checked: DataFrame, sent: DataFrame, letters: DataFrame) -> DataFrame:
    """Verdicts after a model's letters: ``sent(aid, pos, k)`` says which letter (from 0) of
    ``letters(aid, letters)`` is a claim's; S supports unless uncited or with wrong numbers."""
    v = sent.join(letters, "aid").select("aid", "pos", F.substring(F.col("letters"), F.col("k") + 1, F.lit(1)).alias("v")).filter("v <> ''")
    ok = F.col("v") == "S"
    new = F.when(F.col("v").isNull(), F.col("verdict")).when(ok & F.col("numbers_ok") & (F.col("verdict") != "UNCITED"), "SUPPORTED").when(ok, F.col("verdict")).otherwise("UNSUPPORTED")
    return checked.join(v, ["aid", "pos"], "left").withColumn("verdict", new).drop("v")


def report(checked: DataFrame) -> DataFrame:
    """``aid, checkable, supported, unsupported, support_rate, citation_errors``."""
    n = lambda *kinds: F.count_if(F.col("verdict").isin(*kinds))
    by = checked.groupBy("aid").agg(
        F.count_if(F.col("verdict") != "NOT_A_CLAIM").alias("checkable"), n("SUPPORTED", "COMPUTED").alias("supported"), n("UNSUPPORTED", "UNCITED").alias("unsupported"),
        F.sum(F.size("invalid")).alias("citation_errors"),
    )
    return by.withColumn("support_rate", F.when(F.col("checkable") > 0, F.col("supported") / F.col("checkable")).otherwise(1.0))


def matches(rows: DataFrame, answer: str = "answer", target: str = "target", out: str = "ok") -> DataFrame:
    """Lenient match, as a column more: the target's words stand in the answer in order, or its numbers and
    all of its content words (themselves or by stem) occur there.  Null texts are empty, and an empty
    target matches nothing."""
    text, sought = F.coalesce(F.col(answer), F.lit("")), F.coalesce(F.col(target), F.lit(""))
    content = F.when(F.size(tx.content_words(sought)) > 0, tx.content_words(sought)).otherwise(tx.words(sought))
    # arrays first: functions over them take no Python
    held = rows.withColumns({"__a": tx.words(text), "__t": tx.words(sought), "__c": content, "__n": F.array_except(tx.numbers(sought), tx.numbers(text))})
    held = held.withColumns({"__own": F.array_union("__a", stem_arrays(tx.content_words(text))), "__s": stem_arrays("__c")})
    norm = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    inside = (F.size("__t") > 0) & F.contains(norm("__a"), norm("__t"))
    known = lambda w, s: F.array_contains("__own", w) | F.array_contains("__own", s)
    every = F.forall(F.zip_with("__c", "__s", known), lambda x: x)
    return held.withColumn(out, (F.trim(sought) != "") & (inside | ((F.size("__n") == 0) & every))).drop("__a", "__t", "__c", "__n", "__own", "__s")


def bench_summary(results: DataFrame, *, rollup: bool = True) -> DataFrame:
    """By category, and in total as ``**all**``: share of matches, mean recall, exact median seconds, errors."""
    cut = results.rollup("category") if rollup else results.groupBy("category")
    return cut.agg(
        F.count("*").alias("n"), F.avg(F.col("answer_match").cast("double")).alias("match_rate"), F.avg("recall").alias("recall"),
        (F.median("total_ms") / 1000).alias("median_s"), F.try_divide(F.sum("supported"), F.sum("checkable")).alias("grounded"), F.count("error").alias("errors"),
    ).withColumn("category", F.coalesce("category", F.lit("**all**")))


def upper_median(results: DataFrame, key: str, value: str) -> DataFrame:
    """The upper of the two middle values; exact, from counts of values and not from gathered lists."""
    from pyspark.sql import Window

    counts = results.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(value)
    ranked = counts.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(key)))
    return ranked.filter(F.col("upto") > F.floor(F.col("total") / 2)).groupBy(key).agg(F.min(value).alias("upper_median"))
