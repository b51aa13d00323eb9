"""What the research flow does around retrieval: history, model plans, hops, notes and refusals.

Everything is Columns or windows over a batch of questions; a language model's
output comes in as a text column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.stem import stem_arrays
from ..operators import analyze

# The names of question types in a model's plan, and limits of the flow.
PLAN_TYPES = ["lookup", "explanation", "comparison", "multihop", "synthesis", "numeric"]
PLAN_SCHEMA = "type string, subquestions array<string>, queries array<string>"
HISTORY_TURNS, SCOUTED, QUERIES, CHECKED, FLAGGED = 2, 3, 4, 12, 4


def history(turns: DataFrame, keep: int = HISTORY_TURNS) -> DataFrame:
    """Rows of ``turns(conv_id, turn, answer)`` that count as history: the last ``keep`` of a conversation
    whose answer did not abstain, with ``back`` (1 is the latest).  Null answers are not turns yet."""
    told = turns.filter(F.col("answer").isNotNull() & ~analyze.looks_abstained(F.col("answer")))
    return told.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).filter(F.col("back") <= keep)


def _clean(items: Column, least: int, most: int) -> Column:
    bare = F.transform(F.coalesce(items, F.expr("cast(array() as array<string>)")), lambda x: F.trim(x))
    return F.filter(bare, lambda x: F.length(x).between(least, most))


def parse_plan(output: Column) -> Column:
    """``struct<type, subquestions, queries>`` of a model's output from its first ``{``; a plan that is
    no JSON is AMBIGUOUS and empty."""
    plan = F.from_json(F.regexp_extract(F.coalesce(output, F.lit("")), r"(?s)\{.*", 0), PLAN_SCHEMA)
    kind = F.when(plan["type"].isin(PLAN_TYPES), F.upper(plan["type"])).otherwise("AMBIGUOUS")
    return F.struct(kind.alias("type"), _clean(plan["subquestions"], 4, 1 << 30).alias("subquestions"), _clean(plan["queries"], 1, 1 << 30).alias("queries"))


def parse_titles(output: Column) -> Column:
    """The first titles of 2 to 80 characters in the JSON list that a model's output holds."""
    listed = F.from_json(F.regexp_extract(F.coalesce(output, F.lit("")), r"(?s)\[.*", 0), "array<string>")
    return F.slice(_clean(listed, 2, 80), 1, SCOUTED)


def hop_entities(question: Column, answers: Column, previous_question: Column) -> Column:
    """Entities of a hop: the answers that it names as ``#k``, or without such names the latest
    answer where the hop shares a stem with the one before; blank or long answers are left out."""
    named = F.transform(F.regexp_extract_all(question, F.lit(r"#(\d)"), F.lit(1)), lambda k: F.get(answers, k.cast("int") - 1))
    shares = F.arrays_overlap(stem_arrays(tx.content_words(question)), stem_arrays(tx.content_words(F.coalesce(previous_question, F.lit("")))))
    latest = F.when(F.coalesce(shares, F.lit(False)), F.slice(answers, F.greatest(F.size(answers), F.lit(1)), F.lit(1))).otherwise(F.expr("cast(array() as array<string>)"))
    found = F.when(F.exists(named, lambda a: a.isNotNull()), named).otherwise(latest)
    return F.filter(found, lambda a: (F.trim(a) != "") & (F.length(a) < 80))


def hop_note(question: Column, answer: Column, titles: Column) -> Column:
    """A hop as one line for the answer's prompt; null where the hop has no answer."""
    return F.concat(question, F.lit(" → "), tx.strip_citations(answer), F.lit(" (from: "), F.array_join(F.slice(F.array_distinct(titles), 1, 2), "; "), F.lit(")"))


def refusal(entities: Column, content_words: Column, nearest: Column) -> Column:
    """The text of an answer that is not given: what was looked for and what came closest."""
    sought = F.array_join(F.when(F.size(entities) > 0, entities).otherwise(F.slice(content_words, 1, 6)), ", ")
    near = F.when(F.size(nearest) > 0, F.concat(F.lit("\nNearest articles: "), F.array_join(nearest, ", "))).otherwise("")
    return F.concat(F.lit("The library holds too little on this for a reliable answer.\nLooked for: "), sought, near)


def correction(checks: Column) -> Column:
    """One sentence that corrects the wrong equations of ``scan.equation_checks``; null if none is wrong."""
    number = lambda x: F.regexp_replace(F.replace(F.format_number(x, 6), F.lit(","), F.lit("")), r"\.?0+$", "")
    wrong = F.filter(checks, lambda c: ~c["ok"])
    each = F.transform(wrong, lambda c: F.concat(c["expression"], F.lit(" = "), number(c["actual"]), F.lit(", not "), number(c["claimed"])))
    return F.when(F.size(wrong) > 0, F.concat(F.lit("Correction: "), F.array_join(each, "; "), F.lit(".")))


def to_model_check(checked: DataFrame, most: int = CHECKED) -> DataFrame:
    """The claims that a model is asked about, ``aid, pos, k``: the first weak, unsupported or uncited ones."""
    open_ = checked.filter(F.col("verdict").isin("WEAK", "UNSUPPORTED", "UNCITED"))
    ranked = open_.withColumn("k", F.row_number().over(Window.partitionBy("aid").orderBy("pos")) - 1)
    return ranked.filter(F.col("k") < most).select("aid", "pos", "k", "claim", "cites")


def evidence_for_check(sent: DataFrame, evidence: DataFrame) -> DataFrame:
    """The evidence that the sent claims cite; all of an answer's evidence where they cite none of it."""
    cited = sent.select("aid", F.explode("cites").alias("n")).distinct().withColumn("cited", F.lit(True))
    held = evidence.join(sent.select("aid").distinct(), "aid", "left_semi").join(cited, ["aid", "n"], "left")
    any_cited = F.max(F.coalesce("cited", F.lit(False))).over(Window.partitionBy("aid"))
    return held.withColumn("any", any_cited).filter(F.coalesce("cited", F.lit(False)) | ~F.col("any")).drop("cited", "any")


def flagged(checked: DataFrame, most: int = FLAGGED) -> DataFrame:
    """The first claims of an answer to show as doubtful."""
    doubtful = checked.filter(F.col("verdict").isin("UNSUPPORTED", "UNCITED"))
    return doubtful.withColumn("k", F.row_number().over(Window.partitionBy("aid").orderBy("pos"))).filter(F.col("k") <= most)


def mode_of(name: Column) -> Column:
    """QUICK, DEEP or AUTO."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.when(low == "quick", "QUICK").when(low == "deep", "DEEP").otherwise("AUTO")
