"""Rules for questions: type, flags, comparands, route, follow-ups. Columns, but for name spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scan
from ..functions import text as tx

# Patterns of question types; all but CHAIN ignore case.
COMPARE = r"\b(compare|comparison|compared|versus|vs\.?|difference between|differences between|differ|contrast|similarities|similar to|better than|worse than|pros and cons|advantages and disadvantages)\b|\bwhich (is|was|are|were|has|had) (older|larger|bigger|smaller|longer|shorter|taller|higher|lower|faster|slower|heavier|lighter|more|less|earlier|later|closer|farther|further|deeper|hotter|colder|denser)\b"
EXPLAIN = r"^(why|how (does|do|did|is|are|can|could|would)|explain|what (causes|caused|makes|made|happens|happened)|what is the (mechanism|reason|cause|role|purpose|function|significance))\b|\b(mechanism|work\?|works\?)"
NUMERIC = r"\b(how old was|how old were|how many (years|days|months|times|hours|minutes|km|kilometres|kilometers|miles) (passed|elapsed|between|separate|did|does|do|would|will|after|before|longer|more|older)|how long did|how long would|how long will|how much (older|longer|larger|bigger|more|less|heavier|faster)|calculate|compute|times (larger|bigger|more|smaller|heavier|longer|faster)|how many times|ratio|percentage of|what percent|if you (invest|travel|drive|walk|save)|compounded|per (year|hour|second) for|roughly how (far|many|much)|(difference|gap) (in|between) (years|age|height|size))\b"
QUANTITY = r"\b(how (many|much|old|long|far|tall|big|high|deep|fast|heavy|large)|what (year|date|percentage|proportion)|when (did|was|were|is)|in what year|population|area|distance|height|length|melting point|boiling point)\b"
SYNTHESIS = r"^(describe|outline|trace|summari[sz]e|give an overview|give a timeline|discuss)\b|\b(overview|summari[sz]e|history of|evolution of|impact of|impacts of|effects? of|consequences of|timeline|phases of|stages of|main events|major events|career of|life of|life and work|contributions|role of|influence of|significance of|causes and|main (causes|reasons|factors|arguments|theories|types)|what are the (main|key|major)|state of|debate|arguments for|arguments against|survey|trends?)\b"
MULTIHOP = r"\b(the \w+ (of|in|by|at|for) the \w+[^?]{0,60}\b(that|which|who|whose|where|when)\b)|\b(born in the same|same (year|city|country|place) as|who (directed|wrote|founded|invented|discovered|composed|painted|designed|built|led) the [^?]{3,60}(that|which|who|whose|when|where)|(was|were) (born|founded|built|released) (in|during) the (year|decade|reign|presidency) (of|when|that))\b"
CHAIN = r"\b(the |a |an )?(author|writer|director|producer|founder|inventor|creator|composer|painter|architect|designer|discoverer|leader|president|king|queen|monarch|emperor|ruler|wife|husband|spouse|father|mother|son|daughter|capital|currency|language|population|birthplace|home ?town|headquarters|successor|predecessor|owner|manufacturer|developer|publisher|singer|star|coach|captain|mayor|governor|builder)s? of (the |a |an )?([A-Z0-9\"“]|country|city|state|film|movie|book|novel|band|company|element|planet|song|album|team|person|scientist|writer|author|composer|empire|dynasty|war|battle|treaty)"
PREDICATE = r"\b(born|die|died|located|founded|built|invented|discovered|written|wrote|directed|married|educated|stud(y|ied)|attend(ed)?|lived?|flows?|named|w[io]n|completed|released|elected|buried|situated|use[sd]?|speak|spoken|study)\b"
NAMED_AFTER = r"\b(named after|named for|where (the|a) .+ (is|was) (located|born|built|founded))\b"
GENERIC_CLAUSE = r"\b(country|city|state|film|book|company|person|scientist|place)\s+(where|that|which|who|whose|in which)\b"
LOOKUP = r"^(who (is|was|were|are)|what (is|was|are|were) (the )?\w+( \w+)?\??$|when (did|was|were|is)|where (is|was|are|were|did)|which (year|country|city|person)|what year|define|definition of)\b"
LIST = r"\b(list|name (all|the|some)|what are (the|some)|which (countries|people|elements|cities)|examples of)\b"
CLAUSE = r"\b(that|which|who|whose|where|when)\b"
QUESTION = r"^(who|what|when|where|which|why|how|is|are|was|were|do|does|did|can|name|list)\b"
FOLLOW_UP = r"\b(it|its|they|them|their|he|she|him|his|her|that|this|those|these|there|one|ones)\b|^(and|but|so|also|what about|how about|why)\b"
ABSTAIN = r"(does not contain enough information|do(es)? not (say|mention|contain|provide|state)|not (found|mentioned|covered) in the (offline )?(sources|library)|no information|cannot (be )?(determined|answered)|insufficient|not enough information|unable to (find|answer))"
QUOTED = "[\"“]([^\"”]{2,80})[\"”]"


def _has(q: Column, pattern: str) -> Column:
    return q.rlike(f"(?i){pattern}")


def scores(q: Column, n_entities: Column) -> dict[str, Column]:
    """Score of each type, in the order that settles ties."""
    comparison = F.when(_has(q, COMPARE), 0.9).when((n_entities >= 2) & q.rlike(r"\b(and|or)\b") & _has(q, r"^(which|who)\b"), 0.6).otherwise(0.0)
    chain = q.rlike(CHAIN)
    outer = chain & _has(F.regexp_replace(F.regexp_replace(q, f"^(.*?)({CHAIN})", "$1\u0001"), "\u0001", ""), PREDICATE)
    hop = F.when(_has(q, MULTIHOP), 0.75).otherwise(0.0)
    hop = F.when(outer | (chain & _has(q, GENERIC_CLAUSE)) | _has(q, NAMED_AFTER), F.greatest(hop, F.lit(0.8))).otherwise(hop)
    hop = F.when((F.regexp_count(q, F.lit(f"(?i){CLAUSE}")) >= 2) & (hop < 0.6), 0.6).otherwise(hop)
    return {
        "COMPARISON": comparison, "MULTIHOP": hop,
        "SYNTHESIS": F.when(_has(q, SYNTHESIS), 0.7).otherwise(0.0), "EXPLANATION": F.when(_has(q, EXPLAIN), 0.75).otherwise(0.0),
        "NUMERIC": F.when(_has(q, NUMERIC), 0.65).otherwise(0.0), "LOOKUP": F.when(_has(q, LOOKUP), 0.6).otherwise(0.0),
    }


def analyze(questions: DataFrame, *, names: bool = True) -> DataFrame:
    """``qid, question, type, confidence, n_words, entities, numbers, wants_number, wants_list``.

    ``names=False`` leaves name spans out (quoted spans remain), so that no Python runs.
    """
    held = questions.select("qid", F.trim(F.coalesce("question", F.lit(""))).alias("question"))
    q = F.col("question")
    quoted = F.regexp_extract_all(q, F.lit(QUOTED), F.lit(1))
    found = F.concat(quoted, F.filter(scan.name_spans(q), lambda n: ~F.lower(n).isin(tx.QUESTION_WORDS))) if names else quoted
    held = held.withColumn("entities", found)
    held = held.withColumn("entities", F.filter("entities", lambda e, i: F.array_position(F.transform("entities", tx.fold), tx.fold(e)) == i + 1))
    held = held.withColumn("n_words", F.size(tx.content_words(q))).withColumns({f"s_{k}": v for k, v in scores(q, F.size("entities")).items()})
    order = ["COMPARISON", "MULTIHOP", "SYNTHESIS", "EXPLANATION", "NUMERIC", "LOOKUP"]
    best = F.greatest(*(F.col(f"s_{k}") for k in order))
    kind = F.lit(None).cast("string")
    for k in reversed(order):
        kind = F.when(F.col(f"s_{k}") == best, F.lit(k)).otherwise(kind)
    asks = q.endswith("?") | _has(q, QUESTION)
    bare = (F.col("n_words") <= 2) & ~asks
    held = held.withColumn("type", F.when(best > 0, kind).when(bare, "AMBIGUOUS").otherwise("LOOKUP")).withColumn("confidence", F.when(best > 0, best).when(bare, 0.5).otherwise(0.4))
    topic = (F.col("n_words") <= 2) & ~F.contains(q, F.lit("?")) & (F.size("entities") <= 1) & (F.col("type") == "LOOKUP")
    return held.select(
        "qid", "question", F.when(topic, "AMBIGUOUS").otherwise(F.col("type")).alias("type"), F.when(topic, 0.5).otherwise(F.col("confidence")).alias("confidence"),
        "n_words", "entities", tx.numbers(q).alias("numbers"), ((F.col("s_NUMERIC") > 0) | _has(q, QUANTITY)).alias("wants_number"), _has(q, LIST).alias("wants_list"),
    )


def comparands(q: Column, entities: Column | None = None) -> Column:
    """Up to four things that a comparison compares: two or more entities, else what stands between the marks."""
    a = F.regexp_extract(q, r"(?i)(?:between|compare|comparing)\s+(.+?)(?:\?|$|\s+(?:in terms of|regarding|for|on)\s)", 1)
    pair = r"(?i)^(?:is|are|was|were)?\s*(.+?)\s+(?:vs\.?|versus)\s+(.+?)(?:\?|$)"
    b = F.when(q.rlike(pair), F.concat_ws(" vs ", F.regexp_extract(q, pair, 1), F.regexp_extract(q, pair, 2))).otherwise("")
    span = F.when(a != "", a).otherwise(b)
    parts = F.transform(F.split(span, r"(?i)\s+(?:vs\.?|versus|and|or|with|to)\s+"), lambda p: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(p), r"[?.]+$", ""), "^the ", ""), "^a ", "")))
    kept = F.slice(F.filter(parts, lambda p: (p != "") & (F.size(tx.content_words(p)) > 0)), 1, 4)
    if entities is None:
        return kept
    return F.when(F.size(entities) >= 2, F.slice(entities, 1, 4)).when(span == "", entities).otherwise(kept)


def is_follow_up(q: Column, n_entities: Column) -> Column:
    return (F.size(tx.words(q)) <= 3) | (_has(F.trim(q), FOLLOW_UP) & (n_entities == 0))


def looks_abstained(answer: Column) -> Column:
    return F.substring(answer, 1, 400).rlike(f"(?i){ABSTAIN}")


# Preferred roles, then plan, hops, verify, tokens of evidence, sources, words, tokens, k.
_ROUTES = {
    "QUICK": ("FAST,STRONG", False, False, False, 500, 5, 90, 200, 8),
    "DEEP": ("DEEP,STRONG,FAST", True, None, True, None, 8, 300, 600, 14),
    "LOOKUP": ("FAST,STRONG", False, False, False, 550, 5, 90, 200, 8),
    "UNRECOGNISED": ("STRONG,FAST", False, False, False, 900, 6, 180, 380, 10),
    "AMBIGUOUS": ("FAST,STRONG", False, False, False, 700, 6, 140, 280, 10),
    "EXPLANATION": ("STRONG,FAST", None, False, False, 1000, 6, 180, 380, 10),
    "NUMERIC": ("STRONG,FAST", None, False, True, 1000, 6, 180, 380, 10),
    "COMPARISON": ("STRONG,DEEP,FAST", True, False, True, 1100, 8, 220, 440, 12),
    "SYNTHESIS": ("STRONG,DEEP,FAST", True, False, True, 1100, 8, 220, 440, 12),
    "MULTIHOP": ("STRONG,DEEP,FAST", True, True, True, 900, 7, 160, 340, 10),
}
ROUTE_FIELDS = ["roles", "plan", "hops", "verify", "evidence_tokens", "max_sources", "answer_words", "answer_tokens", "k"]


def route(analyzed: DataFrame, mode: str = "AUTO", available: tuple[str, ...] = ("FAST", "STRONG")) -> DataFrame:
    """``qid, type, role`` and the route's fields for each analysed question."""
    unsure = (F.col("type") == "LOOKUP") & (F.col("confidence") < 0.5) & (F.col("n_words") >= 6)
    name = F.lit(mode) if mode in ("QUICK", "DEEP") else F.when(unsure, "UNRECOGNISED").otherwise(F.col("type"))
    spark = analyzed.sparkSession
    table = spark.createDataFrame([(k, *v) for k, v in _ROUTES.items()], "name string, roles string, plan boolean, hops boolean, verify boolean, evidence_tokens int, max_sources int, answer_words int, answer_tokens int, k int")
    rows = analyzed.withColumn("name", name).join(F.broadcast(table), "name")
    others = next((r for r in available if r != "EMBED"), "FAST")
    role = F.coalesce(F.get(F.filter(F.split("roles", ","), lambda r: r.isin(*available)), F.lit(0)), F.lit(others))
    hard = F.col("type").isin("MULTIHOP", "SYNTHESIS", "COMPARISON") | (F.col("confidence") < 0.7)
    return rows.select(
        "qid", "type", role.alias("role"), F.coalesce("plan", F.col("confidence") < 0.6).alias("plan"), F.coalesce("hops", hard).alias("hops"), "verify",
        F.coalesce("evidence_tokens", F.lit(900 if "DEEP" in available else 1300)).alias("evidence_tokens"), "max_sources", "answer_words", "answer_tokens", "k",
    )
