"""Text functions as Columns: folding, words, titles, numbers, citations, paragraphs.

Everything here stays inside Catalyst; what needs a sequential scan of a text is
in ``scan.py`` as Arrow-batched functions.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# English function words and words that frame a request.
STOPWORDS = """
a about above after again against all almost also although always am among an and another any are aren
around as at be became because become been before being below between both but by can cannot could
couldn did didn do does doesn doing don down during each either else enough especially etc even ever
every few for from further had hadn has hasn have haven having he her here hers herself him himself his
how however i if in into is isn it its itself just least less like ll made make many may me might more
most mostly much must my myself neither no nor not now of off often on once one only onto or other
others otherwise our ours ourselves out over own per perhaps quite rather re really s same shall she
should shouldn since so some such t than that the their theirs them themselves then there therefore
these they this those though through thus to too toward towards under until up upon us ve very via
was wasn we were weren what whatever when whenever where whereas whether which while who whoever whom
whose why will with within without won would wouldn yet you your yours yourself yourselves
tell explain describe give list please know want find show briefly detail details overview summary
summarize summarise compare comparison versus vs difference differences similar similarity
similarities main key important according use used using called known
""".split()
# Question words, and headings of sections without prose.
QUESTION_WORDS = ["who", "what", "when", "where", "why", "how", "which", "whom", "whose"]
SKIP_SECTIONS = ["references", "external links", "see also", "further reading", "notes", "bibliography", "sources", "citations", "footnotes", "works cited"]

WORD = r"[\p{L}\p{N}]+(?:['’]\p{L}+)?"
NUMBER = r"(?<![\p{L}\d])(?:\d{1,3}(?:[,  ]\d{3})+|\d+)(?:\.\d+)?"
CITATION = r"\[(\d{1,2}(?:\s*[,–-]\s*\d{1,2})*)]"
EMPTY_PARENS = r"\s*\([\s;,]*\)"


@lru_cache(maxsize=1)
def _bases() -> tuple[str, str]:
    """Characters of the BMP that decompose to one base character and marks, and those bases."""
    found = {}
    for code in range(0xC0, 0x2000):
        rest = [c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn"]
        if len(rest) == 1 and rest[0] != chr(code):
            found[chr(code)] = rest[0]
    return "".join(found), "".join(found.values())


def fold(text: Column) -> Column:
    """Lower case without diacritics; a text with as many bytes as characters has none to drop."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(_fold(text))


def _fold(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.translate(text, *_bases()), r"\p{Mn}+", ""))


def words(text: Column) -> Column:
    """Folded words; what follows an apostrophe is dropped ("einstein's" gives "einstein")."""
    return F.transform(F.regexp_extract_all(fold(text), F.lit(WORD), F.lit(0)), lambda w: F.regexp_replace(w, "['’].*$", ""))


def is_content(word: Column) -> Column:
    """Not a stopword and not a single letter."""
    return ((F.length(word) > 1) | word.rlike(r"^\p{Nd}")) & ~word.isin(STOPWORDS)


def content_words(text: Column) -> Column:
    return F.filter(words(text), is_content)


def norm_title(text: Column) -> Column:
    return F.array_join(words(F.regexp_replace(text, "_", " ")), " ")


def numbers(text: Column) -> Column:
    """Distinct numbers in normal form: no separators, no leading or trailing zeros."""

    def normal(x: Column) -> Column:
        whole = F.regexp_replace(F.regexp_replace(x, r"\..*$", ""), "[,  ]", "")
        whole = F.regexp_replace(F.regexp_replace(whole, "^0+", ""), "^$", "0")
        part = F.regexp_replace(F.regexp_extract(x, r"\.(\d+)$", 1), "0+$", "")
        return F.when(part == "", whole).otherwise(F.concat_ws(".", whole, part))

    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), normal))


def estimate_tokens(text: Column) -> Column:
    return F.floor((F.length(text) + 3) / 4).cast("int")


def paragraphs(text: Column) -> Column:
    """Trimmed non-empty lines."""
    trimmed = F.transform(F.split(text, "\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(trimmed, lambda p: p != "")


def drop_empty_parens(text: Column) -> Column:
    return F.regexp_replace(text, EMPTY_PARENS, "")


def count_words(text: Column) -> Column:
    """Words as runs of non-blanks."""
    return F.regexp_count(text, F.lit(r"\S+"))


def is_heading(par: Column) -> Column:
    """A short line that begins in upper case and has no final punctuation."""
    return (F.length(par) < 80) & ~par.rlike(r"[.:?!,;]$") & (count_words(par) <= 10) & par.rlike(r"^\p{Lu}")


def is_title(line: Column, following: Column) -> Column:
    """Whether a line is a title, judged by itself and the line after it."""
    s = F.trim(line)
    n_words = count_words(s)
    commas = F.length(s) - F.length(F.replace(s, F.lit(","), F.lit("")))
    opened = F.length(F.replace(s, F.lit(")"), F.lit(""))) == F.length(F.replace(s, F.lit("("), F.lit("")))
    # Function words that do not end a title.
    last = "is are was were of the a an and or by to as in on at for with having that which from be has had its their".split()
    shape = (s != "") & (F.length(s) <= 90) & (F.length(following) >= 40) & (n_words <= 10) & (commas <= 1) & opened & ~s.rlike('[;"]')
    shape &= ~F.lower(F.regexp_extract(s, r"(\S+)$", 1)).isin(last) & ~s.rlike(r"[.,:;!?]$") & s.rlike(r"^[\p{Lu}\p{Nd}]") & ~s.rlike(r"^(formula_|\]\]|\||\{)")
    head = fold(F.substring(following, 1, 250))
    own = F.split(norm_title(s), " ")
    long = F.filter(own, lambda w: (F.length(w) > 2) & ~w.isin("the", "and", "list"))
    key = F.coalesce(F.get(long, F.lit(0)), F.get(own, F.lit(0)))
    named = (key != "") & F.contains(head, key)
    defined = head.rlike(r"\b(is|was|are|were) (a|an|the)\b|\brefers? to\b|\bmay refer to\b")
    return shape & (named | defined)


def aliases(title: Column) -> Column:
    """``array<struct<norm,kind>>``: the title (0), and as aliases (2) the title without a final
    "(...)" and without a leading "the " if it is longer than 6 characters."""
    norm = norm_title(title)
    plain = norm_title(F.regexp_replace(title, r"\s*\([^()]*\)\s*$", ""))
    bare = F.when(norm.startswith("the ") & (F.length(norm) > 6), F.substring(norm, 5, 1_000_000))
    made = F.array(
        F.struct(norm.alias("norm"), F.lit(0).alias("kind")),
        F.struct(F.when(plain != norm, plain).alias("norm"), F.lit(2).alias("kind")),
        F.struct(bare.alias("norm"), F.lit(2).alias("kind")),
    )
    return F.filter(F.array_distinct(made), lambda a: a["norm"].isNotNull() & (a["norm"] != ""))


def citations(text: Column) -> Column:
    """Cited numbers in order: [1], [2, 4] and [1-3]; a range that runs backwards is empty."""

    def spread(part: Column) -> Column:
        a, b = F.regexp_extract(part, r"^\s*(\d+)", 1).cast("int"), F.regexp_extract(part, r"[–-]\s*(\d+)", 1)
        end = F.when(b == "", a).otherwise(F.try_to_number(b, F.lit("99")).cast("int"))
        return F.when(end >= a, F.sequence(a, end)).otherwise(F.expr("cast(array() as array<int>)"))

    groups = F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))
    return F.flatten(F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, ","))), spread))


def strip_citations(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s*\[[\d,\s–-]+\]", ""))


def strip_reasoning(text: Column) -> Column:
    """Without <think> blocks; a text may begin inside one (its first tag closes) or end inside one."""
    shut, opened = F.locate("</think>", text), F.locate("<think>", text)
    inside = (shut > 0) & ((opened == 0) | (shut < opened))
    rest = F.when(inside, F.substring(text, shut + 8, F.length(text))).otherwise(text)
    return F.regexp_replace(F.regexp_replace(rest, r"(?s)<think>.*?(</think>|$)", ""), r"^\s+|\s+$", "")


def render_evidence(n: Column, title: Column, section: Column, text: Column) -> Column:
    head = F.concat(F.lit("["), n.cast("string"), F.lit("] "), title, F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit(" — "), section)).otherwise(""))
    return F.concat(head, F.lit("\n"), text)


def embedding_text(title: Column, section: Column, text: Column, prefix: str = "", limit: int = 1200) -> Column:
    head = F.concat(F.lit(prefix), title, F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit(" — "), section)).otherwise(""))
    return F.concat(head, F.lit("\n"), F.substring(F.coalesce(text, F.lit("")), 1, limit))


def match_phrase(text: Column) -> Column:
    """A quoted phrase for a MATCH expression; null without a word."""
    w = words(text)
    return F.when(F.size(w) > 0, F.concat(F.lit('"'), F.array_join(w, " "), F.lit('"')))


def match_terms(terms: Column, joint: str) -> Column:
    """Distinct quoted terms joined by AND or OR."""
    quoted = F.transform(F.array_distinct(terms), lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit("")), F.lit('"')))
    return F.array_join(quoted, f" {joint} ")


def format_ms(ms: Column) -> Column:
    """Milliseconds below a second, else seconds with one digit."""
    return F.when(ms < 1000, F.concat(ms.cast("long").cast("string"), F.lit(" ms"))).otherwise(F.format_string("%.1f s", ms / 1000.0))


def format_bytes(n: Column) -> Column:
    """GB with two digits, or whole MB or KB."""
    n = n.cast("double")
    return F.when(n >= 1 << 30, F.format_string("%.2f GB", n / (1 << 30))).when(n >= 1 << 20, F.format_string("%.0f MB", n / (1 << 20))).otherwise(F.format_string("%.0f KB", n / 1024))


def truncate_middle(tokens: Column, budget: int) -> Column:
    """The first third of a token budget and the rest from the end."""
    head = budget // 3
    cut = F.concat(F.slice(tokens, 1, head), F.slice(tokens, F.size(tokens) - (budget - head) + 1, F.lit(budget - head)))
    return F.when(F.size(tokens) <= budget, tokens).otherwise(cut)


# Parts of model file names, by role; the first that matches holds.
ROLES = [
    (None, "mmproj"),
    ("EMBED", "embed|bge-|e5-|minilm|arctic-embed|gte-"),
    (None, "rerank"),
    ("DEEP", r"(\d{2,3})b-a\d+(\.\d)?b|a3b|a4b|a2b|20b|24b|26b|27b|30b|35b"),
    ("FAST", r"e2b|0\.[5-9]b|1b|1\.[0-9]b|2b|lfm2\.5-1"),
]


def model_role(name: Column) -> Column:
    """The role that a model file's name suggests; null for parts that are no model of their own."""
    role = F.lit("STRONG")
    for found, pattern in reversed(ROLES):
        role = F.when(F.lower(name).rlike(pattern), F.lit(found).cast("string")).otherwise(role)
    return role
