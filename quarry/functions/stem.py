"""Porter stemming of a distinct vocabulary: an Arrow-batched function, and the same rules as SQL.

Words of up to two letters, and words with anything but a-z, stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The suffix tables of the 1980 algorithm in its later revision, longest first where one ends another.
STEP2 = {
    "ational": "ate", "ization": "ize", "iveness": "ive", "fulness": "ful", "ousness": "ous", "tional": "tion", "biliti": "ble", "entli": "ent",
    "ousli": "ous", "ation": "ate", "alism": "al", "aliti": "al", "iviti": "ive", "enci": "ence", "anci": "ance", "izer": "ize", "alli": "al",
    "ator": "ate", "logi": "log", "bli": "ble", "eli": "e",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
STEP4 = "ement ance ence able ible ment ant ent ion ism ate iti ous ive ize al er ic ou".split()

_CONS, _VOW = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_POSITIVE = f"^({_CONS})?{_VOW}{_CONS}"
_ONE = f"^({_CONS})?{_VOW}{_CONS}({_VOW})?$"
_SEVERAL = f"^({_CONS})?{_VOW}{_CONS}{_VOW}{_CONS}"
_HAS_VOWEL = f"^({_CONS})?[aeiouy]"
_SHORT = f"^{_CONS}[aeiouy][^aeiouwxyY]$"
_DOUBLE = "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$"


def _has(pattern: str, word: str) -> bool:
    return re.search(pattern, word) is not None


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    if not re.fullmatch("[a-z]{3,}", word):
        return word
    w = "Y" + word[1:] if word[0] == "y" else word  # a first y is a consonant
    for end, cut in (("sses", 2), ("ies", 2), ("ss", 0), ("s", 1)):
        if w.endswith(end):
            w = w[: len(w) - cut]
            break
    if w.endswith("eed"):
        w = w[:-1] if _has(_POSITIVE, w[:-3]) else w
    else:
        end = next((e for e in ("ed", "ing") if w.endswith(e)), "")
        if end and _has(_HAS_VOWEL, w[: -len(end)]):
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _has(_DOUBLE, w):
                w = w[:-1]
            elif _has(_ONE, w) and _has(_SHORT, w):
                w += "e"
    if w.endswith("y") and _has(_HAS_VOWEL, w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        end = next((e for e in table if w.endswith(e)), "")
        if end and _has(_POSITIVE, w[: -len(end)]):
            w = w[: -len(end)] + table[end]
    end = next((e for e in STEP4 if w.endswith(e)), "")
    if end and _has(_SEVERAL, w[: -len(end)]) and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e"):
        rest = w[:-1]
        if _has(_SEVERAL, rest) or (_has(_POSITIVE, rest) and not (_has(_ONE, rest) and _has(_SHORT, rest))):
            w = rest
    if w.endswith("ll") and _has(_SEVERAL, w[:-1]):
        w = w[:-1]
    return w.lower()


@F.pandas_udf(T.StringType())
def stem_words(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in words:
        yield batch.map(stem, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_arrays(arrays: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Stems of each word of an array; for query-side arrays, which are few."""
    for batch in arrays:
        yield batch.map(lambda ws: [stem(w) for w in ws], na_action="ignore")


def stem_vocabulary(words: DataFrame, col: str = "word") -> DataFrame:
    """``word, stem`` for the distinct words of a column: a word is stemmed once, however often it occurs."""
    return words.select(F.col(col).alias("word")).distinct().withColumn("stem", stem_words("word"))


def stem_sql(source: str, match: str = "regexp_matches") -> str:
    """Common table expressions that end in ``stems(word, stem)`` for ``source(word)``; no Python."""

    def has(pattern: str, of: str) -> str:
        return f"{match}({of}, '{pattern}')"

    def cut(end: str) -> str:
        return f"substr(w, 1, length(w) - {len(end)})"

    def table(rules: dict[str, str]) -> str:
        return "CASE " + " ".join(f"WHEN w LIKE '%{e}' THEN CASE WHEN {has(_POSITIVE, cut(e))} THEN {cut(e)} || '{r}' ELSE w END" for e, r in rules.items()) + " ELSE w END"

    four = " ".join(
        f"WHEN w LIKE '%{e}' THEN CASE WHEN {has(_SEVERAL, cut(e))}" + (f" AND {has('[st]$', cut(e))}" if e == "ion" else "") + f" THEN {cut(e)} ELSE w END" for e in STEP4
    )
    last = cut("e")
    steps = [
        "CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN substr(w, 1, length(w) - 2) WHEN w LIKE '%ss' THEN w WHEN w LIKE '%s' THEN substr(w, 1, length(w) - 1) ELSE w END",
        f"CASE WHEN w LIKE '%eed' THEN CASE WHEN {has(_POSITIVE, cut('eed'))} THEN {cut('d')} ELSE w END WHEN w LIKE '%ed' AND {has(_HAS_VOWEL, cut('ed'))} THEN {cut('ed')} || '|'"
        f" WHEN w LIKE '%ing' AND {has(_HAS_VOWEL, cut('ing'))} THEN {cut('ing')} || '|' ELSE w END",
        f"CASE WHEN w NOT LIKE '%|' THEN w WHEN w LIKE '%at|' OR w LIKE '%bl|' OR w LIKE '%iz|' THEN {cut('|')} || 'e' WHEN {has(_DOUBLE, cut('|'))} THEN {cut('x|')}"
        f" WHEN {has(_ONE, cut('|'))} AND {has(_SHORT, cut('|'))} THEN {cut('|')} || 'e' ELSE {cut('|')} END",
        f"CASE WHEN w LIKE '%y' AND {has(_HAS_VOWEL, cut('y'))} THEN {cut('y')} || 'i' ELSE w END",
        table(STEP2), table(STEP3), f"CASE {four} ELSE w END",
        f"CASE WHEN w LIKE '%e' AND ({has(_SEVERAL, last)} OR ({has(_POSITIVE, last)} AND NOT ({has(_ONE, last)} AND {has(_SHORT, last)}))) THEN {last} ELSE w END",
        f"CASE WHEN w LIKE '%ll' AND {has(_SEVERAL, cut('l'))} THEN {cut('l')} ELSE w END",
    ]
    out = [f"st0 AS (SELECT DISTINCT word, CASE WHEN substr(word, 1, 1) = 'y' THEN 'Y' || substr(word, 2) ELSE word END AS w, {has('^[a-z]{3,}$', 'word')} AS ok FROM {source})"]
    out += [f"st{i + 1} AS (SELECT word, ok, CASE WHEN ok THEN {s} ELSE w END AS w FROM st{i})" for i, s in enumerate(steps)]
    return ", ".join([*out, f"stems AS (SELECT word, CASE WHEN ok THEN lower(w) ELSE word END AS stem FROM st{len(steps)})"])
