"""Text functions that read a text from left to right: sentences, names, equations.

Plain Python on one string, wrapped as Arrow-batched functions.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import STOPWORDS

# Abbreviations that do not end a sentence, those that may, and words that then begin one.
ABBREVIATIONS = set(
    "mr mrs ms dr prof sr jr st mt ft vs etc e.g i.e cf al no vol pp p fig approx ca c inc ltd co corp gen col lt sgt capt gov sen rep rev u.s u.k u.n "
    "jan feb mar apr jun jul aug sep sept oct nov dec est b d r op ed eds".split()
)
ENDING = set("u.s u.k u.n etc inc ltd co corp jr sr".split())
STARTERS = set("he she it they the this that these in a an we his her its their there after during however".split())
# Words that may join the parts of a name.
CONNECTORS = set("of the de da von van der and for on in del la le du".split())

_STOP = set(STOPWORDS)
_MARK = re.compile(r"\n|[.!?]")
_TOKEN = re.compile(r"[^\W_][\w'’.\-]*")
_BREAKS = set(",?;:()")


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").lower()


def _ends_sentence(text: str, start: int, at: int, after: int) -> bool:
    """Whether the mark at ``at`` (closing quotes end at ``after``) ends the sentence from ``start``."""
    if after < len(text):
        following = text[after + 1 : after + 2]
        if text[after] != " " or not following or not (following.isupper() or following.isdigit() or following in '"('):
            return False
    if text[at] != ".":
        return True
    m = re.search(r"[^\W\d_.]*(?:\.|[^\W\d_])*$", text[start:at])
    word = (m[0] if m else "").lower()
    if not word or not (len(word) == 1 or word in ABBREVIATIONS):
        return True
    opener = re.match(r"\s*([^\W\d_]*)", text[after:])[1].lower()
    return word in ENDING and opener in STARTERS


def sentences(text: str) -> list[str]:
    """Sentences: lines are sentences of their own; abbreviations and initials do not end one."""
    cuts, start = [], 0
    for m in _MARK.finditer(text):
        at = m.start()
        if at < start:
            continue
        if m[0] == "\n":
            cuts.append((start, at))
            start = at + 1
            continue
        after = at + 1
        while after < len(text) and text[after] in "\"')’”":
            after += 1
        if _ends_sentence(text, start, at, after):
            cuts.append((start, after))
            start = after
    cuts.append((start, len(text)))
    return [s for a, b in cuts if len(s := text[a:b].strip()) > 1]


def names(text: str) -> list[str]:
    """Runs of capitalised words, with up to two joining words inside ("Treaty of Versailles")."""
    tokens = list(_TOKEN.finditer(text))
    out, i = [], 0
    while i < len(tokens):
        word, before = tokens[i][0], text[: tokens[i].start()].rstrip()
        opens = not i or before.endswith((".", "?"))
        if not word[0].isupper() or (opens and fold(word) in _STOP):
            i += 1
            continue
        end, j = i, i + 1
        while j < len(tokens) and not _BREAKS & set(text[tokens[j - 1].end() : tokens[j].start()]):
            if tokens[j][0][0].isupper() or tokens[j][0][0].isdigit():
                end, j = j, j + 1
                continue
            k = j
            while k < len(tokens) and fold(tokens[k][0]) in CONNECTORS:
                k += 1
            if not 0 < k - j <= 2 or k == len(tokens) or not tokens[k][0][0].isupper():
                break
            j = k
        out.append(text[tokens[i].start() : tokens[end].end()].rstrip(".'’"))
        i = end + 1
    return [n for n in out if len(n) > 1]


_NUMBER = r"\d[\d,]*(?:\.\d+)?"
_EQUATION = re.compile(rf"((?:\(\s*)*{_NUMBER}(?:\s*[-+*/×÷x^−–]\s*(?:\(\s*)*{_NUMBER}(?:\s*\))*)+)\s*(?:=|≈|is about|equals)\s*\$?\s*({_NUMBER})")
_SPAN = re.compile(r"\d[\d,]*\s*[-−–]\s*\d[\d,]*")
_LEXEME = re.compile(r"\d+(?:\.\d*)?|\.\d+|[-+*/^()]")


def evaluate(expression: str) -> float:
    """Value of + - * / ^ with parentheses, by operator precedence; raises on anything else."""
    text = expression.translate(str.maketrans({"×": "*", "x": "*", "÷": "/", "−": "-", "–": "-", ",": None, " ": None}))
    tokens = _LEXEME.findall(text)
    if "".join(tokens) != text:
        raise ValueError("not an expression")
    power = {"+": 1, "-": 1, "*": 2, "/": 2, "^": 3}
    values: list[float] = []
    ops: list[str] = []

    def apply() -> None:
        op = ops.pop()
        if op == "neg":
            values.append(-values.pop())
            return
        b, a = values.pop(), values.pop()
        values.append({"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "^": lambda: a**b}[op]())

    operand = True  # whether a value is expected
    for t in tokens:
        if operand:
            if t == "-":
                ops.append("neg")
            elif t == "(":
                ops.append(t)
            elif t[0].isdigit() or t[0] == ".":
                values.append(float(t))
                operand = False
                while ops and ops[-1] == "neg":  # a sign binds closer than any operator
                    apply()
            else:
                raise ValueError("a number is missing")
        elif t == ")":
            while ops and ops[-1] != "(":
                apply()
            if not ops:
                raise ValueError("a parenthesis is missing")
            ops.pop()
            while ops and ops[-1] == "neg":
                apply()
        elif t in power:
            while ops and ops[-1] != "(" and (power[ops[-1]] > power[t] or (power[ops[-1]] == power[t] and t != "^")):
                apply()
            ops.append(t)
            operand = True
        else:
            raise ValueError("an operator is missing")
    if operand:
        raise ValueError("a number is missing")
    while ops:
        if ops[-1] == "(":
            ops.pop()  # an open parenthesis ends with the text
            continue
        apply()
    out = values.pop()
    if values or isinstance(out, complex):
        raise ValueError("not an expression")
    return out


def equations(text: str) -> list[tuple[str, float, float, bool]]:
    """(expression, claimed, actual, ok) of each equation; ok within 0.5 or 0.5 %, and a span
    written earlier-later also counts as a duration."""
    out = []
    for m in _EQUATION.finditer(text):
        try:
            claimed, actual = float(m[2].replace(",", "")), evaluate(m[1])
        except (ValueError, ZeroDivisionError, OverflowError):
            continue
        if actual != actual or abs(actual) == float("inf"):
            continue
        near = lambda a: abs(a - claimed) <= max(0.5, abs(a) * 0.005)
        out.append((m[1].strip(), claimed, actual, near(actual) or (actual < 0 and _SPAN.fullmatch(m[1].strip()) is not None and near(-actual))))
    return out


def _mapped(of: Callable, kind: T.DataType):
    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: of(t) if t is not None else None)

    return run


split_sentences = _mapped(sentences, T.ArrayType(T.StringType()))
name_spans = _mapped(names, T.ArrayType(T.StringType()))
evaluate_expression = _mapped(lambda t: _value(t), T.DoubleType())
equation_checks = _mapped(
    lambda t: [{"expression": e, "claimed": c, "actual": a, "ok": k} for e, c, a, k in equations(t)],
    T.ArrayType(T.StructType([T.StructField("expression", T.StringType()), T.StructField("claimed", T.DoubleType()), T.StructField("actual", T.DoubleType()), T.StructField("ok", T.BooleanType())])),
)


def _value(text: str) -> float | None:
    try:
        return evaluate(text)
    except (ValueError, ZeroDivisionError, OverflowError):
        return None
