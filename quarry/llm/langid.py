"""Language ID: segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every piece of one vocabulary (the pieces of
a public subword model in lower case, plus the 256 single bytes, so that every
word can be segmented).  A word's likelihood in a language is the sum over *all*
of its segmentations into pieces of the product of the pieces' probabilities,
by the forward algorithm; a text's is the product over its words.  Piece
probabilities are fitted by expectation-maximisation, whose expected counts come
from the same sums (forward-backward).

A word is a run of letters: ASCII letters and all non-ASCII characters, in lower
case, with a marker in front; runs of over 31 bytes are scored as consecutive
runs of at most 31.  The forward algorithm runs once per *distinct* word of a
batch and all languages together, and words stay cached between batches, so
frequent words cost a table lookup.

Fitting reads at most ``max_docs`` documents of each language, those with the
smallest hashes of their id; their words are counted by executors and each
language is fitted in a task of its own.  Scoring is map-only; what is broadcast
is bounded by vocabulary x languages.

Defined cases.  Null texts and texts without a letter give ``und`` with score 0;
so does every text if no language was learned.  Ties go to the language that
sorts first.  The share of the best language compares learned languages alone, so it
is near 1 for random letters too; ``keep_known`` therefore also compares with letters
drawn evenly.  Short texts are kept when in doubt, texts with a key or token by their other words, and languages that were never
learned mostly stay: few of them are worse than random letters in nearly every word.  Rows without a language teach nothing; repeated rows teach as often
as they occur, but an id is chosen once, so repeats of some never keep others, or
other languages, from being learned.  Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .shared import lean

UNKNOWN = "und"
MAX_WORD = 31
MAX_PIECE = 16
MAX_DOCS = 1000
_CACHE_BYTES = 48 << 20
#: Log-probability of a letter's byte, or of a word's marker, when 26 letters and the marker are drawn evenly.
EVEN = -float(np.log(27))
#: Random letters must explain a text so many times better than every language for it to be none.
NOISE_ODDS = 1e6
#: A text of which this share of words is likelier in its language than at random is never noise (a short text may hold a key).
WORDS_OF_LANGUAGE = 0.25
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
LETTER[128:] = True
_MARK = 32


def vocabulary(model_file: str) -> list[bytes]:
    """Pieces of a sentencepiece model that are letters, in lower case, and all single bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    found = set()
    for i in range(model.get_piece_size()):
        body = model.id_to_piece(i).lstrip("▁")
        mark = b" " if model.id_to_piece(i).startswith("▁") else b""
        if body.isalpha() and len(piece := mark + body.lower().encode()) <= MAX_PIECE:
            found.add(piece)
    return sorted(found | {bytes([b]) for b in range(256)})


@dataclass
class Lattice:
    """All pieces inside some words: for each word length the arcs (word, from, to, piece)."""

    size: int
    arcs: list[tuple[np.ndarray, np.ndarray, list[tuple[int, int, np.ndarray, np.ndarray]]]]


@dataclass
class Pieces:
    """The vocabulary as a hash table on piece bytes."""

    pieces: list[bytes]
    hashes: np.ndarray = field(init=False)
    ids: np.ndarray = field(init=False)
    seen: np.ndarray = field(init=False)
    longest: int = field(init=False)

    def __post_init__(self) -> None:
        data = np.frombuffer(b"".join(self.pieces), np.uint8)
        end = np.cumsum([len(p) for p in self.pieces])
        h = tb.span_hash(tb.prefix_hashes(data), end - [len(p) for p in self.pieces], end)
        self.ids = np.argsort(h, kind="stable").astype(np.int32)
        self.hashes = h[self.ids]
        self.seen = np.zeros(1 << 19, bool)
        self.seen[(h & np.uint64((1 << 19) - 1)).astype(np.int64)] = True
        self.longest = max(map(len, self.pieces))

    def lattice(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Lattice:
        """``data`` in lower case; words of at most MAX_WORD bytes."""
        out = []
        sizes = end - start
        for n in np.unique(sizes).tolist():
            which = np.flatnonzero(sizes == n)
            for lo in range(0, len(which), 16384):
                own = which[lo : lo + 16384]
                rows = np.empty((len(own), n + 1), np.uint8)
                rows[:, 0] = _MARK
                rows[:, 1:] = data[start[own][:, None] + np.arange(n)]
                prefix = tb.prefix_hashes(rows.ravel())
                base, arcs = np.arange(len(own)) * (n + 1), []
                for j in range(1, n + 2):
                    for size in range(1, min(j, self.longest) + 1):
                        h = tb.span_hash(prefix, base + (j - size), base + j)
                        maybe = np.flatnonzero(self.seen[(h & np.uint64((1 << 19) - 1)).astype(np.int64)])
                        at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
                        hit = self.hashes[at] == h[maybe]
                        if hit.any():
                            arcs.append((j - size, j, maybe[hit].astype(np.int32), self.ids[at[hit]]))
                out.append((own, np.array([n + 1]), arcs))
        return Lattice(len(start), out)


def log_likelihoods(lattice: Lattice, p: np.ndarray) -> np.ndarray:
    """Natural log of each word's probability, a column per column of ``p``; the forward algorithm."""
    out = np.empty((lattice.size, p.shape[1]))
    for own, n, arcs in lattice.arcs:
        alpha = np.zeros((int(n[0]) + 1, len(own), p.shape[1]))
        alpha[0] = 1.0
        for a, b, w, i in arcs:  # ordered by their ends; a word occurs once per (from, to)
            alpha[b, w] += alpha[a, w] * p[i]
        out[own] = np.log(alpha[-1])
    return out


def fit_pieces(pieces: Pieces, words: list[bytes], counts: np.ndarray, rounds: int = 4, smooth: float = 0.1) -> np.ndarray:
    """Piece probabilities of one language by expectation-maximisation over word counts."""
    p = np.full(len(pieces.pieces), 1.0 / len(pieces.pieces))
    if not words:
        return p
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    lattice = pieces.lattice(data, end - [len(w) for w in words], end)
    for _ in range(rounds):
        expected = np.full(len(p), smooth)
        for own, n, arcs in lattice.arcs:
            alpha, beta = np.zeros((2, int(n[0]) + 1, len(own)))
            alpha[0] = beta[-1] = 1.0
            for a, b, w, i in arcs:
                alpha[b, w] += alpha[a, w] * p[i]
            for a, b, w, i in sorted(arcs, key=lambda x: -x[0]):
                beta[a, w] += p[i] * beta[b, w]
            share = counts[own] / alpha[-1]
            for a, b, w, i in arcs:
                expected += np.bincount(i, share[w] * alpha[a, w] * p[i] * beta[b, w], len(p))
        p = expected / expected.sum()
    return p


@dataclass
class Model:
    langs: list[str]
    pieces: list[bytes]
    p: np.ndarray  # a row for each piece, a column for each language

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Scores batches of texts; keeps the likelihoods of words that it has met."""

    def __init__(self, model: Model) -> None:
        self.model, self.pieces = model, Pieces(model.pieces)
        self.limit = max(1024, _CACHE_BYTES // (8 * max(1, len(model.langs)) + 100))
        self.known: dict[int, int] = {}
        self.values = np.empty((0, len(model.langs)))

    def _likelihoods(self, data: np.ndarray, w: tb.Words) -> np.ndarray:
        u, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        if len(self.known) > self.limit:
            self.known, self.values = {}, self.values[:0]
        at = np.fromiter((self.known.get(h, -1) for h in u.tolist()), np.int64, len(u))
        new = np.flatnonzero(at < 0)
        if len(new):
            own = first[new]
            more = log_likelihoods(self.pieces.lattice(data, w.start[own], w.end[own]), self.model.p)
            at[new] = len(self.known) + np.arange(len(new))
            if len(self.known) + len(new) > len(self.values):
                grown = np.empty((2 * (len(self.known) + len(new)), self.values.shape[1]))
                grown[: len(self.known)] = self.values[: len(self.known)]
                self.values = grown
            self.values[at[new]] = more
            self.known.update(zip(u[new].tolist(), at[new].tolist()))
        return self.values[at[inverse]]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: language, its share, log-odds against evenly drawn letters, share of words with odds above one."""
        data, offsets = tb.buffer(pc.utf8_lower(texts.cast(pa.large_string())))
        langs: list[str] = []
        scores: list[np.ndarray] = []
        odds: list[np.ndarray] = []
        spoken: list[np.ndarray] = []
        for lo, hi in tb.pieces(offsets):
            d, o = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            w = letter_runs(d, o)
            total = np.zeros((hi - lo, len(self.model.langs)))
            of_words = np.zeros((0, total.shape[1]))
            if len(w.start) and self.model.langs:
                of_words = self._likelihoods(d, w)
                sums = np.concatenate([np.zeros((1, total.shape[1])), np.cumsum(of_words, axis=0)])
                total = sums[w.rows[1:]] - sums[w.rows[:-1]]
            letters = np.diff(w.rows) > 0
            ascii_letters = np.concatenate([[0], np.cumsum(LETTER[:128][d & 127] & (d < 128))])
            for r in np.flatnonzero(letters & (ascii_letters[o[1:]] == ascii_letters[o[:-1]])).tolist():
                letters[r] = any(c.isalpha() for c in d[o[r] : o[r + 1]].tobytes().decode(errors="ignore"))
            if not self.model.langs:
                langs += [UNKNOWN] * (hi - lo)
                scores.append(np.zeros(hi - lo))
                odds.append(np.zeros(hi - lo))
                spoken.append(np.zeros(hi - lo))
                continue
            best = total.argmax(1)
            share = 1.0 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            langs += [self.model.langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist())]
            scores.append(np.where(letters, share, 0.0))
            of_row = w.row_of()
            gain = of_words[np.arange(len(of_words)), best[of_row]] - EVEN * (w.end - w.start + 1)
            odds.append(np.bincount(of_row, gain, hi - lo))
            spoken.append(np.bincount(of_row, gain > 0, hi - lo) / np.maximum(np.diff(w.rows), 1))
        return langs, *(np.concatenate(x) if x else np.empty(0) for x in (scores, odds, spoken))


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tb.Words:
    """Runs of letters of at most MAX_WORD bytes, with hashes; longer runs become several."""
    w = tb.find_words(data, offsets, LETTER, hashes=False)
    parts = -(-(w.end - w.start) // MAX_WORD)
    if len(parts) and parts.max() > 1:
        first = np.concatenate([[0], np.cumsum(parts)])
        start = np.repeat(w.start, parts) + (np.arange(first[-1]) - np.repeat(first[:-1], parts)) * MAX_WORD
        w = tb.Words(start, np.minimum(start + MAX_WORD, np.repeat(w.end, parts)), w.hash, first[w.rows])
    w.hash = tb.span_hash(tb.prefix_hashes(data), w.start, w.end) if len(w.start) else w.hash
    return w


def train(
    docs: DataFrame,
    model_file: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    usable: Column | None = None,
    max_docs: int = MAX_DOCS,
    rounds: int = 4,
) -> Model:
    """Fits piece probabilities of every language on its bounded sample; ``usable`` filters ``docs`` first."""
    spark = docs.sparkSession
    base = docs if usable is None else docs.filter(usable)
    base = base.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    base = base.filter("id is not null and lang is not null and text is not null")
    # rows with a hash far above the expected max_docs-th smallest stay out of the ranking's shuffle
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    share = F.xxhash64("id") / F.lit(2.0**64) + 0.5
    # ids are what is chosen, so ids are counted, by a sketch; the margin below is far wider than its error
    sizes = F.broadcast(base.groupBy("lang").agg(F.approx_count_distinct("id", 0.02).alias("n")))  # a row for each language
    likely = base.select("id", "lang").join(sizes, "lang").filter(share * F.col("n") <= 1.3 * max_docs + 50).select("id", "lang").distinct()
    chosen = likely.withColumn("k", rank).filter(F.col("k") <= max_docs).select("id", "lang")
    # narrow rows, at most max_docs for each language
    counted = (
        base.join(F.broadcast(chosen), ["id", "lang"]).select("lang", "text")
        .mapInArrow(lean(_count_words), "lang string, word binary, n long")
        .groupBy("lang", "word").agg(F.sum("n").alias("n"))
    )
    pieces = vocabulary(model_file)
    held = spark.sparkContext.broadcast(pieces)

    def fit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("word")
        p = fit_pieces(Pieces(held.value), rows["word"].to_pylist(), rows["n"].to_numpy().astype(float), rounds)
        return pa.table({"lang": [rows["lang"][0].as_py()], "p": [p.tobytes()]}, schema=pa.schema([("lang", pa.string()), ("p", pa.binary())]))

    fitted = sorted((r["lang"], bytes(r["p"])) for r in counted.groupBy("lang").applyInArrow(fit, "lang string, p binary").collect())
    p = np.stack([np.frombuffer(x) for _, x in fitted], 1) if fitted else np.empty((len(pieces), 0))
    return Model([lang for lang, _ in fitted], pieces, p)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = batch.column("lang").dictionary_encode()
        lang = codes.indices.to_numpy(zero_copy_only=False)
        data, offsets = tb.buffer(pc.utf8_lower(batch.column("text").cast(pa.large_string())))
        for lo, hi in tb.pieces(offsets):
            d, o = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            w = letter_runs(d, o)
            of = lang[lo:hi][w.row_of()]
            for code in np.unique(of).tolist():
                own = np.flatnonzero(of == code)
                _, first, n = np.unique(w.hash[own], return_index=True, return_counts=True)
                at = own[first]
                words = [d[a:b].tobytes() for a, b in zip(w.start[at].tolist(), w.end[at].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([codes.dictionary[code].as_py()] * len(n), pa.string()), pa.array(words, pa.binary()), pa.array(n, pa.int64())],
                    ["lang", "word", "n"],
                )


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``lang_pred`` and ``score``, the share of the best language."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held.value.scorer()
        for batch in batches:
            lang, score, *_ = scorer.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(lean(run), f"doc_id {kind}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, *, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows with a language of at least that share that evenly drawn letters do not explain better by far, with all their columns; map-only."""
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held.value.scorer()
        for batch in batches:
            lang, score, odds, spoken = scorer.predict(batch.column(at))
            some = (score >= least) & ((odds > -np.log(NOISE_ODDS)) | (spoken >= WORDS_OF_LANGUAGE))
            yield batch.filter(pa.array([x != UNKNOWN and s for x, s in zip(lang, some.tolist())], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
