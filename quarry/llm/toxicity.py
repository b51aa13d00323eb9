"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the *presence* of its words, word pairs and skip-grams
(pairs with one word between), each hashed to 32 bits; words also count by
their first bytes (``Ftrl.heads``), a crude stem that ties inflected and compounded
forms.  Long texts are not normalised away, so one tell-tale word weighs the
same wherever it stands.
FTRL-proximal keeps per-coordinate learning rates and an L1 term that leaves
most coordinates at exactly zero: what is kept is a few thousand (index,
weight) pairs, which are broadcast to a map-only scoring pass.

Fitting reads a bounded sample of labelled rows: at most ``max_positive`` ids of
label 1 and ``max_negative`` of label 0, those with the smallest hashes of their
id, and of each label rows with at most ``max_features`` features together (one
row at least), so the sample is bounded in bytes too.  The intercept is then moved
to the class shares of *all* labelled rows.  Executors make features, count them
and leave out those that fewer than ``min_count`` sampled rows have; the rows' other
coordinates, 4 bytes each, go to one task in the order of a hash, where each epoch
is a sequential pass.

Rates, penalties and heads are chosen by cross-validation inside the learning rows
(``choose_toxicity``).

Defined cases.  Null and empty texts have no features and get the intercept's
score.  An id with several labels counts as toxic if one of them is 1; null
labels are ignored.  An id with several rows teaches the one with the fewest
features.  Without labels of both classes the model has no weights
and scores each text with the share of label 1, smoothed to a quarter.  Other columns are
never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .shared import drop_stash, lean, stash

MAX_POSITIVE, MAX_NEGATIVE, MAX_FEATURES = 4096, 12_288, 1 << 25


@dataclass(frozen=True)
class Ftrl:
    """Rates and penalties of FTRL-proximal, and the lengths of the word heads that are features."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.0
    epochs: int = 3
    min_count: int = 3
    heads: tuple[int, ...] = (4, 6)


@dataclass
class Model:
    """Sparse weights: sorted feature hashes, their weights, and the intercept."""

    index: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint32))
    weight: np.ndarray = field(default_factory=lambda: np.empty(0, np.float64))
    bias: float = 0.0
    heads: tuple[int, ...] = Ftrl.heads

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        logit = np.full(n, self.bias)
        if len(self.index):
            seen = np.zeros(1 << 20, bool)
            seen[self.index & 0xFFFFF] = True
            keys = []
            for row, h in features(data, offsets, self.heads):
                maybe = np.flatnonzero(seen[h & 0xFFFFF])
                at = np.minimum(np.searchsorted(self.index, h[maybe]), len(self.index) - 1)
                hit = self.index[at] == h[maybe]
                keys.append(row[maybe[hit]] * len(self.index) + at[hit])
            own = np.unique(np.concatenate(keys))  # presence: each weight once per text
            np.add.at(logit, own // len(self.index), self.weight[own % len(self.index)])
        return 1.0 / (1.0 + np.exp(-np.clip(logit, -40, 40)))


def features(data: np.ndarray, offsets: np.ndarray, heads: tuple[int, ...] = Ftrl.heads) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, 32-bit hash) of words, their heads, pairs and skip-grams, with repeats."""
    w = tb.find_words(data, offsets, hashes=False)
    row, prefix = w.row_of(), tb.prefix_hashes(data)
    w.hash = tb.span_hash(prefix, w.start, w.end)
    yield row, _short(w.hash.copy(), 1)
    for size in heads:
        longer = np.flatnonzero(w.end - w.start > size)
        yield row[longer], _short(tb.span_hash(prefix, w.start[longer], w.start[longer] + size), 16 + size)
    for gap, kind in ((1, 2), (2, 3)):
        if len(row) > gap:
            same = np.flatnonzero(row[gap:] == row[:-gap])
            with np.errstate(over="ignore"):
                yield row[same], _short(w.hash[same] * np.uint64(0x9E3779B97F4A7C15) + w.hash[same + gap], kind)


def _short(h: np.ndarray, kind: int) -> np.ndarray:
    h ^= np.uint64(kind)
    return (tb.mix64(h) >> np.uint64(32)).astype(np.uint32)


def row_features(data: np.ndarray, offsets: np.ndarray, heads: tuple[int, ...] = Ftrl.heads) -> list[np.ndarray]:
    """Per row the sorted distinct features."""
    parts = list(features(data, offsets, heads))
    row, h = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    key = np.unique((row.astype(np.uint64) << np.uint64(32)) | h)
    cut = np.searchsorted(key >> np.uint64(32), np.arange(len(offsets)))
    low = key.astype(np.uint32)
    return [low[a:b] for a, b in zip(cut[:-1], cut[1:])]


def coordinates(index: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Where a row's features stand in the sorted ``index``; those that are not in it are left out."""
    if not len(index):
        return np.empty(0, np.int32)
    at = np.minimum(np.searchsorted(index, row), len(index) - 1)
    return at[index[at] == row].astype(np.int32)


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, size: int, how: Ftrl) -> tuple[np.ndarray, float]:
    """Weights of ``size`` coordinates and the intercept: FTRL-proximal over rows of coordinates, in the
    given order, ``epochs`` times.  The intercept has a rate of its own and no penalty."""
    share = labels.mean() if len(labels) else 0.5
    bias = float(np.log((share + 1e-9) / (1 - share + 1e-9)))
    z, n = np.zeros(size), np.zeros(size)
    zb, nb = 0.0, 0.0

    def weights(z, n):
        return np.where(np.abs(z) > how.l1, -(z - np.sign(z) * how.l1) / ((how.beta + np.sqrt(n)) / how.alpha + how.l2), 0.0)

    b = bias
    for _ in range(how.epochs):
        for c, y in zip(rows, labels):
            zc, nc = z[c], n[c]
            wc = weights(zc, nc)
            p = 1.0 / (1.0 + np.exp(-np.clip(b + wc.sum(), -40, 40)))
            g = p - y
            root = np.sqrt(nc)
            n[c] = nc + g * g
            z[c] = zc + g - (np.sqrt(n[c]) - root) / how.alpha * wc
            sigma = (np.sqrt(nb + g * g) - np.sqrt(nb)) / how.alpha
            zb += g - sigma * (b - bias)
            nb += g * g
            b = bias - zb / ((how.beta + np.sqrt(nb)) / how.alpha)
    return weights(z, n), b


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    usable: Column | None = None,
    max_positive: int = MAX_POSITIVE,
    max_negative: int = MAX_NEGATIVE,
    max_features: int = MAX_FEATURES,
    how: Ftrl = Ftrl(),
) -> Model:
    """Fits a model on the bounded sample of labelled rows; ``usable`` filters ``labels`` first."""
    spark = docs.sparkSession
    known = labels if usable is None else labels.filter(usable)
    known = (
        known.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
        .filter("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = (total.get(1, 0) + 0.5) / (total.get(0, 0) + total.get(1, 0) + 2)  # a quarter without any label
    if not total.get(0) or not total.get(1):
        return Model(bias=float(np.log(share / (1 - share))), heads=how.heads)
    order = F.xxhash64("id")
    sample = (
        known.filter("y = 1").orderBy(order, "id").limit(max_positive)
        .unionByName(known.filter("y = 0").orderBy(order, "id").limit(max_negative))
    )  # at most max_positive + max_negative narrow rows, so it may be broadcast
    made = texts.join(F.broadcast(sample), "id").withColumn("o", F.xxhash64("id", F.lit(17))).mapInArrow(lean(_featurise(how.heads)), "o long, id string, y int, size long, f binary")
    rows = stash(made.groupBy("id").agg(F.min(F.struct("size", "f", "o", "y")).alias("r")).select("id", "r.*"), "toxicity-rows")
    used = F.sum("size").over(Window.partitionBy("y").orderBy("o", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    narrow = rows.select("id", "y", "o", "size").withColumn("used", used).filter((F.col("used") <= max_features) | (F.col("used") == F.col("size"))).select("id")
    rows = rows.join(F.broadcast(narrow), "id")  # as many ids as the sample has

    counted = rows.select("f").mapInArrow(lean(_count), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= how.min_count)
    index = np.sort(counted.select("h").toArrow()["h"].to_numpy()).astype(np.uint32)  # at most 2 * max_features / min_count
    held = spark.sparkContext.broadcast(index)

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [coordinates(held.value, np.frombuffer(f.as_buffer(), np.uint32)).tobytes() for f in batch.column("f")]
            yield pa.RecordBatch.from_arrays([batch.column("o"), batch.column("id"), batch.column("y"), pa.array(own, pa.binary())], ["o", "id", "y", "c"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels = [], []
        for batch in batches:
            labels += batch.column("y").to_pylist()
            rows += [np.frombuffer(c.as_buffer(), np.int32).copy() for c in batch.column("c")]
        w, bias = fit_rows(rows, np.array(labels, float), len(held.value), how)
        on = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *held.value[on].tolist()], pa.int64()), pa.array([bias, *w[on].tolist()], pa.float64()), pa.array([sum(labels)] * (len(on) + 1), pa.float64()), pa.array([len(labels)] * (len(on) + 1), pa.float64())], ["i", "w", "ones", "rows"])

    placed = rows.mapInArrow(lean(located), "o long, id string, y int, c binary")
    fitted = sorted((r["i"], r["w"], r["ones"], r["rows"]) for r in placed.repartition(1).sortWithinPartitions("o", "id").mapInArrow(lean(fit), "i long, w double, ones double, rows double").collect())
    drop_stash(rows)
    held.unpersist()
    if not fitted or not fitted[0][2] or fitted[0][2] == fitted[0][3]:  # no text, or texts of one label alone
        return Model(bias=float(np.log(share / (1 - share))), heads=how.heads)
    ones, zeros = fitted[0][2], fitted[0][3] - fitted[0][2]
    shift = np.log(total[1] / total[0]) - np.log(ones / zeros)
    return Model(np.array([r[0] for r in fitted[1:]], np.uint32), np.array([r[1] for r in fitted[1:]]), fitted[0][1] + float(shift), how.heads)


def _featurise(heads: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").cast(pa.string())
            data, offsets = tb.buffer(batch.column("text"))
            for lo, hi in tb.pieces(offsets):
                rows = row_features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], heads)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("o").slice(lo, hi - lo), ids.slice(lo, hi - lo), batch.column("y").slice(lo, hi - lo), pa.array([len(r) for r in rows], pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())],
                    ["o", "id", "y", "size", "f"],
                )

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, n = np.unique(np.concatenate([np.frombuffer(f.as_buffer(), np.uint32) for f in batch.column(0)] or [np.empty(0, np.uint32)]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(n)], ["h", "n"])


def _scores(model: Model, texts: pa.Array) -> np.ndarray:
    data, offsets = tb.buffer(texts)
    parts = [model.scores(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in tb.pieces(offsets)]
    return np.concatenate(parts) if parts else np.empty(0)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``score`` and ``predicted`` (1 at 0.5 and above)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(held.value, batch.column(1)))], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(id_col, text_col).mapInArrow(lean(run), f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, *, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows whose score is below ``limit``, with all their columns; map-only."""
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(held.value, batch.column(at)) < limit))

    return docs.mapInArrow(lean(run), docs.schema)
