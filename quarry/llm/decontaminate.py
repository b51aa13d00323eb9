"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Words are runs of ASCII letters, digits and non-ASCII characters, with A-Z in
lower case.  A benchmark item gives one window per run of ``n`` words, an item
of fewer words (but at least one) a single window of all its words.  Training
documents are scanned once, map-only: a rolling hash of each window is looked
up in a bitmap and then in the sorted hash set, hits are verified word by word,
and the words under verified windows are marked.

Scale.  The scan neither shuffles nor collects documents.  What is broadcast is
the benchmark, whose size is checked: items are dealt into blocks of at most
``max_windows`` windows, and each block is broadcast by itself.  Before the last
block, rows and what earlier blocks marked in them go to spark.checkpoint.dir, so
that a worker holds one block; all blocks see the original text, and the result
is that of one block.  No block needs a shuffle.

Defined cases.  Null and empty texts have no words: 0 words, 0 hits, not
contaminated.  Null item texts give no window; repeated item rows count once.
Empty tables give empty or clean results.  Columns other than the id and the
text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from . import textbytes as tb
from .shared import drop_stash, lean, stash

WINDOW = 13
#: Windows of one broadcast block: about 200 MB at 100 bytes each.
MAX_WINDOWS = 2_000_000
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")

_HITS = "doc_id long, n_words long, hit_words array<int>, item_ids array<string>, spans array<struct<start:int,end:int>>"


def _pattern_words(text: str) -> list[bytes]:
    return _WORDS.findall(text.encode().translate(_FOLD))


_FOLD = bytes(tb.fold_ascii(np.arange(256, dtype=np.uint8)))


class WindowSet:
    """Hash set of item windows, one sorted array for each window length."""

    def __init__(self, items: list[tuple[str, str]], n: int = WINDOW) -> None:
        held: dict[int, dict[bytes, set[str]]] = {}
        for item, text in items:
            words = _pattern_words(text or "")
            k = min(n, len(words))
            for i in range(len(words) - k + 1 if k else 0):
                held.setdefault(k, {}).setdefault(b" ".join(words[i : i + k]), set()).add(item)
        self.sets = []
        for k, windows in sorted(held.items()):
            texts = list(windows)
            data = np.frombuffer(b"".join(texts), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            hashes = np.empty(len(texts), np.uint64)
            for lo, hi in tb.pieces(offsets):
                w = tb.find_words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                hashes[lo:hi] = tb.grams(w.hash, w.rows, k)[0]
            order = np.argsort(hashes, kind="stable")
            bits = max(16, (16 * len(texts) - 1).bit_length())
            seen = np.zeros(1 << bits, bool)
            seen[(hashes & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
            # equal hashes of different windows stay side by side; verification tells them apart
            self.sets.append((k, hashes[order], [texts[i] for i in order], [sorted(windows[texts[i]]) for i in order], seen, np.uint64((1 << bits) - 1)))

    def scan(self, data: np.ndarray, offsets: np.ndarray, before: list[dict] | None = None) -> Iterator[tuple[int, int, list[int], list[str], list[dict]]]:
        """Per row: number of words, hit word numbers, items, byte spans of hit runs; with the words and items that ``before`` has for it."""
        w = tb.find_words(data, offsets)
        n_words = np.diff(w.rows)
        hits: dict[int, list[tuple[int, int, list[str]]]] = {}
        for k, hashes, texts, owners, seen, mask in self.sets:
            g, bounds = tb.grams(w.hash, w.rows, k)
            maybe = np.flatnonzero(seen[(g & mask).astype(np.int64)])
            if not len(maybe):
                continue
            lo = np.searchsorted(hashes, g[maybe], "left")
            hi = np.searchsorted(hashes, g[maybe], "right")
            found = np.flatnonzero(hi > lo)
            row = np.searchsorted(bounds, maybe, "right") - 1
            for j in found.tolist():
                r = int(row[j])
                hits.setdefault(r, []).append((int(maybe[j] - bounds[r]), k, int(lo[j]), int(hi[j]), texts, owners))
        folded = None
        for r in range(len(n_words)):
            old = before[r] if before else {"words": [], "items": []}
            if r not in hits and not old["words"]:
                yield r, int(n_words[r]), [], [], []
                continue
            if folded is None:
                folded = tb.fold_ascii(data)
            words = _WORDS.findall(folded[offsets[r] : offsets[r + 1]].tobytes())
            marked, items = np.zeros(len(words) + 1, np.int64), set(old["items"])
            for at, k, lo, hi, texts, owners in hits.get(r, []):
                own = b" ".join(words[at : at + k])
                for i in range(lo, hi):
                    if texts[i] == own:
                        marked[at] += 1
                        marked[at + k if at + k < len(words) else -1] -= 1
                        items.update(owners[i])
            hit = np.union1d(np.flatnonzero(np.cumsum(marked[:-1]) > 0), np.array(old["words"], np.int64))
            runs = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1) if len(hit) else []
            first, base = w.rows[r], offsets[r]
            spans = [{"start": int(w.start[first + x[0]] - base), "end": int(w.end[first + x[-1]] - base)} for x in runs]
            yield r, len(words), hit.tolist(), sorted(items), spans


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, n: int, limit: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of at most ``limit`` windows each (one item at least), one block at a time."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).dropna().distinct()
    # a window ends at a word, and each word has a byte and a separator
    bound = F.lit(1) + F.octet_length("text") / 2
    total = items.agg(F.sum(bound)).first()[0] or 0
    parts = max(1, int(-(-total // limit)))
    for part in range(parts):
        block = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        yield [(r["item"], r["text"]) for r in block.toLocalIterator()]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    n: int = WINDOW,
    min_share: float = 0.05,
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """Per document row: ``doc_id, n_words, n_hit, item_ids, spans, contaminated``.

    ``spans`` are UTF-8 byte ranges of the hit words, ``item_ids`` the items with
    a window in the document, as sorted strings.  A document is contaminated if
    hit words are at least ``min_share`` of its words.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = _HITS.replace("doc_id long", f"doc_id {base.schema['doc_id'].dataType.simpleString()}")
    base, held = _all_but_last(base, 1, _blocks(benchmark, item_col, item_text_col, n, max_windows), n)
    out = base.mapInArrow(lean(_scanner(held)), schema).withColumn("n_hit", F.size("hit_words").cast("long"))
    least = Fraction(str(min_share))  # compared in integers
    share = F.col("n_hit") * least.denominator >= F.col("n_words") * least.numerator
    return out.select("doc_id", "n_words", "n_hit", "item_ids", "spans", ((F.col("n_hit") > 0) & share).alias("contaminated"))


_BEFORE = "__hits_before"
_BEFORE_TYPE = StructType().add("words", ArrayType(IntegerType())).add("items", ArrayType(StringType()))
_BEFORE_ARROW = pa.struct([("words", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def _all_but_last(docs: DataFrame, at: int, blocks: Iterator[list[tuple[str, str]]], n: int) -> tuple[DataFrame, Broadcast]:
    """The rows with the marks of all blocks but the last (a column more, if there are several), and the last block."""
    frame, schema, held = docs, StructType([*docs.schema.fields]).add(_BEFORE, _BEFORE_TYPE), None
    for items in blocks:
        if held is not None:
            marked = stash(frame.mapInArrow(lean(_marker(held, at, docs.columns)), schema), "decontaminate")
            if frame is not docs:
                drop_stash(frame)
            held.unpersist()
            frame = marked
        held = docs.sparkSession.sparkContext.broadcast(WindowSet(items, n))
    return frame, held


def _hits_before(batch: pa.RecordBatch, lo: int, hi: int) -> list[dict] | None:
    at = batch.schema.get_field_index(_BEFORE)
    return batch.column(at).slice(lo, hi - lo).to_pylist() if at >= 0 else None


def _marker(held, at: int, cols: list[str]):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: WindowSet = held.value
        for batch in batches:
            data, offsets = tb.buffer(batch.column(at))
            marks = []
            for lo, hi in tb.pieces(offsets):
                rows = windows.scan(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], _hits_before(batch, lo, hi))
                marks += [{"words": x[2], "items": x[3]} for x in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(cols)], pa.array(marks, _BEFORE_ARROW)], [*cols, _BEFORE])

    return mark


def _scanner(held):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: WindowSet = held.value
        for batch in batches:
            data, offsets = tb.buffer(batch.column(1))
            ids = batch.column(0)
            for lo, hi in tb.pieces(offsets):
                rows = list(windows.scan(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], _hits_before(batch, lo, hi)))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo),
                        pa.array([x[1] for x in rows], pa.int64()),
                        pa.array([x[2] for x in rows], pa.list_(pa.int32())),
                        pa.array([x[3] for x in rows], pa.list_(pa.string())),
                        pa.array([x[4] for x in rows], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    ],
                    ["doc_id", "n_words", "hit_words", "item_ids", "spans"],
                )

    return scan


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    n: int = WINDOW,
    min_share: float = 0.05,
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """The documents without those that are contaminated and, in the others, without the
    hit words and what stands between them; all columns stay.

    Spans of all blocks are found on the original text and cut once.
    """
    cols, share = docs.columns, Fraction(str(min_share))
    at = cols.index(text_col)
    marked, held = _all_but_last(docs, at, _blocks(benchmark, item_col, item_text_col, n, max_windows), n)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: WindowSet = held.value
        for batch in batches:
            texts = batch.column(at)
            data, offsets = tb.buffer(texts)
            out, kept = [], []
            for lo, hi in tb.pieces(offsets):
                o, d = offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
                for r, n_words, hit, _, spans in windows.scan(d, o, _hits_before(batch, lo, hi)):
                    kept.append(not (hit and len(hit) * share.denominator >= n_words * share.numerator))
                    raw, rest, last = d[o[r] : o[r + 1]].tobytes(), [], 0
                    for s in spans:
                        rest.append(raw[last : s["start"]])
                        last = s["end"]
                    out.append(b"".join([*rest, raw[last:]]).decode() if texts[lo + r].is_valid else None)
            arrays = [*batch.columns[: len(cols)]]
            arrays[at] = pa.array(out, texts.type)
            yield pa.RecordBatch.from_arrays(arrays, cols).filter(pa.array(kept, pa.bool_()))

    return marked.mapInArrow(lean(cut), docs.schema)
