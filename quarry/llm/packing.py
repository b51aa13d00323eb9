"""Best-fit packing: best-fit decreasing with a segment tree over remaining capacities.

Documents become token ids, those longer than a sequence are cut into pieces of a
whole sequence and a rest, and pieces are packed into sequences of at most
``capacity`` tokens.  Best-fit decreasing puts the longest piece first, each into
the open sequence with the least room that still holds it; a segment tree over the
remaining capacities 0 .. capacity finds that room in logarithmic time.

Scale.  Which *document* a piece is from does not matter to the packing, only its
length, so the plan is made for the histogram of lengths: at most ``capacity``
counts reach the driver, whatever the corpus.  Pieces of one length go to runs of
sequences with equal contents, so one decision of the tree places any number of
pieces exactly as best-fit decreasing would one by one, and the plan is a table
of (length, ranks, sequences, offset) whose size depends on ``capacity`` alone.
A piece then needs its rank among the pieces of its length: its rank within its
partition, counted while it is written, plus the counts of earlier partitions.
No task sees more than its partition, and a length that a third of all pieces
have is not gathered anywhere.

Tokens.  Text is split at blanks, which the tokenizer drops and never joins
across, and before marks that end a word; chunks that differ only in ASCII case are one; each distinct chunk is encoded once per worker and the ids are gathered by
numpy, so repeated words cost a table lookup.

Defined cases.  Null and empty texts are documents of the end token alone.
Repeated rows are packed as often as they occur.  An empty table gives no pieces.
"""

from __future__ import annotations

import os
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .shared import lean, stash

CAPACITY = 4096
END = 1
_CACHE = 400_000
_CHUNK = np.ones(256, bool)
_CHUNK[[9, 10, 13, 32]] = False
#: The tokenizer's own split, for ASCII in lower case.
_ASCII_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_PRINTABLE = re.compile(rb"[!-~]+")
_MARK, _ALNUM = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(b",.;:!?)")] = True
_ALNUM[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True


def split_marks(data: np.ndarray, w: tb.Words) -> tb.Words:
    """Chunks that end in up to three marks after an ASCII letter or digit become two: the tokenizer
    splits there in any case, and words repeat more often without their marks."""
    cut = w.end.copy()
    for _ in range(3):
        cut -= (cut - 1 > w.start) & _MARK[data[cut - 1]]
    two = (cut < w.end) & _ALNUM[data[cut - 1]]
    added = np.concatenate([[0], np.cumsum(two)])
    at = np.arange(len(cut)) + added[:-1]
    start, end = np.empty((2, len(cut) + added[-1]), np.int64)
    start[at], end[at] = w.start, np.where(two, cut, w.end)
    start[at[two] + 1], end[at[two] + 1] = cut[two], w.end[two]
    return tb.Words(start, end, w.hash, w.rows + added[w.rows])


class ChunkTokenizer:
    """Ids of texts by a ``tokenizers`` file whose pre-tokenizer drops white space."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # executors have their cores for tasks
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts: dict[str, list[int]] = {}
        self.known: dict[int, int] = {}
        self.ids, self.used = np.empty(1 << 16, np.int32), 0
        self.start, self.count = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _encode(self, chunks: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = []
        hard = []
        model, parts = self.tokenizer.model, self.parts
        for i, chunk in enumerate(chunks):
            if chunk.isalpha():  # ASCII letters: one part, which the caller keeps by its chunk
                out.append([t.id for t in model.tokenize(chunk.decode().lower())])
                continue
            if not _PRINTABLE.fullmatch(chunk) or b"<|" in chunk:  # not plain ASCII, or a special token
                hard.append(i)
                out.append([])
                continue
            own: list[int] = []
            for part in _ASCII_PARTS.findall(chunk.decode().lower()):
                ids = parts.get(part)
                if ids is None:
                    ids = parts[part] = [t.id for t in model.tokenize(part)]
                own += ids
            out.append(own)
        if hard:
            for i, e in zip(hard, self.tokenizer.encode_batch_fast([chunks[i].decode() for i in hard], add_special_tokens=False)):
                out[i] = e.ids
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids, END after each row, and the rows' bounds in them."""
        w = split_marks(data, tb.find_words(data, offsets, _CHUNK, hashes=False))
        n_rows = len(offsets) - 1
        unit = np.zeros(len(w.start) + n_rows, np.int64)  # the chunks of each row and its end; 0: the end
        if len(w.start):
            # the tokenizer lower-cases all but special tokens: only chunks with "<" are told apart by case
            h = tb.span_hash(tb.prefix_hashes(data), w.start, w.end)
            special = np.flatnonzero(np.diff(np.cumsum(np.concatenate([[0], data == ord("<")]))[np.stack([w.start, w.end])], axis=0)[0])
            if len(special):
                h[special] = tb.span_hash(tb.prefix_hashes(data, tb._CODE), w.start[special], w.end[special]) ^ np.uint64(1)
            u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            if len(self.known) > _CACHE:
                self.known, self.parts, self.used = {}, {}, 0
            at = np.fromiter((self.known.get(x, 0) for x in u.tolist()), np.int64, len(u))
            new = np.flatnonzero(at == 0)
            if len(new):
                own = first[new]
                raw = data.tobytes()
                lists = self._encode([raw[a:b] for a, b in zip(w.start[own].tolist(), w.end[own].tolist())])
                at[new] = self._keep(u[new], lists)
            unit[np.arange(len(inverse)) + w.row_of()] = at[inverse]
        start = np.concatenate([[0], self.start[1 : len(self.known) + 1]])
        count = np.concatenate([[1], self.count[1 : len(self.known) + 1]])
        n = count[unit]
        ends = np.cumsum(n)
        flat = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[unit] - (ends - n), n)
        ids = self.ids[flat]
        row_end = ends[w.rows[1:] + np.arange(n_rows)]
        ids[row_end - 1] = END
        return ids, np.concatenate([[0], row_end])

    def _keep(self, hashes: np.ndarray, lists: list[list[int]]) -> np.ndarray:
        n = np.array([len(x) for x in lists])
        flat = np.array([i for x in lists for i in x], np.int32)
        base = len(self.known) + 1
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(self.used + 2 * len(flat), np.int32)])
        if base + len(n) > len(self.start):
            self.start = np.concatenate([self.start, np.empty(base + 2 * len(n), np.int64)])
            self.count = np.concatenate([self.count, np.empty(base + 2 * len(n), np.int64)])
        self.ids[self.used : self.used + len(flat)] = flat
        at = base + np.arange(len(n))
        self.start[at], self.count[at] = self.used + np.cumsum(n) - n, n
        self.used += len(flat)
        self.known.update(zip(hashes.tolist(), at.tolist()))
        return at


_tokenizers: dict[str, ChunkTokenizer] = {}


def tokenize(docs: DataFrame, tokenizer_file: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of each document: ``doc_id, piece, start, length, ids`` (little-endian unsigned 32-bit)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_file not in _tokenizers:
            _tokenizers[tokenizer_file] = ChunkTokenizer(tokenizer_file)
        tokenizer = _tokenizers[tokenizer_file]
        for batch in batches:
            data, offsets = tb.buffer(batch.column(1))
            for lo, hi in tb.pieces(offsets):
                ids, bounds = tokenizer.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                n = np.diff(bounds)
                parts = -(-n // capacity)
                row = np.repeat(np.arange(hi - lo), parts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                length = np.minimum(capacity, n[row] - piece * capacity)
                ends = np.concatenate([[0], np.cumsum(4 * length)])  # pieces follow each other as their ids do
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(lo + row)), pa.array(piece, pa.int32()), pa.array(piece * capacity), pa.array(length), raw.cast(pa.binary())],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    return docs.select(id_col, text_col).mapInArrow(lean(run), f"doc_id {kind}, piece int, start long, length long, ids binary")


class Rooms:
    """Segment tree over remaining capacities: which of them some open sequences have."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # remaining -> (first sequence, how many)

    def put(self, room: int, first: int, n: int) -> None:
        self.runs[room].append((first, n))
        at = self.size + room
        while at and not self.any[at]:
            self.any[at] = True
            at //= 2

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        if not self.runs[room]:
            at = self.size + room
            self.any[at] = False
            while at > 1 and not self.any[at ^ 1]:
                at //= 2
                self.any[at] = False
        return run

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of at least ``least`` that an open sequence has."""
        at = self.size + least
        if self.any[at]:
            return least
        while at > 1:
            if not at & 1 and self.any[at ^ 1]:
                at ^= 1
                while at < self.size:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best-fit decreasing of ``{length: pieces}``: rows (length, first rank, first sequence, pieces a
    sequence gets, offset of the first of them), sorted by length and rank, and the number of sequences."""
    rooms, rows, opened = Rooms(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = rooms.tightest(length)
            if room is None:
                room, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            else:
                first, n = rooms.take(room)
            each = room // length  # a sequence stays the tightest until it has no room for another
            full = min(n, left // each)
            if full:
                rows.append((length, rank, first, each, capacity - room))
                if room - each * length:
                    rooms.put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left and left < each:
                rows.append((length, rank, first + full, each, capacity - room))
                rooms.put(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            if full < n:
                rooms.put(room, first + full, n - full)
    return np.array(sorted(rows), np.int64).reshape(-1, 5), opened


def pack(pieces: DataFrame, *, length_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """The pieces with ``sequence_id`` (from 0) and ``offset``; lengths from 1 to ``capacity``."""
    spark = pieces.sparkSession
    taken = {c.lower() for c in pieces.columns}
    if taken & {"sequence_id", "offset", "__part", "__rank"}:
        raise ValueError("pieces have columns that packing adds")
    cols = pieces.columns
    at = cols.index(length_col)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            length = batch.column(at).to_numpy().astype(np.int64)
            if len(length) and not 0 < length.min() <= length.max() <= capacity:
                raise ValueError(f"a piece's length is not from 1 to {capacity}")
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            first = np.searchsorted(ordered, ordered)
            own = np.empty(len(length), np.int64)
            own[order] = np.arange(len(length)) - first + seen[ordered]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(own), part)), pa.array(own)], [*cols, "__part", "__rank"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    ranked = stash(pieces.mapInArrow(lean(rank), f"{fields}, __part long, __rank long"), "pieces")
    counts = ranked.groupBy("__part", length_col).agg(F.count("*").alias("__n"))
    histogram = {r[length_col]: r["n"] for r in counts.groupBy(length_col).agg(F.sum("__n").alias("n")).collect()}  # at most capacity rows
    rows, _ = plan(histogram, capacity)
    before = F.sum("__n").over(Window.partitionBy(length_col).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    earlier = counts.select("__part", length_col, F.coalesce(before, F.lit(0)).alias("__before"))
    joined = ranked.join(earlier, ["__part", length_col]).select(*cols, (F.col("__rank") + F.col("__before")).alias("__rank"))
    held = spark.sparkContext.broadcast(rows)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = held.value
        width = np.int64(1) << 48
        keys = rows[:, 0] * width + rows[:, 1]
        for batch in batches:
            length, own = batch.column(at).to_numpy().astype(np.int64), batch.column(len(cols)).to_numpy()
            p = rows[np.searchsorted(keys, length * width + own, "right") - 1]
            n = own - p[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p[:, 2] + n // p[:, 3]), pa.array(p[:, 4] + n % p[:, 3] * length)], [*cols, "sequence_id", "offset"])

    return joined.mapInArrow(lean(place), f"{fields}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, length, ids`` from packed pieces that have ids; a group holds ``capacity`` tokens at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
