"""Vectorised word scanning over the UTF-8 buffers of Arrow string batches.

Every Python operator of this subpackage reads text the same way: the batch's
string buffer is viewed as one ``uint8`` array (no per-row ``str`` objects),
words are runs of bytes that a 256-entry class table accepts, and each word
gets a 64-bit hash from one prefix sum over the buffer.  All steps are numpy
kernels, so the cost is a few nanoseconds a byte, and a batch is cut into
pieces of about ``CHUNK_BYTES`` so that the working set is bounded whatever the
batch holds (one document longer than that is a piece of its own).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_M64 = (1 << 64) - 1


def _splitmix(n: int, seed: int) -> np.ndarray:
    out, x = np.empty(n, np.uint64), seed
    for i in range(n):
        x = (x + 0x9E3779B97F4A7C15) & _M64
        z = x
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _M64
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _M64
        out[i] = z ^ (z >> 31)
    return out


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values; works in place."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_BASE = 0x2545F4914F6CDD1D  # odd, so it has an inverse modulo 2**64
_INV = pow(_BASE, -1, 1 << 64)
_CODE = _splitmix(256, 7)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_CODE = _CODE[_LOWER]
#: Word bytes: digits, letters and all bytes of non-ASCII characters.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = True
WORD[128:] = True


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(n, _BASE, np.uint64), np.full(n, _INV, np.uint64)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(CHUNK_BYTES, 1 << (n - 1).bit_length()) if n > 1 else CHUNK_BYTES)


def buffer(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and int64 row offsets into them; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, of one row at least."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def fold_ascii(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return _LOWER[data]


@dataclass
class Words:
    """Words of some rows: byte ranges, hashes, and per row the range of its words."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    rows: np.ndarray  # row r has words rows[r] .. rows[r + 1]

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))


def prefix_hashes(data: np.ndarray, code: np.ndarray = _LOWER_CODE) -> np.ndarray:
    """Prefix sums from which ``span_hash`` gets the hash of any byte range."""
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(code[data] * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; equal bytes have equal hashes wherever they stand."""
    with np.errstate(over="ignore"):
        h = (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]
        h += (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mix64(h)


def find_words(data: np.ndarray, offsets: np.ndarray, word: np.ndarray = WORD, hashes: bool = True) -> Words:
    """Maximal runs of word bytes within each row, hashed with A-Z in lower case."""
    n = len(data)
    if not n:
        z = np.empty(0, np.int64)
        return Words(z, z, np.empty(0, np.uint64), np.zeros(len(offsets), np.int64))
    is_word = word[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, is_word[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    start = np.flatnonzero(is_word & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, is_word[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    end = np.flatnonzero(is_word & ~after) + 1
    h = span_hash(prefix_hashes(data), start, end) if hashes else np.empty(0, np.uint64)
    return Words(start, end, h, np.searchsorted(start, offsets))


def grams(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words inside a row, and per row the range of its runs.

    The run that begins at word ``w`` of row ``r`` has index ``w - r_lost`` where the
    ranges say where each row's runs begin; rows with fewer than ``k`` words have none.
    """
    counts = np.maximum(np.diff(rows) - k + 1, 0)
    bounds = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=bounds[1:])
    if not bounds[-1]:
        return np.empty(0, np.uint64), bounds
    with np.errstate(over="ignore"):
        whole = hashes[: len(hashes) - k + 1].copy()
        for j in range(1, k):
            whole *= np.uint64(0x9E3779B97F4A7C15)
            whole += hashes[j : len(hashes) - k + 1 + j]
        at = np.arange(bounds[-1]) + np.repeat(rows[:-1] - bounds[:-1], counts)
        return mix64(whole[at] ^ np.uint64(k)), bounds
