"""N-gram Jaccard join: MinHash banding, a shuffle on band hashes, pairs verified on full n-gram sets.

A text's set are the hashes of its runs of ``n`` words (of all its words, if it
has fewer).  Two documents are linked if the Jaccard similarity of their sets is
at least ``threshold``.  The result is one row per document: ``class_id`` (the
smallest document id among those that links connect it with), ``copy_id`` (the
same among those with an equal set) and ``n_links`` (how many other documents
it is linked with, copies included).

How it runs:

1.  One map-only pass makes each document's set digest and band hashes; documents
    with equal sets become one representative, pre-aggregated before the shuffle,
    so a group of copies of any size costs one row from here on.
2.  Band hashes are shuffled and counted.  Representatives that share a band hash
    with another are candidates; each goes home to the largest of its buckets, and
    homes are split into blocks bounded in members and in n-grams (``block_count``).
3.  Two blocks meet if some bucket has members in both, so every pair that shares a
    band is in exactly one pair of blocks; a chain of small buckets meets only its
    neighbours, and only a bucket that is itself large costs many block pairs.
4.  The sets of candidates alone are made again from their texts: a second pass
    over documents drops the others by a bitmap before its shuffle.
5.  A unit of work is a block with some of the smaller blocks that it meets: common
    n-grams are counted by a matrix product, and one row per member comes out (its
    links and its smallest linked member), not pairs.  A group of thousands of near
    copies becomes many units.
6.  Components of verified links give the classes.

Bands and rows are chosen for ``recall`` at the threshold (``choose_bands``).  Blocks
are verified whole, so pairs that share no band are found too if they share blocks.
Working tables go to spark.checkpoint.dir; those that the result does not read are
deleted before it is returned.

Defined cases.  Null and empty texts are linked with nothing: class and copy id
are their own id.  Texts without a word are copies if they are equal.  Repeated
rows are copies.  Null ids are kept; an id of null never becomes a class id
while its class has another.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .components import components
from .shared import drop_stash, lean, sorted_groups, stash

NGRAM, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Members of a block: twice the root of its home's size, but within BLOCK and 8 * BLOCK; and its n-grams.
BLOCK, BLOCK_GRAMS = 128, 1 << 20
#: Bits of the candidates' bitmap: 16 a candidate up to here (16 MB); beyond, the filter only gets weaker.
FILTER_BITS = 1 << 27


def choose_bands(threshold: float, recall: float, max_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, with which ``max_hashes``
    suffice to meet a pair at the threshold with probability ``recall`` at least."""
    best = None
    for rows in range(1, max_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no bands reach that recall with so few hashes")
    return best


def gram_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Per row the sorted distinct n-gram hashes; a row of fewer words has one gram of them all."""
    w = tb.find_words(data, offsets)
    g, bounds = tb.grams(w.hash, w.rows, n)
    out = [np.unique(g[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    counts = np.diff(w.rows)
    for k in range(1, n):
        rows = np.flatnonzero(counts == k)
        if len(rows):
            g, bounds = tb.grams(w.hash, w.rows, k)
            for r in rows.tolist():
                out[r] = g[bounds[r] : bounds[r + 1]]
    return out


def digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit sums over each non-empty set, those rows, and where their members begin."""
    rows = np.flatnonzero([len(s) > 0 for s in sets])
    if not len(rows):
        return np.empty(0, np.int64), np.empty(0, np.int64), rows, rows
    sizes = np.array([len(sets[r]) for r in rows])
    start = np.cumsum(sizes) - sizes
    g = np.concatenate([sets[r] for r in rows])
    with np.errstate(over="ignore"):
        one = np.add.reduceat(g, start)
        two = np.add.reduceat(tb.mix64(g ^ np.uint64(0xA0761D6478BD642F)), start)
    return one.view(np.int64), two.view(np.int64), rows, start


def band_hashes(g: np.ndarray, start: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit hash for each set (its members from ``start`` on) and band."""
    a = tb._splitmix(bands * rows, 99) | np.uint64(1)
    b = tb._splitmix(bands * rows, 101)
    out = np.zeros((len(start), bands), np.uint64)
    work = np.empty_like(g)
    with np.errstate(over="ignore"):
        for k in range(bands * rows):
            np.multiply(g, a[k], out=work)
            work ^= b[k]
            out[:, k // rows] *= np.uint64(0x9E3779B97F4A7C15)
            out[:, k // rows] += np.minimum.reduceat(work, start)
        return tb.mix64(out).view(np.int64)


def _text_digest(raw: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(raw, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _signatures(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.buffer(batch.column(1))
            for lo, hi in tb.pieces(offsets):
                d, o = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                sets = gram_sets(d, o, n)
                one, two, own, start = digests(sets)
                d1, d2 = [None] * (hi - lo), [None] * (hi - lo)
                hashes: list = [None] * (hi - lo)
                if len(own):
                    found = band_hashes(np.concatenate([sets[r] for r in own]), start, bands, rows)
                    for r, x, y, h in zip(own.tolist(), one.tolist(), two.tolist(), found):
                        d1[r], d2[r], hashes[r] = x, y, h
                for r in range(hi - lo):
                    if d1[r] is None and o[r] < o[r + 1]:
                        d1[r], d2[r] = _text_digest(d[o[r] : o[r + 1]].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                        pa.array([len(s) for s in sets], pa.int32()), pa.array(hashes, pa.list_(pa.int64())),
                    ],
                    ["id", "d1", "d2", "n", "bands"],
                )

    return run


def _bitmap(keys: DataFrame, most: int) -> tuple[np.ndarray, int]:
    """A bitmap of the column ``d1`` and its number of bits; at most ``most / 64`` rows reach the driver."""
    bits = min(most, max(1 << 16, 1 << (16 * keys.count()).bit_length()))
    slot = F.col("d1").bitwiseAND(F.lit(bits - 1))
    words = keys.select(F.shiftright(slot, 6).alias("word"), F.expr("shiftleft(1L, cast(d1 & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit"))
    got = words.toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[got["word"].to_numpy()] = got["bit"].to_numpy()
    return out, bits


def _in_bitmap(bitmap: np.ndarray, bits: int, d1: np.ndarray) -> np.ndarray:
    slot = d1 & (bits - 1)
    return (bitmap[slot >> 6] >> (slot & 63)) & 1 == 1


def _sets_of(held, bits: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()  # a task sends each set once
        for batch in batches:
            data, offsets = tb.buffer(batch.column(0))
            for lo, hi in tb.pieces(offsets):
                sets = gram_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n)
                one, two, own, _ = digests(sets)
                out = []
                for i in np.flatnonzero(_in_bitmap(held.value, bits, one)).tolist():
                    key = (int(one[i]), int(two[i]))
                    if key not in met:
                        met.add(key)
                        out.append((*key, sets[own[i]].tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))], ["d1", "d2", "grams"])

    return run


def linked(left: list[np.ndarray], right: list[np.ndarray], threshold: Fraction) -> np.ndarray:
    """Boolean matrix: which sets of ``left`` and ``right`` reach the threshold."""
    m, sizes = len(left), np.array([len(s) for s in (*left, *right)], np.int64)
    if m == len(right) == 1:
        both = np.array([[len(np.intersect1d(left[0], right[0], assume_unique=True))]])
    else:
        _, inverse, counts = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
        shared = counts > 1
        column = np.where(shared, np.cumsum(shared) - 1, -1)[inverse]
        row = np.repeat(np.arange(len(sizes)), sizes)
        row, column = row[column >= 0], column[column >= 0]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        step = max(256, min(8192, (4 << 20) // len(sizes)))
        common = np.zeros((m, len(right)), np.float32)
        for lo in range(0, int(shared.sum()), step):
            a, b = np.searchsorted(column, [lo, lo + step])
            part = np.zeros((len(sizes), step), np.float32)
            part[row[a:b], column[a:b] - lo] = 1
            common += part[:m] @ part[m:].T
        both = common.astype(np.int64)
    union = sizes[:m, None] + sizes[None, m:] - both
    return both * threshold.denominator >= union * threshold.numerator


def _verify(threshold: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["big", "part"]):
            rid, copies, block = (group[c].to_numpy() for c in ("rid", "copies", "block"))
            sets = [np.frombuffer(g.as_buffer(), np.uint64) for g in group["grams"]]
            own = block == group["big"][0].as_py()
            left, others = np.flatnonzero(own), np.flatnonzero(~own)
            right = np.concatenate([left, others]) if group["part"][0].as_py() == 0 else others
            if not len(left) or not len(right) or len(rid) < 2:
                continue
            adj = linked([sets[i] for i in left], [sets[i] for i in right], threshold)
            adj &= left[:, None] != right[None, :]
            links, root = np.zeros(len(rid), np.int64), rid.copy()
            links[others] = copies[left] @ adj[:, len(right) - len(others) :]
            links[left] = adj @ copies[right]
            high = np.iinfo(np.int64).max
            while True:  # each to the smallest among its linked ones, both ways, until nothing changes
                old = root.copy()
                root[left] = np.minimum(root[left], np.where(adj, root[right][None, :], high).min(1))
                root[right] = np.minimum(root[right], np.where(adj, root[left][:, None], high).min(0))
                if (old == root).all():
                    break
            on = np.flatnonzero(links > 0)
            if len(on):
                yield pa.RecordBatch.from_arrays([pa.array(rid[on]), pa.array(root[on]), pa.array(links[on])], ["rid", "root", "links"])

    return run


def block_count(members: Column, grams: Column, least: int) -> Column:
    """Blocks of a home: of ``least`` members where it is small, of 8 times as many where it is large, of about BLOCK_GRAMS n-grams."""
    each = F.least(F.greatest(2 * F.sqrt(members), F.lit(least)), F.lit(8 * least))
    return F.ceil(F.greatest(members / each, grams / F.lit(BLOCK_GRAMS))).cast("long")


def _units(members: DataFrame, least: int) -> DataFrame:
    """``big, part, block``: what a task compares.  A unit holds one block (``big``) and, of the smaller
    blocks that share a bucket with it, about as many members as a block has; part 0 also compares the
    block with itself.  So a large block is not sent along with each small one that it meets."""
    sizes = members.groupBy("block").agg(F.count("*").alias("size"))
    touched = members.select(F.explode("hashes").alias("hash"), "block").distinct()
    met = touched.select("hash", F.col("block").alias("a")).join(touched.select("hash", F.col("block").alias("b")), "hash").filter("a < b").select("a", "b").distinct()
    sized = met.join(sizes.select(F.col("block").alias("a"), F.col("size").alias("sa")), "a").join(sizes.select(F.col("block").alias("b"), F.col("size").alias("sb")), "b")
    pairs = sized.select(
        F.when(F.col("sa") >= F.col("sb"), F.col("a")).otherwise(F.col("b")).alias("big"), F.when(F.col("sa") >= F.col("sb"), F.col("b")).otherwise(F.col("a")).alias("block"),
        F.greatest("sa", "sb").alias("size"), F.least("sa", "sb").alias("less"),
    )
    parts = pairs.groupBy("big", "size").agg(F.sum("less").alias("total"))
    parts = parts.select("big", F.ceil(F.col("total") / F.greatest("size", F.lit(least))).alias("parts"))
    others = pairs.join(parts, "big").select("big", F.pmod(F.xxhash64("block"), "parts").alias("part"), "block")
    own = sizes.join(parts, F.col("block") == F.col("big"), "left").filter("size > 1 or parts is not null")
    own = own.select(F.col("block").alias("big"), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), "block")
    return others.unionByName(own)


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = NGRAM,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    max_hashes: int = 128,
    block: int = BLOCK,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """Per document row: ``doc_id, class_id, copy_id, n_links``."""
    spark = docs.sparkSession
    bands, rows = choose_bands(threshold, recall, max_hashes)
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = stash(base.mapInArrow(lean(_signatures(n, bands, rows)), f"id {kind}, d1 long, d2 long, n int, bands array<long>"), "signatures")
    reps = stash(
        signed.filter("d1 is not null").groupBy("d1", "d2")
        .agg(F.min("id").alias("copy_id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
        .withColumn("rid", F.monotonically_increasing_id()),
        "representatives",
    )

    banded = reps.filter("bands is not null").select("rid", "n", F.explode("bands").alias("hash"))
    buckets = banded.groupBy("hash").agg(F.count("*").alias("m")).filter("m > 1")
    homed = stash(
        banded.join(buckets, "hash").groupBy("rid", "n").agg(F.max(F.struct("m", "hash")).alias("home"), F.collect_set("hash").alias("hashes"))
        .select("rid", "n", F.col("home.hash").alias("home"), "hashes"),
        "homes",
    )  # a row has as many hashes as there are bands at most
    sizes = homed.groupBy("home").agg(F.count("*").alias("m"), F.sum("n").alias("grams"))
    place = F.xxhash64("home", F.pmod(F.xxhash64("rid"), block_count(F.col("m"), F.col("grams"), block)))
    members = stash(homed.join(sizes, "home").select("rid", place.alias("block"), "hashes"), "members")
    candidates = stash(members.select("rid", "block").join(reps.select("rid", "d1", "d2", "copies"), "rid"), "candidates")

    bitmap, bits = _bitmap(candidates, filter_bits)
    held = spark.sparkContext.broadcast(bitmap)
    sets = base.select("text").mapInArrow(lean(_sets_of(held, bits, n)), "d1 long, d2 long, grams binary").dropDuplicates(["d1", "d2"])
    units = stash(_units(members, block), "units")
    checked = stash(
        candidates.join(units, "block").join(sets, ["d1", "d2"]).select("big", "part", "block", "rid", "copies", "grams")
        .repartition("big", "part").sortWithinPartitions("big", "part")
        .mapInArrow(lean(_verify(Fraction(str(threshold)))), "rid long, root long, links long"),
        "links",
    )
    roots = components(checked.filter("rid <> root").select(F.col("rid").alias("a"), F.col("root").alias("b")))
    links = checked.groupBy("rid").agg(F.sum("links").alias("links"))
    named = reps.select("rid", "d1", "d2", "copy_id", "copies").join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    classes = named.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    known = stash(
        named.join(classes, "root").join(links, "rid", "left")
        .select("d1", "d2", "class_id", "copy_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")),
        "classes",
    )
    drop_stash(reps, homed, members, candidates, units, checked, roots)
    held.unpersist()
    return signed.select("id", "d1", "d2").join(known, ["d1", "d2"], "left").select(
        F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("copy_id", "id").alias("copy_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
