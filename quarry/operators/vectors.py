"""An inverted-file vector index: 1-bit codes choose, 8-bit values rescore.

``vectors(id, list_id, code, scale, q)`` is partitioned by list on disk, so a
search reads the lists that its questions probe (dynamic partition pruning) and
fetches 8-bit values for the survivors of the code comparison alone.
Inner products against centroids and query blocks are matrix products over Arrow batches.

Defined cases.  Null vectors are in no list and are never found; vectors of another
length than the rest are a ValueError.  An empty table has no centroids and no hits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as vx
from ..storage import cut
from .search import Best

NPROBE, RERANK, SAMPLE, ROUNDS = 24, 400, 200_000, 12
#: Parts of the lists and of the vectors with which recall@10 is over 0.9 on spread-out vectors at every size measured (README).
PROBE_SHARE, RERANK_SHARE = 0.75, 0.4
#: Queries that are broadcast at a time, and products that a task holds.
BLOCK, _PRODUCTS = 16_384, 1 << 22


def list_count(n: int) -> int:
    return max(1, min(65_536, n, round(2 * math.sqrt(n))))


def effort(n: int, nlist: int, *, probe_share: float = PROBE_SHARE, rerank_share: float = RERANK_SHARE) -> dict[str, int]:
    """``nprobe`` and ``rerank`` of ``search`` as parts of ``nlist`` lists and ``n`` vectors, the reference's at least.

    With parts of 1 every vector is rescored: exact but for the 8-bit values.
    """
    return {"nprobe": max(NPROBE, math.ceil(probe_share * nlist)), "rerank": max(RERANK, math.ceil(rerank_share * n))}


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column without nulls as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not len(column):
        return np.empty((0, 0))
    if len({*np.unique(column.value_lengths().to_numpy(zero_copy_only=False)).tolist()}) != 1:
        raise ValueError("vectors differ in length")
    return flat.reshape(len(column), -1)


def train_centroids(vectors: DataFrame, nlist: int, *, id_col: str = "id", vec_col: str = "v", sample: int = SAMPLE, seed: int = 0) -> DataFrame:
    """``list_id, c`` by spherical k-means over at most ``sample`` vectors, those with the smallest id hashes."""
    spark, kind = vectors.sparkSession, "list_id int, c array<double>"
    rows = vectors.filter(F.col(vec_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(sample)
    x = matrix(rows.select(vx.l2_normalise(vx.doubles(F.col(vec_col))).alias("v")).toArrow()["v"])
    if not len(x):
        return spark.createDataFrame([], kind)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(nlist, len(x)), replace=False)]
    step = max(1, _PRODUCTS // len(c))
    for _ in range(ROUNDS):
        near = np.concatenate([(x[i : i + step] @ c.T).argmax(1) for i in range(0, len(x), step)])
        order = np.argsort(near, kind="stable")
        lists, first = np.unique(near[order], return_index=True)
        sums = np.zeros_like(c)
        sums[lists] = np.add.reduceat(x[order], first, axis=0)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.maximum(size, 1e-12), c)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], kind)


def assign(vectors: DataFrame, centroids: DataFrame, *, id_col: str = "id", vec_col: str = "v") -> DataFrame:
    """``id, list_id``: the list of the largest inner product, compared at nine digits; the smaller list wins ties.

    The centroids are one broadcast matrix: 65,536 at most (``list_count``), so its size is bounded
    by the dimension, whatever the corpus.
    """
    rows = centroids.orderBy("list_id").toArrow()
    if not rows.num_rows:
        return vectors.limit(0).select(F.col(id_col).alias("id"), F.lit(0).alias("list_id"))
    held = vectors.sparkSession.sparkContext.broadcast((rows["list_id"].to_numpy().astype(np.int32), matrix(rows["c"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, c = held.value
        step = max(1, _PRODUCTS // len(c))
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            x = matrix(batch.column(1))
            best = [np.round(x[i : i + step] @ c.T, 9).argmax(1) for i in range(0, len(x), step)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists[np.concatenate(best or [np.empty(0, np.int64)])])], ["id", "list_id"])

    kind = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(F.col(id_col).alias("id"), vx.doubles(F.col(vec_col)).alias("v")).mapInArrow(run, f"id {kind}, list_id int")


def encode(vectors: DataFrame, lists: DataFrame, dim: int, *, id_col: str = "id", vec_col: str = "v") -> DataFrame:
    v = vx.doubles(F.col(vec_col))
    return vectors.select(F.col(id_col).alias("id"), vx.sign_code(v, dim).alias("code"), F.inline(F.array(vx.quantise(v)))).join(lists, "id")


def write_index(encoded: DataFrame, path: str) -> None:
    encoded.repartition("list_id").write.mode("overwrite").partitionBy("list_id").parquet(path)


def probe(queries: DataFrame, centroids: DataFrame, nprobe: int = NPROBE) -> DataFrame:
    """``qid, list_id, place``: the lists of the largest inner products of each query, a stated set.
    What is broadcast are the centroids, 65,536 at most."""
    scored = queries.crossJoin(F.broadcast(centroids)).select("qid", "list_id", F.round(vx.dot(vx.doubles(F.col("v")), F.col("c")), 9).alias("s"))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("s"), "list_id"))).filter(F.col("place") <= nprobe).drop("s")


class _Probes:
    """A batch of queries with their codes and the lists of an index, for passes over its vectors."""

    def __init__(self, queries: DataFrame, centroids: DataFrame, dim: int, nprobe: int) -> None:
        rows = queries.select("qid", vx.doubles(F.col("v")).alias("v")).filter("v is not null").withColumn("code", vx.sign_code(F.col("v"), dim)).toArrow()
        c = centroids.orderBy("list_id").toArrow()
        self.kind, self.qids = queries.schema["qid"].dataType.simpleString(), rows["qid"].combine_chunks()
        self.v, self.code, self.width = matrix(rows["v"]), codes(rows["code"].combine_chunks()), 64 * -(-dim // 64)
        self.lists, self.c, self.nprobe = c["list_id"].to_numpy(), matrix(c["c"]), nprobe
        self.step = max(1, (_PRODUCTS >> 1) // max(1, len(self.lists)))

    def __bool__(self) -> bool:
        return len(self.qids) > 0 and len(self.lists) > 0

    def places(self, lo: int) -> np.ndarray:
        """Place from 1 of each list for the queries from ``lo``, 0 where it is not probed: largest inner product
        at nine digits first, then the smaller list."""
        s = np.round(self.v[lo : lo + self.step] @ self.c.T, 9)
        place = np.empty(s.shape, np.int64)
        np.put_along_axis(place, np.argsort(-s, axis=1, kind="stable"), np.arange(1, s.shape[1] + 1)[None, :], 1)
        return np.where(place <= self.nprobe, place, 0)

    def over(self, batches: Iterator[pa.RecordBatch], meet: Callable) -> None:
        """``meet(q, place, ham, rows, lo)`` for each list of a task's ``list_id, id, code, ..`` and the queries ``q`` that
        probe it, in blocks: ``rows`` is a slice of the task's vectors in order of list and id."""
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by([("list_id", "ascending"), ("id", "ascending")]).combine_chunks().to_batches()[0]
        own, first = np.unique(table.column(0).to_numpy(), return_index=True)
        ends, at = np.append(first, table.num_rows), np.searchsorted(self.lists, own)
        for lo in range(0, len(self.qids), self.step):
            places = self.places(lo)
            for k in range(len(own)):
                q = np.flatnonzero(places[:, at[k]])
                if not len(q):
                    continue
                step = max(1, (_PRODUCTS >> 1) // len(q))
                for i in range(ends[k], ends[k + 1], step):
                    rows = table.slice(i, min(step, ends[k + 1] - i))
                    ham = ((self.width - self.code[lo + q] @ codes(rows.column(2)).T) / 2).astype(np.int64)
                    meet(lo + q, places[q, at[k]], ham, rows)

    def bounds(self, held: DataFrame, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``ham, place, left`` of each query: of the vectors it probes, the first ``rerank`` by distance, place and id are
        those nearer than ``ham``, those at ``ham`` in a list before ``place``, and the first ``left`` at both."""
        n, top = len(self.qids), self.width + 1
        count = self._sums(held, self._distances, top)
        ends = count.cumsum(1)
        ham = np.where(ends[:, -1] > rerank, (ends < rerank).sum(1), top)
        rest = rerank - np.where((ham > 0) & (ham < top), np.take_along_axis(ends, np.clip(ham - 1, 0, top - 1)[:, None], 1)[:, 0], 0)
        place, left = np.zeros(n, np.int64), np.zeros(n, np.int64)
        rows = self._ties(held, ham, rest)
        q = rows["q"].to_numpy()
        place[q], left[q] = rows["place"].to_numpy(), rows["left"].to_numpy()
        return ham, place, left

    def _sums(self, held: DataFrame, count: Callable, width: int) -> np.ndarray:
        n = len(self.qids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.zeros((n, width), np.int64)
            self.over(batches, lambda q, place, ham, rows: count(found, q, ham))
            met = np.flatnonzero(found.any(1))
            for lo in range(0, len(met), 4096):
                own = met[lo : lo + 4096]
                ends = np.arange(len(own) + 1, dtype=np.int32) * width
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.ListArray.from_arrays(pa.array(ends), pa.array(found[own].ravel()))], ["q", "n"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sums = [np.array(x, np.int64).sum(0) for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tolist() for x in sums], pa.list_(pa.int64()))], ["q", "n"])

        rows = held.select("list_id", "id", "code").mapInArrow(run, "q long, n array<long>").groupBy("q").agg(F.collect_list("n").alias("n")).mapInArrow(add, "q long, n array<long>").toArrow()
        out = np.zeros((n, width), np.int64)
        if rows.num_rows:
            out[rows["q"].to_numpy()] = matrix(rows["n"])
        return out

    @staticmethod
    def _distances(found: np.ndarray, q: np.ndarray, ham: np.ndarray) -> None:
        width = found.shape[1]
        key = np.arange(len(q))[:, None] * width + ham
        found[q] += np.bincount(key.ravel(), minlength=len(q) * width).reshape(len(q), width)

    def _ties(self, held: DataFrame, bound: np.ndarray, rest: np.ndarray) -> pa.Table:
        """``q, place, left``: the list in which the vectors at a query's bound run out, and how many count there."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met: list[tuple[np.ndarray, ...]] = []

            def meet(q, place, ham, rows) -> None:
                n = (ham == bound[q][:, None]).sum(1)
                on = n > 0
                if on.any():
                    met.append((q[on], place[on], n[on]))

            self.over(batches, meet)
            if not met:
                return
            q, place, n = (np.concatenate(x) for x in zip(*met))
            order = np.argsort(q, kind="stable")
            own, first = np.unique(q[order], return_index=True)
            ends = pa.array(np.append(first, len(q)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(own), *(pa.ListArray.from_arrays(ends, pa.array(x[order].astype(np.int32))) for x in (place, n))], ["q", "place", "n"])

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for q, places, counts in zip(*(c.to_pylist() for c in batch.columns)):
                    place, n = (np.concatenate([np.array(x, np.int64) for x in xs]) for xs in (places, counts))
                    order = np.argsort(place, kind="stable")
                    before = n[order].cumsum() - n[order]
                    last = int(np.flatnonzero(before < rest[q])[-1])
                    # a list that tasks share has several parts: what is left counts from the first of them
                    own = place[order][last]
                    out.append((q, int(own), int(rest[q] - n[place < own].sum())))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)] if out else [pa.array([], pa.int64())] * 3, ["q", "place", "left"])

        rows = held.select("list_id", "id", "code").mapInArrow(run, "q long, place array<int>, n array<int>").groupBy("q").agg(F.collect_list("place").alias("place"), F.collect_list("n").alias("n"))
        return rows.mapInArrow(choose, "q long, place long, left long").toArrow()


def search(queries: DataFrame, index: DataFrame, centroids: DataFrame, dim: int, *, k: int = 10, nprobe: int = NPROBE, rerank: int = RERANK) -> DataFrame:
    """``qid, id, rank, score`` for ``queries(qid, v)``: of the vectors in the ``nprobe`` nearest lists, the ``rerank`` nearest
    by code, place of the list and id are scored by their 8-bit values.

    Three passes over the vectors as matrix products: counts by distance, counts of each list at the distance where
    ``rerank`` is reached, and scores of which a task keeps the best ``k``.  Pairs never leave a task.
    The defaults are the reference's; they lose much on spread-out vectors, see ``effort``.
    """
    kind = index.schema["id"].dataType.simpleString()
    probes = _Probes(queries, centroids, dim, nprobe)
    if not probes:
        return queries.select("qid").limit(0).select("qid", F.lit(None).cast(kind).alias("id"), F.lit(0).alias("rank"), F.lit(0.0).alias("score"))
    held = cut(index.select("list_id", "id", "code", "scale", "q"), "vectors")
    bound, last, left = probes.bounds(held, rerank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, free = Best(len(probes.qids), k), left.copy()

        def meet(q, place, ham, rows) -> None:
            at = ham == bound[q][:, None]
            on = (ham < bound[q][:, None]) | (at & (place < last[q])[:, None])
            own = np.flatnonzero(place == last[q])  # a list is in one task, by id
            if len(own):
                seen = at[own].cumsum(1)
                on[own] |= at[own] & (seen <= free[q[own]][:, None])
                free[q[own]] = np.maximum(0, free[q[own]] - seen[:, -1])
            scores = (probes.v[q] @ matrix(rows.column(4)).T) * rows.column(3).to_numpy()[None, :]
            i, j = np.nonzero(on & (scores >= best.floor[q][:, None] - 1e-9))
            best.add(q[i], rows.column(1).to_numpy(zero_copy_only=False)[j], np.round(scores[i, j], 9))

        probes.over(batches, meet)
        yield from _rows_of(best, probes.qids)

    lists = held.repartition("list_id")
    found = lists.mapInArrow(run, f"qid {probes.kind}, id {kind}, score double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k).select("qid", "id", "rank", "score")


def codes(column: pa.Array) -> np.ndarray:
    """Codes of 64-bit words as rows of 1 and -1."""
    words = np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False)).astype(np.int64)
    if not len(column):
        return np.empty((0, 64), np.float32)
    return np.unpackbits(words.view(np.uint8).reshape(len(column), -1), axis=1).astype(np.float32) * 2 - 1


def nearest_codes(queries: DataFrame, rows: DataFrame, *, k: int, block: int = BLOCK) -> DataFrame:
    """Exact ``qid, id, ham`` of the ``k`` codes of ``rows(id, c)`` that differ in the fewest bits, for ``queries(qid, qc)``;
    ties go to the smaller id.  As ``nearest``: a task sends its best ``k`` for each query."""
    words = queries.agg(F.max(F.size("qc"))).first()[0] or 1
    found = _blocks(queries.select("qid", F.col("qc").alias("v")), rows.select("id", F.col("c").alias("v")), codes, k, block)
    ranked = found.withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).filter(F.col("k") <= k)
    return ranked.select("qid", "id", ((64 * words - F.col("score")) / 2).cast("int").alias("ham"))


def nearest(queries: DataFrame, vectors: DataFrame, *, k: int = 10, block: int = BLOCK, id_col: str = "id", vec_col: str = "v") -> DataFrame:
    """Exact ``qid, id, rank, score`` of the ``k`` largest inner products for ``queries(qid, v)``.

    Queries go in blocks of ``block`` at most: each is broadcast by itself and meets all vectors as
    matrix products; a task sends the best ``k`` of its vectors for each query.  Scores are compared at
    nine digits and ties go to the smaller id.
    """
    found = _blocks(queries.select("qid", vx.doubles(F.col("v")).alias("v")), vectors.select(F.col(id_col).alias("id"), vx.doubles(F.col(vec_col)).alias("v")), matrix, k, block)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")))
    return ranked.filter(F.col("rank") <= k).select("qid", "id", "rank", "score")


def _blocks(queries: DataFrame, vectors: DataFrame, dense: Callable[[pa.Array], np.ndarray], k: int, block: int) -> DataFrame:
    """``qid, id, score``: the best ``k`` inner products of each task for each query, blocks of queries one after another."""
    spark, n = vectors.sparkSession, queries.count()
    kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double"
    rows = vectors.filter("id is not null and v is not null")
    parts = max(1, -(-n // block))
    found = None
    for part in range(parts):
        own = queries if parts == 1 else queries.filter(F.pmod(F.xxhash64("qid"), F.lit(parts)) == part)
        asked = own.filter("v is not null").toArrow()
        held = spark.sparkContext.broadcast((asked["qid"].combine_chunks(), dense(asked["v"].combine_chunks())))
        best = rows.mapInArrow(_best(held, dense, k), kinds)
        found = best if found is None else found.unionByName(best)
    return found


def _best(held, dense: Callable[[pa.Array], np.ndarray], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = held.value
        best = Best(len(q), k)
        step = max(1, _PRODUCTS // max(1, len(q)))
        for batch in batches:
            if not batch.num_rows or not len(q):
                continue
            x, own = dense(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, len(x), step):
                s = q @ x[lo : lo + step].T
                i, j = np.nonzero(s >= best.floor[:, None] - 1e-9)
                best.add(i, own[lo : lo + step][j], np.round(s[i, j].astype(np.float64), 9))
        yield from _rows_of(best, qid)

    return run


def _rows_of(best: Best, qids: pa.Array) -> Iterator[pa.RecordBatch]:
    found = best.rows()
    if found is not None:
        for lo in range(0, len(found[0]), 65_536):
            which, ids, scores = (x[lo : lo + 65_536] for x in found)
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(which)), pa.array(ids), pa.array(scores)], ["qid", "id", "score"])
