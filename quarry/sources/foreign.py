"""Packs in other formats: SQLite files and binary vector files, as Python data sources.

A file is split into ranges of row ids or positions, and each task seeks to its own
range; nothing is read whole.  SQLite and seeking need a file system path, so the
file has to be on a mount that all executors see.
"""

from __future__ import annotations

import sqlite3
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Table -> its columns as (name, type, SQL) and the id that ranges are cut by.
PACK_TABLES = {
    "docs": ("id bigint, title string, first_chunk bigint, n_chunks int, prior double, words int, url string", "id"),
    "chunks": ("id bigint, doc_id bigint, ord int, section string, text string", "id"),
    "titles": ("norm string, doc_id bigint, kind int", "rowid"),
    "term_df": ("term string, df bigint", "rowid"),
}
MAGIC, HEAD = b"KVEC0001", "<8sIIQII"  # fixed values of the vector format


class Span(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


def _spans(low: int, high: int, rows: int) -> list[Span]:
    return [Span(a, min(a + rows, high)) for a in range(low, high, rows)] or [Span(0, 0)]


def inflate(raw: bytes | str | None, dictionary: bytes | None) -> str:
    """A chunk's text: zlib with the pack's dictionary, or plain UTF-8 in a pack without; null is empty."""
    if raw is None or isinstance(raw, str):
        return raw or ""
    if dictionary is None:
        return bytes(raw).decode("utf-8", "replace")
    unpack = zlib.decompressobj(15, zdict=dictionary) if dictionary else zlib.decompressobj(15)
    return (unpack.decompress(raw) + unpack.flush()).decode("utf-8", "replace")


class SqlitePack(DataSource):
    """Format ``sqlite_pack``: options ``path``, ``table`` and ``rows`` (ids of one task, 200,000)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_pack"

    def schema(self) -> str:
        return PACK_TABLES[self.options["table"]][0]

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqlitePackReader(self.options, schema.fieldNames())


class SqlitePackReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.path, self.table, self.names = options["path"].removeprefix("file://"), options["table"], names
        self.rows, self.key = int(options.get("rows", 200_000)), PACK_TABLES[options["table"]][1]

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro&immutable=1", uri=True)

    def partitions(self) -> list[Span]:
        with self._open() as db:
            low, high = db.execute(f"SELECT min({self.key}), max({self.key}) FROM {self.table}").fetchone()
        return _spans(low, high + 1, self.rows) if low is not None else [Span(0, 0)]

    def read(self, partition: Span) -> Iterator[tuple]:
        with self._open() as db:
            held = db.execute("SELECT value FROM meta WHERE key = 'zdict'").fetchone() if self.table == "chunks" else None
            dictionary = held[0] if held else None
            at = self.names.index("text") if "text" in self.names else None
            for row in db.execute(f"SELECT {', '.join(self.names)} FROM {self.table} WHERE {self.key} >= ? AND {self.key} < ?", (partition.low, partition.high)):
                yield row if at is None else (*row[:at], inflate(row[at], dictionary), *row[at + 1 :])


def read_sqlite_pack(spark: SparkSession, path: str, table: str, rows: int = 200_000) -> DataFrame:
    """One table of a SQLite pack; chunk texts are inflated where they are read."""
    spark.dataSource.register(SqlitePack)
    return spark.read.format("sqlite_pack").option("table", table).option("rows", rows).load(path)


def layout(path: str) -> dict:
    """Header and section starts of a vector file."""
    with open(path, "rb") as f:
        magic, dim, nlist, n, _, _ = struct.unpack(HEAD, f.read(32))
    if magic != MAGIC or dim % 8:
        raise ValueError(f"not a vector file: {path}")
    offsets = 32 + nlist * dim * 4
    ids = offsets + (nlist + 1) * 8
    codes = ids + n * 4
    scales = codes + n * (dim // 8)
    return {"dim": dim, "nlist": nlist, "n": n, "centroids": 32, "offsets": offsets, "ids": ids, "codes": codes, "scales": scales, "vecs": scales + n * 4}


def _section(path: str, start: int, kind: str, count: int) -> np.ndarray:
    return np.fromfile(path, kind, count, offset=start) if count else np.empty(0, kind)


class VectorFile(DataSource):
    """Format ``vector_file``: options ``path`` and ``rows`` (positions of one task, 65,536)."""

    @classmethod
    def name(cls) -> str:
        return "vector_file"

    def schema(self) -> str:
        return "id bigint, list_id int, code array<bigint>, scale double, q array<tinyint>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return VectorFileReader(self.options)


class VectorFileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.rows = options["path"].removeprefix("file://"), int(options.get("rows", 65_536))

    def partitions(self) -> list[Span]:
        return _spans(0, layout(self.path)["n"], self.rows)

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        at, low, n = layout(self.path), partition.low, partition.high - partition.low
        dim = at["dim"]
        ids = _section(self.path, at["ids"] + low * 4, "<u4", n)
        bits = _section(self.path, at["codes"] + low * (dim // 8), "u1", n * (dim // 8)).reshape(n, dim // 8)
        scales = _section(self.path, at["scales"] + low * 4, "<f4", n)
        q = _section(self.path, at["vecs"] + low * dim, "i1", n * dim).reshape(n, dim)
        ends = _section(self.path, at["offsets"], "<u8", at["nlist"] + 1)[1:].astype(np.int64)
        lists = np.searchsorted(ends, np.arange(low, low + n), side="right").astype(np.int32)
        # a code's last word is filled from its low end, as functions.vector.sign_code does
        words = [bits[:, i : i + 8] for i in range(0, dim // 8, 8)]
        code = np.stack([np.pad(w, ((0, 0), (8 - w.shape[1], 0))).copy().view(">u8")[:, 0].astype(np.int64) for w in words], 1) if n else np.empty((0, 1), np.int64)
        names = ["id", "list_id", "code", "scale", "q"]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids.astype(np.int64)), pa.array(lists), pa.array(list(code), pa.list_(pa.int64())), pa.array(scales.astype(np.float64)), pa.array(list(q), pa.list_(pa.int8()))], names=names
        )


def read_vector_file(spark: SparkSession, path: str, rows: int = 65_536) -> tuple[DataFrame, DataFrame]:
    """``(index, centroids)`` of a vector file, as ``operators.vectors.search`` takes them."""
    spark.dataSource.register(VectorFile)
    local = path.removeprefix("file://")
    at = layout(local)
    c = _section(local, at["centroids"], "<f4", at["nlist"] * at["dim"]).reshape(at["nlist"], at["dim"])
    centroids = spark.createDataFrame([(i, v.astype(float).tolist()) for i, v in enumerate(c)], "list_id int, c array<double>")
    return spark.read.format("vector_file").option("rows", rows).load(path), centroids


def write_vector_file(index: DataFrame, centroids: DataFrame, path: str, dim: int) -> None:
    """Writes an index in the binary format, in order of list and id.

    The format is one file, so this is an export by one writer: rows stream through it a
    partition at a time, and each section is filled at its own place in the file.
    """
    if dim % 8:
        raise ValueError("dim must be a multiple of 8")
    c = [r["c"] for r in centroids.orderBy("list_id").toLocalIterator()]
    sizes = np.zeros(len(c) + 1, np.uint64)
    for r in index.groupBy("list_id").count().toLocalIterator():
        sizes[r["list_id"] + 1] = r["count"]
    n = int(sizes.sum())
    with open(path, "wb") as f:
        f.write(struct.pack(HEAD, MAGIC, dim, len(c), n, 0, 0) + np.asarray(c, "<f4").tobytes() + np.cumsum(sizes).astype("<u8").tobytes())
    at = layout(path)
    with open(path, "r+b") as f:
        for i, r in enumerate(index.select("list_id", "id", "scale", "q", "code").orderBy("list_id", "id").toLocalIterator()):
            word = lambda w, k: (w & (1 << 64) - 1).to_bytes(8, "big")[-k:]
            code = b"".join(word(w, min(8, dim // 8 - 8 * j)) for j, w in enumerate(r["code"]))
            for section, size, raw in (("ids", 4, struct.pack("<I", r["id"])), ("codes", dim // 8, code), ("scales", 4, struct.pack("<f", r["scale"])), ("vecs", dim, np.asarray(r["q"], "i1").tobytes())):
                f.seek(at[section] + i * size)
                f.write(raw)
