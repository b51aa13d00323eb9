"""Sharding: size-tiered compaction of immutable shards under versioned manifests.

A store is a folder with data files and manifests ``manifest-<version>.json``.
Arrivals are appended as small Parquet shards, which are never changed; a
manifest lists the shards of one version.  Compaction groups shards by size (tier
``k`` holds sizes from ``smallest * ratio**k`` on), merges a tier that has
``fan_in`` shards or more into files of about ``target`` bytes, and leaves files
of at least half of the target alone.  Merges that would fill a higher tier are
planned together, from the sizes, until no tier is full, so each byte is rewritten
once a call.  Merging reads whole shards next to each other without a shuffle: the
work of a task is one target file.

A version is committed by writing its manifest under another name and renaming
it to a name that must not exist yet: readers see the old version or the new
one, a writer that lost the race fails with its data unreferenced, and a job that
dies before the rename leaves nothing visible.  Old versions stay readable until
``vacuum``, which spares what was superseded recently and files that no manifest
lists yet, as a writer may be about to commit them.  Rows pass through DataFrame
readers and writers alone; the driver handles file names and sizes.

Defined cases.  Empty arrivals add a version without shards (one version, if
there is no value in the arrival column).  Reading a version
without shards gives no rows of the store's schema.  All columns, nulls and
repeated rows are kept as they are.  Rows with a null arrival are an arrival.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET = 128 << 20
#: Seconds for which superseded versions stay readable, and for which unlisted files may still be committed.
KEEP, PENDING = 24 * 3600, 7 * 24 * 3600


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    arrival: str


class ShardStore:
    def __init__(self, spark: SparkSession, folder: str, *, target: int = TARGET, smallest: int = 1 << 16, ratio: int = 4, fan_in: int = 4) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.target, self.smallest, self.ratio, self.fan_in = target, smallest, ratio, fan_in
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(name)

    # manifests

    def version(self) -> int:
        """The newest version; 0 for a store without any."""
        if not self._fs.exists(self._path(self.folder)):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        return max((int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        text = "\n".join(r["value"] for r in self.spark.read.text(self._name(version)).collect())
        return json.loads(text)

    def shards(self, version: int | None = None) -> list[Shard]:
        return [Shard(**s) for s in self.manifest(version)["shards"]]

    def _commit(self, base: int, schema: str, shards: list[Shard]) -> int:
        """Makes version ``base + 1``; raises if another writer has made it, or if ``base`` is so old that it is gone."""
        body = json.dumps({"version": base + 1, "schema": schema, "shards": [vars(s) for s in shards]})
        draft, final = f"{self.folder}/.draft-{uuid.uuid4().hex}", self._name(base + 1)
        out = self._fs.create(self._path(draft), False)
        out.write(bytearray(body.encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(self._path(self.folder).toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._jvm.java.lang.reflect.Array.newInstance(self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self._path(draft), self._path(final), options)  # fails if the name is taken
        except Exception as e:
            self._fs.delete(self._path(draft), False)
            raise RuntimeError(f"version {base + 1} was committed by another writer") from e
        if base and not self._fs.exists(self._path(self._name(base))):  # the name was free because vacuum had freed it
            self._fs.delete(self._path(final), False)
            raise RuntimeError(f"version {base} was superseded long ago")
        return base + 1

    def _name(self, version: int) -> str:
        return f"{self.folder}/manifest-{version:08d}.json"

    # data

    def _files(self, folder: str, arrival: str) -> list[Shard]:
        found, todo = [], [self._path(folder)]
        while todo:
            for s in self._fs.listStatus(todo.pop()):
                if s.isDirectory():
                    todo.append(s.getPath())
                elif s.getPath().getName().endswith(".parquet"):
                    found.append(Shard(s.getPath().toString(), s.getLen(), arrival))
        return sorted(found, key=lambda s: s.path)

    def append(self, rows: DataFrame, *, arrival_col: str | None = None, rows_per_shard: int = 20_000) -> int:
        """Appends one arrival, or with ``arrival_col`` one for each of its values (few), a version each."""
        if arrival_col is not None and rows.columns.count(arrival_col) != 1:
            raise ValueError("the arrival column is not one of the rows' columns")
        base = self.manifest()
        schema = rows.drop(arrival_col).schema if arrival_col else rows.schema
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
        if base["schema"] and json.loads(base["schema"]) != json.loads(schema.json()):
            raise ValueError("the rows' schema is not the store's")
        folder = f"{self.folder}/data/{uuid.uuid4().hex}"
        writer = rows.write.option("maxRecordsPerFile", rows_per_shard)
        (writer.partitionBy(arrival_col) if arrival_col else writer).parquet(folder)
        parts = [(f"{folder}", "")]
        if arrival_col:
            parts = sorted((s.getPath().toString(), s.getPath().getName().split("=", 1)[1]) for s in self._fs.listStatus(self._path(folder)) if s.isDirectory())
        version, shards = base["version"], [Shard(**s) for s in base["shards"]]
        for path, arrival in parts or [(None, "")]:
            shards = [*shards, *(s for s in self._files(path, arrival) if s.bytes)] if path else shards
            version = self._commit(version, schema.json(), shards)
        return version

    def _tier(self, size: int) -> int:
        return max(0, int(math.log(max(size, 1) / self.smallest, self.ratio)))

    def runs(self, shards: list[Shard]) -> list[list[Shard]]:
        """The runs of shards that a compaction merges: full tiers of similar sizes, and what they fill in turn."""
        small, done = [[s] for s in sorted(shards, key=lambda s: s.path) if s.bytes < self.target / 2], []
        size = lambda run: sum(s.bytes for s in run)
        while True:
            by: dict[int, list[list[Shard]]] = {}
            for run in small:
                by.setdefault(self._tier(size(run)), []).append(run)
            full = [runs for _, runs in sorted(by.items()) if len(runs) >= self.fan_in]
            if not full:
                return done + [run for run in small if len(run) > 1]
            small = [run for runs in by.values() if len(runs) < self.fan_in for run in runs]
            for runs in full:
                whole = [s for run in runs for s in run]
                (small if size(whole) < self.target / 2 else done).append(whole)

    def compact(self) -> int:
        """Merges what ``runs`` plans and commits the result as one version; returns the newest version."""
        base = self.manifest()
        shards = [Shard(**s) for s in base["shards"]]
        merged: list[Shard] = []
        gone: set[str] = set()
        for run in self.runs(shards):
            folder = f"{self.folder}/data/{uuid.uuid4().hex}"
            files = max(1, round(sum(s.bytes for s in run) / self.target))
            self._rows(base["schema"], run).coalesce(files).write.parquet(folder)
            merged += self._files(folder, "merged")
            gone |= {s.path for s in run}
        if not merged:
            return base["version"]
        return self._commit(base["version"], base["schema"], [*(s for s in shards if s.path not in gone), *merged])

    def _rows(self, schema: str, shards: list[Shard]) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(kind).parquet(*[s.path for s in shards]) if shards else self.spark.createDataFrame([], kind)

    def read(self, version: int | None = None) -> DataFrame:
        held = self.manifest(version)
        if not held["schema"]:
            raise ValueError("the store has no version yet")
        return self._rows(held["schema"], [Shard(**s) for s in held["shards"]])

    def vacuum(self, keep: float = KEEP, pending: float = PENDING) -> int:
        """Deletes versions that were superseded over ``keep`` seconds ago, with the data files that only they
        list, and files that no manifest lists and that are older than ``pending`` seconds (those of writers
        that died; younger ones may be about to be committed).  Returns how many data files.

        Names go before files: a reader never finds a version without its files, and what a vacuum that
        dies leaves behind is unlisted.
        """
        newest, now = self.version(), time.time()
        made = {v: self._fs.getFileStatus(self._path(self._name(v))).getModificationTime() / 1000 for v in range(1, newest + 1) if self._fs.exists(self._path(self._name(v)))}
        old = [v for v in sorted(made) if v < newest and made.get(v + 1, 0) <= now - keep]
        live = {s.path for v in made if v not in old for s in self.shards(v)}
        listed = {s.path for v in old for s in self.shards(v)}
        for v in old:
            self._fs.delete(self._path(self._name(v)), False)
        data, n = f"{self.folder}/data", 0
        for s in self._files(data, "") if self._fs.exists(self._path(data)) else []:
            if s.path not in live and (s.path in listed or self._fs.getFileStatus(self._path(s.path)).getModificationTime() / 1000 <= now - pending):
                self._fs.delete(self._path(s.path), False)
                n += 1
        return n


def arrival_of(source_col: str = "source", arrivals: int = 8) -> Column:
    """An arrival number for each source, so that large sources arrive as large batches."""
    return F.pmod(F.crc32(F.coalesce(F.col(source_col), F.lit(""))), F.lit(arrivals)).cast("int")
