"""Cutting long plans at small tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame, label: str) -> DataFrame:
    """The frame, written under ``spark.checkpoint.dir`` and read again.

    Plans of later steps then start from files: they stay short, and a lost
    executor costs no more than the step at hand.  Where the setting is missing a
    folder of this machine is set, which only a local master may use.
    """
    spark = df.sparkSession
    path = fresh(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(spark: SparkSession, label: str) -> str:
    """A path under ``spark.checkpoint.dir`` that does not exist yet."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='quarry-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Bytes up to which a frame of few rows for each question may be broadcast.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame) -> DataFrame:
    """The frame, marked for broadcast if the optimiser's estimate of its size is at most
    ``BROADCAST_BYTES``; a larger one is left to the optimiser, which shuffles it."""
    return F.broadcast(df) if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= BROADCAST_BYTES else df


#: Bytes for each task slot up to which a scan of few files is dealt out anew.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table of few, small files dealt over all task slots; any other table as it is.

    A row group is read by one task, so a small file with one row group would keep all
    later work on its rows in one task.  The shuffle moves ``SPREAD_BYTES`` for each slot
    at most: tables beyond that have row groups enough and are never shuffled.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(slots) if size <= SPREAD_BYTES * slots and len(df.inputFiles()) < slots else df
