"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_libc = ctypes.CDLL(None)
#: ASCII white space, the separators of a word `[^\x20\x09-\x0D]+`.
WORD = r"[^\x20\x09-\x0D]+"


class Memo(dict):
    """Results by key in two generations, so that at most 2 * limit are held.

    `memo[key]` computes a missing value; keys longer than `longest` are not kept.
    """

    def __init__(self, compute, limit: int = 200_000, longest: int = 64):
        super().__init__()
        self.compute, self.limit, self.longest, self.old = compute, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> None:
    """Checkpoints go to the folder that the cluster names in spark.checkpoint.dir; a local one only where that is unset."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or f"/tmp/checkpoints/{os.getpid()}")


def cut(df: DataFrame) -> DataFrame:
    """df written once to the shared checkpoint folder: its lineage ends there, and a lost executor loses nothing of it."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def each(values: pa.Array, rows: int = 256) -> Iterator:
    """The values of an Arrow array as Python values, few at a time, so that a worker never holds a whole batch twice."""
    for k in range(0, len(values), rows):
        yield from values.slice(k, rows).to_pylist()


def give_back() -> None:
    """What a worker has freed goes back to the system: it lives on beside the workers and the JVM of later stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def bounded(ids: DataFrame, most: int = 100_000) -> DataFrame:
    """ids written once, and marked for broadcast if they are `most` rows (of one number) or fewer; else Spark shuffles."""
    ids = cut(ids)
    return F.broadcast(ids) if ids.count() <= most else ids


def row_key(*columns: str | Column) -> Column:
    """Two 64-bit hashes that stand for a row's content where an id may be null or repeated."""
    return F.struct(F.xxhash64(F.lit(1), *columns).alias("a"), F.xxhash64(F.lit(2), *columns).alias("b"))
