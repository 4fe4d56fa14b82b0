"""State tables between rounds and batches."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def state_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a local one only where that is unset."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or f"/tmp/checkpoints/{os.getpid()}")
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder; its lineage ends there."""
    state_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder. Unlike a checkpoint it carries on nothing that the planner knew of df, so that loops plan
    every round as fast as the first."""
    path = f"{state_folder(df.sparkSession)}/written-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class BucketTable:
    """A table in hash buckets of its key, of which a batch of a stream rewrites only those that it touches.

    Each batch writes the buckets that it touched as its own version, then a manifest: of every bucket the version that holds.
    Batch n starts from the manifest of batch n - 1, so one that runs again, in this process or the next, does the same again.
    A table that is opened anew in the same folder goes on where it was. A manifest has a row a bucket, whatever the table's size.
    """

    def __init__(self, spark: SparkSession, schema: str, folder: str | None = None, key: str = "conv_id", buckets: int = 64):
        self.spark, self.schema, self.key, self.buckets = spark, schema, key, buckets
        self.folder = folder or f"{state_folder(spark)}/table-{uuid.uuid4()}"

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of the rows' keys, `buckets` numbers at most."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def versions(self, before: int | None = None) -> dict[int, int]:
        """Of each bucket that has rows the batch that wrote it: as batch `before` finds them, or the newest."""
        if before == 0:
            return {}
        shape = "batch int, bucket int, version int"
        if before is not None:
            rows = self.spark.read.schema(shape).json(f"{self.folder}/manifest/{before - 1}")
        else:
            rows = self.spark.read.schema(shape).option("recursiveFileLookup", True).json(f"{self.folder}/manifest")
            rows = rows.filter(F.col("batch") == (rows.agg(F.max("batch")).first()[0]))
        return {r["bucket"]: r["version"] for r in rows.filter("bucket >= 0").collect()}

    def read(self, before: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The table as batch `before` finds it, or the newest; `only` these buckets."""
        held = self.versions(before)
        paths = [f"{self.folder}/rows/{v}/bucket={b}" for b, v in held.items() if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def replace(self, rows: DataFrame, touched: list[int], batch: int) -> None:
        """From batch `batch` on the touched buckets hold these rows."""
        held = {b: v for b, v in self.versions(batch).items() if b not in touched}
        if touched:
            path = f"{self.folder}/rows/{batch}"
            rows.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
            new = self.spark.read.schema(f"{self.schema}, bucket int").parquet(path).select("bucket").distinct().collect()
            held |= {r["bucket"]: batch for r in new}
        manifest = [(batch, -1, -1), *((batch, b, v) for b, v in held.items())]
        self.spark.createDataFrame(manifest, "batch int, bucket int, version int").coalesce(1).write.mode("overwrite").json(f"{self.folder}/manifest/{batch}")
