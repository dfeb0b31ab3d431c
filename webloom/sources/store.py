"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What the cluster names in ``spark.checkpoint.dir``, else the folder given to ``SparkContext.setCheckpointDir``.

    Only a local master, as in tests, may do without both: then it is a folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), f"webloom-shared-{os.getuid()}")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other call gets."""
    return f"{shared_folder(spark)}/webloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df``, written once and read back."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Grown:
    """A table that loops append to: each part is written once, and all parts are one folder, so a plan has one scan."""

    def __init__(self, spark: SparkSession, schema: str, label: str):
        self.spark, self.schema, self.path, self.parts = spark, schema, new_path(spark, label), 0

    def append(self, df: DataFrame) -> DataFrame:
        """Write the rows; gives the part alone."""
        columns = self.spark.createDataFrame([], self.schema).columns
        part = f"{self.path}/{self.parts:06d}"
        df.select(columns).write.parquet(part)
        self.parts += 1
        return self.spark.read.schema(self.schema).parquet(part)

    def table(self) -> DataFrame:
        if not self.parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)
