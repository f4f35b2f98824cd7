"""Shared folder for intermediate tables, and small helpers used by several operators."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The setting by which Spark deletes the shuffle files of a query when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Words are maximal runs of anything but these separators (ASCII white space).
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is missing, a local session (tests) gets a folder of its own; on a
    cluster that is an error, as no folder of one machine can be seen by the others.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    made = f"/tmp/checkpoints/newsignal-{os.getpid()}"
    os.makedirs(made, exist_ok=True)
    return f"file://{made}"


class Workspace:
    """Intermediate tables of one run in the shared folder: they cut the lineage, survive lost executors, and go when nothing reads them any more."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/newsignal/{tag}-{uuid.uuid4().hex}"
        self.live: list[tuple[DataFrame, str]] = []
        self.made = 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back."""
        self.made += 1
        path = f"{self.folder}/{self.made}-{name}"
        before = self.spark.conf.get(SHUFFLE_CLEANUP)
        self.spark.conf.set(SHUFFLE_CLEANUP, "true")  # what the table was made of is no longer needed
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(SHUFFLE_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.live.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete the files of tables that this workspace keeps."""
        for found, path in [x for x in self.live if any(x[0] is t for t in tables)]:
            place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
            self.live = [x for x in self.live if x[0] is not found]

    def drop_all_but(self, *tables: DataFrame) -> None:
        """Delete all but the tables that the result still reads."""
        self.drop(*[t for t, _ in self.live if not any(t is x for x in tables)])


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    return Workspace(df.sparkSession, tag).keep(df, tag)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
