"""Stored tables: merges, nested views, exports."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which driver and executors share; local sessions without one get their own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return f"file:///tmp/checkpoints/newsignal-core-{os.getpid()}"


#: The setting by which Spark deletes the shuffle files of a query when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables between the steps of one operator, in the shared folder: they cut the lineage, survive lost executors, and are deleted when told."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, f"{shared_folder(spark)}/newsignal/scratch-{uuid.uuid4().hex}", {}

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back; the shuffle files that it was made of go."""
        path = f"{self.folder}/{len(self.paths)}"
        before = self.spark.conf.get(SHUFFLE_CLEANUP)
        self.spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(SHUFFLE_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = out
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete the files of these tables, as far as they are kept here."""
        for path, df in self.paths.items():
            if df is not None and any(df is t for t in tables):
                place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
                self.paths[path] = None

    def drop_all_but(self, *tables: DataFrame) -> None:
        """Delete the files of all tables but these, which a result still reads."""
        self.drop(*[df for df in self.paths.values() if df is not None and not any(df is t for t in tables)])


#: A key in more than a fraction 1 / HOT of all rows is a hot one, so there are fewer than HOT of them.
HOT = 1024


def join_counted(rows: DataFrame, counts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``counts`` (one row a key; ``n``: how many of the ``total`` rows have the key), inner.

    Hot keys, fewer than HOT by their definition, are looked up in a broadcast table, so no key
    takes more than a fraction 1 / HOT of the rows through the shuffle.
    """
    others = [c for c in counts.columns if c != key]
    hot = counts.filter(F.col(n) * HOT > total).withColumn("_hot", F.lit(True))
    marked = rows.join(F.broadcast(hot), key, "left")
    often = marked.filter("_hot").select(*rows.columns, *others)
    seldom = marked.filter("_hot is null").select(*rows.columns).join(counts.filter(F.col(n) * HOT <= total).hint("merge"), key).select(*rows.columns, *others)
    return often.unionByName(seldom)


def filled(name: str, side: str):
    """A text column of one side, empty counting as missing."""
    return F.nullif(F.col(f"{side}.{name}"), F.lit(""))


def smart_merge(old: DataFrame, new: DataFrame, key: str, texts: list[str], others: list[str]) -> DataFrame:
    """Upsert by lower-cased key: a new value that isn't empty wins, else the old one stays; keys under two characters are no rows."""
    o, n = old.withColumn("_k", F.lower(key)).alias("o"), new.filter(F.length(key) >= 2).withColumn("_k", F.lower(key)).alias("n")
    joined = o.join(n, F.col("o._k") == F.col("n._k"), "full_outer")
    cols = [F.coalesce(F.col(f"o.{key}"), F.col(f"n.{key}")).alias(key)]
    cols += [F.coalesce(filled(c, "n"), F.col(f"o.{c}")).alias(c) for c in texts]
    cols += [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in others]
    return joined.select(*cols)


def append_missing(kept: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """``kept`` and those rows of ``more`` whose lower-cased key isn't in it."""
    k = kept.select(F.lower(key).alias("_k")).distinct()
    extra = more.withColumn("_k", F.lower(key)).join(k, "_k", "left_anti").drop("_k")
    return kept.unionByName(extra, allowMissingColumns=True)


def upsert(table: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """The latest version of each key."""
    both = table.unionByName(changes, allowMissingColumns=True)
    return both.groupBy(key).agg(F.max_by(F.struct("*"), version).alias("r")).select("r.*")


def nest(parents: DataFrame, children: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """Parents with their children as an array ordered by its fields; without children it is empty."""
    grouped = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    return parents.join(grouped, key, "left").withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)))
