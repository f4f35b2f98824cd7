"""Readers: the base tables, and articles derived from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Length of the title that an article takes from its document; the rest is its summary.
TITLE = 80
#: SQL of ``articles`` for DuckDB, as a common table expression.
ARTICLES_SQL = """articles AS (SELECT doc_id, substring(text, 1, 80) AS title, substring(text, 81) AS summary, source AS source_name, lang,
    TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS published_at, n_chars FROM documents)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, title, summary, source_name, lang, published_at, n_chars: documents as articles, one a minute from 2024 on."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.substring("text", 1, TITLE).alias("title"), F.substr("text", F.lit(TITLE + 1)).alias("summary"), F.col("source").alias("source_name"), "lang",
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))).alias("published_at"), "n_chars",
    )


def read_log(spark: SparkSession, path: str, schema: str, last: int | None = None, order: str = "timestamp") -> DataFrame:
    """An append-only log of JSON lines; lines that don't parse are left out, and the ``last`` newest kept if asked for."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.orderBy(F.desc(order)).limit(last) if last else rows


def latest_complete(manifests: DataFrame, least_steps: int = 6) -> DataFrame:
    """The newest recording whose manifest has enough steps."""
    return manifests.filter(F.col("step_count") >= least_steps).agg(F.max_by(F.struct("*"), "recorded_at").alias("m")).select("m.*")


def first_nonempty(sources: list[DataFrame]) -> DataFrame:
    """The rows of the first source that has any, by name; lower sources only count while higher ones are empty."""
    tagged = [s.withColumn("_rank", F.lit(k)) for k, s in enumerate(sources)]
    every = tagged[0]
    for s in tagged[1:]:
        every = every.unionByName(s, allowMissingColumns=True)
    least = every.agg(F.min("_rank").alias("_least"))  # one row
    return every.join(F.broadcast(least), F.col("_rank") == F.col("_least")).drop("_rank", "_least")


def fresh(cache: DataFrame, key: str, stamp: str, as_of, ttl_seconds: int) -> DataFrame:
    """The latest entry of each key that isn't older than the time to live."""
    young = cache.filter(F.col(stamp) > F.lit(as_of) - F.make_dt_interval(secs=F.lit(ttl_seconds)))
    return young.groupBy(key).agg(F.max_by(F.struct("*"), stamp).alias("r")).select("r.*")
