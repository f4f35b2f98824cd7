"""Sinks: nested JSON, campaign CSV, append-only logs, step recordings, and inserts of what is new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import article_key


def write_nested(parents: DataFrame, children: DataFrame, key: str, name: str, order: list[str], path: str) -> None:
    """One JSON document for each parent, with its children as an array in the given order."""
    fields = [*order, *(c for c in children.columns if c not in (key, *order))]
    grouped = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    parents.join(grouped, key, "left").withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType))).write.mode("overwrite").json(path)


def campaign_rows(companies: DataFrame, contacts: DataFrame, emails: DataFrame) -> DataFrame:
    """A row for each contact with its email (names match whatever their case and blanks; the last email counts), one blank row for a finished company without contacts."""
    norm = lambda c: F.lower(F.trim(F.col(c)))
    mail = emails.groupBy(norm("contact").alias("k")).agg(F.max_by(F.struct("email", "subject"), "sent_at").alias("m"))
    j = companies.filter("status = 'done'").join(contacts, "company", "left").join(mail, norm("contact") == F.col("k"), "left")
    blank = lambda c: F.coalesce(c, F.lit(""))
    return j.select("company", blank(F.col("contact")).alias("contact"), blank(F.col("role")).alias("role"), blank(F.col("m.email")).alias("email"), blank(F.col("m.subject")).alias("subject"))


def write_campaign(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Adds records to a log of JSON lines."""
    rows.write.mode("append").json(path)


def record_step(rows: DataFrame, folder: str, run: str, step: str, order: int, seconds: Column | float = 0.0) -> None:
    """Keeps a step's rows, and a line about it in the recording's manifest."""
    rows.write.mode("overwrite").json(f"{folder}/{run}/{step}")
    about = rows.agg(F.count("*").alias("rows")).select(F.lit(run).alias("run_id"), F.lit(step).alias("step"), F.lit(order).alias("order"), "rows", F.lit(seconds).alias("seconds"))
    append_log(about, f"{folder}/{run}/manifest")


def new_articles(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows to insert: titles of 10 to 500 characters, dates that can't be read blanked, known ids left out, each id once (the first by url)."""
    ids = incoming.filter(F.length(F.trim("title")).between(10, 500)).withColumn("id", article_key(F.col("url")))
    dated = ids.withColumn("published", F.when(F.try_to_timestamp("published").isNotNull(), F.col("published")).otherwise(""))
    once = dated.groupBy("id").agg(F.min_by(F.struct(*dated.columns), "url").alias("r")).select("r.*")
    return once.join(stored.select("id"), "id", "left_anti")
