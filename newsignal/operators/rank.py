"""Caps, first-of-a-kind and other window operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch, join_counted

#: Entries of good, usual and poor sources.
TIERS = (100, 50, 15)


def top_per_key(df: DataFrame, key: str, order: list[Column], most: int | Column, rank: str = "rank") -> DataFrame:
    """At most ``most`` rows of each key in the given order, with their rank."""
    numbered = df.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return numbered.filter(F.col(rank) <= most)


def first_of(df: DataFrame, keys: list[Column | str], order: list[Column]) -> DataFrame:
    """The first row of each key: exact deduplication where an order says which copy stays."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def quartile_caps(stats: DataFrame, value: str, base: int) -> DataFrame:
    """``cap`` of each source by where its value lies among all: 1.5 x base from the third quartile on, 0.6 x base up to the first.

    Quartiles are elements of the sorted values (numbers n div 4 and 3 n div 4, from 0); with
    fewer than four sources everyone has the base.  One row a source: small at any corpus size.
    """
    q = stats.agg(F.sort_array(F.collect_list(value)).alias("v")).select(F.size("v").alias("n"), F.get("v", (F.size("v") / 4).cast("int")).alias("low"), F.get("v", (F.size("v") * 3 / 4).cast("int")).alias("high"))
    x = F.col(value)
    cap = F.when(F.col("n") < 4, base).when(x >= F.col("high"), int(1.5 * base)).when(x <= F.col("low"), max(3, int(0.6 * base))).otherwise(base)
    return stats.join(F.broadcast(q)).withColumn("cap", cap).drop("n", "low", "high")


def tier_cap(posterior: Column) -> Column:
    """100 entries for a good source, 15 for a poor one, else 50."""
    good, usual, poor = TIERS
    return F.when(posterior > 0.70, good).when(posterior < 0.40, poor).otherwise(usual)


def fail_open(df: DataFrame, passes: Column, order: list[Column], most: int) -> DataFrame:
    """Rows that pass; if none does, the first ``most`` rows in the given order."""
    flagged = df.withColumn("_pass", passes)
    any_ = F.broadcast(flagged.agg(F.coalesce(F.bool_or("_pass"), F.lit(False)).alias("_any")))
    best = F.broadcast(df.orderBy(*order).limit(most).select(F.struct(*df.columns).alias("_best")))
    kept = flagged.join(any_).filter("_pass and _any").select(*df.columns)
    return kept.unionByName(best.join(any_).filter("not _any").select("_best.*"))


#: Parts that a range of values is cut into in each pass of ``exact_percentiles``; five passes part any two doubles.
PARTS = 4096


def exact_percentiles(df: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """(group, p): for each share the percentile of a group's values, between neighbours by a straight line, as exact as sorting.

    No group is sorted or held: each pass counts the values of the range that a wanted rank lies
    in, by PARTS parts of it, and the part with the rank is the next range, until a range is one
    value.  Passes read the values again, so what is shuffled is bounded by groups, ranks and parts.

    Cases: nulls don't count, and a group without values has nulls; a null group is one group.
    """
    work = Scratch(df.sparkSession)
    rows = df.select(F.struct(F.col(group).alias("g")).alias("k"), F.col(value).cast("double").alias("x")).withColumn("k", F.to_json("k"))
    whole = work.keep(rows.groupBy("k").agg(F.count("x").alias("n"), F.count("*").alias("rows"), F.min("x").alias("low"), F.max("x").alias("high")))
    total = whole.agg(F.sum("rows")).first()[0] or 0
    ranks = [F.struct(F.lit(2 * i + up).alias("i"), r.cast("long").alias("rank")) for i, s in enumerate(shares) for up, r in ((0, F.floor(s * (F.col("n") - 1))), (1, F.ceil(s * (F.col("n") - 1))))]
    wanted = work.keep(whole.filter("n > 0").select("k", "rows", F.explode(F.array(*ranks)).alias("r")).select("k", "rows", "r.i", "r.rank").join(whole.select("k", "low", "high"), "k").withColumn("below", F.lit(0).cast("long")))
    before = Window.partitionBy("k", "i").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # PARTS rows
    while not wanted.filter("low < high").isEmpty():
        lists = wanted.groupBy("k", "rows").agg(F.collect_list(F.struct("i", "rank", "low", "high", "below")).alias("w"))  # two for each share
        met = join_counted(rows, lists, "k", "rows", total).select("k", "rows", "x", F.explode("w").alias("w")).filter(F.col("x").between(F.col("w.low"), F.col("w.high")))
        part = F.when(F.col("w.high") > F.col("w.low"), F.least(F.floor((F.col("x") - F.col("w.low")) / (F.col("w.high") - F.col("w.low")) * PARTS), F.lit(PARTS - 1))).otherwise(0)
        counts = met.groupBy("k", "rows", "w.i", "w.rank", "w.below", part.alias("part")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        placed = counts.withColumn("at", F.col("below") + F.coalesce(F.sum("n").over(before), F.lit(0)))
        wanted = work.keep(placed.filter((F.col("rank") >= F.col("at")) & (F.col("rank") < F.col("at") + F.col("n"))).select("k", "rows", "i", "rank", "low", "high", F.col("at").alias("below")))
    found = wanted.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("i", "low"))).alias("v"))
    line = lambda i, s: F.col("v")[2 * i] + (F.col("v")[2 * i + 1] - F.col("v")[2 * i]) * (s * (F.col("n") - 1) - F.floor(s * (F.col("n") - 1)))
    kind = df.schema[group].dataType.simpleString()
    out = whole.join(found, "k", "left").select(F.from_json("k", f"g {kind}")["g"].alias(group), F.array(*[F.when(F.col("n") > 0, line(i, s)) for i, s in enumerate(shares)]).alias("p"))
    out = work.keep(out)
    work.drop_all_but(out)
    return out


def smallest(df: DataFrame, group: str, key: str, most: int, work: Scratch) -> DataFrame:
    """The ``most`` rows of each group with the smallest keys (whole numbers), or all if there are no more.

    No group is sorted or held: each pass counts the keys of the range that the last wanted row lies
    in, by PARTS parts of it, until the range is one key.  Of rows that share this key any count.

    Cases: null groups and rows with a null key are left out.
    """
    rows = df.filter(F.col(group).isNotNull() & F.col(key).isNotNull())
    if most <= 0:
        return rows.filter("false")
    wanted = rows.groupBy(group).agg(F.count("*").alias("_n"), F.min(key).alias("_low"), F.max(key).alias("_high")).filter(F.col("_n") > most)
    wanted = work.keep(wanted.select(group, F.lit(most).cast("long").alias("_rest"), "_low", "_high"))
    away = lambda a: (F.col(a).cast("decimal(20,0)") - F.col("_low")).cast("double")
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # PARTS rows
    while not wanted.filter("_low < _high").isEmpty():
        met = rows.join(wanted, group).filter(F.col(key).between(F.col("_low"), F.col("_high")))
        part = F.when(F.col("_high") > F.col("_low"), F.least(F.floor(away(key) / away("_high") * PARTS), F.lit(PARTS - 1))).otherwise(0)
        counts = met.groupBy(group, "_rest", part.alias("_part")).agg(F.count("*").alias("_n"), F.min(key).alias("_low"), F.max(key).alias("_high"))
        placed = counts.withColumn("_at", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        wanted = work.keep(placed.filter((F.col("_rest") > F.col("_at")) & (F.col("_rest") <= F.col("_at") + F.col("_n"))).select(group, (F.col("_rest") - F.col("_at")).alias("_rest"), "_low", "_high"))
    cut = rows.join(wanted.select(group, "_rest", F.col("_low").alias("_cut")), group, "left")
    below = cut.filter(F.col("_cut").isNull() | (F.col(key) < F.col("_cut"))).select(*df.columns)
    last = top_per_key(cut.filter(F.col(key) == F.col("_cut")), group, [F.col(key)], F.col("_rest"), "_place")
    return below.unionByName(last.select(*df.columns))
