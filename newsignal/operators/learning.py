"""Folds over run histories: moving averages, CUSUM, Beta posteriors, run-over-run rules.

A fold is an ``aggregate`` over the ordered array of one key's runs: the state of each step
depends on the one before, which no window frame expresses.  Histories are short (one entry a
run), so an array per key is bounded by the number of runs, never by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def history(df: DataFrame, key: str, run: str, *values: str) -> DataFrame:
    """One row a key: its runs in order as ``runs``."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(run, *values))).alias("runs"))


def ema(runs: Column, value: str, alpha: float, start: float) -> Column:
    """Exponential moving average after the last run."""
    return F.aggregate(runs, F.lit(float(start)), lambda s, r: s + alpha * (r[value] - s))


def cusum_low(runs: Column, value: str, target: float, drift: float) -> Column:
    """One-sided CUSUM of falls below the target, never under 0, after the last run."""
    return F.aggregate(runs, F.lit(0.0), lambda s, r: F.greatest(F.lit(0.0), s + target - drift - r[value]))


def beta_posterior(runs: Column, reward: str, weight: str, decay: float = 0.97, floor: float = 1.5, cap: float = 200.0) -> Column:
    """Beta(alpha, beta) after all runs: both decay towards 1 (never below the floor), then take in the reward, within a total of ``cap``."""
    fade = lambda x: F.greatest(F.lit(floor), 1 + (x - 1) * decay)

    def step(s: Column, r: Column) -> Column:
        a, b = fade(s["alpha"]) + r[reward] * r[weight], fade(s["beta"]) + (1 - r[reward]) * r[weight]
        shrink = F.least(F.lit(1.0), cap / (a + b))
        return F.struct((a * shrink).alias("alpha"), (b * shrink).alias("beta"))

    return F.aggregate(runs, F.struct(F.lit(1.0).alias("alpha"), F.lit(1.0).alias("beta")), step)


def rolling_baseline(df: DataFrame, key: str, run: str, value: str, last: int = 5) -> DataFrame:
    """``baseline``: mean of the last runs before this one, if there are two at least."""
    w = Window.partitionBy(key).orderBy(run).rowsBetween(-last, -1)
    return df.withColumn("baseline", F.when(F.count(value).over(w) >= 2, F.avg(value).over(w)))


def half_trend(df: DataFrame, key: str, run: str, value: str, margin: float) -> DataFrame:
    """(key, delta, trend): mean of the second half of the runs less that of the first."""
    w = Window.partitionBy(key)
    placed = df.withColumns({"_at": F.row_number().over(w.orderBy(run)), "_n": F.count("*").over(w)}).withColumn("_late", F.col("_at") > F.floor(F.col("_n") / 2))
    delta = F.avg(F.when(F.col("_late"), F.col(value))) - F.avg(F.when(~F.col("_late"), F.col(value)))
    out = placed.groupBy(key).agg(delta.alias("delta"))
    return out.withColumn("trend", F.when(F.col("delta") > margin, "improving").when(F.col("delta") < -margin, "declining").otherwise("stable"))


def drops(df: DataFrame, key: str, run: str, value: str, share: float) -> DataFrame:
    """Runs whose value fell by more than the share against the run before."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(run))
    return df.withColumn("before", before).filter((F.col("before") > 0) & (F.col(value) < (1 - share) * F.col("before")))
