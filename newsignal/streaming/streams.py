"""Structured Streaming counterparts of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import article_key


def first_seen(articles: DataFrame, url: str = "url", stamp: str = "published_at", lateness: str = "48 hours") -> DataFrame:
    """Articles whose canonical url wasn't seen within the watermark; state is dropped once it is older."""
    keyed = articles.withColumn("article_key", article_key(F.col(url)))
    return keyed.withWatermark(stamp, lateness).dropDuplicatesWithinWatermark(["article_key"])


def windowed_counts(events: DataFrame, key: str, stamp: str, value: str, length: str = "1 hour", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Count and mean per key and (sliding) window; late rows within the watermark still count."""
    span = F.window(stamp, length, slide) if slide else F.window(stamp, length)
    out = events.withWatermark(stamp, lateness).groupBy(span.alias("span"), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return out.select(F.col("span.start").alias("start"), F.col("span.end").alias("end"), key, "n", "mean")


def sessions(events: DataFrame, key: str, stamp: str, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Session windows per key: runs of events no further apart than the gap."""
    out = events.withWatermark(stamp, lateness).groupBy(F.session_window(stamp, gap).alias("span"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("span.start").alias("start"), F.col("span.end").alias("end"), "n")


def posterior_updates(rewards: DataFrame, arm: str = "arm", run: str = "run", reward: str = "reward", weight: str = "weight", decay: float = 0.97, floor: float = 1.5) -> DataFrame:
    """(arm, run, alpha, beta) after each batch of rewards: a Beta posterior kept as state per arm.

    Rows of one batch are taken in order of their run; state survives restarts through the query's checkpoint.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, frames, state: GroupState):
        alpha, beta = state.get if state.exists else (1.0, 1.0)
        rows = pd.concat(list(frames)).sort_values(run)
        for r, w in zip(rows[reward], rows[weight], strict=True):
            alpha = max(floor, 1 + (alpha - 1) * decay) + r * w
            beta = max(floor, 1 + (beta - 1) * decay) + (1 - r) * w
        state.update((float(alpha), float(beta)))
        yield pd.DataFrame({"arm": [key[0]], "run": [int(rows[run].max())], "alpha": [alpha], "beta": [beta]})

    return rewards.groupBy(arm).applyInPandasWithState(step, "arm string, run long, alpha double, beta double", "alpha double, beta double", "update", GroupStateTimeout.NoTimeout)
