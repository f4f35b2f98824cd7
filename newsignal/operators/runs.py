"""Folds over the runs of a loop: thresholds that adapt, and the guard that freezes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Quality below BASELINE adds up, less DRIFT a run, over the last LAST runs; beyond LIMIT adaptation freezes, and a run from THAW on ends that.
BASELINE, DRIFT, LAST, LIMIT, THAW = 0.4, 0.05, 5, 0.3, 0.45
#: Weight of a run in a threshold, and the most it can be.
ALPHA, MOST_ALPHA = 0.1, 0.30


def _history(t: DataFrame, loop: str, run: str, *columns: str) -> DataFrame:
    """(loop, h): the runs of each loop in order.  A loop runs once a cycle, so its history is short."""
    return t.groupBy(loop).agg(F.array_sort(F.collect_list(F.struct(run, *columns))).alias("h"))


def _peak(last: Column) -> Column:
    """The largest sum that stays above 0 along a list of deviations."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("peak"))

    def add(a: Column, q: Column) -> Column:
        s = F.greatest(F.lit(0.0), a["sum"] + (BASELINE - q - DRIFT))
        return F.struct(s.alias("sum"), F.greatest(a["peak"], s).alias("peak"))

    return F.aggregate(last, start, add, lambda a: a["peak"])


def freeze(t: DataFrame, loop: str, run: str, quality: str) -> DataFrame:
    """(loop, run, frozen) after each run."""
    start = F.struct(F.array().cast("array<double>").alias("last"), F.lit(False).alias("frozen"), F.array().cast(f"array<struct<{run}:int,frozen:boolean>>").alias("out"))

    def step(a: Column, r: Column) -> Column:
        seen = F.concat(a["last"], F.array(r[quality]))
        last = F.slice(seen, F.greatest(F.size(seen) - (LAST - 1), F.lit(1)), LAST)
        frozen = F.when(a["frozen"] & (r[quality] >= THAW), F.lit(False)).when((F.size(last) >= 3) & (_peak(last) > LIMIT), F.lit(True)).otherwise(a["frozen"])
        return F.struct(last.alias("last"), frozen.alias("frozen"), F.concat(a["out"], F.array(F.struct(r[run].alias(run), frozen.alias("frozen")))).alias("out"))

    folded = _history(t, loop, run, quality).select(loop, F.explode(F.aggregate("h", start, step, lambda a: a["out"])).alias("o"))
    return folded.select(loop, f"o.{run}", "o.frozen")


def adapt(t: DataFrame, loop: str, run: str) -> DataFrame:
    """(loop, run, accept_t, coherence_t, reject_t, noise_t) after each run with accept, coherence, pass_rate, noise and confidence."""
    names = ("accept_t", "coherence_t", "reject_t", "noise_t")
    kind = f"array<struct<{run}:int," + ",".join(f"{n}:double" for n in names) + ">>"
    start = F.struct(*[F.lit(v).alias(n) for n, v in zip(names, (0.30, 0.40, 0.50, 0.10), strict=True)], F.array().cast(kind).alias("out"))

    def step(a: Column, r: Column) -> Column:
        alpha = F.least(F.lit(MOST_ALPHA), ALPHA * (0.7 + 0.6 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), r["confidence"]))))
        to = lambda now, target: F.round(alpha * target + (1 - alpha) * now, 4)
        both = lambda now, seen, low, high, down, up: F.when(seen < low, to(now, down)).when(seen > high, to(now, up)).otherwise(now)
        accept = both(a["accept_t"], r["accept"], 0.2, 0.8, F.greatest(F.lit(0.20), a["accept_t"] - 0.02), F.least(F.lit(0.50), a["accept_t"] + 0.02))
        coherence = F.when(r["coherence"] > 0, to(a["coherence_t"], F.greatest(F.lit(0.30), F.least(F.lit(0.65), r["coherence"] * 0.85)))).otherwise(a["coherence_t"])
        reject = both(a["reject_t"], r["pass_rate"], 0.3, 0.8, F.greatest(F.lit(0.30), a["reject_t"] - 0.03), F.least(F.lit(0.70), a["reject_t"] + 0.03))
        noise = F.when(r["noise"] > 0.4, to(a["noise_t"], F.greatest(F.lit(0.05), a["noise_t"] - 0.01))).when(r["noise"] < 0.1, to(a["noise_t"], F.least(F.lit(0.20), a["noise_t"] + 0.01))).otherwise(a["noise_t"])
        now = [c.alias(n) for n, c in zip(names, (accept, coherence, reject, noise), strict=True)]
        return F.struct(*now, F.concat(a["out"], F.array(F.struct(r[run].alias(run), *now))).alias("out"))

    folded = _history(t, loop, run, "accept", "coherence", "pass_rate", "noise", "confidence").select(loop, F.explode(F.aggregate("h", start, step, lambda a: a["out"])).alias("o"))
    return folded.select(loop, f"o.{run}", *[f"o.{n}" for n in names])
