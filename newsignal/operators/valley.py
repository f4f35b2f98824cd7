"""The valley of a density of scores, from a histogram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores count with so many digits, so a histogram has 10 ** DIGITS bins at most; points of the density, and on each side those that a valley lies below.
DIGITS, POINTS, SIDE = 4, 200, 10
#: Where the density is looked at, which scores make it, and how many there must be of all and of these.
LOW, HIGH, LEAST, MOST, ENOUGH, ENOUGH_INSIDE = 0.30, 0.95, 0.05, 0.98, 30, 20


def density_valley(scores: DataFrame, score: Column, default: float = 0.88) -> DataFrame:
    """One row (threshold, valleys): the minimum of a Gaussian density of the scores that is nearest to ``default``, within 0.70 to 0.95.

    The histogram is an aggregate; the width comes from its moments (1.06 standard deviations times
    n to the power -0.2), and the density is summed over bins at POINTS places, so what is left
    after the aggregate is bounded whatever the number of scores.

    Cases: nulls don't count; too few scores, scores of one value, and a density without a valley
    give the default and no valleys; of valleys equally near the lower one counts.
    """
    bins = scores.select(F.round(score, DIGITS).alias("s")).filter("s is not null").groupBy("s").agg(F.count("*").alias("n"))
    inside = bins.filter(F.col("s").between(LEAST, MOST))
    n, total, squares = F.sum("n"), F.sum(F.col("n") * F.col("s")), F.sum(F.col("n") * F.col("s") * F.col("s"))
    moments = inside.agg(n.alias("n"), total.alias("t"), squares.alias("q"))
    deviation = F.sqrt(F.greatest((F.col("q") - F.col("t") * F.col("t") / F.col("n")) / (F.col("n") - 1), F.lit(0.0)))
    every = bins.agg(F.sum("n").alias("every"))
    width = moments.join(F.broadcast(every)).select(F.when((F.col("every") >= ENOUGH) & (F.col("n") >= ENOUGH_INSIDE) & (deviation > 1e-9), 1.06 * deviation * F.pow(F.col("n"), F.lit(-0.2))).alias("width"))
    step = (HIGH - LOW) / (POINTS - 1)
    # Every bin gives its part to each place: a thousand bins by two hundred places, summed as they are made.
    spread = inside.join(F.broadcast(width.filter("width is not null"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(POINTS - 1))))
    away = (LOW + F.col("i") * step - F.col("s")) / F.col("width")
    density = spread.groupBy("i").agg(F.sum(F.col("n") * F.exp(-0.5 * away * away)).alias("d"))
    order = Window.orderBy("i")  # POINTS rows
    sides = density.select("i", "d", F.min("d").over(order.rowsBetween(-SIDE, -1)).alias("left"), F.min("d").over(order.rowsBetween(1, SIDE)).alias("right"))
    low = sides.filter(F.col("i").between(SIDE, POINTS - SIDE - 1)).filter("d < left and d < right").select((LOW + F.col("i") * step).alias("at"))
    best = low.agg(F.min_by("at", F.struct(F.abs(F.col("at") - default), "at")).alias("at"), F.count("*").alias("valleys"))
    return best.select(F.round(F.when(F.col("at").isNull(), default).otherwise(F.greatest(F.lit(0.70), F.least(F.lit(0.95), F.col("at")))), 6).alias("threshold"), "valleys")
