"""Weights of draws, resampling, shells, blocks: ``weights(ds, draw, lw)``, each data set on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Draws with numbers in a stretch of this many are summed up in one task.
STRETCH = 1 << 16


def importance_weights(weights: DataFrame) -> DataFrame:
    """Weights from log weights, summing to 1 in a data set, and the effective sample size. Greatest value and sums are grouped, partly before the shuffle, so a data set may be of any size."""
    top = weights.groupBy("ds").agg(F.max("lw").alias("top"))
    raw = weights.join(top, "ds").withColumn("e", F.exp(F.col("lw") - F.col("top"))).drop("top")
    sums = raw.groupBy("ds").agg(F.sum("e").alias("total"), F.sum(F.col("e") * F.col("e")).alias("square"))
    return raw.join(sums, "ds").withColumn("w", F.col("e") / F.col("total")).withColumn("ess", F.col("total") * F.col("total") / F.col("square")).drop("e", "total", "square")


def systematic_resample(weights: DataFrame, start: float = 0.5, stretch: int = STRETCH) -> DataFrame:
    """Times that each draw is taken when n points, ``(k + start) / n``, are laid on the running sum of weights.

    The sum runs within stretches of draws' numbers, on top of the sums of the stretches before.
    """
    w = importance_weights(weights).withColumn("part", F.floor(F.col("draw") / stretch))
    order = Window.partitionBy("ds").orderBy("part")
    parts = w.groupBy("ds", "part").agg(F.sum("w").alias("sum"), F.count(F.lit(1)).alias("m"))
    parts = parts.select("ds", "part", F.coalesce(F.sum("sum").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"), F.sum("m").over(Window.partitionBy("ds")).alias("n"))
    run = Window.partitionBy("ds", "part").orderBy("draw")
    points = lambda total: F.greatest(F.lit(0), F.ceil(F.round(F.col("n") * F.least(F.lit(1.0), total), 9) - start))
    upto = F.col("before") + F.sum("w").over(run.rowsBetween(Window.unboundedPreceding, 0))
    under = F.col("before") + F.coalesce(F.sum("w").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return w.join(parts, ["ds", "part"]).select("ds", "draw", (points(upto) - points(under)).alias("times"))


def top_draws(weights: DataFrame, n: int) -> DataFrame:
    """The n draws of greatest log weight; of equals the first."""
    rank = F.row_number().over(Window.partitionBy("ds").orderBy(F.desc("lw"), "draw"))
    return weights.withColumn("rank", rank).where(F.col("rank") <= n)


def blocks(history: DataFrame, size: int) -> DataFrame:
    """Sums over blocks of a history ``(ds, draw, value)`` and whether each block improved on the one before."""
    t = F.row_number().over(Window.partitionBy("ds").orderBy("draw")) - 1
    sums = history.withColumn("block", F.floor(t / size)).groupBy("ds", "block").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n")).where(F.col("n") == size)
    before = F.lag("total").over(Window.partitionBy("ds").orderBy("block"))
    return sums.withColumn("before", before).withColumn("stop", F.coalesce(1.001 * F.col("total") <= 0.999 * F.col("before"), F.lit(False))).drop("n")


def envelopes(draws: DataFrame, centre: float = 0.995, tail: float = 0.999, share: float = 0.2, least: int = 20, margin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Upper bounds of ``draws(ds, shell, lw)``, shell by shell: the value at a rising quantile's place with a margin that rises from the first to the second number, and the spread of the top values; neither falls outwards."""
    shells = F.max("shell").over(Window.partitionBy("ds"))
    up, down = Window.partitionBy("ds", "shell").orderBy("lw", "draw"), Window.partitionBy("ds", "shell").orderBy(F.desc("lw"), F.desc("draw"))
    m = F.count(F.lit(1)).over(Window.partitionBy("ds", "shell"))
    d = draws.withColumn("last", shells).withColumn("m", m).withColumn("up", F.row_number().over(up) - 1).withColumn("down", F.row_number().over(down))
    q = F.least(F.lit(0.9999), centre + F.try_divide(F.col("shell"), F.col("last")) * (tail - centre))
    q = F.when(F.col("last") == 0, centre).otherwise(q)
    place = F.floor(q * (F.col("m") - 1))
    kept = F.greatest(F.lit(least), F.floor(share * F.col("m")))
    out = F.coalesce(F.try_divide(F.col("shell"), F.col("last")), F.lit(0.0))
    over = margin[0] + out * (margin[1] - margin[0])
    per = d.groupBy("ds", "shell").agg(F.max(F.when(F.col("up") == place, F.col("lw") + over)).alias("bound"), F.coalesce(F.stddev_samp(F.when(F.col("down") <= kept, F.col("lw"))), F.lit(0.0)).alias("spread"))
    run = Window.partitionBy("ds").orderBy("shell").rowsBetween(Window.unboundedPreceding, 0)
    return per.select("ds", "shell", F.max("bound").over(run).alias("bound"), F.max("spread").over(run).alias("spread"))
