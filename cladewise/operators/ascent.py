"""What steers a stochastic ascent and a rejection sampler: averages over steps, schedules, draws from counts, acceptance.

Histories come in data sets of a bounded number of steps.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladewise.functions import scalars as S


def gradient_average(history: DataFrame, beta: float = 0.98, factor: float = 2.0, floor: float = 7.0) -> DataFrame:
    """``ds, step, average, clip`` of ``history(ds, step, value)``: the moving average of gradient norms, which starts at the first, and the norm to cut gradients at."""
    run = Window.partitionBy("ds").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    at = F.row_number().over(Window.partitionBy("ds").orderBy("step")) - 1
    share = F.when(F.col("at") == 0, 1.0).otherwise((1 - beta) * F.pow(F.lit(beta), -F.col("at")))
    found = history.withColumn("at", at).withColumn("average", F.pow(F.lit(beta), F.col("at")) * F.sum(F.col("value") * share).over(run))
    return found.select("ds", "step", "average", F.greatest(factor * F.col("average"), F.lit(floor)).alias("clip"))


def trace_average(history: DataFrame, beta: float = 0.3, warm: int = 50, period: int = 30) -> DataFrame:
    """``ds, step, average``: the moving average of traces that are taken every ``period`` steps once ``warm`` have passed."""
    at = F.row_number().over(Window.partitionBy("ds").orderBy("step")) - 1
    due = history.withColumn("at", at).where((F.col("at") >= warm) & ((F.col("at") - warm) % period == 0))
    return gradient_average(due.select("ds", "step", "value"), 1 - beta).select("ds", "step", "average")


def schedule(sizes: DataFrame, steps: int, first: int = 256, grow: int = 20, rate: float = 0.05, full_share: float = 0.95, whole: int = 400, anchor: int = 50) -> DataFrame:
    """``ds, step, sites, rate, full``: how many sites a step of each of ``sizes(ds, n)`` uses, its learning rate, and whether it takes the full gradient.

    Sites double every ``grow`` steps; where that is too many, half of what is
    missing is added. With ``full_share`` of all sites a step uses all of them.
    """
    n = F.col("n")

    def grown(m, t):
        twice = F.when(2 * m > n, m + F.floor((n - m) / 2)).otherwise(2 * m)
        return F.when((t > 0) & (t % grow == 0), F.least(n, F.greatest(twice, m + 1))).otherwise(m)

    def used(m):
        return F.when(m >= full_share * n, n).otherwise(m)

    start = F.least(F.lit(first), n).cast("long")
    empty = F.array().cast("array<struct<step:int,sites:bigint>>")
    acc = F.struct(start.alias("m"), empty.alias("out"))

    def step(a, t):
        m = used(grown(a["m"], t)).cast("long")
        return F.struct(m.alias("m"), F.concat(a["out"], F.array(F.struct(t.alias("step"), m.alias("sites")))).alias("out"))

    rows = sizes.withColumn("plan", F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), acc, step)["out"]).select("ds", "n", F.explode("plan").alias("s")).select("ds", "n", "s.*")
    fall = 0.9 + 0.05 * (1 + F.cos(F.lit(math.pi) * F.col("step") / whole))
    all_ = F.col("sites") >= F.col("n")
    return rows.select("ds", "step", "sites", F.when(all_, rate).otherwise(rate * F.sqrt(F.col("sites") / F.col("n")) * fall).alias("rate"), (all_ | ((F.col("step") > 0) & (F.col("step") % anchor == 0))).alias("full"))


def draw_counts(counts: DataFrame, item: str, draws: int, seed: int = 1) -> DataFrame:
    """Multinomial draw: ``ds, item, times`` from ``counts(ds, item, n)``; each draw falls into one step of the running shares, items in order."""
    run = F.sum("n").over(Window.partitionBy("ds").orderBy(item).rowsBetween(Window.unboundedPreceding, 0))
    steps = counts.withColumn("upto", run).withColumn("total", F.sum("n").over(Window.partitionBy("ds")))
    each = steps.select("ds", "total").distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    each = each.select("ds", (S.uniform(F.lit(seed), F.col("ds"), F.col("draw")) * F.col("total")).alias("u"))
    met = steps.join(each, "ds").where("u < upto AND u >= upto - n")
    return met.groupBy("ds", item).agg(F.count(F.lit(1)).alias("times"))


def accept(proposals: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """The first ``n`` accepted of ``proposals(ds, draw, lw, bound)``, in the order of draws: ``ds, draw, place``. Accepted is what a uniform number allows below the bound of its shell."""
    u = F.log(S.uniform(F.lit(seed), F.col("ds"), F.col("draw")))
    taken = proposals.where(u <= F.col("lw") - F.col("bound"))
    return taken.withColumn("place", F.row_number().over(Window.partitionBy("ds").orderBy("draw"))).where(F.col("place") <= n).select("ds", "draw", "place")


def relaxed_clock(branches: DataFrame, sigma: float = 0.6, beta: float = 4.0, kappa: float = 0.5, eps: float = 1e-6) -> DataFrame:
    """``tree, branches, time, clock, yule`` from ``branches(tree, length, above, below)``, the times of both ends before the present.

    Rates are lognormal about one, their squares cut down as by Huber; times
    between ends are made positive by a softplus. ``yule``: birth rate
    integrated out.
    """
    tau = eps + S.softplus(F.col("above") - F.col("below"), beta)
    length = F.col("length") + eps
    z = F.log(length / F.col("tau")) + 0.5 * sigma * sigma
    term = -F.log(length) - S.huber(z, kappa) / (sigma * sigma) - math.log(sigma) - 0.5 * math.log(2 * math.pi)
    sums = branches.withColumn("tau", tau).groupBy("tree").agg(F.count(F.lit(1)).alias("branches"), F.sum("tau").alias("time"), F.sum(term).alias("clock"))
    return sums.withColumn("yule", -F.col("branches") * F.log("time"))


#: Least spread of rates; mean and deviation of its logarithm where that is normal.
SIGMA_FLOOR, LOG_SIGMA_MEAN, LOG_SIGMA_SD = 0.4, math.log(0.7), 0.1


def clock_slopes(branches: DataFrame, raw: float, prior: str | None = "yule", log_sigma: tuple[float, float] = (LOG_SIGMA_MEAN, LOG_SIGMA_SD), sigma_mean: float | None = None, shape: float = 2.0, beta: float = 4.0, kappa: float = 0.5, eps: float = 1e-6) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Log prior of a relaxed clock with its slopes, from ``branches(tree, node, parent, length, above, below)``, where leaves have no ``below``.

    Three tables: ``tree, sigma, log_prior, raw_slope``; ``tree, node, slope``
    in each branch's length; ``tree, node, slope`` in the time of each inner
    node, less their mean, as moving all times together changes nothing. The
    spread is :data:`SIGMA_FLOOR` and the softplus of ``raw``; its logarithm is
    normal, or the spread exponential with the mean ``sigma_mean``. ``prior``
    of the whole time: ``yule``, ``gamma`` (mean: the tree's length, held) or none.
    """
    if prior not in ("yule", "gamma", None):
        raise ValueError(f"no such prior: {prior}")
    sigma = SIGMA_FLOOR + max(raw, 0.0) + math.log1p(math.exp(-abs(raw)))
    square = sigma * sigma
    delta = F.col("above") - F.coalesce(F.col("below"), F.lit(0.0))
    at = branches.withColumn("tau", eps + S.softplus(delta, beta)).withColumn("far", S.softplus_slope(delta, beta)).withColumn("own", F.col("length") + eps)
    at = at.withColumn("z", F.log(F.col("own") / F.col("tau")) + 0.5 * square)
    rho, psi = S.huber(F.col("z"), kappa), S.huber_slope(F.col("z"), kappa)
    each = -F.log("own") - rho / square - math.log(sigma) - 0.5 * math.log(2 * math.pi)
    sums = at.groupBy("tree").agg(F.count(F.lit(1)).alias("n"), F.sum("tau").alias("time"), F.sum("own").alias("whole"), F.sum(each).alias("clock"), F.sum(-1.0 / sigma - psi / sigma + 2.0 * rho / (square * sigma)).alias("turn"))
    time, scale = F.col("time"), F.col("whole") / shape
    value, turn = {
        "yule": (-F.col("n") * F.log(time), -F.col("n") / time),
        "gamma": ((shape - 1.0) * F.log(time) - time / scale - shape * F.log(scale) - math.lgamma(shape), (shape - 1.0) / time - 1.0 / scale),
        None: (F.lit(0.0), F.lit(0.0)),
    }[prior]
    if sigma_mean is None:
        off, wide = math.log(sigma) - log_sigma[0], log_sigma[1] ** 2
        own, own_turn = -0.5 * off * off / wide, -off / wide / sigma
    else:
        own, own_turn = -math.log(sigma_mean) - sigma / sigma_mean, -1.0 / sigma_mean
    chain = 1.0 / (1.0 + math.exp(-raw)) if raw > -700 else 0.0
    trees = sums.select("tree", F.lit(sigma).alias("sigma"), (F.col("clock") + value + own).alias("log_prior"), (chain * (F.col("turn") + own_turn)).alias("raw_slope"))
    lengths = at.select("tree", "node", ((-1.0 - psi / square) / F.col("own")).alias("slope"))
    moved = at.join(sums.select("tree", turn.alias("turn")), "tree").withColumn("s", (psi / (square * F.col("tau")) + F.col("turn")) * F.col("far"))
    parts = F.array(F.struct(F.col("parent").alias("node"), F.col("s").alias("s")), F.when(F.col("below").isNotNull(), F.struct(F.col("node").alias("node"), (-F.col("s")).alias("s"))))
    ends = moved.select("tree", F.explode(F.array_compact(parts)).alias("e")).groupBy("tree", F.col("e.node").alias("node")).agg(F.sum("e.s").alias("s"))
    mean = ends.groupBy("tree").agg(F.avg("s").alias("mean"))
    return trees, lengths, ends.join(mean, "tree").select("tree", "node", (F.col("s") - F.col("mean")).alias("slope"))
