"""Normal distributions whose covariance has a low rank: factors, draws, densities, divergence and slopes.

``factors(ds, taxon, r)`` holds a row of the factor R for each taxon, so the
covariance of the taxa is R R', the same in every dimension. All work is in
the space of the rank: sums over taxa make R'R, whose Cholesky factor is an
array expression; no matrix of all taxa exists. Where R'R is singular (a rank
above the number of taxa, or equal columns) densities and slopes are null or
not a number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.functions import matrices as M
from cladewise.functions import scalars as S

#: Variance that the first factors give a coordinate.
FIRST_VARIANCE = 0.01


def first_factors(points: DataFrame, rank: int, variance: float = FIRST_VARIANCE, seed: int = 1) -> DataFrame:
    """Factors drawn so that the expected covariance is ``variance`` times the identity."""
    axes = F.sequence(F.lit(0), F.lit(rank - 1))
    return points.select("ds", "taxon", F.transform(axes, lambda a: (variance / rank) ** 0.5 * S.normal(F.lit(seed), F.col("ds"), F.col("taxon"), a)).alias("r"))


def gram(factors: DataFrame, rank: int) -> DataFrame:
    """``ds, gram, lower``: R'R from grouped sums, and its Cholesky factor."""
    at = lambda a: F.get("r", F.lit(a))
    sums = factors.groupBy("ds").agg(*[F.sum(at(a) * at(b)).alias(f"g{a}_{b}") for a in range(rank) for b in range(a, rank)])
    whole = F.array(*[F.array(*[F.col(f"g{min(a, b)}_{max(a, b)}") for b in range(rank)]) for a in range(rank)])
    return sums.select("ds", whole.alias("gram")).withColumn("lower", M.cholesky(F.col("gram"), rank))


def noise(points: DataFrame, rank: int, samples: int, seed: int = 1) -> DataFrame:
    """``ds, sample, z``: standard numbers of each draw, those of a dimension side by side; draws 2h and 2h + 1 mirror each other."""
    sized = points.groupBy("ds").agg(F.max(F.size("x")).alias("d")).where("d > 0")
    number = lambda p: S.normal(F.lit(seed), F.col("ds"), F.col("h"), F.floor(p / rank), p % rank)
    half = sized.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(samples // 2 - 1)))).withColumn("z", F.transform(F.sequence(F.lit(0), F.col("d") * rank - 1), number))
    return half.select("ds", "z", F.col("h"), F.explode(F.array(F.lit(0), F.lit(1))).alias("side")).select("ds", (2 * F.col("h") + F.col("side")).cast("long").alias("sample"), F.transform("z", lambda v: v * (1 - 2 * F.col("side"))).alias("z"))


def _of(z: Column, dim: Column, rank: int) -> Column:
    return F.slice(z, dim * rank + 1, F.lit(rank))


def draws(points: DataFrame, factors: DataFrame, numbers: DataFrame, rank: int) -> DataFrame:
    """``ds, sample, taxon, x``: the points moved by R z in every dimension."""
    near = points.join(factors.select("ds", "taxon", "r"), ["ds", "taxon"]).join(numbers, "ds")
    return near.select("ds", "sample", "taxon", F.transform("x", lambda v, dim: v + S.dot(F.col("r"), _of(F.col("z"), dim, rank))).alias("x"))


def coordinates(drawn: DataFrame, points: DataFrame, factors: DataFrame, rank: int) -> DataFrame:
    """``ds, sample, dim, a, lower``: least-squares coordinates of ``drawn(ds, sample, taxon, x)`` on the factor's columns, dimension by dimension."""
    off = drawn.join(points.select("ds", "taxon", F.col("x").alias("m")), ["ds", "taxon"]).join(factors.select("ds", "taxon", "r"), ["ds", "taxon"])
    each = off.select("ds", "sample", "r", F.posexplode(F.zip_with("x", "m", lambda v, m: v - m)).alias("dim", "v"))
    sums = each.groupBy("ds", "sample", "dim").agg(F.array(*[F.sum(F.get("r", F.lit(a)) * F.col("v")) for a in range(rank)]).alias("b"))
    known = sums.join(gram(factors, rank), "ds")
    return known.select("ds", "sample", "dim", "lower", M.backward(F.col("lower"), M.forward(F.col("lower"), F.col("b"), rank), rank).alias("a"))


def log_density(drawn: DataFrame, points: DataFrame, factors: DataFrame, rank: int) -> DataFrame:
    """``ds, sample, log_density, embedded``, summed over dimensions.

    ``log_density`` is that of R z with standard z on the space of R's columns.
    ``embedded`` takes the coordinates as normal with covariance R'R, the
    convention of the embedded distribution.
    """
    at = coordinates(drawn, points, factors, rank)
    base = -0.5 * rank * math.log(2.0 * math.pi) - 0.5 * M.log_det(F.col("lower"))
    back = M.forward(F.col("lower"), F.col("a"), rank)
    each = at.withColumn("y", back).select("ds", "sample", (base - 0.5 * S.dot(F.col("a"), F.col("a"))).alias("l"), (base - 0.5 * S.dot(F.col("y"), F.col("y"))).alias("e"))
    return each.groupBy("ds", "sample").agg(F.sum("l").alias("log_density"), F.sum("e").alias("embedded"))


def forms(points: DataFrame, factors: DataFrame, rank: int) -> DataFrame:
    """``ds, trace, mean_square, log_det, divergence`` of the distribution over all dimensions; divergence is that from the standard normal distribution, in as many numbers as points have."""
    sums = points.groupBy("ds").agg(F.sum(S.dot(F.col("x"), F.col("x"))).alias("mean_square"), F.max(F.size("x")).alias("d"), F.sum(F.size("x")).alias("full"))
    trace = S.total(F.transform("gram", lambda row, a: F.get(row, a)))
    found = sums.join(gram(factors, rank), "ds").select("ds", (F.col("d") * trace).alias("trace"), "mean_square", (F.col("d") * M.log_det(F.col("lower"))).alias("log_det"), "full")
    return found.select("ds", "trace", "mean_square", "log_det", (0.5 * (F.col("trace") + F.col("mean_square") - F.col("full") - F.col("log_det"))).alias("divergence"))


def divergence_slopes(points: DataFrame, factors: DataFrame, rank: int, entropy: bool = False) -> DataFrame:
    """``ds, taxon, slope``: slopes of the divergence in the rows of R, d (R - R (R'R)^-1); with ``entropy`` those of the distribution's entropy, d R (R'R)^-1."""
    d = points.groupBy("ds").agg(F.max(F.size("x")).alias("d"))
    near = factors.join(gram(factors, rank), "ds").join(d, "ds")
    pull = M.backward(F.col("lower"), M.forward(F.col("lower"), F.col("r"), rank), rank)
    slope = F.transform("p", lambda p: F.col("d") * p) if entropy else F.zip_with("r", "p", lambda r, p: F.col("d") * (r - p))
    return near.withColumn("p", pull).select("ds", "taxon", slope.alias("slope"))


def factor_slopes(gradients: DataFrame, numbers: DataFrame, rank: int) -> DataFrame:
    """``ds, taxon, slope``: the mean over draws of the slopes in the rows of R, from ``gradients(ds, sample, taxon, g)`` in the drawn points: a row's slope is the sum over dimensions of g z."""
    near = gradients.join(numbers, ["ds", "sample"])
    axis = lambda a: S.total(F.transform("g", lambda v, dim: v * F.get("z", dim * rank + a)))
    return near.groupBy("ds", "taxon").agg(F.array(*[F.avg(axis(a)) for a in range(rank)]).alias("slope"))
