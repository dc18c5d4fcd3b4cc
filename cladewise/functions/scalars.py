"""Scalar formulas as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SATURATED = 3.0  # largest corrected distance


def total(array: Column) -> Column:
    """Sum of an array of doubles in order."""
    return F.aggregate(array, F.lit(0.0), lambda acc, v: acc + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def acosh_stable(u: Column) -> Column:
    """Inverse hyperbolic cosine by that of the sine of half of it, which needs no cases near 1 or far from it."""
    half = F.sqrt((F.greatest(u, F.lit(1.0)) - 1.0) / 2.0)
    return 2.0 * F.log1p(half + half * half / (1.0 + F.sqrt(1.0 + half * half)))


def acosh_slope(u: Column) -> Column:
    """Derivative of :func:`acosh_stable`, finite at 1."""
    e = F.greatest(F.greatest(u, F.lit(1.0)) - 1.0, F.lit(1e-18))
    return 1.0 / F.sqrt(e * (e + 2.0))


def jukes_cantor(differ: Column, compared: Column) -> Column:
    """Distance from counts of differing and compared sites; saturated at three quarters, null when nothing was compared."""
    p = F.try_divide(differ.cast("double"), compared.cast("double"))
    return F.when(p >= 0.75, F.lit(SATURATED)).otherwise(-0.75 * F.log(1.0 - 4.0 * p / 3.0))


def poisson(differ: Column, compared: Column) -> Column:
    """Distance from counts of differing and compared sites; capped, also when nothing was compared."""
    return F.when((compared == 0) | (differ >= compared), F.lit(SATURATED)).otherwise(F.least(F.lit(SATURATED), -F.log(1.0 - F.try_divide(differ.cast("double"), compared.cast("double")))))


def huber(z: Column, kappa: float = 0.5) -> Column:
    size = F.abs(z)
    return F.when(size <= kappa, 0.5 * z * z).otherwise(kappa * (size - 0.5 * kappa))


def huber_slope(z: Column, kappa: float = 0.5) -> Column:
    return F.when(F.abs(z) <= kappa, z).otherwise(kappa * F.signum(z))


def softplus(x: Column, beta: float = 1.0) -> Column:
    """Smooth positive part; the exponent is held within 60."""
    return F.log1p(F.exp(F.least(F.lit(60.0), F.greatest(F.lit(-60.0), beta * x)))) / beta


def pair_index(i: Column, j: Column, n: Column) -> Column:
    """Place of the pair i < j among all pairs of n items in order."""
    return (i * (2 * n - i - 1) / 2).cast("long") + (j - i - 1)


def radial_flow(x: Column, alpha: float, beta: float, radius: float) -> tuple[Column, Column]:
    """Image of ``x`` under a radial flow about the origin, and the log of the determinant's size."""
    r = F.sqrt(dot(x, x))
    h = 1.0 / (alpha + r / radius)
    slope = -(h * h) / radius
    image = F.transform(x, lambda v: v + beta * h * v)
    log_det = (F.size(x) - 1) * F.log(1.0 + beta * h) + F.log(1.0 + beta * h + beta * slope * r)
    return image, log_det


def planar_flow(x: Column, u: Callable[[Column], Column], w: Callable[[Column], Column], b: float) -> tuple[Column, Column]:
    """Image of ``x`` under a planar flow, and the log of the determinant's size; ``u`` and ``w`` give a dimension's entries."""
    along = total(F.transform(x, lambda v, d: v * w(d))) + b
    t = F.tanh(along)
    image = F.transform(x, lambda v, d: v + u(d) * t)
    wu = total(F.transform(x, lambda v, d: w(d) * u(d)))
    return image, F.log(F.abs(1.0 + (1.0 - t * t) * wu))


def radial_flow_back(x: Column, g: Column, alpha: float, beta: float, radius: float, share: float = 1.0) -> tuple[Column, Column, Column]:
    """The way back through :func:`radial_flow`: slopes in ``x``, alpha and beta of what has the slopes ``g`` in the image, plus ``share`` times the log determinant."""
    r = F.sqrt(dot(x, x))
    h = 1.0 / (alpha + r / radius)
    h1, h2 = -(h * h) / radius, 2.0 * h * h * h / (radius * radius)
    near, far, others = 1.0 + beta * h, 1.0 + beta * h + beta * h1 * r, F.size(x) - 1
    along = dot(x, g)
    by_radius = beta * h1 * along + share * (others * beta * h1 / near + beta * (2.0 * h1 + h2 * r) / far)
    pull = F.when(r > 0, by_radius / r).otherwise(0.0)
    back = F.zip_with(x, g, lambda v, s: s * near + v * pull)
    by_alpha = -beta * h * h * along + share * (-others * beta * h * h / near + beta * (2.0 * h * h * h * r / radius - h * h) / far)
    by_beta = h * along + share * (others * h / near + (h + h1 * r) / far)
    return back, by_alpha, by_beta


def planar_flow_back(x: Column, g: Column, u: Column, w: Column, b: float, share: float = 1.0) -> tuple[Column, Column, Column, Column]:
    """The way back through :func:`planar_flow` with arrays ``u`` and ``w``: slopes in ``x``, u, w and b."""
    t = F.tanh(dot(x, w) + b)
    bend = 1.0 - t * t
    wu = dot(w, u)
    size = 1.0 + bend * wu
    by_along = bend * dot(g, u) - share * 2.0 * t * bend * wu / size
    back = F.zip_with(g, w, lambda s, v: s + v * by_along)
    by_u = F.zip_with(g, w, lambda s, v: s * t + share * bend * v / size)
    by_w = F.zip_with(x, u, lambda v, a: v * by_along + share * bend * a / size)
    return back, by_u, by_w, by_along


def diagonal_log_density(x: Column, mean: Column, variance: Column) -> Column:
    """Log density of a normal distribution with independent dimensions."""
    off = F.zip_with(x, mean, lambda a, m: (a - m) * (a - m))
    terms = F.zip_with(off, variance, lambda s, v: s / v + F.log(v) + math.log(2.0 * math.pi))
    return -0.5 * total(terms)


def uniform(*names: Column) -> Column:
    """Number between 0 and 1, exclusive, for a combination of names: 52 bits of their MD5, so that SQL can draw it too."""
    digits = F.conv(F.substring(F.md5(F.concat_ws(":", *[n.cast("string") for n in names])), 1, 13), 16, 10)
    return (digits.cast("double") + 0.5) / float(1 << 52)


def uniform_sql(*names: str) -> str:
    return f"((CAST('0x' || substr(md5(concat_ws(':', {', '.join(names)})), 1, 13) AS BIGINT) + 0.5) / {float(1 << 52)})"


def normal(*names: Column) -> Column:
    """Standard normal number for a combination of names."""
    return F.sqrt(-2.0 * F.log(uniform(F.lit(1), *names))) * F.cos(2.0 * math.pi * uniform(F.lit(2), *names))


def softplus_slope(x: Column, beta: float = 1.0) -> Column:
    return 1.0 / (1.0 + F.exp(-F.least(F.lit(60.0), F.greatest(F.lit(-60.0), beta * x))))


def softplus_inverse(y: Column, beta: float = 1.0) -> Column:
    """The x whose softplus is y; values below zero count as zero, whose inverse is held finite."""
    return F.log(F.greatest(F.expm1(beta * F.greatest(y, F.lit(0.0))), F.lit(1e-300))) / beta


def pair_of(place: Column, n: Column) -> tuple[Column, Column]:
    """Inverse of :func:`pair_index`: both items of the pair at a place, from the row where the triangle's tail begins."""
    left = n * (n - 1) / 2 - 1 - place  # pairs behind this one
    back = F.floor((F.sqrt(8 * left + 1) - 1) / 2)
    i = (n - 2 - back).cast("long")
    return i, (place - i * (2 * n - i - 1) / 2 + i + 1).cast("long")


def floored(p: Column, least: float = 1e-300) -> Column:
    """A probability whose logarithm is finite."""
    return p + F.lit(least)


def chi_square_quantile(q: float, freedom: int) -> float:
    """Inverse of the chi-square distribution function, by halving an interval."""
    low, high = 0.0, 1.0
    while chi_square(high, freedom) < q:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, freedom) < q else (low, middle)
    return (low + high) / 2


def chi_square(x: float, freedom: int) -> float:
    """Chi-square distribution function: the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, term = freedom / 2, 1.0
    total, k = 1.0, 1
    while term > 1e-17 * total:
        term *= (x / 2) / (a + k)
        total += term
        k += 1
    return min(1.0, math.exp(a * math.log(x / 2) - x / 2 - math.lgamma(a + 1)) * total)


def region(z2: Column, bounds: list[float]) -> Column:
    """Number of the shell that a squared distance falls into, given the shells' inner bounds after the first."""
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= z2)).cast("long")
