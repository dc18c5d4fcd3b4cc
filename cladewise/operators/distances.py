"""Pair distances and what follows from them.

Taxa come in data sets. A pair join is an equality join on the data set, so its
size follows the sizes of the data sets and not the square of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewise.functions import scalars as S


def pairs(taxa: DataFrame, group: str, taxon: str, *carry: str) -> DataFrame:
    """All pairs i < j of taxa of a group: ``group, i, j`` and each carried column twice, as ``name_i`` and ``name_j``."""
    a = taxa.select(group, F.col(taxon).alias("i"), *[F.col(c).alias(f"{c}_i") for c in carry])
    b = taxa.select(group, F.col(taxon).alias("j"), *[F.col(c).alias(f"{c}_j") for c in carry])
    return a.join(b, group).where("i < j")


def euclidean(points: DataFrame, scale: float = 1.0, carry: bool = False) -> DataFrame:
    """``ds, i, j, d``; with ``carry`` also both points, ``x_i`` and ``x_j``."""
    d = F.sqrt(S.total(F.zip_with("x_i", "x_j", lambda a, b: (a - b) * (a - b)))) / scale
    return pairs(points, "ds", "taxon", "x").select("ds", "i", "j", d.alias("d"), *["x_i", "x_j"] * carry)


def hyperbolic(points: DataFrame, curvature: float = 1.0, scale: float = 1.0) -> DataFrame:
    """Distances on the hyperboloid whose points have these spatial coordinates."""
    lifted = points.withColumn("x0", F.sqrt(1.0 + S.dot(F.col("x"), F.col("x"))))
    u = F.col("x0_i") * F.col("x0_j") - S.dot(F.col("x_i"), F.col("x_j"))
    return pairs(lifted, "ds", "taxon", "x", "x0").select("ds", "i", "j", (S.acosh_stable(u) / (curvature**0.5 * scale)).alias("d"))


def site_counts(sequences: DataFrame) -> DataFrame:
    """``ds, i, j, compared, differ`` from ``sequences(ds, taxon, codes array<int>)``; a negative code is missing, and a site counts where neither is."""
    # both counts in one number, 32 bits each: an array has fewer elements
    one, two = F.lit(1).cast("long"), F.lit((1 << 32) + 1)
    both = F.zip_with("codes_i", "codes_j", lambda a, b: F.when((a >= 0) & (b >= 0), F.when(a == b, one).otherwise(two)).otherwise(F.lit(0).cast("long")))
    packed = F.aggregate(both, F.lit(0).cast("long"), lambda acc, v: acc + v)
    counted = pairs(sequences, "ds", "taxon", "codes").select("ds", "i", "j", packed.alias("c"))
    return counted.select("ds", "i", "j", F.col("c").bitwiseAND(F.lit((1 << 32) - 1)).alias("compared"), F.shiftright("c", 32).alias("differ"))


def jukes_cantor(sequences: DataFrame) -> DataFrame:
    return site_counts(sequences).select("ds", "i", "j", S.jukes_cantor(F.col("differ"), F.col("compared")).alias("d"))


def poisson(mutations: DataFrame) -> DataFrame:
    return site_counts(mutations).select("ds", "i", "j", S.poisson(F.col("differ"), F.col("compared")).alias("d"))


def validate(distances: DataFrame) -> DataFrame:
    """Per data set: pairs, those that are null, not finite or negative, and whether the triangle of pairs is complete."""
    d = F.col("d")
    bad = d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")) | (d < 0)
    taxa = distances.select("ds", F.explode(F.array("i", "j")).alias("t")).distinct().groupBy("ds").agg(F.count(F.lit(1)).alias("n"))
    seen = distances.groupBy("ds").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(bad).alias("bad"))
    return seen.join(taxa, "ds").select("ds", "n", "pairs", "bad", (F.col("pairs") == (F.col("n") * (F.col("n") - 1) / 2).cast("long")).alias("complete"))


def point_scale(distances: DataFrame, curvature: float = 0.0) -> DataFrame:
    """Factor that brings the median distance to a set place: 25 in Euclidean space, 4 over the root of the curvature in hyperbolic; 1 where the median is no use."""
    goal = 4.0 / curvature**0.5 if curvature else 25.0
    m = distances.groupBy("ds").agg(F.percentile("d", 0.5).alias("median"))
    return m.select("ds", "median", F.when((F.col("median") > 0) & (F.col("median") < float("inf")), goal / F.col("median")).otherwise(1.0).alias("scale"))


def diameter(distances: DataFrame) -> DataFrame:
    """The farthest pair of each data set; of equals the first."""
    best = F.min(F.struct((-F.col("d")).alias("d"), "i", "j"))
    return distances.groupBy("ds").agg(best.alias("b")).select("ds", "b.i", "b.j", (-F.col("b.d")).alias("d"))


def ends(distances: DataFrame) -> DataFrame:
    """Each pair from both ends: ``ds, i, j, d``."""
    return distances.select("ds", F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("e"), "d").select("ds", "e.i", "e.j", "d")


def row_sums(distances: DataFrame) -> DataFrame:
    return ends(distances).groupBy("ds", "i").agg(F.sum("d").alias("s"), (F.count(F.lit(1)) + 1).alias("n"))


def first_join(distances: DataFrame, decimals: int = 9) -> DataFrame:
    """The pair that neighbour joining joins first: least (n - 2) d - s_i - s_j, of equals (to so many decimals) the first pair."""
    s = row_sums(distances)
    a = s.select("ds", "i", F.col("s").alias("s_i"), "n")
    b = s.select("ds", F.col("i").alias("j"), F.col("s").alias("s_j"))
    q = distances.join(a, ["ds", "i"]).join(b, ["ds", "j"]).withColumn("q", (F.col("n") - 2) * F.col("d") - F.col("s_i") - F.col("s_j"))
    least = F.min_by(F.struct("i", "j", "d", "s_i", "s_j", "n", "q"), F.struct(F.round("q", decimals), "i", "j"))
    return q.groupBy("ds").agg(least.alias("m")).select("ds", "m.*")


def first_update(distances: DataFrame) -> DataFrame:
    """Branch lengths of the first join and the distances of all other taxa to the new node: ``ds, u, v, len_u, len_v, k, d``."""
    m = first_join(distances).where("n > 2")
    to_u = 0.5 * F.col("d") + (F.col("s_i") - F.col("s_j")) / (2.0 * (F.col("n") - 2))
    m = m.select("ds", F.col("i").alias("u"), F.col("j").alias("v"), F.col("d").alias("d_uv"), to_u.alias("raw"))
    # the second length is taken before the first is cut off at zero
    m = m.withColumn("len_v", F.greatest(F.lit(0.0), F.col("d_uv") - F.col("raw"))).withColumn("len_u", F.greatest(F.lit(0.0), F.col("raw")))
    e = ends(distances)
    near = m.join(e, "ds").where("(i = u OR i = v) AND j <> u AND j <> v")
    joined = near.groupBy("ds", "u", "v", "len_u", "len_v", "d_uv", F.col("j").alias("k")).agg(F.sum("d").alias("both"))
    return joined.select("ds", "u", "v", "len_u", "len_v", "k", F.greatest(F.lit(0.0), 0.5 * (F.col("both") - F.col("d_uv"))).alias("d"))


def closest_pair(distances: DataFrame) -> DataFrame:
    """The pair that UPGMA joins first, and the height of its node."""
    least = F.min(F.struct("d", "i", "j"))
    return distances.groupBy("ds").agg(least.alias("m")).select("ds", "m.i", "m.j", (F.col("m.d") / 2).alias("height"))


def double_centre(distances: DataFrame) -> DataFrame:
    """Gram matrix of classical scaling, i <= j: minus half of squared distances without row, column and whole means."""
    square = ends(distances).withColumn("d2", F.col("d") * F.col("d"))
    rows = square.groupBy("ds", "i").agg((F.sum("d2") / (F.count(F.lit(1)) + 1)).alias("m"))
    whole = rows.groupBy("ds").agg(F.avg("m").alias("g"))
    rows = rows.join(whole, "ds")
    a, b = rows.select("ds", "i", F.col("m").alias("m_i"), "g"), rows.select("ds", F.col("i").alias("j"), F.col("m").alias("m_j"))
    off = distances.join(a, ["ds", "i"]).join(b, ["ds", "j"]).select("ds", "i", "j", (-0.5 * (F.col("d") * F.col("d") - F.col("m_i") - F.col("m_j") + F.col("g"))).alias("b"))
    own = rows.select("ds", "i", F.col("i").alias("j"), (-0.5 * (F.col("g") - 2 * F.col("m"))).alias("b"))
    return off.unionByName(own)


def summarise(distances: DataFrame, keys: list[str]) -> DataFrame:
    """Distribution of a distance over samples; values that are not finite are left out."""
    d = F.col("d")
    usable = distances.where(d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf")))
    quantile = lambda q, name: F.percentile("d", q).alias(name)
    return usable.groupBy(*keys).agg(
        F.avg("d").alias("mean"), F.stddev_samp("d").alias("std"), quantile(0.5, "med"), F.min("d").alias("min"), F.max("d").alias("max"),
        quantile(0.025, "low95"), quantile(0.975, "high95"), quantile(0.25, "low50"), quantile(0.75, "high50"),
    )

