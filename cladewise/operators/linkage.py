"""Average linkage by joins and grouped minima over all data sets at once, however many taxa one has.

Average linkage is reducible: joining two clusters that are nearest to each
other brings no cluster nearer to a third than the nearer of both was. So all
pairs of mutual nearest neighbours may join in one round, and the tree is that
of joining the closest pair again and again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.operators import trees as T
from cladewise.sources.shared import by_shuffle, stored


def _name(least: str, n: str) -> Column:
    """A cluster's name: clusters with the same least taxon lie within each other, so least taxon and size tell them apart."""
    return F.when(F.col(n) == 1, F.concat(F.lit("t"), F.col(least).cast("string"))).otherwise(F.concat_ws("_", F.concat(F.lit("u"), F.col(least).cast("string")), F.col(n).cast("string")))


def merges(distances: DataFrame, decimals: int = 9) -> DataFrame:
    """Joins of the average-linkage tree of each data set: ``ds, node, left, right, left_n, right_n, height``.

    A round keeps the sum of distances between each two clusters; the mean is
    that over both sizes, the height of a join half of it. Of equal means (to
    so many decimals) the pair with the smaller numbers is nearer, a cluster's number being that of its least taxon.
    """
    keys = ["ds", "a", "b"]
    now = stored(distances.select("ds", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), F.col("d").alias("total"), F.lit(1).cast("long").alias("na"), F.lit(1).cast("long").alias("nb"), F.lit(False).alias("joined")))
    tables, left = [], now
    while not left.isEmpty():
        mean = F.round(F.col("total") / (F.col("na") * F.col("nb")), decimals)
        ends = left.select("ds", F.explode(F.array("a", "b")).alias("c"), F.struct(mean.alias("m"), "a", "b").alias("s"))
        nearest = ends.groupBy("ds", "c").agg(F.min("s").alias("s"))
        mutual = nearest.groupBy("ds", "s.a", "s.b").agg(F.count(F.lit(1)).alias("sides")).where("sides = 2").select(keys)
        found = left.drop("joined").join(by_shuffle(mutual), keys)
        part = F.explode(F.array(*[F.struct(F.col(c).alias("old"), F.col("a").alias("new"), (F.col("na") + F.col("nb")).alias("n")) for c in "ab"])).alias("p")
        renamed = found.select("ds", part).select("ds", "p.*")
        moved = left
        for c in "ab":
            moved = moved.join(by_shuffle(renamed.select("ds", F.col("old").alias(c), F.col("new").alias(f"new_{c}"), F.col("n").alias(f"n_{c}"))), ["ds", c], "left")
        moved = moved.select("ds", *[F.struct(F.coalesce(f"new_{c}", c).alias("c"), F.coalesce(f"n_{c}", f"n{c}").alias("n")).alias(c) for c in "ab"], "total").where("a.c <> b.c")
        moved = moved.withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b")).groupBy("ds", "lo", "hi").agg(F.sum("total").alias("total"))
        rest = moved.select("ds", F.col("lo.c").alias("a"), F.col("hi.c").alias("b"), "total", F.col("lo.n").alias("na"), F.col("hi.n").alias("nb"), F.lit(False).alias("joined"))
        now = stored(found.withColumn("joined", F.lit(True)).unionByName(rest))
        tables.append(now.where("joined").drop("joined"))
        left = now.where("NOT joined")
    out = stored(reduce(DataFrame.unionByName, tables, now.where("joined").drop("joined").where("false")))
    whole = out.withColumn("n", F.col("na") + F.col("nb"))
    return whole.select("ds", _name("a", "n").alias("node"), _name("a", "na").alias("left"), _name("b", "nb").alias("right"), F.col("na").alias("left_n"), F.col("nb").alias("right_n"), (F.col("total") / (2 * F.col("na") * F.col("nb"))).alias("height"))


def edges(joins: DataFrame) -> DataFrame:
    """``ds, node, parent, length`` of the trees of :func:`merges`; a length is what the parent's height has over the node's, nothing below zero."""
    child = joins.select("ds", F.col("node").alias("parent"), "height", F.explode(F.array("left", "right")).alias("node"))
    own = joins.select("ds", "node", F.col("height").alias("own"))
    inner = child.join(by_shuffle(own), ["ds", "node"], "left").select("ds", "node", "parent", F.greatest(F.lit(0.0), F.col("height") - F.coalesce("own", F.lit(0.0))).alias("length"))
    root = joins.select("ds", "node").join(by_shuffle(child.select("ds", "node")), ["ds", "node"], "left_anti")
    return inner.unionByName(root.select("ds", "node", F.lit(None).cast("string").alias("parent"), F.lit(0.0).alias("length")))


def distance_slopes(joins: DataFrame, length_slopes: DataFrame | None = None) -> DataFrame:
    """Slopes in the distances from ``length_slopes(ds, node, g)`` in the lengths of the nodes' edges: ``ds, i, j, slope`` with taxa as names, i < j.

    A node's height is half the mean of the distances over the pairs that it
    joins; its slope is the sum of its edges' below less that above, where these
    have a length. Each pair meets at one node, over two of its children, and
    has the share 1 / (2 left_n right_n) of that node's. Without ``length_slopes``: of the whole tree's length.
    """
    tree = stored(edges(joins))
    g = tree.where("parent IS NOT NULL").join(by_shuffle(length_slopes), ["ds", "node"]) if length_slopes is not None else tree.where("parent IS NOT NULL").withColumn("g", F.lit(1.0))
    held = g.where("length > 0")
    each = held.select("ds", F.col("parent").alias("node"), "g").unionByName(held.select("ds", "node", (-F.col("g")).alias("g")))
    by_node = each.groupBy("ds", "node").agg(F.sum("g").alias("g"))
    share = joins.join(by_shuffle(by_node), ["ds", "node"]).select("ds", "left", "right", (F.col("g") / (2 * F.col("left_n") * F.col("right_n"))).alias("slope"))
    named = tree.withColumnRenamed("ds", "tree")
    below = T.ancestors(named, T.leaves(named).select("tree", "node")).select(F.col("tree").alias("ds"), F.col("anc").alias("clade"), F.col("node").alias("leaf"))
    one = share.join(by_shuffle(below.select("ds", F.col("clade").alias("left"), F.col("leaf").alias("a"))), ["ds", "left"])
    two = one.join(by_shuffle(below.select("ds", F.col("clade").alias("right"), F.col("leaf").alias("b"))), ["ds", "right"])
    return two.select("ds", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "slope")
