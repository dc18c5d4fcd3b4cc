"""Connected components by contraction.

Each round every node hooks to its smallest neighbour, hooks are followed to
their roots by pointer doubling, and the edges are rewritten between roots. At
least half of the remaining nodes go in each round. All steps are joins and
partially aggregated groupings, and each is stored, so a node with very many
edges never has to meet them in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewise.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """Map each node of ``edges(a long, b long)`` to the smallest node of its component: ``(node, root)``.

    Loops, repeated edges and either direction are allowed; an empty input gives an empty result.
    """
    left = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found: DataFrame | None = None
    while not left.isEmpty():
        hooks = left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        hooks = materialise(hooks)
        while True:  # follow hooks to their ends
            nxt = hooks.select(F.col("node").alias("root"), F.col("root").alias("further"))
            jumped = materialise(hooks.join(nxt, "root", "left").select("node", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
            hooks = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        if found is None:
            found = hooks
        else:
            nxt = hooks.select(F.col("node").alias("root"), F.col("root").alias("further"))
            found = materialise(found.join(nxt, "root", "left").select("node", F.coalesce("further", "root").alias("root")).unionByName(hooks))
        step = left
        for end in ("a", "b"):
            step = step.join(hooks.select(F.col("node").alias(end), F.col("root").alias("r")), end, "left").withColumn(end, F.coalesce("r", end)).drop("r")
        left = materialise(step.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).where("false")
    roots = found.select(F.col("root").alias("node"), "root").distinct()
    return found.unionByName(roots)
