"""Lineage-barcode tables ``mutations(ds, cell, site, state)``: dictionaries, rates, transition probabilities.

State -1 is silent, 0 unedited, above 0 an edit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladewise.operators import trees as T


def renumber(mutations: DataFrame, by_site: bool = False) -> DataFrame:
    """Give edits numbers from 1 in the order of their first cell and site, within a data set or within each site of it; silent and unedited stay."""
    keys = ["ds", "site"] if by_site else ["ds"]
    first = mutations.where("state > 0").groupBy(*keys, "state").agg(F.min(F.struct("cell", "site")).alias("at"))
    number = first.select(*keys, "state", F.row_number().over(Window.partitionBy(*keys).orderBy("at")).alias("number"))
    return mutations.join(number, [*keys, "state"], "left").select("ds", "cell", "site", F.coalesce("number", "state").alias("state"))


def mutation_rates(mutations: DataFrame, by_site: bool = False) -> DataFrame:
    """Share of each edit among all edits of a data set (or site), and the uniform share."""
    keys = ["ds", "site"] if by_site else ["ds"]
    counts = mutations.where("state > 0").groupBy(*keys, "state").agg(F.count(F.lit(1)).alias("n"))
    each = Window.partitionBy(*keys)
    return counts.select(*keys, "state", "n", (F.col("n") / F.sum("n").over(each)).alias("empirical"), (1.0 / F.count(F.lit(1)).over(each)).alias("uniform"))


def table_agreement(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one of two tables has, and which."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("missing_in", F.lit("right")).unionByName(b.join(a, key, "left_anti").withColumn("missing_in", F.lit("left")))


def _grid(branches: DataFrame, edits: int) -> DataFrame:
    """Each branch with every pair of states 0 to edits, and edits + 1 for silent."""
    states = F.sequence(F.lit(0), F.lit(edits + 1))
    return branches.withColumn("a", F.explode(states)).withColumn("b", F.explode(states))


def _by_kind(edits: int, stay0: Column, edit: Column, stay: Column, silence: Column, silent: float) -> Column:
    a, b, s = F.col("a"), F.col("b"), edits + 1
    return (
        F.when((a == s) & (b == s), F.lit(silent)).when(a == s, 0.0).when(b == s, silence)
        .when((a == 0) & (b == 0), stay0).when(a == 0, edit).when(a == b, stay).otherwise(0.0)
    )


def transition(branches: DataFrame, edits: int = 3, nu: float = 0.4) -> DataFrame:
    """Transition probabilities over a branch of length ``t`` with equal edit rates, silencing rate ``nu``, and their slopes: ``a, b, p, dp_dt, dp_dnu``.

    Edits do not revert, any state can fall silent, silence stays.
    """
    t, q = F.col("t"), 1.0 / edits
    alive, unedited = F.exp(-nu * t), F.exp(-t)
    edited = -F.expm1(-t)
    grid = _grid(branches, edits)
    return grid.select(
        "*",
        _by_kind(edits, alive * unedited, q * alive * edited, alive, -F.expm1(-nu * t), 1.0).alias("p"),
        _by_kind(edits, -(1 + nu) * alive * unedited, q * alive * (unedited - nu * edited), -nu * alive, nu * alive, 0.0).alias("dp_dt"),
        _by_kind(edits, -t * alive * unedited, -t * q * alive * edited, -t * alive, t * alive, 0.0).alias("dp_dnu"),
    )


def allowed_states(trees: DataFrame, cells: DataFrame) -> DataFrame:
    """What the leaves below leave to each inner node at each site: ``tree, node, site, allowed`` from ``cells(tree, node, site, state)``.

    0 where it must be unedited, an edit where it has that or none, -1 where any
    state is possible. An unedited leaf asks for 0, an edited one for its edit
    or none, a silent one for nothing; two edits leave 0. These claims only
    grow stronger upwards, in whatever order they meet, so that one grouped
    minimum and maximum over the closure of ancestors gives them for every node.
    """
    below = T.ancestors(trees, cells.select("tree", "node").distinct()).where("steps > 0").select("tree", "node", "anc")
    met = below.join(cells, ["tree", "node"]).groupBy("tree", F.col("anc").alias("node"), "site")
    seen = F.when(F.col("state") >= 0, F.col("state"))
    found = met.agg(F.min(seen).alias("low"), F.max(seen).alias("high"))
    return found.select("tree", "node", "site", F.when(F.col("low").isNull(), -1).when(F.col("low") == F.col("high"), F.col("low")).otherwise(0).cast("int").alias("allowed"))
