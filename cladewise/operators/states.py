"""States on trees: likelihood and draws by joins and groupings, one level of all trees at a time.

A node's row holds an array of log probabilities, one for each state of a small
alphabet. Children's messages are summed by partial aggregates, so neither a
tree nor a node with very many children has to fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.functions import scalars as S
from cladewise.sources.shared import by_shuffle, stored

LEAST, MOST_STATES = 1e-6, 64


def alphabet_of(states: DataFrame) -> list[str]:
    found = [r["state"] for r in states.select("state").where("state IS NOT NULL").distinct().orderBy("state").limit(MOST_STATES + 1).collect()]
    if len(found) > MOST_STATES:
        raise ValueError(f"more than {MOST_STATES} states")
    return found


def levels(trees: DataFrame) -> list[DataFrame]:
    """Nodes by distance from the root: the columns of ``trees``, a table for each level. Only what hangs on a root is reached, so this ends; it ends at once where no edge is left."""
    nodes = stored(trees)  # once, so that no level derives the trees again
    edge = nodes.where("parent IS NOT NULL")
    out, left = [nodes.where("parent IS NULL")], edge.count()
    while left:
        above = out[-1].select("tree", F.col("node").alias("parent"))
        now = stored(edge.join(by_shuffle(above), ["tree", "parent"]).select(*nodes.columns))
        found = now.count()
        if not found:
            break
        out.append(now)
        left -= found
    return out


def stay_and_move(length: Column, k: int) -> tuple[Column, Column]:
    """Probabilities of the same state and of each other one, for k states of equal rates, one change a unit of time expected."""
    same = F.exp(-F.greatest(length, F.lit(LEAST)) * k / max(1, k - 1))
    return (1 - same) / k + same, (1 - same) / k


def stay_and_move_slopes(length: Column, k: int) -> tuple[Column, Column]:
    """Slopes of both probabilities in the length."""
    e = F.exp(-F.greatest(length, F.lit(LEAST)) * k / max(1, k - 1))
    return -e, e / max(1, k - 1)


def inside(trees: DataFrame, leaf_states: DataFrame) -> tuple[list[DataFrame], list[str]]:
    """``tree, node, parent, length, inside`` (log probability of the leaves below, by the node's state), a table for each level, and the alphabet."""
    names = alphabet_of(leaf_states)
    k = len(names)
    known = leaf_states.select("tree", "node", F.array(*[F.when(F.col("state") == s, 0.0).otherwise(float("-inf")) for s in names]).alias("own"))
    by_level = levels(trees.select("tree", "node", "parent", "length").join(by_shuffle(known), ["tree", "node"], "left"))
    out: list[DataFrame] = []
    sums: DataFrame | None = None
    for here in reversed(by_level):
        if sums is not None:
            here = here.join(by_shuffle(sums), ["tree", "node"], "left")
            here = here.withColumn("inside", F.coalesce("own", "below"))
        else:
            here = here.withColumnRenamed("own", "inside")
        here = stored(here.withColumn("inside", F.coalesce("inside", F.array_repeat(F.lit(0.0), k))).select("tree", "node", "parent", "length", "inside"))
        out.append(here)
        stay, move = stay_and_move(F.col("length"), k)
        top = F.array_max("inside")
        total = S.total(F.transform("inside", lambda v: F.exp(v - F.col("top"))))
        sent = here.withColumn("top", top).withColumn("total", total).withColumn("stay", stay).withColumn("move", move)
        message = F.transform("inside", lambda v: F.col("top") + F.log(F.col("move") * F.col("total") + (F.col("stay") - F.col("move")) * F.exp(v - F.col("top"))))
        each = sent.where("parent IS NOT NULL").withColumn("m", message).groupBy("tree", F.col("parent").alias("node"))
        sums = each.agg(*[F.sum(F.col("m")[a]).alias(f"m{a}") for a in range(k)]).select("tree", "node", F.array(*[f"m{a}" for a in range(k)]).alias("below"))
    return out[::-1], names


def likelihood(trees: DataFrame, leaf_states: DataFrame) -> DataFrame:
    """``tree, leaves, log_likelihood`` of leaf states on their trees, with equal rates and equal frequencies at the root."""
    tables, names = inside(trees, leaf_states)
    n = leaf_states.groupBy("tree").agg(F.count(F.lit(1)).cast("int").alias("leaves"))
    top = F.array_max("inside")
    value = F.col("top") + F.log(S.total(F.transform("inside", lambda v: F.exp(v - F.col("top")))) / max(1, len(names)))
    return tables[0].withColumn("top", top).select("tree", value.alias("log_likelihood")).join(n, "tree").select("tree", "leaves", "log_likelihood")


def draw(trees: DataFrame, leaf_states: DataFrame, seed: int = 1) -> DataFrame:
    """Draw the states of all nodes from their joint posterior given those of the leaves: ``tree, node, state``. A node's draw depends on seed, tree and node only."""
    tables, names = inside(trees, leaf_states)
    k, given, out = len(names), None, None
    u = S.uniform(F.lit(seed), F.col("tree"), F.col("node"))
    for here in tables:
        if given is None:
            weights = F.transform("inside", lambda v: F.exp(v - F.array_max("inside")))
            here = here.withColumn("w", weights)
        else:
            stay, move = stay_and_move(F.col("length"), k)
            here = here.join(by_shuffle(given), ["tree", "parent"]).withColumn("stay", stay).withColumn("move", move)
            weights = F.transform("inside", lambda v, i: F.when(i == F.col("from"), F.col("stay")).otherwise(F.col("move")) * F.exp(v - F.array_max("inside")))
            here = here.withColumn("w", weights)
        run = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: S.total(F.slice("w", 1, i)))
        here = here.withColumn("run", run).withColumn("u", u * S.total(F.col("w")))
        at = F.least(F.lit(k - 1), F.size(F.filter("run", lambda c: c < F.col("u"))))
        now = stored(here.select("tree", "node", at.alias("at")))
        given = now.select("tree", F.col("node").alias("parent"), F.col("at").alias("from"))
        out = now if out is None else out.unionByName(now)
    return out.select("tree", "node", F.element_at(F.array(*[F.lit(s) for s in names]), F.col("at") + 1).alias("state"))


def marginals(trees: DataFrame, leaf_states: DataFrame) -> tuple[DataFrame, list[str]]:
    """``tree, node, shares, slope``: the posterior of each node's state, and the slope of the log likelihood in its branch (null at the root).

    A parent's shares q pass down: with m(a) the child's message and l its
    inside values, the slope is the mean of m'(a) / m(a) under q.
    """
    tables, names = inside(trees, leaf_states)
    k, above, out = len(names), None, None
    likely = F.transform("inside", lambda v: F.exp(v - F.array_max("inside")))
    for here in tables:
        here = here.withColumn("l", likely).withColumn("total", S.total(F.col("l")))
        if above is None:
            here = here.withColumn("shares", F.transform("l", lambda v: v / F.col("total"))).withColumn("slope", F.lit(None).cast("double"))
        else:
            stay, move = stay_and_move(F.col("length"), k)
            d_stay, d_move = stay_and_move_slopes(F.col("length"), k)
            here = here.join(by_shuffle(above), ["tree", "parent"]).withColumns({"move": move, "more": stay - move, "d_move": d_move, "d_more": d_stay - d_move})
            here = here.withColumn("m", F.transform("l", lambda v: F.col("move") * F.col("total") + F.col("more") * v))
            here = here.withColumn("q", F.zip_with("q", "m", lambda q, m: q / m)).withColumn("q_sum", S.total(F.col("q")))
            here = here.withColumn("slope", F.col("d_move") * F.col("total") * F.col("q_sum") + F.col("d_more") * S.dot(F.col("q"), F.col("l")))
            here = here.withColumn("shares", F.zip_with("l", "q", lambda v, q: v * (F.col("more") * q + F.col("move") * F.col("q_sum"))))
        now = stored(here.select("tree", "node", "shares", "slope"))
        above = now.select("tree", F.col("node").alias("parent"), F.col("shares").alias("q"))
        out = now if out is None else out.unionByName(now)
    return out, names
