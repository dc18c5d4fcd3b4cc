"""Likelihoods of leaf states on trees and their slopes, level by level, for all trees and site patterns at once.

A row is a node and a pattern with an array over states. A level is one join
with the branches and one grouped sum of log messages, which starts before the
shuffle; so neither a tree nor an alignment has to fit one task, and a node may
have any number of children. The sweep down divides a parent's whole by the
child's own message, as a difference of logarithms.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.functions import matrices as M
from cladewise.functions import scalars as S
from cladewise.operators import trees as T
from cladewise.operators.ascent import draw_counts
from cladewise.sources.shared import by_shuffle, release, stored

LEAST = 1e-300
Step = Callable[[Column], Column]


@dataclass(frozen=True)
class Modes:
    """Bases in which a reversible model's rate matrix is diagonal, entries row by row: numbers, or columns of the branch table and of ``table(tree, ...)``."""

    right: list[Column]
    left: list[Column]
    roots: list[Column]
    turned: list[list[Column]]
    table: DataFrame | None = None


@dataclass(frozen=True)
class Kernel:
    """What a branch does with an array over ``k`` states; expressions over columns of the branch table.

    ``up``: the matrix of probabilities times the array, ``down``: the array
    times the matrix, ``slopes``: the matrix's slope in a parameter times the array.
    """

    k: int
    up: Step
    down: Step
    slopes: dict[str, Step] = field(default_factory=dict)
    modes: Modes | None = None

    def outer(self, u: Column, x: Column) -> Column:
        """The slope by each entry of the branch's matrix, row by row; with ``modes``, that by each entry of the rate matrix between the bases.

        Between the bases the exponential's slope in the direction of a matrix
        is that matrix entry by entry times the differences of the exponentials of two roots over those of the roots.
        """
        if self.modes is None:
            return F.flatten(F.transform(u, lambda a: F.transform(x, lambda b: a * b)))
        k, m, t = self.k, self.modes, F.col("t")
        before = F.array(*[M._sum([F.get(u, F.lit(a)) * m.right[a * k + i] for a in range(k)]) for i in range(k)])
        behind = F.array(*[M._sum([m.left[j * k + b] * F.get(x, F.lit(b)) for b in range(k)]) for j in range(k)])

        def share(i: int, j: int) -> Column:
            i, j = min(i, j), max(i, j)
            apart = m.roots[i] - m.roots[j]
            return F.exp(m.roots[j] * t) * (t if i == j else F.coalesce(F.try_divide(F.expm1(apart * t), apart), t))

        return M.let(before, lambda p: M.let(behind, lambda q: F.array(*[F.get(p, F.lit(i)) * F.get(q, F.lit(j)) * share(i, j) for i in range(k) for j in range(k)])))


def equal_kernel(k: int) -> Kernel:
    """States of equal rates, one change a unit of time expected; branches have ``t``."""
    e = F.exp(-F.col("t") * k / max(1, k - 1))
    up = lambda x: F.transform(x, lambda v: (1 - e) / k * S.total(x) + e * v)
    slope = lambda x: F.transform(x, lambda v: e / max(1, k - 1) * S.total(x) - e * k / max(1, k - 1) * v)
    return Kernel(k, up, up, {"length": slope})


def dense_kernel(k: int, turns: tuple[str, ...] = ()) -> Kernel:
    """Any matrix; branches have ``q`` (rates), ``p`` (probabilities) and ``d`` (slopes of these, in the order of ``turns``)."""
    slopes: dict[str, Step] = {"length": lambda x: M.apply(F.col("q"), M.apply(F.col("p"), x))}
    for n, name in enumerate(turns):
        slopes[name] = lambda x, n=n: M.apply(F.get(F.col("d"), F.lit(n)), x)
    return Kernel(k, lambda x: M.apply(F.col("p"), x), lambda x: M.apply_left(x, F.col("p"), k), slopes)


def reversible_branches(branches: DataFrame, rates: Column, freqs: Column, k: int, normal: bool = True, slopes: bool = False) -> DataFrame:
    """``branches`` with the columns of :func:`dense_kernel` for a reversible model; slopes in each exchange rate if asked for."""
    turns = M.reversible_turns(rates, freqs, k, normal) if slopes else None
    with_q = branches.withColumn("q", M.reversible(rates, freqs, k, normal))
    if turns is not None:
        with_q = with_q.withColumn("turns", turns)
    found = M.exponential(F.col("q"), F.col("t"), k, F.col("turns") if slopes else None)
    return with_q.withColumn("e", found).withColumns({"p": F.col("e.p"), "d": F.col("e.d")}).drop("e", "turns")


def spectral_kernel(k: int, modes: Modes) -> Kernel:
    """A reversible model by its modes; branches have ``t`` and what the modes are columns of.

    The identity is taken out of the exponential, so that small probabilities of short branches keep their digits.
    """
    t, right, left, roots = F.col("t"), modes.right, modes.left, modes.roots
    into = lambda v: [M._sum([left[m * k + b] * F.get(v, F.lit(b)) for b in range(k)]) for m in range(k)]
    onto = lambda v: [M._sum([F.get(v, F.lit(a)) * right[a * k + m] for a in range(k)]) for m in range(k)]
    back = lambda z, a: M._sum([right[a * k + m] * F.get(z, F.lit(m)) for m in range(k)])
    forth = lambda z, b: M._sum([F.get(z, F.lit(m)) * left[m * k + b] for m in range(k)])

    def up(x: Column) -> Column:
        grown = lambda v: F.array(*[F.expm1(root * t) * e for root, e in zip(roots, into(v))])
        return M.let(x, lambda v: M.let(grown(v), lambda z: F.array(*[F.get(v, F.lit(a)) + back(z, a) for a in range(k)])))

    def down(x: Column) -> Column:
        grown = lambda v: F.array(*[F.expm1(root * t) * e for root, e in zip(roots, onto(v))])
        return M.let(x, lambda v: M.let(grown(v), lambda z: F.array(*[F.get(v, F.lit(b)) + forth(z, b) for b in range(k)])))

    def by_length(x: Column) -> Column:
        grown = lambda v: F.array(*[root * F.exp(root * t) * e for root, e in zip(roots, into(v))])
        return M.let(x, lambda v: M.let(grown(v), lambda z: F.array(*[back(z, a) for a in range(k)])))

    return Kernel(k, up, down, {"length": by_length}, modes)


def fixed_modes(rates: list[float], freqs: list[float], normal: bool) -> Modes:
    """Modes of one model for all trees."""
    right, left, roots, turned = M.modes(rates, freqs, normal)
    column = lambda values: [F.lit(float(v)) for v in values]
    return Modes(column(right.ravel()), column(left.ravel()), column(roots), [column(m.ravel()) for m in turned])


def own_modes(models: DataFrame, rates: tuple[float, ...], k: int, normal: bool = True) -> Modes:
    """Modes of each tree's model, of ``models(tree, freqs)`` with the same exchange rates."""

    @F.pandas_udf("right array<double>, left array<double>, roots array<double>, turned array<array<double>>")
    def each(freqs: pd.Series) -> pd.DataFrame:
        found = [M.modes(rates, f, normal) for f in freqs]
        rows = [(right.ravel(), left.ravel(), roots, [m.ravel() for m in turned]) for right, left, roots, turned in found]
        return pd.DataFrame(rows, columns=["right", "left", "roots", "turned"])

    table = stored(models.select("tree", each("freqs").alias("m")).select("tree", "m.*"))
    entries = lambda of, n: [F.get(of, F.lit(i)) for i in range(n)]
    turned = [entries(F.get(F.col("turned"), F.lit(n)), k * k) for n in range(len(rates))]
    return Modes(entries(F.col("right"), k * k), entries(F.col("left"), k * k), entries(F.col("roots"), k), turned, table)


def barcode_kernel(edits: int) -> Kernel:
    """Unedited, ``edits`` edits, silent; branches have ``t``, ``nu`` (silencing) and ``rates`` (share of each edit)."""
    t, nu, q = F.col("t"), F.col("nu"), F.col("rates")
    alive, plain, last = F.exp(-nu * t), F.exp(-t), edits + 1
    edited, quiet = -F.expm1(-t), -F.expm1(-nu * t)

    def by_place(x: Column, first: Callable[[Column, Column, Column], Column], other: Callable[[Column, Column], Column], silent: Callable[[Column], Column]) -> Column:
        hit, off = S.dot(q, F.slice(x, 2, edits)), F.get(x, F.lit(last))
        return F.transform(x, lambda v, i: F.when(i == 0, first(v, hit, off)).when(i == last, silent(v)).otherwise(other(v, off)))

    def up(x: Column) -> Column:
        return by_place(x, lambda v, hit, off: alive * (plain * v + edited * hit) + quiet * off, lambda v, off: alive * v + quiet * off, lambda v: v)

    def by_length(x: Column) -> Column:
        return by_place(x, lambda v, hit, off: alive * ((plain - nu * edited) * hit - (1 + nu) * plain * v) + nu * alive * off, lambda v, off: nu * alive * (off - v), lambda v: v * 0.0)

    def by_nu(x: Column) -> Column:
        return by_place(x, lambda v, hit, off: t * alive * (off - plain * v - edited * hit), lambda v, off: t * alive * (off - v), lambda v: v * 0.0)

    def down(x: Column) -> Column:
        first, awake = F.get(x, F.lit(0)), S.total(F.slice(x, 1, edits + 1))
        return F.transform(x, lambda v, i: F.when(i == 0, alive * plain * v).when(i == last, v + quiet * awake).otherwise(alive * (v + edited * F.get(q, (i - 1).cast("int")) * first)))

    return Kernel(edits + 2, up, down, {"length": by_length, "nu": by_nu})


class Sweep:
    """Values up all trees of ``nodes(tree, node, parent, length)``.

    ``tips(tree, node, pattern, own)`` holds arrays over states, one row for a
    leaf and pattern that is known; no row says nothing. ``branches(tree, node,
    ...)`` has the kernel's columns, and ``by_pattern`` says that it has a row for each pattern.
    """

    def __init__(self, nodes: DataFrame, tips: DataFrame, branches: DataFrame, kernel: Kernel, by_pattern: bool = False):
        self.kernel, self.branches, self.on = kernel, branches, ["tree", "node", "pattern"] if by_pattern else ["tree", "node"]
        depth = T.heights(nodes).select("tree", "node", "depth")
        placed = stored(nodes.select("tree", "node", "parent").join(by_shuffle(depth), ["tree", "node"]))
        known = stored(tips.select("tree", "node", "pattern", "own").join(by_shuffle(placed), ["tree", "node"]))
        deepest = placed.agg(F.max("depth")).first()[0]
        self.levels: list[DataFrame] = []
        sums: DataFrame | None = None
        empty = F.lit(None).cast("array<double>").alias("below")
        for level in range(deepest or 0, -1, -1) if deepest is not None else ():
            here = known.where(F.col("depth") == level).select("tree", "node", "parent", "pattern", F.col("own").alias("inside"), F.lit(0.0).alias("scale"), empty)
            if sums is not None:
                top = F.array_max("below")
                inner = sums.join(by_shuffle(placed.where(F.col("depth") == level).select("tree", "node", "parent")), ["tree", "node"])
                here = here.unionByName(inner.select("tree", "node", "parent", "pattern", F.transform("below", lambda v: F.exp(v - F.array_max("below"))).alias("inside"), (F.col("scale") + top).alias("scale"), "below"))
            if level:
                here = here.join(by_shuffle(branches), self.on).withColumn("sent", F.transform(kernel.up(F.col("inside")), lambda v: F.log(F.greatest(v, F.lit(LEAST)))))
                here = here.select("tree", "node", "parent", "pattern", "inside", "scale", "below", "sent")
            here = stored(here)
            self.levels.insert(0, here)
            if level:
                each = here.groupBy("tree", F.col("parent").alias("node"), "pattern").agg(*[F.sum(F.col("sent")[a]).alias(f"m{a}") for a in range(kernel.k)], F.sum("scale").alias("scale"))
                sums = each.select("tree", "node", "pattern", "scale", F.array(*[f"m{a}" for a in range(kernel.k)]).alias("below"))
        release(known)

    def by_pattern(self, root: DataFrame) -> DataFrame:
        """``tree, pattern, value``: log likelihoods, with ``root(tree, freqs)`` (and ``pattern``, if it has that column)."""
        on = ["tree", "pattern"] if "pattern" in root.columns else ["tree"]
        value = F.log(F.greatest(S.dot(F.col("freqs"), F.col("inside")), F.lit(LEAST))) + F.col("scale")
        return self.levels[0].join(by_shuffle(root), on).select("tree", "pattern", value.alias("value"))

    def values(self, root: DataFrame, counts: DataFrame) -> DataFrame:
        """``tree, log_likelihood`` with ``counts(tree, pattern, n)``, how often each pattern stands."""
        return self.by_pattern(root).join(by_shuffle(counts), ["tree", "pattern"]).groupBy("tree").agg(F.sum(F.col("n") * F.col("value")).alias("log_likelihood"))

    def slopes(self, root: DataFrame, counts: DataFrame, outer: bool = False) -> DataFrame:
        """``tree, node, ...``: slope of the log likelihood by each of the kernel's parameters on the branch above each node, summed over patterns.

        ``outer``: also ``w``, the slope by each entry of the branch's matrix, row by row. A
        kernel with modes gives ``tree, w`` instead, that by the rate matrix between the bases, a row for each tree and level.
        """
        whole_tree = outer and self.kernel.modes is not None
        names, above, out = [] if whole_tree else list(self.kernel.slopes), None, None
        keys = ["tree"] if whole_tree else ["tree", "node"]
        logs = lambda x: F.transform(x, lambda v: F.log(F.greatest(v, F.lit(LEAST))))
        on = ["tree", "pattern"] if "pattern" in root.columns else ["tree"]
        for level, here in enumerate(self.levels):
            if level == 0:
                now = here.join(by_shuffle(root), on).withColumn("around", logs(F.col("freqs")))
            else:
                met = here.join(by_shuffle(above), ["tree", "parent", "pattern"]).join(by_shuffle(self.branches), self.on)
                rest = F.zip_with("whole", "sent", lambda a, b: a - b)
                met = met.withColumn("rest", rest).withColumn("u", F.transform("rest", lambda v: F.exp(v - F.array_max("rest"))))
                total = S.dot(F.col("u"), F.transform("sent", F.exp))
                met = met.withColumn("total", F.greatest(total, F.lit(LEAST)))
                now = met.withColumns({f"s_{n}": S.dot(F.col("u"), f(F.col("inside"))) / F.col("total") for n, f in self.kernel.slopes.items() if n in names}).withColumn("around", logs(self.kernel.down(F.col("u"))))
                if outer:
                    now = now.withColumn("w", F.transform(self.kernel.outer(F.col("u"), F.col("inside")), lambda v: v / F.col("total")))
                now = now.select("tree", "node", "pattern", "around", "below", *[f"s_{n}" for n in names], *["w"] * outer)
                if level + 1 < len(self.levels):
                    now = stored(now)
                entries = [F.sum(F.col("n") * F.col("w")[i]).alias(f"w{i}") for i in range(self.kernel.k**2)] if outer else []
                part = now.join(by_shuffle(counts), ["tree", "pattern"]).groupBy(*keys).agg(*[F.sum(F.col("n") * F.col(f"s_{n}")).alias(n) for n in names], *entries)
                if outer:
                    part = part.select(*keys, *[f"`{n}`" for n in names], F.array(*[f"w{i}" for i in range(self.kernel.k**2)]).alias("w"))
                out = part if out is None else out.unionByName(part)
            above = now.where("below IS NOT NULL").select("tree", F.col("node").alias("parent"), "pattern", F.zip_with("around", "below", lambda a, b: a + b).alias("whole"))
        return out


def exchange_slopes(sweep: Sweep, root: DataFrame, counts: DataFrame, rates: Column, normal: bool = True) -> DataFrame:
    """``tree, slopes``: slope of each tree's log likelihood in every exchange rate of a reversible model, in order.

    The slope by the entries of a branch's matrix is one matrix, whatever the
    number of patterns and rates. It goes back through the exponential as the
    slope of that of the transposed rate matrix in its direction, is summed
    over branches, and only then meets the rate matrix's slopes. ``root(tree,
    freqs)`` holds the model's frequencies. A kernel with modes has all this
    between its bases, where the way back is a product entry by entry.
    """
    k, modes = sweep.kernel.k, sweep.kernel.modes
    if modes is not None:
        summed = sweep.slopes(root, counts, outer=True).groupBy("tree").agg(*[F.sum(F.col("w")[i]).alias(f"w{i}") for i in range(k * k)])
        met = summed.join(by_shuffle(modes.table.select("tree", "turned")), "tree") if modes.table is not None else summed
        return met.select("tree", F.array(*[M._sum([v * F.col(f"w{i}") for i, v in enumerate(by)]) for by in modes.turned]).alias("slopes"))
    found = sweep.slopes(root, counts, outer=True).select("tree", "node", "w").join(by_shuffle(sweep.branches.select("tree", "node", "t", "q")), ["tree", "node"])
    rows = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda a: F.slice("w", a * k + 1, F.lit(k)))
    by_q = found.withColumn("way", M.exponential(M.transposed(F.col("q"), k), F.col("t"), k, F.array(rows))).select("tree", F.flatten(F.get(F.col("way.d"), F.lit(0))).alias("g"))
    sums = by_q.groupBy("tree").agg(*[F.sum(F.col("g")[i]).alias(f"g{i}") for i in range(k * k)])
    each = sums.select("tree", F.array(*[f"g{i}" for i in range(k * k)]).alias("g")).join(by_shuffle(root), "tree")
    return each.select("tree", F.transform(M.reversible_turns(rates, F.col("freqs"), k, normal), lambda m: S.dot(F.flatten(m), F.col("g"))).alias("slopes"))


# --- sequences -------------------------------------------------------------------

def patterns(sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct columns of ``sequences(ds, taxon, codes)``: ``tree, node, pattern, code`` of their cells and ``tree, pattern, n``.

    A pattern's name is its first site's number; nodes are named ``t`` and the taxon.
    """
    sites = sequences.select("ds", "taxon", F.posexplode("codes").alias("site", "code"))
    column = sites.groupBy("ds", "site").agg(F.array_sort(F.collect_list(F.struct("taxon", "code"))).alias("cells"))
    found = stored(column.groupBy("ds", "cells").agg(F.min("site").alias("pattern"), F.count(F.lit(1)).alias("n")))
    each = found.select(F.col("ds").alias("tree"), "pattern", F.explode("cells").alias("c"))
    return each.select("tree", F.concat(F.lit("t"), F.col("c.taxon").cast("string")).alias("node"), "pattern", F.col("c.code").alias("code")), found.select(F.col("ds").alias("tree"), "pattern", "n")


def subsample(counts: DataFrame, draws: int, seed: int = 1) -> DataFrame:
    """``tree, pattern, n``: as many sites as ``draws`` says, drawn by the patterns' ``counts``; each stands for an equal part of all sites."""
    given = counts.withColumnRenamed("tree", "ds")
    total = given.groupBy("ds").agg((F.sum("n") / draws).alias("part"))
    return draw_counts(given, "pattern", draws, seed).join(total, "ds").select(F.col("ds").alias("tree"), "pattern", (F.col("times") * F.col("part")).alias("n"))


def one_hot(code: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda a: (a == code).cast("double"))


def branch_lengths(nodes: DataFrame, least: float) -> DataFrame:
    return nodes.where("parent IS NOT NULL").select("tree", "node", F.greatest(F.col("length"), F.lit(least)).alias("t"))


def base_frequencies(sequences: DataFrame) -> DataFrame:
    """``tree, freqs``: the share of each base, with one of each added."""
    code = sequences.select(F.col("ds").alias("tree"), F.explode("codes").alias("c")).where("c >= 0")
    counts = code.groupBy("tree").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("c") == b).alias(f"c{b}") for b in range(4)])
    return counts.select("tree", F.array(*[(F.col(f"c{b}") + 1) / (F.col("n") + 4) for b in range(4)]).alias("freqs"))


#: Pairs of bases in the order of exchange rates.
BASE_PAIRS = ("AC", "AG", "AT", "CG", "CT", "GT")


def dna_sweep(edges: DataFrame, sequences: DataFrame, model: str = "jc", kappa: float = 4.0, rates: tuple[float, ...] = (1.0,) * 6, least: float = 1e-3, slopes: bool = False, draws: int | None = None, seed: int = 1, given: DataFrame | None = None) -> tuple[Sweep, DataFrame, DataFrame]:
    """The sweep of base codes (below zero: missing) on trees ``edges(ds, node, parent, length)``, with its root frequencies and pattern counts.

    ``jc``: equal rates; ``hky``: transitions ``kappa`` times as likely, the
    data set's own frequencies; ``gtr``: any exchange rates;
    ``given``: what ``given(ds, rates, freqs)`` holds, a rate matrix by rows as it stands. ``slopes``: also in the six exchange rates.
    ``draws``: only so many sites, drawn anew for each ``seed``; then values and slopes are estimates of those over all sites.
    """
    nodes = edges.withColumnRenamed("ds", "tree")
    cells, counts = patterns(sequences)
    if draws:
        counts = stored(subsample(counts, draws, seed))
        cells = cells.join(counts.select("tree", "pattern"), ["tree", "pattern"], "left_semi")
    tips = cells.where("code >= 0").select("tree", "node", "pattern", one_hot(F.col("code"), 4).alias("own"))
    branches = branch_lengths(nodes, least)
    if model == "jc":
        root = counts.select("tree").distinct().withColumn("freqs", F.array(*[F.lit(0.25)] * 4))
        return Sweep(nodes, tips, stored(branches), equal_kernel(4)), root, counts
    if model == "given":
        if given is None or slopes:
            raise ValueError("a given model needs its matrices and has slopes in lengths only")
        known = given.select(F.col("ds").alias("tree"), F.col("rates").alias("q"), "freqs")
        full = branches.join(by_shuffle(known.select("tree", "q")), "tree").withColumn("p", M.exponential(F.col("q"), F.col("t"), 4)["p"])
        return Sweep(nodes, tips, stored(full), dense_kernel(4)), known.select("tree", "freqs"), counts
    exchange = {"hky": (1.0, kappa, 1.0, 1.0, kappa, 1.0), "gtr": tuple(float(x) for x in rates)}[model]
    root = stored(base_frequencies(sequences))
    if not slopes:
        modes = own_modes(root, exchange, 4)
        return Sweep(nodes, tips, stored(branches.join(by_shuffle(modes.table.drop("turned")), "tree")), spectral_kernel(4, modes)), root, counts
    full = reversible_branches(branches.join(by_shuffle(root), "tree"), F.array(*[F.lit(x) for x in exchange]), F.col("freqs"), 4, slopes=True)
    return Sweep(nodes, tips, stored(full.drop("freqs")), dense_kernel(4, BASE_PAIRS)), root, counts


def dna_likelihood(edges: DataFrame, sequences: DataFrame, model: str = "jc", **options) -> DataFrame:
    """``ds, sites, log_likelihood`` of each data set's tree."""
    sweep, root, counts = dna_sweep(edges, sequences, model, **options)
    sites = counts.groupBy("tree").agg(F.round(F.sum("n")).cast("int").alias("sites"))
    return sweep.values(root, counts).join(by_shuffle(sites), "tree").select(F.col("tree").alias("ds"), "sites", "log_likelihood")


def barcode_sweep(edges: DataFrame, sequences: DataFrame, nu: float = 0.4, leading: float = 0.05, rates: DataFrame | None = None, least: float = 1e-3) -> tuple[Sweep, DataFrame, DataFrame]:
    """The sweep of barcode states (-1 silent, 0 unedited) with a branch above the root.

    ``rates(ds, state, rate)`` or ``rates(ds, site, state, rate)`` gives the share
    of each edit, for all sites or site by site; without it all edits of a data set are alike.
    """
    nodes = edges.withColumnRenamed("ds", "tree")
    every = sequences.select("ds", F.array_max("codes").alias("m")).agg(F.greatest(F.max("m"), F.lit(1))).first()[0] or 1
    kernel, by_site = barcode_kernel(every), rates is not None and "site" in rates.columns
    if by_site:
        cells = sequences.select(F.col("ds").alias("tree"), F.concat(F.lit("t"), F.col("taxon").cast("string")).alias("node"), F.posexplode("codes").alias("pattern", "code"))
        counts = cells.select("tree", "pattern").distinct().withColumn("n", F.lit(1).cast("long"))
    else:
        cells, counts = patterns(sequences)
    if rates is None:
        most = sequences.groupBy(F.col("ds").alias("tree")).agg(F.greatest(F.max(F.array_max("codes")), F.lit(1)).alias("m"))
        share = most.select("tree", F.transform(F.sequence(F.lit(1), F.lit(every)), lambda e: F.when(e <= F.col("m"), 1.0 / F.col("m")).otherwise(0.0)).alias("rates"))
    else:
        keys = [F.col("ds").alias("tree")] + ([F.col("site").alias("pattern")] if by_site else [])
        listed = rates.select(*keys, "state", "rate").groupBy("tree", *(["pattern"] if by_site else [])).agg(F.map_from_entries(F.collect_list(F.struct(F.col("state").cast("int"), "rate"))).alias("m"))
        share = listed.select(*[c for c in listed.columns if c != "m"], F.transform(F.sequence(F.lit(1), F.lit(every)), lambda e: F.coalesce(F.try_element_at("m", e), F.lit(0.0))).alias("rates"))
        if by_site:  # a site without edits has no rates
            share = counts.select("tree", "pattern").join(by_shuffle(share), ["tree", "pattern"], "left").withColumn("rates", F.coalesce("rates", F.array_repeat(F.lit(0.0), every)))
        else:
            share = counts.select("tree").distinct().join(by_shuffle(share), "tree", "left").withColumn("rates", F.coalesce("rates", F.array_repeat(F.lit(0.0), every)))
    share = stored(share.withColumn("nu", F.lit(nu)))
    tips = cells.select("tree", "node", "pattern", one_hot(F.when(F.col("code") < 0, every + 1).otherwise(F.col("code")), every + 2).alias("own"))
    start = one_hot(F.lit(0), every + 2)
    root = share.withColumn("t", F.lit(leading)).withColumn("freqs", kernel.down(start))
    branches = stored(branch_lengths(nodes, least).join(by_shuffle(share), "tree"))
    return Sweep(nodes, tips, branches, kernel, by_site), root.select("tree", *(["pattern"] if by_site else []), "freqs"), counts


def barcode_likelihood(edges: DataFrame, sequences: DataFrame, **options) -> DataFrame:
    """``ds, sites, log_likelihood`` of barcodes on each data set's tree."""
    sweep, root, counts = barcode_sweep(edges, sequences, **options)
    sites = counts.groupBy("tree").agg(F.sum("n").cast("int").alias("sites"))
    return sweep.values(root, counts).join(by_shuffle(sites), "tree").select(F.col("tree").alias("ds"), "sites", "log_likelihood")


# --- states of migration -----------------------------------------------------------

def state_sweep(nodes: DataFrame, leaf_states: DataFrame, names: list[str], rates: list[float], freqs: list[float] | None = None, primary: str | None = None, least: float = 1e-6, slopes: bool = False) -> tuple[Sweep, DataFrame, DataFrame]:
    """The sweep of leaf states under a reversible model with exchange rates for the pairs of ``names`` in order, not made normal.

    The root has the frequencies (equal unless given), or is the state
    ``primary``; a state that is not in ``names`` is an error.
    """
    k = len(names)
    if primary is not None and primary not in names:
        raise ValueError(f"no state {primary}")
    if len(rates) != k * (k - 1) // 2:
        raise ValueError(f"{k} states have {k * (k - 1) // 2} exchange rates")
    pi = freqs or [1.0 / k] * k
    at = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])
    tips = leaf_states.select("tree", "node", F.lit(0).alias("pattern"), one_hot(F.try_element_at(at, F.col("state")), k).alias("own"))
    column = lambda values: F.array(*[F.lit(float(v)) for v in values])
    pairs = tuple(f"{a}|{b}" for i, a in enumerate(names) for b in names[i + 1 :])
    if slopes or min(pi) <= 0:
        branches, kernel = reversible_branches(branch_lengths(nodes, least), column(rates), column(pi), k, normal=False, slopes=slopes), dense_kernel(k, pairs if slopes else ())
    else:
        branches, kernel = branch_lengths(nodes, least), spectral_kernel(k, fixed_modes(rates, pi, False))
    trees = nodes.select("tree").distinct()
    start = pi if primary is None else [float(n == primary) for n in names]
    return Sweep(nodes, tips, stored(branches), kernel), trees.withColumn("freqs", column(start)), trees.select("tree", F.lit(0).alias("pattern"), F.lit(1).cast("long").alias("n"))
