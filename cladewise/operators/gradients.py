"""Slopes along the way from points over distances and trees to likelihoods.

Slopes in points and estimates of traces are joins and grouped sums over all
data sets. The reverse pass through a tree is one group for each bounded data
set, as the trees themselves are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.functions import scalars as S
from cladewise.operators import inference as I
from cladewise.plans.config import AnalysisConfig

LEAST_DISTANCE = 1e-9
Matrix = Callable[[float], np.ndarray]


# --- points ----------------------------------------------------------------

def point_slopes(slopes: DataFrame, points: DataFrame, config: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """``ds, taxon, dim, slope`` in the points' coordinates from ``slopes(ds, i, j, g)`` in their distances.

    Both ends of a pair get their share; sums are partial before the shuffle.
    ``slopes`` that still have ``x_i`` and ``x_j``, as :func:`distances.pairs`
    carries them, need no join and lie by data sets already, so that nothing
    of a pair travels; others meet the points by one join for each end.
    Points that coincide pull each other nowhere.
    """
    def ends(name: str) -> DataFrame:
        return points.select("ds", F.col("taxon").alias(name), F.col("x").alias(f"x_{name}"))

    near = {"x_i", "x_j"} <= set(slopes.columns)
    both = slopes if near else slopes.join(ends("i"), ["ds", "i"]).join(ends("j"), ["ds", "j"])
    if config.curved:
        both = both.withColumn("t_i", F.sqrt(1.0 + S.dot(F.col("x_i"), F.col("x_i")))).withColumn("t_j", F.sqrt(1.0 + S.dot(F.col("x_j"), F.col("x_j"))))
        u = F.col("t_i") * F.col("t_j") - S.dot(F.col("x_i"), F.col("x_j"))
        rate = F.col("g") * S.acosh_slope(u) / config.curvature**0.5
        share = lambda me, you: F.zip_with(f"x_{me}", f"x_{you}", lambda a, b: F.col("rate") * (F.col(f"t_{you}") / F.col(f"t_{me}") * a - b))
    else:
        d = F.sqrt(S.total(F.zip_with("x_i", "x_j", lambda a, b: (a - b) * (a - b))))
        rate = F.when(d > LEAST_DISTANCE, F.col("g") / d).otherwise(0.0)
        share = lambda me, you: F.zip_with(f"x_{me}", f"x_{you}", lambda a, b: F.col("rate") * (a - b))
    both = both.withColumn("rate", rate)
    sides = F.array(*[F.struct(F.col(me).alias("taxon"), share(me, you).alias("s")) for me, you in ("ij", "ji")])
    each = both.select("ds", F.explode(sides).alias("e")).select("ds", "e.taxon", F.posexplode("e.s").alias("dim", "s"))
    return each.groupBy("ds", "taxon", "dim").agg(F.sum("s").alias("slope"))


def natural_slopes(slopes: DataFrame, variance: Column) -> DataFrame:
    """``slope`` of each mean times its variance, which undoes the metric of a normal distribution with independent axes."""
    return slopes.withColumn("slope", F.col("slope") * variance)


def trace_probes(rows: DataFrame, probes: int = 10, seed: int = 1) -> DataFrame:
    """``ds, probe, value``: z' A' A z for normal probes z and the matrix A of ``rows(ds, row, x)``; their mean estimates the trace of A' A.

    A probe is a row of its own and a row of A meets it by itself, so nothing but sums travels.
    """
    each = rows.withColumn("probe", F.explode(F.sequence(F.lit(0), F.lit(probes - 1))))
    z = F.transform("x", lambda v, d: v * S.normal(F.lit(seed), F.col("ds"), F.col("probe"), d))
    return each.withColumn("along", S.total(z)).groupBy("ds", "probe").agg(F.sum(F.col("along") * F.col("along")).alias("value"))


def traces(rows: DataFrame, probes: int = 10, seed: int = 1) -> DataFrame:
    """``ds, trace, spread`` over the probes."""
    return trace_probes(rows, probes, seed).groupBy("ds").agg(F.avg("value").alias("trace"), F.stddev_samp("value").alias("spread"))


# --- from distances to trees -----------------------------------------------

class JoinedTree:
    """A neighbour-joining tree of distances with the way back: lengths, and slopes in distances from those in lengths."""

    def __init__(self, names: list, d: np.ndarray):
        self.names, self.n = names, len(names)
        self.steps, self.live, self.room = I.joined(d)
        self.split = [(0.5 * s[4] + (s[5] - s[6]) / (2 * (s[3] - 2)) if s[3] > 2 else 0.5 * s[4]) for s in self.steps]
        self.lengths = np.zeros(2 * self.n)
        for u, v, *_, x, y in self.steps:
            self.lengths[u], self.lengths[v] = x, y
        self.label = [f"t{n}" for n in names] + [f"_{s[2]:06d}" for s in self.steps[:-1]] + ["_root"]
        self.parents = {u: s[2] for s in self.steps for u in s[:2]}

    def edges(self) -> list[tuple]:
        """Numbers of nodes, children before parents, each with its parent."""
        return [(u, s[2]) for s in self.steps for u in s[:2]]

    def back(self, g: np.ndarray) -> np.ndarray:
        """Slopes in the distances, a symmetric matrix of each pair's slope, from ``g`` in the lengths by node. Where a length or distance was held at zero nothing passes."""
        out = np.zeros_like(self.room)  # a pair's slope is what stands at both of its places
        open_ = self.room > 0
        for (u, v, w, n, d_uv, *_), live, cut in zip(reversed(self.steps), reversed(self.live), reversed(self.split)):
            if n == 2:
                out[u, v] += 0.5 * (g[u] + g[v])
                continue
            sent = np.where(open_[w], out[w] + out[:, w], 0.0)
            there = np.zeros(len(out))
            there[live] = 1.0
            there[[u, v]] = 0.0
            half = 0.5 * there * sent
            to_u, to_v = (g[u] if cut > 0 else 0.0), (g[v] if d_uv - cut > 0 else 0.0)
            tilt = (to_u - to_v) / (2 * (n - 2)) * there
            out[u] += half + tilt
            out[v] += half - tilt
            out[u, v] += 0.5 * (to_u + to_v) - half.sum()
        return (out + out.T)[: self.n, : self.n]

    def forth(self, move: np.ndarray) -> np.ndarray:
        """Change of the lengths with a change of the distances, the order of joins held."""
        d = I._room(move)
        out = np.zeros(2 * self.n)
        for (u, v, w, n, d_uv, *_), live, cut in zip(self.steps, self.live, self.split):
            if n == 2:
                out[u] = out[v] = 0.5 * d[u, v]
                continue
            to_u = 0.5 * d[u, v] + (d[u, live].sum() - d[v, live].sum()) / (2 * (n - 2))
            out[u], out[v] = (to_u if cut > 0 else 0.0), (d[u, v] - to_u if d_uv - cut > 0 else 0.0)
            d[w, live] = d[live, w] = np.where(self.room[w, live] > 0, 0.5 * (d[u, live] + d[v, live] - d[u, v]), 0.0)
        return out


def linkage_back(names: list, d: np.ndarray, g: dict[str, float]) -> np.ndarray:
    """Slopes in the distances of an average-linkage tree from ``g`` in the lengths by node: a node's height is half the mean over the pairs it joins."""
    edges = I.upgma(names, d)
    at = {f"t{n}": [k] for k, n in enumerate(names)}
    pairs: dict[str, list[str]] = {}
    for node, parent, _ in edges:
        if parent is not None:
            pairs.setdefault(parent, []).append(node)
            at[parent] = at.get(parent, []) + at[node]
    height: dict[str, float] = dict.fromkeys(at, 0.0)
    for node, parent, length in edges:
        if parent is not None and length > 0:
            height[parent] += g.get(node, 0.0)
            height[node] -= g.get(node, 0.0)
    out = np.zeros_like(d)
    for parent, (a, b) in pairs.items():
        share = height[parent] / (2.0 * len(at[a]) * len(at[b]))
        out[np.ix_(at[a], at[b])] += share
        out[np.ix_(at[b], at[a])] += share
    return out


# --- from lengths to likelihoods -------------------------------------------

def patterns(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of taxa by sites, and how often each occurs."""
    found, counts = np.unique(codes, axis=1, return_counts=True)
    return found, counts


def likelihood_slopes(edges: list[tuple[int, int]], lengths: np.ndarray, tips: list[np.ndarray], counts: np.ndarray, move: Matrix, turn: Matrix, root: np.ndarray, other: list[Matrix] = ()) -> tuple[float, np.ndarray, list[float], np.ndarray]:
    """Log likelihood, its slope in each node's length, in the parameters whose matrix slopes are ``other``, and the root's share of states by pattern.

    ``edges`` are (node, parent), children first; nodes below ``len(tips)`` are
    leaves with (patterns, states) partials. Inside values go up, outside
    values down; both are scaled, which ratios do not see.
    """
    top = edges[-1][1]
    inside: dict[int, np.ndarray] = dict(enumerate(tips))
    matrices, message, log_scale = {}, {}, np.zeros(len(counts))
    children: dict[int, list[int]] = {}
    for node, parent in edges:
        most = inside[node].max(axis=1, keepdims=True)
        log_scale += np.log(most[:, 0])
        inside[node] = inside[node] / most
        matrices[node] = move(lengths[node])
        message[node] = inside[node] @ matrices[node].T
        inside[parent] = inside[parent] * message[node] if parent in inside else message[node]
        children.setdefault(parent, []).append(node)
    total = inside[top] @ root
    value = float(counts @ (np.log(total) + log_scale))
    slope, sums = np.zeros(len(lengths)), [0.0] * len(other)
    outside = {top: np.broadcast_to(root, inside[top].shape)}
    for parent in sorted(children, reverse=True):  # a parent's number is above its children's
        kids = children[parent]
        for node in kids:
            around = outside[parent]
            for sister in kids:
                if sister != node:
                    around = around * message[sister]
            whole = np.maximum((around * message[node]).sum(1), 1e-300)
            slope[node] = counts @ ((around * (inside[node] @ turn(lengths[node]).T)).sum(1) / whole)
            for k, by in enumerate(other):
                sums[k] += counts @ ((around * (inside[node] @ by(lengths[node]).T)).sum(1) / whole)
            if node in children:
                down = around @ matrices[node]
                outside[node] = down / np.maximum(down.max(axis=1, keepdims=True), 1e-300)
    return value, slope, sums, inside[top] * (counts / total)[:, None]


def jukes_cantor_slopes(trees: list[JoinedTree], tips: np.ndarray, counts: np.ndarray, least: float = 1e-3) -> list[tuple[float, np.ndarray]]:
    """:func:`model_slopes` with equally likely bases for several trees of the same taxa at once: value and slopes in lengths of each.

    Nodes whose subtrees are equally high, of all trees, are one step, up and down again. ``tips`` are
    (taxa, states, patterns), 1 where a base may be.
    """
    n = len(tips)
    size, steps = 2 * n, {}
    for k, tree in enumerate(trees):
        high = np.zeros(size, int).tolist()
        for u, v, w, *_ in tree.steps:
            high[w] = 1 + max(high[u], high[v])
            steps.setdefault(high[w], []).append((k * size + u, k * size + v, k * size + w))
    by_height = [np.array(steps[h]).T for h in sorted(steps)]
    given = np.concatenate([tree.lengths for tree in trees])
    more = np.exp(-4.0 / 3.0 * np.maximum(given, least))[:, None, None]
    move = (1.0 - more) / 4.0
    inside, message = np.empty((2, len(given), *tips.shape[1:]))  # of inner nodes, values that sum up to 1
    by_sum = np.ones((4, len(given), len(counts)))
    scale, inner, about, along = by_sum  # sums taken out of inside values; of these, of what is around a node, and of the products of both
    for k in range(len(trees)):
        at = slice(k * size, k * size + n)
        inside[at] = tips
        inner[at] = tips.sum(1)
        message[at] = move[at] * inner[at, None] + more[at] * tips
    for u, v, w in by_height:
        here = message.take(u, 0)
        here *= message.take(v, 0)
        scale[w] = total = here.sum(1)
        here /= total[:, None]
        inside[w] = here
        here *= more[w]
        here += move[w]
        message[w] = here
    outside = np.full_like(inside, 0.25)
    for u, v, w in reversed(by_height):
        both = np.concatenate([u, v])
        near = outside.take(np.concatenate([w, w]), 0)
        near *= message.take(np.concatenate([v, u]), 0)
        about[both] = total = np.maximum(near.sum(1), 1e-300)
        along[both] = np.einsum("nsp,nsp->np", near, inside.take(both, 0))
        down = np.flatnonzero(both % size >= n)
        near, both = near[down], both[down]
        near /= total[down, None]
        near *= more[both]
        near += move[both]
        outside[both] = near
    less = about * inner
    whole = np.maximum(move[:, 0] * less + more[:, 0] * along, 1e-300)
    slope = np.where(given >= least, ((less - 4.0 * along) * more[:, 0] / 3.0 / whole) @ counts, 0.0)
    slope[[k * size + tree.steps[-1][2] for k, tree in enumerate(trees)]] = 0.0
    values = np.log(scale).reshape(len(trees), size, -1).sum(1) @ counts + np.log(0.25) * counts.sum()
    return [(float(v), slope[k * size : (k + 1) * size]) for k, v in enumerate(values)]


def symmetric_turn(t: float) -> np.ndarray:
    """Slope of the matrix of equally likely bases in the length."""
    e = np.exp(-4.0 * t / 3.0)
    return np.full((4, 4), e / 3) - np.eye(4) * (4 * e / 3)


def barcode_turn(t: float, edits: int, nu: float) -> np.ndarray:
    """Slope of the barcode matrix in the length."""
    m = np.zeros((edits + 2, edits + 2))
    quiet = np.exp(-nu * t)
    m[range(edits + 1), range(edits + 1)] = -nu * quiet
    m[0, 0] = -(1 + nu) * quiet * np.exp(-t)
    m[0, 1 : edits + 1] = quiet * (np.exp(-t) + nu * np.expm1(-t)) / edits
    m[: edits + 1, -1] = nu * quiet
    return m


def barcode_turn_nu(t: float, edits: int, nu: float) -> np.ndarray:
    """Slope of the barcode matrix in the rate of silencing."""
    m = -t * I.barcode_matrix(t, edits, nu)
    m[: edits + 1, -1] = t * np.exp(-nu * t)
    m[-1, -1] = 0
    return m


def central(of: Callable[[float], Matrix], at: float, step: float = 1e-5) -> Matrix:
    """Slope of a matrix in a parameter of its model, by a central difference."""
    high, low = of(at + step), of(at - step)
    return lambda t: (high(t) - low(t)) / (2 * step)


def base_tips(codes: np.ndarray) -> list[np.ndarray]:
    return [np.where((c < 0)[:, None], 1.0, np.eye(4)[np.maximum(c, 0)]) for c in codes]


def tree_slopes(distances: DataFrame, sequences: DataFrame, model: str = "jc", kappa: float = 4.0, nu: float = 0.4, leading: float = 0.05, least: float = 1e-3) -> DataFrame:
    """Slopes of the log likelihood of each data set on its neighbour-joining tree: ``ds, kind, name, value``.

    ``kind``: ``likelihood`` (one row), ``length`` (name: the node), ``distance``
    (name: both taxa), ``parameter`` (``kappa``, ``nu`` or ``leading``). ``jc``
    and ``hky`` take base codes, ``barcode`` barcode states with a branch above
    the root. A data set whose taxa are not all in both tables is an error.
    """

    def each(pairs: pd.DataFrame, taxa: pd.DataFrame) -> pd.DataFrame:
        if not len(pairs) or not len(taxa):
            return pd.DataFrame({"ds": [], "kind": [], "name": [], "value": []})
        names, d = I._square(pairs)
        rows = dict(zip(taxa["taxon"], taxa["codes"]))
        missing = [n for n in names if n not in rows]
        if missing:
            raise ValueError(f"no sequence of taxon {missing[0]} in data set {pairs['ds'].iloc[0]}")
        codes, counts = patterns(np.stack([rows[n] for n in names]))
        tree = JoinedTree(names, d)
        value, slope, found = model_slopes(tree, codes, counts, model, kappa, nu, leading, least)
        by_pair = tree.back(slope)
        rows = [("likelihood", "", value)]
        rows += [("length", tree.label[u], slope[u]) for u, _ in tree.edges()]
        rows += [("distance", f"{names[a]}-{names[b]}", by_pair[a, b]) for a in range(len(names)) for b in range(a + 1, len(names))]
        rows += [("parameter", k, v) for k, v in found.items()]
        return pd.DataFrame(rows, columns=["kind", "name", "value"]).assign(ds=pairs["ds"].iloc[0])[["ds", "kind", "name", "value"]]

    return I.by_data_set(distances, "i", "j", "d").cogroup(I.by_data_set(sequences, "taxon", "codes")).applyInPandas(each, "ds long, kind string, name string, value double")


def model_slopes(tree: JoinedTree, codes: np.ndarray, counts: np.ndarray, model: str = "jc", kappa: float = 4.0, nu: float = 0.4, leading: float = 0.05, least: float = 1e-3, lengths: np.ndarray | None = None) -> tuple[float, np.ndarray, dict[str, float]]:
    """Value, slopes in lengths and in the model's parameters; a length below ``least`` counts as ``least`` and has no slope."""
    given = tree.lengths if lengths is None else lengths
    used = np.maximum(given, least)
    found: dict[str, float] = {}
    if model == "barcode":
        edits = max(1, int(codes.max()))
        tips = [np.eye(edits + 2)[np.where(c < 0, edits + 1, c)] for c in codes]
        value, slope, (by_nu,), share = likelihood_slopes(tree.edges(), used, tips, counts, lambda t: I.barcode_matrix(t, edits, nu), lambda t: barcode_turn(t, edits, nu), I.barcode_matrix(leading, edits, nu)[0], [lambda t: barcode_turn_nu(t, edits, nu)])
        found["nu"] = by_nu + float((share @ barcode_turn_nu(leading, edits, nu)[0]).sum())
        found["leading"] = float((share @ barcode_turn(leading, edits, nu)[0]).sum())
    elif model == "hky":
        seen = codes[codes >= 0]
        freqs = (np.bincount(seen, np.broadcast_to(counts, codes.shape)[codes >= 0], 4) + 1.0) / (np.broadcast_to(counts, codes.shape)[codes >= 0].sum() + 4.0)
        move = I.hky(kappa, freqs)
        value, slope, (by_kappa,), _ = likelihood_slopes(tree.edges(), used, base_tips(codes), counts, move, lambda t: (move(t + 1e-6) - move(t - 1e-6)) / 2e-6, freqs, [central(lambda k: I.hky(k, freqs), kappa)])
        found["kappa"] = by_kappa
    else:
        value, slope, _, _ = likelihood_slopes(tree.edges(), used, base_tips(codes), counts, I.jukes_cantor_matrix, symmetric_turn, np.full(4, 0.25))
    return value, np.where(given >= least, slope, 0.0), found
