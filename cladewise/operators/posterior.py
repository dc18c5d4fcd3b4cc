"""Posterior over embeddings of taxa: normal around fitted points, distances of a draw, its tree, the tree's likelihood.

Draws are Spark rows, made from hashes of their names, so that they do not
depend on how rows are spread. The fit of a data set is one group: data sets
are bounded, and there are many of them.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.functions import scalars as S
from cladewise.operators import gradients as G
from cladewise.operators.inference import by_data_set
from cladewise.plans.config import AnalysisConfig, Covariance


def draws(points: DataFrame, n: int, sigma: Column, seed: int = 1) -> DataFrame:
    """``ds, sample, taxon, x``: n draws around ``points(ds, taxon, x)``; each odd draw mirrors the one before it."""
    rows = points.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    pair, sign = F.floor(F.col("sample") / 2), F.when(F.col("sample") % 2 == 0, 1.0).otherwise(-1.0)
    moved = F.transform("x", lambda v, d: v + sign * sigma * S.normal(F.lit(seed), F.col("ds"), F.col("taxon"), pair, d))
    return rows.select("ds", "sample", "taxon", moved.alias("x"))


def distance_matrix(x: np.ndarray, scale: float) -> np.ndarray:
    square = (x * x).sum(1)
    d = np.sqrt(np.maximum(0.0, square[:, None] + square[None, :] - 2 * x @ x.T)) / scale
    np.fill_diagonal(d, 0.0)
    return d


class _Target:
    """One data set's lower bound: its value, slopes and curvature at points, for sequences on the tree of the points' distances."""

    def __init__(self, names: list, codes: np.ndarray, scale: float, model: str):
        self.names, self.scale, self.model = names, scale, model
        self.codes, self.counts = G.patterns(codes)
        self.tips = np.stack(G.base_tips(self.codes)).transpose(0, 2, 1).copy() if model == "jc" else None

    def at(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        """Log likelihood and its slope in each coordinate."""
        return self.at_each([x])[0]

    def at_each(self, points: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        """:meth:`at` for several points at once."""
        far = [distance_matrix(x, self.scale) for x in points]
        trees = [G.JoinedTree(self.names, d) for d in far]
        if self.model == "jc":
            found = G.jukes_cantor_slopes(trees, self.tips, self.counts)
        else:
            found = [G.model_slopes(tree, self.codes, self.counts, self.model, leading=0.05)[:2] for tree in trees]
        out = []
        for x, d, tree, (value, slope) in zip(points, far, trees, found):
            rate = np.divide(tree.back(slope), d * self.scale**2, out=np.zeros_like(d), where=d > G.LEAST_DISTANCE)
            out.append((value, rate.sum(1)[:, None] * x - rate @ x))
        return out

    def batch(self, mean: np.ndarray, spread: np.ndarray, noise: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Bound, and its slopes in means and log spreads, by the mean over draws; the divergence from a standard normal is exact."""
        found = self.at_each([mean + spread * z for z in noise])
        bound = np.mean([f[0] for f in found]) - 0.5 * (spread**2 - 1 - 2 * np.log(spread) + mean**2).sum()
        by_mean = np.mean([f[1] for f in found], axis=0) - mean
        by_spread = np.mean([f[1] * z * spread for f, z in zip(found, noise)], axis=0) - (spread**2 - 1)
        return float(bound), by_mean, by_spread

    def curvature(self, mean: np.ndarray, probes: np.ndarray, step: float = 1e-5) -> tuple[float, float]:
        """Log likelihood at the means and z' J' H J z averaged over probes: J takes points to lengths with the order of joins held, H is the likelihood's curvature in lengths, by a forward difference of slopes."""
        d = distance_matrix(mean, self.scale)
        tree = G.JoinedTree(self.names, d)
        value, slope, _ = G.model_slopes(tree, self.codes, self.counts, self.model)
        total = 0.0
        for z in probes:
            cross = mean @ z.T
            own = np.diag(cross)
            move = np.divide(own[:, None] + own[None, :] - cross - cross.T, d * self.scale**2, out=np.zeros_like(d), where=d > G.LEAST_DISTANCE)
            v = tree.forth(move)
            _, moved, _ = G.model_slopes(tree, self.codes, self.counts, self.model, lengths=tree.lengths + step * v)
            total += float(v @ np.where(slope != 0, moved - slope, 0.0)) / step
        return value, total / len(probes)


def _target(p: pd.DataFrame, s: pd.DataFrame, model: str) -> tuple[list, np.ndarray, _Target] | None:
    """Null where there are fewer than three taxa; the middle distance becomes half a substitution a site. A taxon that only one side has is an error."""
    rows = dict(zip(s["taxon"], s["codes"]))
    alone = sorted(set(p["taxon"]) ^ set(rows))
    if alone:
        raise ValueError(f"taxon {alone[0]} has not both points and a sequence")
    p = p.sort_values("taxon")
    names = p["taxon"].tolist()
    if len(names) < 3:
        return None
    mean = np.stack(p["x"].to_list())
    scale = float(np.median(distance_matrix(mean, 1.0)[np.triu_indices(len(names), 1)])) / 0.5 or 1.0
    return names, mean, _Target(names, np.stack([rows[n] for n in names]), scale, model)


def fit(points: DataFrame, sequences: DataFrame, config: AnalysisConfig = AnalysisConfig(), most: int | None = None, start: float = -3.0, seed: int = 1) -> DataFrame:
    """Fit a normal around the points of each data set: ``ds, step, elbo, log_sigma, taxon, x, log_sigmas``.

    Stochastic ascent with Adam on exact slopes of mirrored draws, cut at twice
    the moving average of their norms (7 at least). One spread for all
    coordinates, or one for each with ``Covariance.DIAG``; other forms, and
    options of the analysis that the fit does not know, raise ``NotImplementedError``. From ``least_batches`` steps on it ends with the
    first block of steps that does not improve on the block before, or after
    ``most`` steps if that is given. A bound lies below zero, and a block after
    which the fit goes on is better by a five-hundredth. The history has a row
    a step and null taxa; the rows of the taxa are those of the block's end, or
    start, with the best bound over one fixed set of draws. Data sets with
    fewer than three taxa give no rows.
    """
    if config.covariance not in (Covariance.CONST, Covariance.DIAG):
        raise NotImplementedError(f"no fit with covariance {config.covariance.value}")
    ignored = [n for n in ("hyperbolic", "radial_flow", "planar_flow", "ultrametric", "tree_prior", "relaxed_clock", "migration") if getattr(config, n)]
    if ignored:
        raise NotImplementedError(f"no fit with {', '.join(ignored)}")
    alone, model = config.covariance is Covariance.DIAG, "barcode" if config.crispr else "jc"
    columns = ["ds", "step", "elbo", "log_sigma", "taxon", "x", "log_sigmas"]

    def each(p: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        known = _target(p, s, model)
        if known is None:
            return pd.DataFrame({c: [] for c in columns})
        names, mean, target = known
        ds = int(p["ds"].iloc[0])
        rng = np.random.default_rng([seed, ds])
        half = -(-config.batch_size // 2)

        def noise() -> np.ndarray:
            z = rng.standard_normal((half, *mean.shape))
            return np.concatenate([z, -z])[: config.batch_size]

        spreads = lambda t: np.broadcast_to(np.exp(t[1]), mean.shape)
        theta = [mean, np.full(mean.shape if alone else (), start)]
        fixed = noise()
        best, kept = target.batch(theta[0], spreads(theta), fixed)[0], theta
        history = [(ds, 0, best, start, None, None, None)]
        m, v, norm, sums, block = [0.0, 0.0], [0.0, 0.0], None, [], 0.0
        for t in itertools.count(1) if most is None else range(1, most + 1):
            bound, *g = target.batch(theta[0], spreads(theta), noise())
            if not alone:
                g[1] = np.asarray(g[1].sum())
            size = float(np.sqrt(sum((a * a).sum() for a in g)))
            norm = size if norm is None else 0.98 * norm + 0.02 * size
            cut = min(1.0, max(2 * norm, 7.0) / max(size, 1e-300))
            for k in range(2):
                m[k] = 0.9 * m[k] + 0.1 * cut * g[k]
                v[k] = 0.9 * v[k] + 0.1 * (cut * g[k]) ** 2
            theta = [theta[k] + config.learning_rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.9**t)) + 1e-8) for k in range(2)]
            history.append((ds, t, bound, float(np.mean(theta[1])), None, None, None))
            block += bound
            if t % config.block == 0:
                now = target.batch(theta[0], spreads(theta), fixed)[0]
                if now > best:
                    best, kept = now, theta
                sums.append(block)
                block = 0.0
                if t >= config.least_batches and len(sums) > 1 and not 1.001 * sums[-1] > 0.999 * sums[-2]:
                    break
        each_spread = np.broadcast_to(kept[1], mean.shape)
        rows = history + [(ds, t + 1, best, float(np.mean(kept[1])), int(n), x.tolist(), w.tolist()) for n, x, w in zip(names, kept[0], each_spread)]
        return pd.DataFrame(rows, columns=columns).astype({"taxon": "Int64"})

    return _together(points, sequences).applyInPandas(each, "ds long, step int, elbo double, log_sigma double, taxon long, x array<double>, log_sigmas array<double>")


def taylor_bound(points: DataFrame, sequences: DataFrame, sigma: float = 0.05, probes: int = 10, model: str = "jc", seed: int = 1) -> DataFrame:
    """Second-order lower bound around the points of each data set: ``ds, value, trace, bound``.

    The mean of the likelihood over draws is its value at the points and half
    the trace of curvature times variance, which probes estimate.
    """

    def each(p: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        known = _target(p, s, model)
        if known is None:
            return pd.DataFrame({"ds": [], "value": [], "trace": [], "bound": []})
        _, mean, target = known
        ds = int(p["ds"].iloc[0])
        z = np.random.default_rng([seed, ds]).standard_normal((probes, *mean.shape))
        value, bend = target.curvature(mean, z)
        trace = sigma * sigma * bend
        bound = value + 0.5 * trace - 0.5 * (mean.size * (sigma**2 - 1 - 2 * math.log(sigma)) + (mean**2).sum())
        return pd.DataFrame({"ds": [ds], "value": [value], "trace": [trace], "bound": [bound]})

    return _together(points, sequences).applyInPandas(each, "ds long, value double, trace double, bound double")


def _together(points: DataFrame, sequences: DataFrame):
    return by_data_set(points, "taxon", "x").cogroup(by_data_set(sequences, "taxon", "codes"))


def fitted_points(fits: DataFrame) -> DataFrame:
    """``ds, taxon, x, log_sigmas`` of the rows of :func:`fit` that are its result."""
    return fits.where("taxon IS NOT NULL").select("ds", "taxon", "x", "log_sigmas")


def fitted_draws(fits: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """Draws from the fitted normals, each coordinate with its spread."""
    p = fitted_points(fits)
    standard = draws(p.withColumn("x", F.transform("x", lambda v: F.lit(0.0))), n, F.lit(1.0), seed).withColumnRenamed("x", "z")
    return standard.join(p, ["ds", "taxon"]).select("ds", "sample", "taxon", F.expr("transform(x, (v, d) -> v + exp(log_sigmas[d]) * z[d])").alias("x"))
