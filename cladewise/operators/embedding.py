"""Points whose distances come close to given ones, one data set a group, and distances by the geometry of an analysis."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from cladewise.operators import distances as D
from cladewise.operators.inference import _square, by_data_set
from cladewise.plans.config import AnalysisConfig


def classical(d: np.ndarray, dims: int) -> np.ndarray:
    """Classical scaling: the ``dims`` greatest eigenpairs of the double-centred squares; those below zero give zeros."""
    square = d * d
    b = -0.5 * (square - square.mean(0) - square.mean(1)[:, None] + square.mean())
    values, vectors = np.linalg.eigh(b)
    at = np.argsort(values)[::-1][:dims]
    x = vectors[:, at] * np.sqrt(np.maximum(0.0, values[at]))
    return np.pad(x, ((0, 0), (0, dims - x.shape[1])))


def hyperboloid(d: np.ndarray, dims: int, curvature: float = 1.0) -> np.ndarray:
    """Spatial coordinates on the hyperboloid: the ``dims`` least eigenpairs of the matrix of hyperbolic cosines, which are below zero where the distances fit."""
    values, vectors = np.linalg.eigh(np.cosh(np.sqrt(curvature) * d))
    x = vectors[:, :dims] * np.sqrt(np.maximum(0.0, -values[:dims]))
    return np.pad(x, ((0, 0), (0, dims - x.shape[1])))


def embed(distances: DataFrame, config: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """``ds, taxon, x`` from ``distances(ds, i, j, d)``, in the space that the analysis names; each axis points to the side of its greatest coordinate."""

    def each(pairs: pd.DataFrame) -> pd.DataFrame:
        names, d = _square(pairs)
        x = hyperboloid(d, config.dimensionality, config.curvature) if config.curved else classical(d, config.dimensionality)
        side = np.sign(x[np.abs(x).argmax(0), np.arange(x.shape[1])])
        return pd.DataFrame({"ds": pairs["ds"].iloc[0], "taxon": names, "x": (x * np.where(side == 0, 1, side)).tolist()})

    return by_data_set(distances, "i", "j", "d").applyInPandas(each, "ds long, taxon long, x array<double>")


def point_distances(points: DataFrame, config: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """Distances in the space that the analysis names."""
    return D.hyperbolic(points, config.curvature) if config.curved else D.euclidean(points)
