"""Eigenpairs of symmetric matrices that stand in tables, and what rests on them: initial points in both geometries and covariances from distances.

A matrix is ``ds, i, j, b`` with i <= j, one for each data set; none has to fit
a task. Products with a block of vectors are joins and grouped sums. The blocks
so made span a growing space (block Krylov), orthogonal by two passes of
grouped sums, and the eigenpairs of the matrix within that space come from its
few numbers, a row for each data set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewise.functions import scalars as S
from cladewise.operators import distances as D
from cladewise.plans.config import AnalysisConfig
from cladewise.sources.shared import release, stored

MORE, STEPS, TOLERANCE = 4, 24, 1e-7
#: What a covariance from distances adds to make its least eigenvalue positive.
MARGIN = 1e-6
_ROUNDING = 1e-14
#: Rows of a data set that meet its matrices at once.
BLOCK = 512


def _orthonormal(gram: np.ndarray, scale: float) -> np.ndarray:
    """Columns T for which W T is orthonormal, from W'W; directions that are mere rounding against ``scale`` give zeros."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    kept = values > _ROUNDING * max(scale, values[-1], 1e-300)
    return vectors * np.where(kept, 1.0 / np.sqrt(np.where(kept, values, 1.0)), 0.0)


def _within(h: np.ndarray, m: int, p: int, k: int, least: bool) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest or least eigenpairs of the matrix within the basis, from Q'BQ block column by block column; vectors of zeros in the basis take no part."""
    whole, at = np.zeros((m, m)), 0
    for right in range(p, m + 1, p):
        whole[:right, right - p : right] = h[at : at + right * p].reshape(right, p)
        at += right * p
    whole = np.triu(whole) + np.triu(whole, 1).T
    live = np.flatnonzero(np.abs(whole).sum(0) > 0)
    values, vectors = np.zeros(k), np.zeros((m, k))
    if len(live):
        found, turned = np.linalg.eigh(whole[np.ix_(live, live)])
        order = (np.arange(len(found)) if least else np.arange(len(found))[::-1])[:k]
        values[: len(order)] = found[order]
        vectors[np.ix_(live, np.arange(len(order)))] = turned[:, order]
    return values, vectors


def _algebra(p: int, k: int, least: bool):
    """Per data set: the columns that make the new block orthonormal, the eigenpairs so far, and how far they are off, against the greatest."""

    @F.pandas_udf("t array<double>, values array<double>, vectors array<double>, off double")
    def each(h: pd.Series, c: pd.Series, g: pd.Series) -> pd.DataFrame:
        rows = []
        for all_h, own, gram in zip(h, c, g):
            own, gram = np.asarray(own, float).reshape(-1, p), np.asarray(gram, float).reshape(p, p)
            rest = gram - own.T @ own
            t = _orthonormal(rest, float(np.trace(gram)))
            values, vectors, off = np.zeros(k), np.zeros((len(own), k)), 0.0
            if len(all_h):
                values, vectors = _within(np.asarray(all_h, float), len(own), p, k, least)
                last = vectors[-p:]
                far = np.einsum("ak,ab,bk->k", last, rest, last).max()
                size = max(float(np.trace(gram)), float(np.abs(values).max()) ** 2)
                off = float(np.sqrt(max(0.0, far) / size)) if size > 0 else 0.0
            rows.append((t.ravel(), values, vectors.ravel(), off))
        return pd.DataFrame(rows, columns=["t", "values", "vectors", "off"])

    return each


def _blocks(column: pa.Array) -> np.ndarray:
    """Arrays of one length as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _products(rows: DataFrame, left: str, right: str, name: str) -> DataFrame:
    """``ds`` and the sums over rows of all products of an element of ``left`` with one of ``right``, one after the other.

    A batch of rows gives one sum for each data set in it; these few are added up.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ds = batch.column(0).to_numpy()
            order = np.argsort(ds, kind="stable")
            a, b = _blocks(batch.column(1))[order], _blocks(batch.column(2))[order]
            names, first = np.unique(ds[order], return_index=True)
            ends = [*first[1:], len(order)]
            for n, start, end in zip(names, first, ends):
                sums = (a[start:end].T @ b[start:end]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([sums], pa.list_(pa.float64()))], names=["ds", "v"])

    parts = rows.select(F.col("ds").cast("long").alias("ds"), F.col(left).alias("l"), F.col(right).alias("r")).mapInArrow(each, "ds long, v array<double>")
    added = F.aggregate(F.slice("all", F.lit(2), F.size("all")), F.get("all", F.lit(0)), lambda x, y: F.zip_with(x, y, lambda u, v: u + v))
    return parts.groupBy("ds").agg(F.collect_list("v").alias("all")).select("ds", added.alias(name))


def _applied(rows: DataFrame, small: DataFrame, matrices: list[str], kept: list[str], name: str, f: Callable[..., np.ndarray]) -> DataFrame:
    """``ds, i``, the columns ``kept`` and ``name``: ``f`` of a block of rows' ``q`` and ``w`` and of their data set's ``matrices``, which stand row by row.

    A block has the rows of a data set whose numbers lie within one run of :data:`BLOCK`, so a data set may have any number of rows.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = [c for c in ("q", "w") if c in rows.columns]
    placed = rows.select("ds", "i", *parts, F.floor(F.col("i") / BLOCK).alias("block"))
    known = placed.select("ds", "block").distinct().join(small.select("ds", *matrices), "ds")
    types = {x.name: x.dataType.simpleString() for x in rows.schema}
    schema = ", ".join([f"ds {types['ds']}", f"i {types['i']}", *[f"{c} array<double>" for c in kept], f"{name} array<double>"])

    def each(r: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if not len(r) or not len(s):
            return pd.DataFrame({c: [] for c in ("ds", "i", *kept, name)})
        made = f(*[np.stack(r[c].to_list()) for c in parts], *[np.asarray(s[c].iloc[0], float) for c in matrices])
        return r[["ds", "i", *kept]].assign(**{name: list(made)})

    spread = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns]).repartition(n, "ds", "block").groupBy("ds", "block")
    return spread(placed).cogroup(spread(known)).applyInPandas(each, schema)


def _small(rows: DataFrame, before: DataFrame | None, m: int, p: int, k: int, least: bool, product: bool = True) -> DataFrame:
    """``ds, h, c, t, values, vectors, off`` from a basis ``q`` of ``m`` columns and a block ``w``, which is the ``product`` of the matrix with the basis' last block, or a block that is to be made orthogonal once more."""
    found = _products(rows, "w", "w", "g")
    none = F.array().cast("array<double>")
    found = found.join(_products(rows, "q", "w", "c"), "ds") if m else found.withColumn("c", none)
    found = found.join(before.select("ds", "h"), "ds") if before is not None else found.withColumn("h", none)
    found = found.withColumn("h", F.concat("h", "c") if product else none).withColumn("s", _algebra(p, k, least)("h", "c", "g"))
    return stored(found.select("ds", "h", "c", "s.*"))


def _extended(rows: DataFrame, small: DataFrame, m: int, p: int, k: int, least: bool) -> DataFrame:
    """The basis with the block, made orthogonal to it and within itself by two passes."""
    for last in (False, True):
        moved = _applied(rows, small, ["c", "t"], ["q"], "w", lambda q, w, c, t: (w - q @ c.reshape(m, p)) @ t.reshape(p, p))
        if last:
            return stored(moved.select("ds", "i", F.concat("q", "w").alias("q")))
        rows = stored(moved)
        small = _small(rows, None, m, p, k, least, product=False)
    raise AssertionError


def eigenpairs(matrix: DataFrame, k: int, least: bool = False, block: int | None = None, steps: int = STEPS, tolerance: float = TOLERANCE, seed: int = 1) -> DataFrame:
    """``ds, i, v, values, off``: components of the ``k`` greatest (or ``least``) eigenpairs of each ``matrix(ds, i, j, b)``, i <= j, and the eigenvalues.

    Blocks are wider than ``k``, so equal eigenvalues are all found. Rounds end
    when every data set's residuals are below ``tolerance`` of its matrix, or
    after ``steps``; ``off`` says what residual is left. A matrix with fewer
    than ``k`` rows has zeros for the pairs that it lacks. Signs are free.
    """
    p = block or k + MORE
    turned = matrix.where("i <> j").select("ds", F.col("j").alias("i"), F.col("i").alias("j"), "b")
    both = stored(matrix.select("ds", "i", "j", "b").unionByName(turned).repartition("ds", "i").sortWithinPartitions("ds", "i"))
    axes = F.sequence(F.lit(0), F.lit(p - 1))
    start = both.select("ds", "i").distinct().select("ds", "i", F.array().cast("array<double>").alias("q"), F.transform(axes, lambda a: S.normal(F.lit(seed), F.col("ds"), F.col("i"), a)).alias("w"))
    rows = stored(start)
    basis = _extended(rows, _small(rows, None, 0, p, k, least), 0, p, k, least)
    small = None
    for step in range(1, steps + 1):
        m = step * p
        block_of = basis.select("ds", F.col("i").alias("j"), F.slice("q", m - p + 1, F.lit(p)).alias("v"))
        made = both.join(block_of, ["ds", "j"]).groupBy("ds", "i").agg(F.array(*[F.sum(F.col("b") * F.get("v", F.lit(a))) for a in range(p)]).alias("w"))
        rows = stored(basis.join(made, ["ds", "i"]))
        small, old = _small(rows, small, m, p, k, least), small
        if old is not None:
            release(old)
        if step == steps or (small.agg(F.max("off")).first()[0] or 0.0) <= tolerance:
            break
        basis, old = _extended(rows, small, m, p, k, least), basis
        release(old, rows)
    found = _applied(rows.select("ds", "i", "q"), small, ["vectors"], [], "v", lambda q, vectors: q @ vectors.reshape(m, k))
    return found.join(small.select("ds", "values", "off"), "ds").select("ds", "i", "v", "values", "off")


def _placed(pairs: DataFrame, k: int, sign: int) -> DataFrame:
    """Components times the roots of eigenvalues (of those of the other sign: zero); each axis points to the side of its greatest coordinate, of equals that of the smallest number."""
    scaled = pairs.select("ds", "i", F.zip_with("v", "values", lambda v, e: v * F.sqrt(F.greatest(F.lit(0.0), sign * e))).alias("x"))
    scaled = stored(scaled)
    side = [F.max_by(F.signum(F.get("x", F.lit(a))), F.struct(F.round(F.abs(F.get("x", F.lit(a))), 9), -F.col("i"))) for a in range(k)]
    sides = scaled.groupBy("ds").agg(F.array(*side).alias("s"))
    return scaled.join(sides, "ds").select("ds", F.col("i").alias("taxon"), F.zip_with("x", "s", lambda v, s: F.when(s < 0, -v).otherwise(v)).alias("x"))


def embed(distances: DataFrame, config: AnalysisConfig = AnalysisConfig(), block: int | None = None) -> DataFrame:
    """``ds, taxon, x`` from ``distances(ds, i, j, d)``, as :func:`cladewise.operators.embedding.embed` gives them, but for data sets of any size."""
    k = config.dimensionality
    if not config.curved:
        return _placed(eigenpairs(D.double_centre(distances), k, block=block), k, 1)
    off = distances.select("ds", "i", "j", F.cosh(config.curvature**0.5 * F.col("d")).alias("b"))
    own = D.ends(distances).select("ds", "i", F.col("i").alias("j"), F.lit(1.0).alias("b")).distinct()
    return _placed(eigenpairs(off.unionByName(own), k, least=True, block=block), k, -1)


def distance_covariance(distances: DataFrame, scale: float = 1.0) -> DataFrame:
    """``ds, i, j, b``, i <= j: a covariance of taxa from their distances.

    That is minus half of the distances without row, column and whole means. It
    is known but for a multiple of the identity: unless its least eigenvalue is
    above rounding, as much is added as makes that :data:`MARGIN`. Then the mean
    of the diagonal is set to ``scale``.
    """
    centred = stored(D.double_centre(distances.withColumn("d", F.sqrt("d"))))
    least = eigenpairs(centred, 1, least=True, block=16).groupBy("ds").agg(F.first(F.get("values", F.lit(0))).alias("least"))
    diagonal = centred.where("i = j").groupBy("ds").agg(F.sum("b").alias("trace"), F.count(F.lit(1)).alias("n"), F.max("b").alias("top"))
    added = F.when(F.col("least") <= 1e-9 * F.greatest(F.lit(1.0), F.col("top")), MARGIN - F.least(F.lit(0.0), F.round("least", 9))).otherwise(0.0)
    known = diagonal.join(least, "ds").withColumn("added", added).select("ds", "added", (scale * F.col("n") / (F.col("trace") + F.col("n") * F.col("added"))).alias("factor"))
    return centred.join(known, "ds").select("ds", "i", "j", (F.col("factor") * (F.col("b") + F.when(F.col("i") == F.col("j"), F.col("added")).otherwise(0.0))).alias("b"))
