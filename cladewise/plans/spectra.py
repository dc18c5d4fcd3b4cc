"""Registered queries of initial points by eigenpairs in tables and of covariances from distances, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladewise.operators import distances, dump, spectral
from cladewise.plans import fixtures as X
from cladewise.plans.config import AnalysisConfig
from cladewise.plans.queries import EUCLIDEAN
from cladewise.plans.registry import query, r, rounded
from cladewise.sources.shared import stored

_CENTRED = f"""{EUCLIDEAN}, u AS (SELECT ds, i, j, d FROM d UNION ALL SELECT ds, j, i, d FROM d UNION ALL SELECT ds, taxon, taxon, 0.0 FROM points),
m AS (SELECT ds, i, avg(d) AS m FROM u GROUP BY ds, i), w AS (SELECT ds, avg(m) AS w, count(*) AS n FROM m GROUP BY ds HAVING count(*) > 1),
b AS (SELECT u.ds, u.i, u.j, n, -0.5 * (u.d - a.m - c.m + w.w) + CASE WHEN u.i = u.j THEN 1e-6 ELSE 0 END AS b FROM u JOIN m a ON a.ds = u.ds AND a.i = u.i JOIN m c ON c.ds = u.ds AND c.i = u.j JOIN w ON w.ds = u.ds WHERE u.i <= u.j),
t AS (SELECT ds, any_value(n) / sum(b) AS f FROM b WHERE i = j GROUP BY ds)"""


@query(f"WITH {_CENTRED} SELECT b.ds, i, j, {r('f * b', 'b')} FROM b JOIN t ON t.ds = b.ds")
def distance_covariance(spark, sf_dir):
    """Covariance of the taxa from their distances: centred, made positive by its least eigenvalue, with a mean variance of one."""
    return rounded(spectral.distance_covariance(distances.euclidean(X.points(spark, sf_dir))), "b")


@query(f"WITH {EUCLIDEAN} SELECT ds, i, j, {r('d', 'd')} FROM d")
def scaling_round_trip(spark, sf_dir):
    """Distances between points that were placed by nothing but distances: in as many dimensions as the first points had, none is lost."""
    p = X.points(spark, sf_dir)
    dims = p.agg(F.max(F.size("x"))).first()[0] or 1
    placed = spectral.embed(distances.euclidean(p), AnalysisConfig(dimensionality=dims))
    return rounded(distances.euclidean(placed), "d")


@query()
def spectral_embedding(spark, sf_dir):
    """First points of an analysis, by the five greatest eigenpairs."""
    return spectral.embed(distances.euclidean(X.points(spark, sf_dir)), AnalysisConfig(dimensionality=5))


def _text(v: str) -> str:
    return f"format('{{:.6f}}', round({v}, 6) + 0.0)"


@query(f"""WITH {_CENTRED}, full_ AS (SELECT b.ds, i, j, f * b AS b FROM b JOIN t ON t.ds = b.ds UNION ALL SELECT b.ds, j, i, f * b FROM b JOIN t ON t.ds = b.ds WHERE i <> j)
SELECT ds, 'head' AS section, CAST(0 AS BIGINT) AS row, 'DIST taxa ' || n || ' dimensions 64 lambda 1.000000' AS line FROM w
UNION ALL SELECT ds, 'parameters', CAST(0 AS BIGINT), '0.000000' FROM w
UNION ALL SELECT u.ds, 'distances', i, string_agg({_text('d')}, ' ' ORDER BY j) FROM u JOIN w ON w.ds = u.ds GROUP BY u.ds, i
UNION ALL SELECT ds, 'pseudo', i, string_agg({_text('b')}, ' ' ORDER BY j) FROM full_ GROUP BY ds, i""")
def covariance_dump(spark, sf_dir):
    """Text of every data set's covariance from distances."""
    d = stored(distances.euclidean(X.points(spark, sf_dir)))
    start = d.select("ds").distinct().select("ds", F.lit(0).alias("place"), F.lit(0.0).alias("value"))
    return dump.covariance(d, 64, "DIST", start, pseudo=spectral.distance_covariance(d))
