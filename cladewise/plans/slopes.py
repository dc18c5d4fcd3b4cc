"""Registered queries of slopes, traces and what they need, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladewise.functions import scalars as S
from cladewise.operators import distances, gradients, inference, posterior, states, trees
from cladewise.plans import fixtures as X
from cladewise.plans.config import AnalysisConfig
from cladewise.plans.queries import _MOVE, _PAIRS, _STAY, EUCLIDEAN, INSIDE, MOMENTS, SPREAD, _moments, _normal_sql, _splits_sql
from cladewise.plans.registry import query, r, rounded

# Points pull towards distances of one: the slope of a pair is what its distance lacks.
_CURVED = AnalysisConfig(hyperbolic=True, curvature=4.0)
_ENDS = "ends AS (SELECT ds, i AS taxon, j AS other, g FROM g UNION ALL SELECT ds, j, i, g FROM g)"
_FLAT = f"""{EUCLIDEAN}, g AS (SELECT ds, i, j, (1 - d) / d AS g FROM d WHERE d > 1e-9), {_ENDS},
c AS (SELECT ds, taxon, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS dim FROM points),
s AS (SELECT e.ds, e.taxon, a.dim, sum(g * (a.v - b.v)) AS slope FROM ends e JOIN c a ON a.ds = e.ds AND a.taxon = e.taxon JOIN c b ON b.ds = e.ds AND b.taxon = e.other AND b.dim = a.dim GROUP BY ALL)"""


def _spread(spark, sf_dir):
    """Points by data sets over all shuffle partitions: their pairs are far more than their bytes say."""
    return X.points(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "ds")


def _pull(spark, sf_dir):
    p = _spread(spark, sf_dir)
    d = distances.euclidean(p, carry=True).withColumn("g", 1 - F.col("d"))
    return gradients.point_slopes(d, p)


@query(f"WITH {_FLAT} SELECT ds, taxon, CAST(dim AS INTEGER) AS dim, {r('slope', 'slope')} FROM s")
def point_slopes(spark, sf_dir):
    """Slopes in the points' coordinates of half the squared lack of all distances."""
    return rounded(_pull(spark, sf_dir), "slope")


@query(f"WITH {_FLAT}, {MOMENTS.replace('e AS', 'mv AS').replace('FROM e', 'FROM mv')} SELECT s.ds, taxon, CAST(s.dim AS INTEGER) AS dim, {r('slope * greatest(variance, 1e-3)', 'slope')} FROM s JOIN m ON m.ds = s.ds AND m.dim = s.dim")
def natural_slopes(spark, sf_dir):
    """Those slopes in the metric of a normal distribution with the axes' variances, none below the floor."""
    variance = _moments(X.points(spark, sf_dir)).select("ds", "dim", F.greatest("variance", F.lit(1e-3)).alias("variance"))
    return rounded(gradients.natural_slopes(_pull(spark, sf_dir).join(variance, ["ds", "dim"]), F.col("variance")).drop("variance").select("ds", "taxon", "dim", "slope"), "slope")


@query(f"""WITH {X.POINTS}, t AS (SELECT ds, taxon, x, sqrt(1 + list_inner_product(x, x)) AS t FROM points),
u AS (SELECT a.ds, a.taxon AS i, b.taxon AS j, a.t * b.t - list_inner_product(a.x, b.x) AS u FROM t a JOIN t b ON a.ds = b.ds AND a.taxon < b.taxon),
g AS (SELECT ds, i, j, 1 / sqrt(greatest(u - 1, 1e-18) * (greatest(u - 1, 1e-18) + 2)) / 2 AS g FROM u), {_ENDS},
c AS (SELECT ds, taxon, t, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS dim FROM t)
SELECT e.ds, e.taxon, CAST(a.dim AS INTEGER) AS dim, {r('sum(g * (b.t / a.t * a.v - b.v))', 'slope')} FROM ends e JOIN c a ON a.ds = e.ds AND a.taxon = e.taxon JOIN c b ON b.ds = e.ds AND b.taxon = e.other AND b.dim = a.dim GROUP BY e.ds, e.taxon, a.dim""")
def curved_point_slopes(spark, sf_dir):
    """Slopes in the points' coordinates of the sum of all hyperbolic distances."""
    p = _spread(spark, sf_dir)
    every = distances.pairs(p, "ds", "taxon", "x").withColumn("g", F.lit(1.0))
    return rounded(gradients.point_slopes(every, p, _CURVED), "slope")


@query(f"""WITH {X.POINTS}, e AS (SELECT ds, taxon, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS dim FROM points),
z AS (SELECT ds, probe, dim, {_normal_sql('1', 'ds', 'probe', 'dim')} AS z FROM (SELECT DISTINCT ds, dim FROM e) t CROSS JOIN (SELECT unnest(range(10)) AS probe) p),
a AS (SELECT e.ds, probe, taxon, sum(v * z) AS along FROM e JOIN z ON z.ds = e.ds AND z.dim = e.dim GROUP BY ALL), q AS (SELECT ds, probe, sum(along * along) AS value FROM a GROUP BY ds, probe)
SELECT ds, {r('avg(value)', 'trace')}, {r('stddev_samp(value)', 'spread')} FROM q GROUP BY ds""")
def probe_traces(spark, sf_dir):
    """Trace of each data set's matrix of inner products, estimated by ten probes."""
    return rounded(gradients.traces(X.points(spark, sf_dir).withColumnRenamed("taxon", "row")), "trace", "spread")


# --- flows: slopes of the log density of a standard normal at the image, and the determinant -----

_RADIAL = f"""{X.POINTS}, a AS (SELECT ds, taxon, x, sqrt(list_inner_product(x, x)) AS rad FROM points), h AS (SELECT *, 1 / (1.0 + rad / 5.0) AS h FROM a),
k AS (SELECT *, 1 + 2 * h AS near, 1 + 2 * h - 2 * h * h / 5 * rad AS far, -(1 + 2 * h) * rad * rad AS along, len(x) - 1 AS m FROM h),
s AS (SELECT *, -2 * h * h / 5 * along + m * (-2 * h * h / 5) / near + 2 * (-2 * h * h / 5 + 2 * h * h * h / 25 * rad) / far AS by_radius FROM k)"""


@query(f"""WITH {_RADIAL} SELECT ds, taxon, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS dim, round(unnest(list_transform(x, lambda v: -near * near * v + v * by_radius / rad)), 6) + 0.0 AS slope,
{r('-2 * h * h * along - m * 2 * h * h / near + 2 * (2 * h * h * h * rad / 5 - h * h) / far', 'by_alpha')}, {r('h * along + m * h / near + (h - h * h / 5 * rad) / far', 'by_beta')} FROM s WHERE rad > 0""")
def radial_flow_slopes(spark, sf_dir):
    """Slopes in points, alpha and beta of the log density at the image of a radial flow."""
    p = X.points(spark, sf_dir).where(S.dot(F.col("x"), F.col("x")) > 0)
    image, _ = S.radial_flow(F.col("x"), 1.0, 2.0, 5.0)
    g = p.withColumn("g", F.transform(image, lambda v: -v))
    back, by_alpha, by_beta = S.radial_flow_back(F.col("x"), F.col("g"), 1.0, 2.0, 5.0)
    found = g.select("ds", "taxon", F.posexplode(back).alias("dim", "slope"), by_alpha.alias("by_alpha"), by_beta.alias("by_beta"))
    return rounded(found, "slope", "by_alpha", "by_beta")


_PLANAR = f"""{X.POINTS}, e AS (SELECT ds, taxon, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS dim FROM points),
f AS (SELECT *, CASE WHEN dim % 2 = 0 THEN 0.3 ELSE 0.1 END AS u, CASE WHEN dim % 2 = 0 THEN 0.5 ELSE 0.0 END AS w FROM e),
t AS (SELECT ds, taxon, tanh(sum(v * w) + 0.25) AS t, CAST(sum(w * u) AS DOUBLE) AS wu FROM f GROUP BY ds, taxon), g AS (SELECT f.*, t, wu, -(v + u * t) AS g FROM f JOIN t ON t.ds = f.ds AND t.taxon = f.taxon),
a AS (SELECT ds, taxon, (1 - any_value(t) * any_value(t)) * sum(g * u) - 2 * any_value(t) * (1 - any_value(t) * any_value(t)) * any_value(wu) / (1 + (1 - any_value(t) * any_value(t)) * any_value(wu)) AS al FROM g GROUP BY ds, taxon)"""


@query(f"""WITH {_PLANAR} SELECT g.ds, g.taxon, CAST(dim AS INTEGER) AS dim, {r('CAST(g + w * al AS DOUBLE)', 'slope')}, {r('CAST(g * t + (1 - t * t) * w / (1 + (1 - t * t) * wu) AS DOUBLE)', 'by_u')}, {r('CAST(v * al + (1 - t * t) * u / (1 + (1 - t * t) * wu) AS DOUBLE)', 'by_w')}, {r('CAST(al AS DOUBLE)', 'by_b')} FROM g JOIN a ON a.ds = g.ds AND a.taxon = g.taxon""")
def planar_flow_slopes(spark, sf_dir):
    """Slopes in points and all parameters of the log density at the image of a planar flow."""
    even = lambda a, b: lambda d: F.when(d % 2 == 0, F.lit(a)).otherwise(F.lit(b))
    image, _ = S.planar_flow(F.col("x"), even(0.3, 0.1), even(0.5, 0.0), 0.25)
    entries = lambda f: F.transform("x", lambda v, d: f(d))
    p = X.points(spark, sf_dir).select("ds", "taxon", "x", F.transform(image, lambda v: -v).alias("g"), entries(even(0.3, 0.1)).alias("u"), entries(even(0.5, 0.0)).alias("w"))
    back, by_u, by_w, by_b = S.planar_flow_back(F.col("x"), F.col("g"), F.col("u"), F.col("w"), 0.25)
    found = p.select("ds", "taxon", F.posexplode(F.arrays_zip(back.alias("slope"), by_u.alias("by_u"), by_w.alias("by_w"))).alias("dim", "z"), by_b.alias("by_b"))
    return rounded(found.select("ds", "taxon", "dim", "z.slope", "z.by_u", "z.by_w", "by_b"), "slope", "by_u", "by_w", "by_b")


# --- states on trees ---------------------------------------------------------

_E = "exp(-greatest({0}, 1e-6) * 5 / 4.0)"
MARGINALS = f"""{INSIDE}, qr AS (SELECT rm.tree, rm.a, exp(v - m) / sum(exp(v - m)) OVER (PARTITION BY rm.tree) AS q FROM rm JOIN rt ON rt.tree = rm.tree),
y0 AS (SELECT ym.tree, ym.node, ym.a, t.length, exp(ym.v - yt.m) AS l, yt.total, q / ({_MOVE.format('t.length')} * yt.total + {_E.format('t.length')} * exp(ym.v - yt.m)) AS w
  FROM ym JOIN yt ON yt.tree = ym.tree AND yt.node = ym.node JOIN trees t ON t.tree = ym.tree AND t.node = ym.node JOIN qr ON qr.tree = ym.tree AND qr.a = ym.a),
y1 AS (SELECT *, sum(w) OVER (PARTITION BY tree, node) AS ws FROM y0),
qy AS (SELECT tree, node, a, l * ({_E.format('length')} * w + {_MOVE.format('length')} * ws) AS q, {_E.format('length')} / 4 * total * w - 5.0 / 4 * {_E.format('length')} * w * l AS part FROM y1),
l0 AS (SELECT lf.tree, lf.node, lf.length, lf.s, g.a, q / CASE WHEN g.a = lf.s THEN {_STAY.format('lf.length')} ELSE {_MOVE.format('lf.length')} END AS w FROM lf JOIN qy g ON g.tree = lf.tree AND g.node = lf.parent),
every AS (SELECT tree, 'R' AS node, max(q) AS most, CAST(NULL AS DOUBLE) AS slope FROM qr GROUP BY tree
  UNION ALL SELECT tree, node, max(q), sum(part) FROM qy GROUP BY tree, node
  UNION ALL SELECT tree, node, 1.0, sum({_E.format('length')} / 4 * w - CASE WHEN a = s THEN 5.0 / 4 * {_E.format('length')} * w ELSE 0 END) FROM l0 GROUP BY tree, node)"""


@query(f"WITH {MARGINALS} SELECT tree, node, {r('most', 'most')}, {r('slope', 'slope')} FROM every")
def state_slopes(spark, sf_dir):
    """Slope of every branch of every customer's tree in the likelihood of leaf states, and the share of the likeliest state of its node."""
    found, _ = states.marginals(X.trees(spark, sf_dir), X.leaf_states(spark, sf_dir))
    return rounded(found.select("tree", "node", F.array_max("shares").alias("most"), "slope"), "most", "slope")


@query(f"""WITH {_splits_sql('sp', 'year(o_orderdate)')}, {_splits_sql('sq', 'o_orderpriority')},
b AS (SELECT tree, split, min(is_new) AS is_new FROM (SELECT tree, split, false AS is_new FROM sp UNION ALL SELECT tree, split, true FROM sq) GROUP BY tree, split)
SELECT tree, split, is_new, CAST(row_number() OVER (PARTITION BY tree ORDER BY is_new, split) - 1 AS INTEGER) AS slot FROM b""")
def split_slots(spark, sf_dir):
    """Numbers of the splits of a customer's first tree, and of those that only the second has."""
    return trees.split_slots(trees.splits(X.trees(spark, sf_dir)), trees.splits(X.other_trees(spark, sf_dir)))


@query(f"""WITH {X.TREES}, t AS (SELECT tree, sum(length + 1e-6) AS length FROM trees WHERE parent IS NOT NULL GROUP BY tree)
SELECT tree, {r('length', 'length')}, {r('length / 2', 'scale')}, {r('ln(length) - 2 - 2 * ln(length / 2)', 'log_prior')} FROM t""")
def prior_scale(spark, sf_dir):
    """Gamma prior of tree lengths with the scale that fits each start."""
    return rounded(trees.prior_scale(X.trees(spark, sf_dir)), "length", "scale", "log_prior")


# --- the way back through trees of distances ----------------------------------

@query()
def dna_slopes(spark, sf_dir):
    """Slopes of each alignment's likelihood in lengths, distances and the ratio of transitions."""
    a = X.alignment(spark, sf_dir)
    return rounded(gradients.tree_slopes(distances.jukes_cantor(a), a, "hky"), "value")


@query()
def barcode_slopes(spark, sf_dir):
    """Slopes of each data set's barcode likelihood in lengths, distances, silencing and the leading branch."""
    m = X.cell_rows(spark, sf_dir)
    return rounded(gradients.tree_slopes(distances.poisson(m), m, "barcode"), "value")


@query()
def taylor_bound(spark, sf_dir):
    """Second-order lower bound of each data set around its points."""
    return rounded(posterior.taylor_bound(X.points(spark, sf_dir), X.alignment(spark, sf_dir), SPREAD), "value", "trace", "bound")
