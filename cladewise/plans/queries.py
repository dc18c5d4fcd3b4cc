"""Registered queries and the SQL that gives the same rows. Values are rounded to six decimals on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewise.functions import scalars as S
from cladewise.operators import crispr, distances, inference, newick, posterior, sampling, states, trees
from cladewise.plans import fixtures as X
from cladewise.plans.registry import ORACLE_SQL, QUERIES, query, r, rounded  # noqa: F401
from cladewise.sources.shared import stored

# --- distances -----------------------------------------------------------

_PAIRS = "FROM points a JOIN points b ON a.ds = b.ds AND a.taxon < b.taxon"
EUCLIDEAN = f"{X.POINTS}, d AS (SELECT a.ds, a.taxon AS i, b.taxon AS j, list_distance(a.x, b.x) AS d {_PAIRS})"


@query(f"WITH {EUCLIDEAN} SELECT ds, i, j, {r('d', 'd')} FROM d")
def euclidean_distance(spark, sf_dir):
    return rounded(distances.euclidean(X.points(spark, sf_dir)), "d")


@query(f"""WITH {X.POINTS}, u AS (
  SELECT a.ds, a.taxon AS i, b.taxon AS j, greatest(1.0, sqrt(1 + list_inner_product(a.x, a.x)) * sqrt(1 + list_inner_product(b.x, b.x)) - list_inner_product(a.x, b.x)) AS u {_PAIRS})
SELECT ds, i, j, {r('ln(u + sqrt(u * u - 1))', 'd')} FROM u""")
def hyperbolic_distance(spark, sf_dir):
    return rounded(distances.hyperbolic(X.points(spark, sf_dir)), "d")


def _counts_sql(source: str) -> str:
    return f"""c AS (
  SELECT a.ds, a.taxon AS i, b.taxon AS j,
    len(list_filter(list_zip(a.codes, b.codes), lambda z: z[1] >= 0 AND z[2] >= 0)) AS compared,
    len(list_filter(list_zip(a.codes, b.codes), lambda z: z[1] >= 0 AND z[2] >= 0 AND z[1] <> z[2])) AS differ
  FROM {source} a JOIN {source} b ON a.ds = b.ds AND a.taxon < b.taxon)"""


@query(f"""WITH {X.ALIGNMENT}, {_counts_sql('alignment')}
SELECT ds, i, j, CASE WHEN compared = 0 THEN NULL WHEN CAST(differ AS DOUBLE) / compared >= 0.75 THEN 3.0 ELSE {r('-0.75 * ln(1 - 4.0 * differ / compared / 3)', 'd').removesuffix(' AS d')} END AS d FROM c""")
def jc_distance(spark, sf_dir):
    return rounded(distances.jukes_cantor(X.alignment(spark, sf_dir)), "d")


CELLS = f"""{X.MUTATIONS}, cells AS (
  SELECT c.ds, c.cell AS taxon, list(coalesce(m.state, -1) ORDER BY s.site) AS codes
  FROM (SELECT DISTINCT ds, cell FROM mutations) c CROSS JOIN (SELECT unnest(range({X.SITES})) AS site) s
  LEFT JOIN mutations m ON m.cell = c.cell AND m.site = s.site GROUP BY ALL)"""


@query(f"""WITH {CELLS}, {_counts_sql('cells')}
SELECT ds, i, j, CASE WHEN compared = 0 OR differ >= compared THEN 3.0 ELSE least(3.0, {r('-ln(1 - CAST(differ AS DOUBLE) / compared)', 'd').removesuffix(' AS d')}) END AS d FROM c""")
def crispr_distance(spark, sf_dir):
    return rounded(distances.poisson(X.cell_rows(spark, sf_dir)), "d")


@query(f"""WITH {X.POINTS}, n AS (SELECT ds, count(*) AS n, min(taxon) AS base FROM points GROUP BY ds),
k AS (SELECT a.ds, a.taxon AS i, b.taxon AS j {_PAIRS})
SELECT ds, i, j, row_number() OVER (PARTITION BY ds ORDER BY i, j) - 1 AS place FROM k""")
def pair_index(spark, sf_dir):
    p = X.points(spark, sf_dir)
    n = p.groupBy("ds").agg(F.count(F.lit(1)).alias("n"))
    rank = p.select("ds", "taxon").withColumn("at", F.row_number().over(distances_window()) - 1)
    at = distances.pairs(rank, "ds", "taxon", "at").join(n, "ds")
    return at.select("ds", "i", "j", S.pair_index(F.col("at_i").cast("long"), F.col("at_j").cast("long"), F.col("n")).alias("place"))


def distances_window():
    from pyspark.sql import Window

    return Window.partitionBy("ds").orderBy("taxon")


@query(f"""WITH {EUCLIDEAN}, t AS (SELECT ds, count(DISTINCT t) AS n FROM (SELECT ds, i AS t FROM d UNION ALL SELECT ds, j FROM d) GROUP BY ds)
SELECT d.ds, t.n, count(*) AS pairs, count(*) FILTER (d IS NULL OR NOT isfinite(d) OR d < 0) AS bad, count(*) = t.n * (t.n - 1) // 2 AS complete FROM d JOIN t ON t.ds = d.ds GROUP BY d.ds, t.n""")
def distance_validation(spark, sf_dir):
    return distances.validate(distances.euclidean(X.points(spark, sf_dir)))


@query(f"WITH {EUCLIDEAN}, m AS (SELECT ds, quantile_cont(d, 0.5) AS m FROM d GROUP BY ds) SELECT ds, {r('m', 'median')}, {r('25 / m', 'scale')} FROM m")
def pointscale(spark, sf_dir):
    return rounded(distances.point_scale(distances.euclidean(X.points(spark, sf_dir))), "median", "scale")


@query(f"WITH {EUCLIDEAN}, o AS (SELECT *, row_number() OVER (PARTITION BY ds ORDER BY d DESC, i, j) AS k FROM d) SELECT ds, i, j, {r('d', 'd')} FROM o WHERE k = 1")
def diameter_pair(spark, sf_dir):
    return rounded(distances.diameter(distances.euclidean(X.points(spark, sf_dir))), "d")


# --- first steps of tree building ---------------------------------------

ENDS = "e AS (SELECT ds, i, j, d FROM d UNION ALL SELECT ds, j, i, d FROM d), s AS (SELECT ds, i, sum(d) AS s, count(*) + 1 AS n FROM e GROUP BY ds, i)"


@query(f"WITH {EUCLIDEAN}, {ENDS} SELECT ds, i, {r('s', 's')}, n FROM s")
def nj_row_sums(spark, sf_dir):
    return rounded(distances.row_sums(distances.euclidean(X.points(spark, sf_dir))), "s")


JOIN1 = f"""{EUCLIDEAN}, {ENDS}, q AS (SELECT d.ds, d.i, d.j, d.d, a.s AS s_i, b.s AS s_j, a.n, (a.n - 2) * d.d - a.s - b.s AS q FROM d JOIN s a ON a.ds = d.ds AND a.i = d.i JOIN s b ON b.ds = d.ds AND b.i = d.j),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ds ORDER BY round(q, 9), i, j) AS k FROM q) WHERE k = 1)"""


@query(f"WITH {JOIN1} SELECT ds, i, j, {r('d', 'd')}, {r('q', 'q')} FROM best")
def nj_first_join(spark, sf_dir):
    return rounded(distances.first_join(distances.euclidean(X.points(spark, sf_dir))), "d", "q").select("ds", "i", "j", "d", "q")


@query(f"""WITH {JOIN1}, m AS (SELECT ds, i AS u, j AS v, d AS d_uv, 0.5 * d + (s_i - s_j) / (2.0 * (n - 2)) AS raw FROM best WHERE n > 2),
k AS (SELECT m.ds, u, v, d_uv, raw, e.j AS k, sum(e.d) AS both_d FROM m JOIN e ON e.ds = m.ds AND e.i IN (u, v) AND e.j NOT IN (u, v) GROUP BY ALL)
SELECT ds, u, v, {r('greatest(0.0, raw)', 'len_u')}, {r('greatest(0.0, d_uv - raw)', 'len_v')}, k, {r('greatest(0.0, 0.5 * (both_d - d_uv))', 'd')} FROM k""")
def nj_first_update(spark, sf_dir):
    return rounded(distances.first_update(distances.euclidean(X.points(spark, sf_dir))), "len_u", "len_v", "d")


@query(f"WITH {EUCLIDEAN}, o AS (SELECT *, row_number() OVER (PARTITION BY ds ORDER BY d, i, j) AS k FROM d) SELECT ds, i, j, {r('d / 2', 'height')} FROM o WHERE k = 1")
def upgma_first_join(spark, sf_dir):
    return rounded(distances.closest_pair(distances.euclidean(X.points(spark, sf_dir))), "height")


@query(f"""WITH {EUCLIDEAN}, f AS (SELECT ds, i, j, d * d AS d2 FROM d UNION ALL SELECT ds, j, i, d * d FROM d UNION ALL SELECT ds, taxon, taxon, 0 FROM points),
m AS (SELECT ds, i, avg(d2) AS m FROM f GROUP BY ds, i), g AS (SELECT ds, avg(d2) AS g FROM f GROUP BY ds)
SELECT f.ds, f.i, f.j, {r('-0.5 * (d2 - a.m - b.m + g)', 'b')} FROM f JOIN m a ON a.ds = f.ds AND a.i = f.i JOIN m b ON b.ds = f.ds AND b.i = f.j JOIN g ON g.ds = f.ds WHERE f.i <= f.j AND (SELECT count(*) FROM points p WHERE p.ds = f.ds) > 1""")
def mds_double_center(spark, sf_dir):
    return rounded(distances.double_centre(distances.euclidean(X.points(spark, sf_dir))), "b")


@query(f"""WITH {X.POINTS}, s AS (SELECT a.ds, a.taxon AS i, b.taxon AS j, u.k AS sample, list_distance(a.x[8 * u.k + 1 : 8 * u.k + 8], b.x[8 * u.k + 1 : 8 * u.k + 8]) AS d {_PAIRS} CROSS JOIN (SELECT unnest(range(8)) AS k) u)
SELECT ds, i, j, {r('avg(d)', 'mean')}, {r('stddev_samp(d)', 'std')}, {r('quantile_cont(d, 0.5)', 'med')}, {r('min(d)', '"min"')}, {r('max(d)', '"max"')}, {r('quantile_cont(d, 0.025)', 'low95')}, {r('quantile_cont(d, 0.975)', 'high95')}, {r('quantile_cont(d, 0.25)', 'low50')}, {r('quantile_cont(d, 0.75)', 'high50')} FROM s GROUP BY ds, i, j""")
def eval_pair_stats(spark, sf_dir):
    """Distribution of each pair's distance over eight samples, taken from eight dimensions each."""
    p = X.points(spark, sf_dir)
    both = distances.pairs(p, "ds", "taxon", "x").withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(7))))
    cut = lambda c: F.slice(c, 8 * F.col("sample") + 1, F.lit(8))
    d = F.sqrt(S.total(F.zip_with(cut("x_i"), cut("x_j"), lambda a, b: (a - b) * (a - b))))
    return rounded(distances.summarise(both.select("ds", "i", "j", d.alias("d")), ["ds", "i", "j"]), "mean", "std", "med", "min", "max", "low95", "high95", "low50", "high50")


# --- points: centres, flows, densities -----------------------------------

MOMENTS = "e AS (SELECT ds, taxon, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS dim FROM points), m AS (SELECT ds, dim, avg(v) AS mean, var_pop(v) AS variance FROM e GROUP BY ds, dim)"


def _moments(points: DataFrame) -> DataFrame:
    return points.select("ds", F.posexplode("x").alias("dim", "v")).groupBy("ds", "dim").agg(F.avg("v").alias("mean"), F.var_pop("v").alias("variance"))


@query(f"WITH {X.POINTS}, {MOMENTS} SELECT ds, CAST(dim AS INTEGER) AS dim, {r('mean', 'mean')}, {r('variance', 'variance')} FROM m")
def centroid(spark, sf_dir):
    return rounded(_moments(X.points(spark, sf_dir)), "mean", "variance")


@query(f"""WITH {X.POINTS}, {MOMENTS}, ok AS (SELECT ds FROM m GROUP BY ds HAVING min(variance) > 1e-12)
SELECT e.ds, e.taxon, {r('sum(-0.5 * ((v - mean) * (v - mean) / variance + ln(variance) + ln(2 * pi())))', 'log_density')} FROM e JOIN m ON m.ds = e.ds AND m.dim = e.dim WHERE e.ds IN (SELECT ds FROM ok) GROUP BY e.ds, e.taxon""")
def diag_mvn_logdens(spark, sf_dir):
    p = X.points(spark, sf_dir)
    m = _moments(p).groupBy("ds").agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "variance"))).alias("m"), F.min("variance").alias("least")).where("least > 1e-12")
    density = S.diagonal_log_density(F.col("x"), F.col("m.mean"), F.col("m.variance"))
    return rounded(p.join(m, "ds").select("ds", "taxon", density.alias("log_density")), "log_density")


@query(f"""WITH {X.POINTS}, h AS (SELECT *, sqrt(list_inner_product(x, x)) AS rad FROM points), g AS (SELECT *, 1 / (1.0 + rad / 5.0) AS h FROM h)
SELECT ds, taxon, {r('list_sum(list_transform(x, lambda v: v + 2.0 * h * v))', 'total')}, {r('(len(x) - 1) * ln(1 + 2.0 * h) + ln(1 + 2.0 * h - 2.0 * h * h / 5.0 * rad)', 'log_det')} FROM g""")
def radial_flow(spark, sf_dir):
    image, log_det = S.radial_flow(F.col("x"), 1.0, 2.0, 5.0)
    return rounded(X.points(spark, sf_dir).select("ds", "taxon", S.total(image).alias("total"), log_det.alias("log_det")), "total", "log_det")


@query(f"""WITH {X.POINTS}, e AS (SELECT ds, taxon, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS d FROM points),
t AS (SELECT ds, taxon, tanh(sum(CASE WHEN d % 2 = 0 THEN 0.5 * v ELSE 0 END) + 0.25) AS t, sum(v) AS v, sum(CASE WHEN d % 2 = 0 THEN 0.3 ELSE 0.1 END) AS u, sum(CASE WHEN d % 2 = 0 THEN 0.15 ELSE 0 END) AS wu FROM e GROUP BY ds, taxon)
SELECT ds, taxon, {r('CAST(v + u * t AS DOUBLE)', 'total')}, {r('CAST(ln(abs(1 + (1 - t * t) * wu)) AS DOUBLE)', 'log_det')} FROM t""")
def planar_flow(spark, sf_dir):
    even = lambda a, b: lambda d: F.when(d % 2 == 0, F.lit(a)).otherwise(F.lit(b))
    image, log_det = S.planar_flow(F.col("x"), even(0.3, 0.1), even(0.5, 0.0), 0.25)
    return rounded(X.points(spark, sf_dir).select("ds", "taxon", S.total(image).alias("total"), log_det.alias("log_det")), "total", "log_det")


# --- sequences and barcodes ----------------------------------------------


@query(f"""WITH {X.ALIGNMENT}, e AS (SELECT ds, taxon, unnest(codes) AS c, generate_subscripts(codes, 1) - 1 AS site FROM alignment),
p AS (SELECT ds, site, string_agg(CASE c WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'G' WHEN 3 THEN 'T' ELSE '-' END, '' ORDER BY taxon) AS pattern FROM e GROUP BY ds, site)
SELECT ds, pattern, count(*) AS n FROM p GROUP BY ds, pattern""")
def site_patterns(spark, sf_dir):
    """Distinct alignment columns and how often each occurs."""
    letter = F.substring(F.lit("-ACGT"), F.col("c") + 2, F.lit(1))
    sites = X.alignment(spark, sf_dir).select("ds", "taxon", F.posexplode("codes").alias("site", "c"))
    pattern = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("taxon", letter.alias("b")))), lambda s: s["b"]), "")
    return sites.groupBy("ds", "site").agg(pattern.alias("pattern")).groupBy("ds", "pattern").agg(F.count(F.lit(1)).alias("n"))


def _renumber_sql(keys: str, on: str) -> str:
    return f"""WITH {X.MUTATIONS}, f AS (SELECT {keys}, state, min(struct_pack(c := cell, s := site)) AS first_at FROM mutations WHERE state > 0 GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY first_at) AS number FROM f)
SELECT m.ds, m.cell, m.site, CAST(coalesce(n.number, m.state) AS INTEGER) AS state FROM mutations m LEFT JOIN n ON {on} AND n.state = m.state"""


@query(_renumber_sql("ds", "n.ds = m.ds"))
def renumber_global(spark, sf_dir):
    return crispr.renumber(X.mutations(spark, sf_dir))


@query(_renumber_sql("ds, site", "n.ds = m.ds AND n.site = m.site"))
def renumber_sitewise(spark, sf_dir):
    return crispr.renumber(X.mutations(spark, sf_dir), by_site=True)


def _rates_sql(keys: str) -> str:
    return f"""WITH {X.MUTATIONS}, c AS (SELECT {keys}, state, count(*) AS n FROM mutations WHERE state > 0 GROUP BY ALL)
SELECT {keys}, state, n, {r(f'n / sum(n) OVER (PARTITION BY {keys})', 'empirical')}, {r(f'1.0 / count(*) OVER (PARTITION BY {keys})', 'uniform')} FROM c"""


@query(_rates_sql("ds"))
def mutrates_global(spark, sf_dir):
    return rounded(crispr.mutation_rates(X.mutations(spark, sf_dir)), "empirical", "uniform")


@query(_rates_sql("ds, site"))
def mutrates_sitewise(spark, sf_dir):
    return rounded(crispr.mutation_rates(X.mutations(spark, sf_dir), by_site=True), "empirical", "uniform")


@query("SELECT event_type AS state, first_id, row_number() OVER (ORDER BY first_id) - 1 AS state_id FROM (SELECT event_type, min(event_id) AS first_id FROM events GROUP BY event_type)")
def state_dictionary(spark, sf_dir):
    """States numbered by first appearance; the dictionary is as small as the alphabet."""
    from pyspark.sql import Window

    first = X.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("state")).agg(F.min("event_id").alias("first_id"))
    return first.withColumn("state_id", (F.row_number().over(Window.orderBy("first_id")) - 1).cast("long"))


@query("""SELECT key, 'right' AS missing_in FROM (SELECT user_id AS key FROM events EXCEPT SELECT c_custkey FROM customer)
UNION ALL SELECT key, 'left' FROM (SELECT c_custkey AS key FROM customer EXCEPT SELECT user_id FROM events)""")
def table_agreement(spark, sf_dir):
    left = X.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"))
    return crispr.table_agreement(left, X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), "key")


_KIND = "CASE WHEN a = 4 AND b = 4 THEN {0} WHEN a = 4 THEN 0.0 WHEN b = 4 THEN {4} WHEN a = 0 AND b = 0 THEN {1} WHEN a = 0 THEN {2} WHEN a = b THEN {3} ELSE 0.0 END"


def _kind(*parts: str) -> str:
    return _KIND.format(*parts)


@query(f"""WITH t AS (SELECT o_orderkey AS branch, CAST(o_totalprice AS DOUBLE) / 1e5 AS t FROM orders), s AS (SELECT CAST(unnest(range(5)) AS INTEGER) AS s), g AS (SELECT branch, t, x.s AS a, y.s AS b FROM t, s x, s y)
SELECT branch, a, b, {r(_kind('1.0', 'exp(-1.4 * t)', 'exp(-0.4 * t) * (1 - exp(-t)) / 3', 'exp(-0.4 * t)', '1 - exp(-0.4 * t)'), 'p')},
 {r(_kind('0.0', '-1.4 * exp(-1.4 * t)', '(-0.4 * exp(-0.4 * t) * (1 - exp(-t)) + exp(-1.4 * t)) / 3', '-0.4 * exp(-0.4 * t)', '0.4 * exp(-0.4 * t)'), 'dp_dt')},
 {r(_kind('0.0', '-t * exp(-1.4 * t)', '-t * exp(-0.4 * t) * (1 - exp(-t)) / 3', '-t * exp(-0.4 * t)', 't * exp(-0.4 * t)'), 'dp_dnu')} FROM g""")
def crispr_transition(spark, sf_dir):
    """Transition probabilities and both slopes over a branch for each order."""
    branches = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("branch"), (F.col("o_totalprice").cast("double") / 1e5).alias("t"))
    return rounded(crispr.transition(branches).drop("t"), "p", "dp_dt", "dp_dnu")


# --- trees ---------------------------------------------------------------

UP = """WITH RECURSIVE {trees}, up AS (
  SELECT tree, node, node AS anc, CAST(0 AS DOUBLE) AS dist, 0 AS steps FROM trees
  UNION ALL SELECT u.tree, u.node, t.parent, u.dist + t.length, u.steps + 1 FROM up u JOIN trees t ON t.tree = u.tree AND t.node = u.anc WHERE t.parent IS NOT NULL)"""
_UP = UP.format(trees=X.TREES)


@query(f"""WITH {X.TREES}, l AS (SELECT t.tree, t.node, t.parent, t.length AS leaf, p.length AS year FROM trees t JOIN trees p ON p.tree = t.tree AND p.node = t.parent WHERE t.node LIKE 'L%')
SELECT a.tree, a.node AS i, b.node AS j, {r('CASE WHEN a.parent = b.parent THEN a.leaf + b.leaf ELSE a.leaf + a.year + b.leaf + b.year END', 'd')} FROM l a JOIN l b ON a.tree = b.tree AND a.node < b.node""")
def leaf_lca_distance(spark, sf_dir):
    return rounded(trees.leaf_distances(X.trees(spark, sf_dir)), "d")


@query(f"{_UP} SELECT tree, node, {r('max(dist)', 'height')}, max(steps) AS depth FROM up GROUP BY tree, node")
def node_heights(spark, sf_dir):
    return rounded(trees.heights(X.trees(spark, sf_dir)), "height")


def _splits_sql(name: str, group: str) -> str:
    return f"""{name}_n AS (SELECT o_custkey AS tree, list('L' || o_orderkey ORDER BY 'L' || o_orderkey) AS every FROM orders GROUP BY ALL),
{name}_s AS (SELECT o_custkey AS tree, {group} AS g, list('L' || o_orderkey ORDER BY 'L' || o_orderkey) AS side FROM orders GROUP BY ALL),
{name}_c AS (SELECT tree, CASE WHEN 2 * len(side) > len(every) OR (2 * len(side) = len(every) AND side[1] <> every[1]) THEN list_filter(every, lambda v: NOT list_contains(side, v)) ELSE side END AS side
  FROM {name}_s JOIN {name}_n USING (tree) WHERE len(side) >= 2 AND len(every) - len(side) >= 2),
{name} AS (SELECT DISTINCT tree, CAST(len(side) AS INTEGER) AS size, array_to_string(side, ',') AS split FROM {name}_c)"""


@query(f"WITH {_splits_sql('sp', 'year(o_orderdate)')} SELECT tree, size, split FROM sp")
def tree_splits(spark, sf_dir):
    return trees.splits(X.trees(spark, sf_dir))


@query(f"""WITH {_splits_sql('sp', 'year(o_orderdate)')}, {_splits_sql('sq', 'o_orderpriority')}, t AS (SELECT DISTINCT o_custkey AS tree FROM orders),
c AS (SELECT t.tree, (SELECT count(*) FROM sp WHERE sp.tree = t.tree) AS n_left, (SELECT count(*) FROM sq WHERE sq.tree = t.tree) AS n_right, (SELECT count(*) FROM sp JOIN sq USING (tree, split) WHERE tree = t.tree) AS common FROM t)
SELECT *, n_left + n_right - 2 * common AS rf FROM c""")
def rf_distance(spark, sf_dir):
    """Robinson-Foulds distance between each customer's two trees."""
    return trees.robinson_foulds(X.trees(spark, sf_dir), X.other_trees(spark, sf_dir))


@query(f"""WITH {X.TREES}, t AS (SELECT tree, count(*) AS branches, sum(length + 1e-6) AS length FROM trees WHERE parent IS NOT NULL GROUP BY tree)
SELECT tree, branches, {r('length', 'length')}, {r('-branches * ln(length)', 'yule')}, {r('ln(length) - length / 5 - 2 * ln(5)', 'gamma')} FROM t""")
def tree_length_prior(spark, sf_dir):
    return rounded(trees.length_prior(X.trees(spark, sf_dir)), "length", "yule", "gamma")


STATES = """st AS (SELECT o_custkey AS tree, 'L' || o_orderkey AS node, o_orderpriority AS state FROM orders),
cnt AS (SELECT u.tree, u.anc AS node, st.state, count(*) AS n FROM up u JOIN st ON st.tree = u.tree AND st.node = u.node WHERE u.steps > 0 GROUP BY ALL),
every AS (SELECT tree, node, state FROM st UNION ALL SELECT tree, node, state FROM (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY n DESC, state) AS k FROM cnt) WHERE k = 1),
h AS (SELECT tree, node, max(dist) AS height FROM up GROUP BY tree, node),
mig AS (SELECT t.tree, t.node, p.state AS from_state, c.state AS to_state, hp.height AS start_time, hc.height AS end_time
  FROM trees t JOIN every c ON c.tree = t.tree AND c.node = t.node JOIN every p ON p.tree = t.tree AND p.node = t.parent
  JOIN h hc ON hc.tree = t.tree AND hc.node = t.node JOIN h hp ON hp.tree = t.tree AND hp.node = t.parent WHERE c.state <> p.state)"""


def _migrations(spark, sf_dir):
    t = X.trees(spark, sf_dir)
    return trees.migrations(t, trees.inner_states(t, X.leaf_states(spark, sf_dir)))


@query(f"{_UP}, {STATES} SELECT tree, node, from_state, to_state, {r('start_time', 'start_time')}, {r('end_time', 'end_time')} FROM mig")
def migration_edges(spark, sf_dir):
    return rounded(_migrations(spark, sf_dir), "start_time", "end_time")


@query(f"{_UP}, {STATES} SELECT tree, from_state, to_state, count(*) AS n, {r('avg(end_time)', 'mean_time')} FROM mig GROUP BY tree, from_state, to_state")
def migration_graph(spark, sf_dir):
    """Multigraph of state changes, parallel edges counted."""
    g = _migrations(spark, sf_dir).groupBy("tree", "from_state", "to_state").agg(F.count(F.lit(1)).alias("n"), F.avg("end_time").alias("mean_time"))
    return rounded(g, "mean_time")


@query(f"""{_UP}, {STATES}, ln AS (SELECT tree, format('{{}}_G{{}} -> {{}}_G{{}} [label="{{:.4f}}"];', regexp_replace(from_state, '[^A-Za-z0-9]', '_', 'g'), tree, regexp_replace(to_state, '[^A-Za-z0-9]', '_', 'g'), tree, (start_time + end_time) / 2) AS edge FROM mig)
SELECT tree, 'digraph G' || tree || ' {{ ' || string_agg(edge, ' ' ORDER BY edge) || ' }}' AS line FROM ln GROUP BY tree""")
def dot_lines(spark, sf_dir):
    return trees.dot(_migrations(spark, sf_dir))


@query(f"WITH {X.TREES} SELECT tree, node, parent, {r('CASE WHEN parent IS NOT NULL AND length - 1.2 <= 0 THEN 0.001 WHEN parent IS NULL THEN length ELSE length - 1.2 END', 'length')} FROM trees WHERE tree IN (SELECT tree FROM trees WHERE length > 1.2) UNION ALL SELECT tree, node, parent, CASE WHEN parent IS NULL THEN length ELSE 0.1 END FROM trees WHERE tree NOT IN (SELECT tree FROM trees WHERE length > 1.2)")
def zero_branch_repair(spark, sf_dir):
    """Lengths less 1.2, so that many are below zero, repaired."""
    t = X.trees(spark, sf_dir).withColumn("length", F.when(F.col("parent").isNull(), F.col("length")).otherwise(F.col("length") - 1.2))
    return rounded(trees.repair_lengths(t), "length")


# --- sampling --------------------------------------------------------------

NORMAL = f"{X.WEIGHTS}, e AS (SELECT *, exp(lw - max(lw) OVER (PARTITION BY ds)) AS e FROM weights), w AS (SELECT ds, draw, lw, e / sum(e) OVER (PARTITION BY ds) AS w FROM e)"


@query(f"WITH {NORMAL} SELECT ds, draw, {r('lw', 'lw')}, {r('w', 'w')}, {r('1 / sum(w * w) OVER (PARTITION BY ds)', 'ess')} FROM w")
def importance_weights(spark, sf_dir):
    return rounded(sampling.importance_weights(X.weights(spark, sf_dir)), "lw", "w", "ess")


@query(f"""WITH {NORMAL}, c AS (SELECT ds, draw, CAST(greatest(0, ceil(round(count(*) OVER (PARTITION BY ds) * least(1.0, sum(w) OVER (PARTITION BY ds ORDER BY draw ROWS UNBOUNDED PRECEDING)), 9) - 0.5)) AS BIGINT) AS upto FROM w)
SELECT ds, draw, upto - coalesce(lag(upto) OVER (PARTITION BY ds ORDER BY draw), 0) AS times FROM c""")
def systematic_resample(spark, sf_dir):
    return sampling.systematic_resample(X.weights(spark, sf_dir))


@query(f"WITH {X.WEIGHTS}, k AS (SELECT *, row_number() OVER (PARTITION BY ds ORDER BY lw DESC, draw) AS rank FROM weights) SELECT ds, draw, {r('lw', 'lw')}, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 10")
def top_draws(spark, sf_dir):
    """A top-k report: the ten draws of greatest weight in each data set."""
    return rounded(sampling.top_draws(X.weights(spark, sf_dir), 10), "lw")


@query("""WITH t AS (SELECT user_id AS ds, value, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 10 AS block FROM events),
b AS (SELECT ds, block, sum(value) AS total FROM t GROUP BY ds, block HAVING count(*) = 10), c AS (SELECT *, lag(total) OVER (PARTITION BY ds ORDER BY block) AS before FROM b)
SELECT ds, block, round(total, 6) + 0.0 AS total, round(before, 6) + 0.0 AS before, coalesce(1.001 * total <= 0.999 * before, FALSE) AS stop FROM c""")
def elbo_blocks(spark, sf_dir):
    """Stop rule over blocks of ten steps."""
    h = X.table(spark, sf_dir, "events").select(F.col("user_id").alias("ds"), F.col("event_id").alias("draw"), "value")
    return rounded(sampling.blocks(h, 10), "total", "before")


SHELLS = f"{NORMAL}, sh AS (SELECT ds, draw, lw, w, CAST(least(11, floor(lw * 4)) AS BIGINT) AS shell FROM w)"


def _shells(spark, sf_dir):
    return sampling.importance_weights(X.weights(spark, sf_dir)).withColumn("shell", F.least(F.lit(11), F.floor(F.col("lw") * 4)))


@query(f"WITH {SHELLS} SELECT ds, shell, count(*) AS n, {r('sum(w)', 'mass')} FROM sh GROUP BY ds, shell")
def shell_mass(spark, sf_dir):
    return rounded(_shells(spark, sf_dir).groupBy("ds", "shell").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("mass")), "mass")


@query(f"""WITH {SHELLS}, o AS (SELECT *, max(shell) OVER (PARTITION BY ds) AS last, count(*) OVER (PARTITION BY ds, shell) AS m, row_number() OVER (PARTITION BY ds, shell ORDER BY lw, draw) - 1 AS up, row_number() OVER (PARTITION BY ds, shell ORDER BY lw DESC, draw DESC) AS down FROM sh),
p AS (SELECT ds, shell, max(lw) FILTER (up = floor(CASE WHEN last = 0 THEN 0.995 ELSE least(0.9999, 0.995 + CAST(shell AS DOUBLE) / last * (0.999 - 0.995)) END * (m - 1))) AS bound, coalesce(stddev_samp(lw) FILTER (down <= greatest(20, floor(0.2 * m))), 0) AS spread FROM o GROUP BY ds, shell)
SELECT ds, shell, {r('max(bound) OVER (PARTITION BY ds ORDER BY shell)', 'bound')}, {r('max(spread) OVER (PARTITION BY ds ORDER BY shell)', 'spread')} FROM p""")
def shell_envelopes(spark, sf_dir):
    return rounded(sampling.envelopes(_shells(spark, sf_dir)), "bound", "spread")


# --- trees and likelihoods beyond SQL -----------------------------------


@query()
def nj_trees(spark, sf_dir):
    """Neighbour-joining tree of each data set, as edges."""
    return rounded(inference.build_trees(distances.euclidean(X.points(spark, sf_dir)), "nj"), "length")


@query()
def newick_trees(spark, sf_dir):
    """The neighbour-joining trees as text."""
    return newick.from_edges(inference.build_trees(distances.euclidean(X.points(spark, sf_dir)), "nj").withColumnRenamed("ds", "tree"))


_MOVE = "(1 - exp(-greatest({0}, 1e-6) * 5 / 4.0)) / 5"
_STAY = "(1 - exp(-greatest({0}, 1e-6) * 5 / 4.0)) / 5 + exp(-greatest({0}, 1e-6) * 5 / 4.0)"
INSIDE = f"""{X.TREES}, sts AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS a FROM (SELECT DISTINCT o_orderpriority AS s FROM orders)),
lf AS (SELECT t.tree, t.node, t.parent, t.length, x.a AS s FROM trees t JOIN orders o ON o.o_custkey = t.tree AND 'L' || o.o_orderkey = t.node JOIN sts x ON x.s = o.o_orderpriority),
ym AS (SELECT lf.tree, lf.parent AS node, g.a, sum(ln(CASE WHEN g.a = lf.s THEN {_STAY.format('lf.length')} ELSE {_MOVE.format('lf.length')} END)) AS v FROM lf CROSS JOIN sts g GROUP BY ALL),
yt AS (SELECT tree, node, max(v) AS m, sum(exp(v - (SELECT max(z.v) FROM ym z WHERE z.tree = ym.tree AND z.node = ym.node))) AS total FROM ym GROUP BY tree, node),
rm AS (SELECT ym.tree, ym.a, sum(yt.m + ln({_MOVE.format('t.length')} * yt.total + exp(-greatest(t.length, 1e-6) * 5 / 4.0) * exp(ym.v - yt.m))) AS v
  FROM ym JOIN yt ON yt.tree = ym.tree AND yt.node = ym.node JOIN trees t ON t.tree = ym.tree AND t.node = ym.node GROUP BY ym.tree, ym.a),
rt AS (SELECT tree, max(v) AS m FROM rm GROUP BY tree)"""


@query(f"""WITH {INSIDE} SELECT rm.tree, CAST((SELECT count(*) FROM orders o WHERE o.o_custkey = rm.tree) AS INTEGER) AS leaves, {r('max(rt.m) + ln(sum(exp(v - rt.m)) / 5)', 'log_likelihood')} FROM rm JOIN rt ON rt.tree = rm.tree GROUP BY rm.tree""")
def migration_loglik(spark, sf_dir):
    """Log likelihood of the leaf states of every customer's tree."""
    return rounded(states.likelihood(X.trees(spark, sf_dir), X.leaf_states(spark, sf_dir)), "log_likelihood")


SAMPLES, SPREAD = 8, 0.05


def _draws(spark, sf_dir):
    return posterior.draws(X.points(spark, sf_dir), SAMPLES, F.lit(SPREAD))


def _sample_trees(spark, sf_dir):
    """Neighbour-joining trees of all draws; a draw is a data set of its own."""
    return stored(inference.build_trees(distances.euclidean(_draws(spark, sf_dir).withColumn("ds", F.col("ds") * SAMPLES + F.col("sample"))), "nj"))


def _normal_sql(*names: str) -> str:
    return f"sqrt(-2.0 * ln({S.uniform_sql('1', *names)})) * cos(2.0 * pi() * {S.uniform_sql('2', *names)})"


@query(f"""WITH {X.POINTS}, e AS (SELECT ds, taxon, generate_subscripts(x, 1) - 1 AS dim, unnest(x) AS v FROM points),
z AS (SELECT ds, taxon, dim, v, h, {_normal_sql('1', 'ds', 'taxon', 'h', 'dim')} AS z FROM e CROSS JOIN (SELECT unnest(range({SAMPLES // 2})) AS h) p),
dr AS (SELECT ds, taxon, dim, 2 * h + side AS sample, v + (1 - 2 * side) * {SPREAD} * z AS v FROM z CROSS JOIN (SELECT unnest([0, 1]) AS side) q),
x AS (SELECT ds, taxon, sample, list(v ORDER BY dim) AS x FROM dr GROUP BY ALL),
d AS (SELECT a.ds, a.taxon AS i, b.taxon AS j, list_distance(a.x, b.x) AS d FROM x a JOIN x b ON a.ds = b.ds AND a.sample = b.sample AND a.taxon < b.taxon)
SELECT ds, i, j, {r('avg(d)', 'mean')}, {r('stddev_samp(d)', 'std')}, {r('quantile_cont(d, 0.5)', 'med')}, {r('min(d)', '"min"')}, {r('max(d)', '"max"')}, {r('quantile_cont(d, 0.025)', 'low95')}, {r('quantile_cont(d, 0.975)', 'high95')}, {r('quantile_cont(d, 0.25)', 'low50')}, {r('quantile_cont(d, 0.75)', 'high50')} FROM d GROUP BY ds, i, j""")
def posterior_pair_stats(spark, sf_dir):
    """Distribution of each pair's distance over draws around the points."""
    d = distances.euclidean(_draws(spark, sf_dir).withColumn("ds", F.col("ds") * SAMPLES + F.col("sample")))
    return rounded(distances.summarise(d.withColumn("ds", F.floor(F.col("ds") / SAMPLES)), ["ds", "i", "j"]), "mean", "std", "med", "min", "max", "low95", "high95", "low50", "high50")


@query()
def posterior_split_support(spark, sf_dir):
    """Share of the drawn trees of a data set that have a split."""
    s = trees.splits(_sample_trees(spark, sf_dir).withColumnRenamed("ds", "tree")).withColumn("ds", F.floor(F.col("tree") / SAMPLES))
    return rounded(s.groupBy("ds", "size", "split").agg((F.count(F.lit(1)) / SAMPLES).alias("support")), "support")


@query()
def posterior_fit(spark, sf_dir):
    """History and result of the fit of each data set."""
    return posterior.fit(X.points(spark, sf_dir), X.alignment(spark, sf_dir))


@query()
def fitted_mean_trees(spark, sf_dir):
    """Trees of the fitted means."""
    fits = posterior.fit(X.points(spark, sf_dir), X.alignment(spark, sf_dir))
    return rounded(inference.build_trees(distances.euclidean(posterior.fitted_points(fits)), "nj"), "length")


DRAWN = f"""{INSIDE}, cum AS (SELECT rm.tree, a, sum(exp(v - m)) OVER (PARTITION BY rm.tree ORDER BY a) AS c, sum(exp(v - m)) OVER (PARTITION BY rm.tree) AS total FROM rm JOIN rt ON rt.tree = rm.tree),
dr AS (SELECT tree, 'R' AS node, least(4, count(*) FILTER (c < total * {S.uniform_sql('1', 'tree', "'R'")})) AS a FROM cum GROUP BY tree),
yw AS (SELECT ym.tree, ym.node, ym.a, (CASE WHEN ym.a = dr.a THEN {_STAY.format('t.length')} ELSE {_MOVE.format('t.length')} END) * exp(ym.v - yt.m) AS w
  FROM ym JOIN yt ON yt.tree = ym.tree AND yt.node = ym.node JOIN trees t ON t.tree = ym.tree AND t.node = ym.node JOIN dr ON dr.tree = ym.tree),
yc AS (SELECT tree, node, a, sum(w) OVER (PARTITION BY tree, node ORDER BY a) AS c, sum(w) OVER (PARTITION BY tree, node) AS total FROM yw),
dy AS (SELECT tree, node, least(4, count(*) FILTER (c < total * {S.uniform_sql('1', 'tree', 'node')})) AS a FROM yc GROUP BY tree, node),
drawn AS (SELECT tree, node, s AS state FROM (SELECT tree, node, a FROM dr UNION ALL SELECT tree, node, a FROM dy UNION ALL SELECT tree, node, s FROM lf) d JOIN sts ON sts.a = d.a)"""


@query(f"WITH {DRAWN} SELECT tree, node, state FROM drawn")
def sampled_states(spark, sf_dir):
    """Drawn ancestral states of every customer's tree."""
    return states.draw(X.trees(spark, sf_dir), X.leaf_states(spark, sf_dir))


@query(f"""WITH {DRAWN}, h AS (SELECT t.tree, t.node, t.length + coalesce(p.length, 0) AS height FROM trees t LEFT JOIN trees p ON p.tree = t.tree AND p.node = t.parent)
SELECT t.tree, t.node, p.state AS from_state, c.state AS to_state, {r('hp.height', 'start_time')}, {r('hc.height', 'end_time')} FROM trees t JOIN drawn c ON c.tree = t.tree AND c.node = t.node JOIN drawn p ON p.tree = t.tree AND p.node = t.parent
  JOIN h hc ON hc.tree = t.tree AND hc.node = t.node JOIN h hp ON hp.tree = t.tree AND hp.node = t.parent WHERE c.state <> p.state""")
def sampled_migrations(spark, sf_dir):
    """State changes along every tree for the drawn states."""
    t = stored(X.trees(spark, sf_dir))
    return rounded(trees.migrations(t, states.draw(t, X.leaf_states(spark, sf_dir))), "start_time", "end_time")


_LABEL = "t.node || '[&state=' || d.state || ']'"


@query(f"""WITH {DRAWN}, lb AS (SELECT t.tree, t.node, t.parent, {_LABEL} AS label, format('{{:.6f}}', t.length) AS length FROM trees t JOIN drawn d ON d.tree = t.tree AND d.node = t.node),
lv AS (SELECT tree, parent, string_agg(label || ':' || length, ',' ORDER BY node) AS s FROM lb WHERE node LIKE 'L%' GROUP BY tree, parent),
yv AS (SELECT lb.tree, string_agg('(' || s || ')' || label || ':' || length, ',' ORDER BY lb.node) AS s FROM lb JOIN lv ON lv.tree = lb.tree AND lv.parent = lb.node GROUP BY lb.tree)
SELECT yv.tree, 'TREE sample_' || yv.tree || ' = [&R] (' || s || ')' || label || ';' AS line FROM yv JOIN lb ON lb.tree = yv.tree AND lb.node = 'R'""")
def labelled_nexus(spark, sf_dir):
    """Each tree's line of a NEXUS file, every node with its drawn state."""
    t = X.trees(spark, sf_dir)
    return newick.nexus(t, states.draw(t, X.leaf_states(spark, sf_dir)))


from cladewise.plans import analysis, likelihoods, linkages, normals, slopes, spectra  # noqa: E402, F401  register the rest
