"""Registered queries of priors, schedules, samplers, text outputs and scalar formulas, with their SQL."""

from __future__ import annotations

import math


from pyspark.sql import functions as F

from cladewise.functions import scalars as S
from cladewise.operators import ascent, distances, embedding, inference, sampling, states, trees
from cladewise.plans import fixtures as X
from cladewise.plans.config import AnalysisConfig
from cladewise.plans.queries import _PAIRS, CELLS, EUCLIDEAN, JOIN1, MOMENTS, NORMAL, _moments, _shells
from cladewise.plans.registry import query, r, rounded

# --- scalar formulas over the given values ---------------------------------

VALUES = "SELECT event_id, value, value / 50 - 1 AS x FROM events WHERE value IS NOT NULL"


def _values(spark, sf_dir):
    return X.table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_id", "value", (F.col("value") / 50 - 1).alias("x"))


@query(f"WITH v AS ({VALUES}) SELECT event_id, {r('ln(1 + exp(least(60, greatest(-60, 2.0 * x)))) / 2.0', 'soft')}, {r('1 / (1 + exp(-least(60, greatest(-60, 2.0 * x))))', 'slope')}, {r('greatest(x, -30) + 0 * x', 'back')} FROM v WHERE x > -12 AND x < 25")
def softplus_family(spark, sf_dir):
    """Softplus, its slope, and the argument back from the value."""
    v = _values(spark, sf_dir).where("x > -12 AND x < 25")
    soft = S.softplus(F.col("x"), 2.0)
    return rounded(v.select("event_id", soft.alias("soft"), S.softplus_slope(F.col("x"), 2.0).alias("slope"), S.softplus_inverse(soft, 2.0).alias("back")), "soft", "slope", "back")


@query(f"WITH v AS ({VALUES}) SELECT event_id, {r('CASE WHEN abs(x) <= 0.5 THEN x * x / 2 ELSE 0.5 * abs(x) - 0.125 END', 'rho')}, {r('greatest(-0.5, least(0.5, x))', 'psi')} FROM v")
def huber_loss(spark, sf_dir):
    return rounded(_values(spark, sf_dir).select("event_id", S.huber(F.col("x")).alias("rho"), S.huber_slope(F.col("x")).alias("psi")), "rho", "psi")


@query(f"WITH v AS ({VALUES}) SELECT event_id, {r('1 / sqrt(u * u - 1)', 'slope')} FROM (SELECT event_id, 1.5 + abs(x) AS u FROM v)")
def acosh_slopes(spark, sf_dir):
    return rounded(_values(spark, sf_dir).select("event_id", S.acosh_slope(1.5 + F.abs("x")).alias("slope")), "slope")


@query("SELECT event_id, round(ln(CASE WHEN value > 50 THEN value ELSE 1e-300 END), 6) + 0.0 AS log_p FROM events WHERE value IS NOT NULL")
def probability_floor(spark, sf_dir):
    """Logarithms of weights, of which those below 50 are zero, with the floor that keeps them finite."""
    p = F.when(F.col("value") > 50, F.col("value")).otherwise(0.0)
    return rounded(_values(spark, sf_dir).select("event_id", F.log(S.floored(p)).alias("log_p")), "log_p")


@query(f"""WITH {X.POINTS}, t AS (SELECT ds, taxon, row_number() OVER (PARTITION BY ds ORDER BY taxon) - 1 AS at FROM points)
SELECT a.ds, row_number() OVER (PARTITION BY a.ds ORDER BY a.at, b.at) - 1 AS place, a.at AS i, b.at AS j FROM t a JOIN t b ON a.ds = b.ds AND a.at < b.at""")
def pair_from_index(spark, sf_dir):
    """Both items of every place in the list of pairs."""
    n = X.points(spark, sf_dir).groupBy("ds").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    places = n.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n") * (F.col("n") - 1) / 2 - 1).cast("long"))))
    i, j = S.pair_of(F.col("place"), F.col("n"))
    return places.select("ds", "place", i.alias("i"), j.alias("j"))


# --- shells, acceptance ----------------------------------------------------

SHELLS, AXES = 12, 64
_CDF = "1 - exp(-z2 / 2) * list_sum(list_transform(range(32), lambda j: pow(z2 / 2, j) / gamma(j + 1)))"


@query(f"""WITH {X.POINTS}, {MOMENTS}, ok AS (SELECT ds FROM m GROUP BY ds HAVING min(variance) > 1e-12),
z AS (SELECT e.ds, e.taxon, sum((v - mean) * (v - mean) / variance) AS z2 FROM e JOIN m ON m.ds = e.ds AND m.dim = e.dim WHERE e.ds IN (SELECT ds FROM ok) GROUP BY e.ds, e.taxon)
SELECT ds, taxon, {r('z2', 'z2')}, CAST(least({SHELLS - 1}, floor({SHELLS} * ({_CDF}))) AS BIGINT) AS shell FROM z""")
def chi_square_shells(spark, sf_dir):
    """Shell of equal mass that each point lies in, by its squared distance from the centre in standard deviations of each axis."""
    bounds = [S.chi_square_quantile(k / SHELLS, AXES) for k in range(1, SHELLS)]
    p = X.points(spark, sf_dir)
    m = _moments(p).groupBy("ds").agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "variance"))).alias("m"), F.min("variance").alias("least")).where("least > 1e-12")
    z2 = S.total(F.zip_with("x", "m", lambda v, k: (v - k["mean"]) * (v - k["mean"]) / k["variance"]))
    return rounded(p.join(m, "ds").select("ds", "taxon", z2.alias("z2"), S.region(z2, bounds).alias("shell")), "z2")


@query(f"""WITH {NORMAL}, sh AS (SELECT ds, draw, lw, least(11, floor(lw * 4)) AS shell FROM w),
o AS (SELECT *, max(shell) OVER (PARTITION BY ds) AS last, count(*) OVER (PARTITION BY ds, shell) AS m, row_number() OVER (PARTITION BY ds, shell ORDER BY lw, draw) - 1 AS up FROM sh),
p AS (SELECT ds, shell, max(lw) FILTER (up = floor(CASE WHEN last = 0 THEN 0.995 ELSE least(0.9999, 0.995 + CAST(shell AS DOUBLE) / last * (0.999 - 0.995)) END * (m - 1))) AS bound FROM o GROUP BY ds, shell),
b AS (SELECT ds, shell, max(bound) OVER (PARTITION BY ds ORDER BY shell) AS bound FROM p),
t AS (SELECT sh.ds, draw, row_number() OVER (PARTITION BY sh.ds ORDER BY draw) AS place FROM sh JOIN b ON b.ds = sh.ds AND b.shell = sh.shell WHERE ln({S.uniform_sql('1', 'sh.ds', 'draw')}) <= lw - bound)
SELECT ds, draw, CAST(place AS INTEGER) AS place FROM t WHERE place <= 25""")
def rejection_sample(spark, sf_dir):
    """The first 25 draws of each data set that the envelope of their shell lets pass."""
    shells = _shells(spark, sf_dir)
    bounds = sampling.envelopes(shells).select("ds", "shell", "bound")
    return ascent.accept(shells.join(bounds, ["ds", "shell"]).select("ds", "draw", "lw", "bound"), 25)


# --- averages, schedules, subsampling ---------------------------------------

STEPS = 500
HISTORY = f"h AS (SELECT event_id // {STEPS} AS ds, event_id AS step, value, row_number() OVER (PARTITION BY event_id // {STEPS} ORDER BY event_id) - 1 AS pos FROM events WHERE value > 0)"


def _history(spark, sf_dir):
    """Values in the order of events, in runs of a bounded number of steps."""
    e = X.table(spark, sf_dir, "events").where("value > 0")
    return e.select(F.floor(F.col("event_id") / STEPS).alias("ds"), F.col("event_id").alias("step"), "value")


@query(f"""WITH {HISTORY}, a AS (SELECT x.ds, x.step, sum(y.value * CASE WHEN y.pos = 0 THEN pow(0.98, x.pos) ELSE 0.02 * pow(0.98, x.pos - y.pos) END) AS average FROM h x JOIN h y ON x.ds = y.ds AND y.pos <= x.pos GROUP BY x.ds, x.step)
SELECT ds, step, {r('average', 'average')}, {r('greatest(2 * average, 7)', 'clip')} FROM a""")
def gradient_ema(spark, sf_dir):
    return rounded(ascent.gradient_average(_history(spark, sf_dir)), "average", "clip")


@query(f"""WITH {HISTORY}, d AS (SELECT ds, step, ln(value) AS value, (pos - 50) // 30 AS k FROM h WHERE pos >= 50 AND (pos - 50) % 30 = 0),
a AS (SELECT x.ds, x.step, sum(y.value * CASE WHEN y.k = 0 THEN pow(0.7, x.k) ELSE 0.3 * pow(0.7, x.k - y.k) END) AS average FROM d x JOIN d y ON x.ds = y.ds AND y.k <= x.k GROUP BY x.ds, x.step)
SELECT ds, step, {r('average', 'average')} FROM a""")
def trace_ema(spark, sf_dir):
    return rounded(ascent.trace_average(_history(spark, sf_dir).withColumn("value", F.log("value"))), "average")


@query(f"""WITH RECURSIVE n AS (SELECT l_suppkey AS ds, count(*) AS n FROM lineitem GROUP BY l_suppkey),
s AS (SELECT ds, n, 0 AS step, CASE WHEN least(64, n) >= 0.95 * n THEN n ELSE least(64, n) END AS m FROM n
  UNION ALL SELECT ds, n, step + 1, CASE WHEN g >= 0.95 * n THEN n ELSE g END FROM (
    SELECT ds, n, step, CASE WHEN (step + 1) % 20 = 0 THEN least(n, greatest(m + 1, CASE WHEN 2 * m > n THEN m + (n - m) // 2 ELSE 2 * m END)) ELSE m END AS g FROM s WHERE step < 119))
SELECT ds, step, CAST(m AS BIGINT) AS sites, {r("CASE WHEN m >= n THEN 0.05 ELSE 0.05 * sqrt(CAST(m AS DOUBLE) / n) * (0.9 + 0.1 * (0.5 * (1 + cos(pi() * step / 400.0)))) END", 'rate')}, m >= n OR (step > 0 AND step % 50 = 0) AS "full" FROM s""")
def step_schedule(spark, sf_dir):
    """Sites, learning rate and full gradients of 120 steps, a data set for each supplier with its lines as sites."""
    n = X.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("ds")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(ascent.schedule(n, 120, first=64), "rate")


@query(f"""WITH c AS (SELECT l_suppkey AS ds, l_returnflag || '/' || l_linestatus || '/' || l_linenumber AS item, count(*) AS n FROM lineitem GROUP BY ALL),
s AS (SELECT *, sum(n) OVER (PARTITION BY ds ORDER BY item) AS upto, sum(n) OVER (PARTITION BY ds) AS total FROM c),
u AS (SELECT ds, draw, {S.uniform_sql('1', 'ds', 'draw')} * total AS u FROM (SELECT DISTINCT ds, total FROM s) t CROSS JOIN (SELECT unnest(range(256)) AS draw) d)
SELECT s.ds, item, count(*) AS times FROM s JOIN u ON u.ds = s.ds AND u < upto AND u >= upto - n GROUP BY s.ds, item""")
def pattern_draws(spark, sf_dir):
    """256 patterns of each data set drawn by their counts: a subsample of sites."""
    item = F.concat_ws("/", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))
    counts = X.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("ds"), item.alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return ascent.draw_counts(counts, "item", 256)


# --- normal distributions ----------------------------------------------------

_FORMS = "f AS (SELECT ds, dim, mean, greatest(variance, 1e-3) AS diag, avg(greatest(variance, 1e-3)) OVER (PARTITION BY ds) AS const FROM m)"


@query(f"""WITH {X.POINTS}, {MOMENTS}, {_FORMS} SELECT ds, form, {r('sum(v)', 'trace')}, {r('sum(mean * mean)', 'mean_square')}, {r('sum(ln(v))', 'log_det')}, {r("CASE WHEN form = 'diag' THEN sum(ln(v) * ln(v)) * 5 ELSE max(ln(v) * ln(v)) * 5 END", 'penalty')}, CAST(CASE WHEN form = 'diag' THEN count(*) ELSE 1 END AS BIGINT) AS parameters
FROM (SELECT ds, mean, 'const' AS form, const AS v FROM f UNION ALL SELECT ds, mean, 'diag', diag FROM f) x GROUP BY ds, form""")
def covariance_forms(spark, sf_dir):
    """Trace, squared mean, log determinant and penalty of each data set's normal distribution, with one variance and with one for each axis; none falls below the floor."""
    m = _moments(X.points(spark, sf_dir)).withColumn("v", F.greatest("variance", F.lit(1e-3)))
    one = m.groupBy("ds").agg(F.avg("v").alias("v"))
    const = m.drop("v").join(one, "ds").withColumn("form", F.lit("const"))
    both = const.unionByName(m.withColumn("form", F.lit("diag"))).withColumn("l", F.log("v"))
    found = both.groupBy("ds", "form").agg(F.sum("v").alias("trace"), F.sum(F.col("mean") * F.col("mean")).alias("mean_square"), F.sum("l").alias("log_det"), F.sum(F.col("l") * F.col("l")).alias("all"), F.max(F.col("l") * F.col("l")).alias("one"), F.count(F.lit(1)).alias("n"))
    diag = F.col("form") == "diag"
    return rounded(found.select("ds", "form", "trace", "mean_square", "log_det", (5 * F.when(diag, F.col("all")).otherwise(F.col("one"))).alias("penalty"), F.when(diag, F.col("n")).otherwise(1).alias("parameters")), "trace", "mean_square", "log_det", "penalty")


# --- texts -----------------------------------------------------------------

@query(f"""WITH {EUCLIDEAN} SELECT ds, i, string_agg(format('{{:.3f}}', round(d * 1000) / 1000), chr(9) ORDER BY j) AS line FROM d GROUP BY ds, i""")
def distance_matrix_lines(spark, sf_dir):
    """The upper triangle of each distance matrix, a line for each row that has one."""
    d = distances.euclidean(X.points(spark, sf_dir)).withColumn("d", F.round(F.col("d") * 1000) / 1000)
    cells = F.transform(F.array_sort(F.collect_list(F.struct("j", "d"))), lambda s: F.format_string("%.3f", s["d"]))
    return d.groupBy("ds", "i").agg(F.array_join(cells, "\t").alias("line"))


@query(f"WITH {CELLS} SELECT ds, taxon AS cell, taxon || chr(9) || array_to_string(codes, chr(9)) AS line FROM cells")
def mutation_table_lines(spark, sf_dir):
    """Barcode tables as text with tabs, a line for each cell."""
    return X.cell_rows(spark, sf_dir).select("ds", F.col("taxon").alias("cell"), F.concat_ws("\t", F.col("taxon").cast("string"), F.array_join(F.transform("codes", lambda c: c.cast("string")), "\t")).alias("line"))


@query(f"""WITH {X.MUTATIONS}, k AS (SELECT ds, state, count(*) AS n FROM mutations WHERE state > 0 GROUP BY ds, state), t AS (SELECT ds, sum(n) AS n FROM k GROUP BY ds),
e AS (SELECT k.ds, string_agg(state || '=' || format('{{:.4f}}', round(10000.0 * k.n / t.n) / 10000), ' ' ORDER BY state) AS rates FROM k JOIN t ON t.ds = k.ds GROUP BY k.ds)
SELECT m.ds, 'cells ' || count(DISTINCT cell) || ' edits ' || max(state) || ' silencing 0.4 leading 0.05 rates ' || any_value(rates) AS model FROM mutations m JOIN e ON e.ds = m.ds GROUP BY m.ds""")
def barcode_model_lines(spark, sf_dir):
    """The barcode model of each data set before a fit, as text."""
    m = X.mutations(spark, sf_dir)
    k = m.where("state > 0").groupBy("ds", "state").agg(F.count(F.lit(1)).alias("n"))
    rate = F.round(10000.0 * F.col("n") / F.col("t")) / 10000
    cells = F.transform(F.array_sort(F.collect_list(F.struct("state", rate.alias("q")))), lambda s: F.concat(s["state"].cast("string"), F.lit("="), F.format_string("%.4f", s["q"])))
    rates = k.join(k.groupBy("ds").agg(F.sum("n").alias("t")), "ds").groupBy("ds").agg(F.array_join(cells, " ").alias("rates"))
    sizes = m.groupBy("ds").agg(F.count_distinct("cell").alias("cells"), F.max("state").alias("edits"))
    return sizes.join(rates, "ds").select("ds", F.format_string("cells %d edits %d silencing 0.4 leading 0.05 rates %s", "cells", "edits", "rates").alias("model"))


@query(f"""WITH {X.TREES}, l AS (SELECT DISTINCT tree, node FROM trees WHERE node LIKE 'L%')
SELECT tree, '#NEXUS BEGIN TAXA; DIMENSIONS NTAX=' || count(*) || '; TAXLABELS ' || string_agg(node, ' ' ORDER BY node) || '; END;' AS line FROM l GROUP BY tree""")
def nexus_taxa(spark, sf_dir):
    """Head of a NEXUS file for each tree."""
    tips = trees.leaves(X.trees(spark, sf_dir)).groupBy("tree").agg(F.array_sort(F.collect_list("node")).alias("n"))
    return tips.select("tree", F.format_string("#NEXUS BEGIN TAXA; DIMENSIONS NTAX=%d; TAXLABELS %s; END;", F.size("n"), F.array_join("n", " ")).alias("line"))


# --- trees -----------------------------------------------------------------

@query("""SELECT o_custkey AS tree, count(*) FILTER (o_orderpriority <> '5-LOW') AS shared, count(*) FILTER (o_orderpriority = '5-LOW') AS only_left,
  CAST(CASE WHEN count(*) FILTER (o_orderpriority <> '5-LOW') = 0 THEN 1 ELSE 0 END AS BIGINT) AS only_right FROM orders GROUP BY o_custkey""")
def leaf_agreement(spark, sf_dir):
    """Leaves that both trees of a customer have, or only one, where the second has lost the group of lowest priority; a tree that lost all has its root for a leaf."""
    other = X.other_trees(spark, sf_dir).where("node <> 'Y5-LOW' AND (parent IS NULL OR parent <> 'Y5-LOW')")
    return trees.leaf_agreement(X.trees(spark, sf_dir), other)


_SP = "ln(1 + exp(least(60, greatest(-60, 4.0 * ({0}))))) / 4.0"


@query(f"""WITH {X.TREES}, p AS (SELECT tree, parent, max(length) AS time FROM trees WHERE node LIKE 'L%' GROUP BY tree, parent),
q AS (SELECT p.tree, max(p.time + t.length) AS time FROM p JOIN trees t ON t.tree = p.tree AND t.node = p.parent GROUP BY p.tree),
b AS (SELECT t.tree, t.length + 1e-6 AS len, 1e-6 + {_SP.format("CASE WHEN t.node LIKE 'L%' THEN p.time ELSE q.time - p2.time END")} AS tau FROM trees t LEFT JOIN p ON p.tree = t.tree AND p.parent = t.parent LEFT JOIN p p2 ON p2.tree = t.tree AND p2.parent = t.node JOIN q ON q.tree = t.tree WHERE t.parent IS NOT NULL),
z AS (SELECT tree, len, tau, ln(len / tau) + 0.18 AS z FROM b)
SELECT tree, count(*) AS branches, {r('sum(tau)', 'time')}, {r("sum(-ln(len) - (CASE WHEN abs(z) <= 0.5 THEN z * z / 2 ELSE 0.5 * abs(z) - 0.125 END) / 0.36 - ln(0.6) - 0.5 * ln(2 * pi()))", 'clock')}, {r('-count(*) * ln(sum(tau))', 'yule')} FROM z GROUP BY tree""")
def relaxed_clock_prior(spark, sf_dir):
    """Log prior of each tree under a relaxed clock; a node's time is the longest way down to its leaves."""
    t = X.trees(spark, sf_dir)
    down = trees.ancestors(t, trees.leaves(t).select("tree", "node")).groupBy("tree", F.col("anc").alias("node")).agg(F.max("dist").alias("time"))
    above = down.select("tree", F.col("node").alias("parent"), F.col("time").alias("above"))
    edges = t.where("parent IS NOT NULL").join(down, ["tree", "node"]).join(above, ["tree", "parent"])
    return rounded(ascent.relaxed_clock(edges.select("tree", "length", "above", F.col("time").alias("below"))), "time", "clock", "yule")


_RAW = 0.3
_SIGMA = ascent.SIGMA_FLOOR + math.log1p(math.exp(_RAW))
_OFF = math.log(_SIGMA) - ascent.LOG_SIGMA_MEAN
_CLOCK = f"""{X.TREES}, p AS (SELECT tree, parent, max(length) AS time FROM trees WHERE node LIKE 'L%' GROUP BY tree, parent),
q AS (SELECT p.tree, max(p.time + t.length) AS time FROM p JOIN trees t ON t.tree = p.tree AND t.node = p.parent GROUP BY p.tree),
b AS (SELECT t.tree, t.node, t.parent, t.length + 1e-6 AS len, CASE WHEN t.node LIKE 'L%' THEN p.time ELSE q.time - p2.time END AS delta FROM trees t LEFT JOIN p ON p.tree = t.tree AND p.parent = t.parent LEFT JOIN p p2 ON p2.tree = t.tree AND p2.parent = t.node JOIN q ON q.tree = t.tree WHERE t.parent IS NOT NULL),
z AS (SELECT *, 1e-6 + {_SP.format('delta')} AS tau, ln(len / (1e-6 + {_SP.format('delta')})) + {_SIGMA**2 / 2!r} AS z FROM b),
k AS (SELECT *, CASE WHEN abs(z) <= 0.5 THEN z * z / 2 ELSE 0.5 * abs(z) - 0.125 END AS rho, least(0.5, greatest(-0.5, z)) AS psi, sum(tau) OVER (PARTITION BY tree) AS whole, count(*) OVER (PARTITION BY tree) AS n FROM z)"""


def _clock(spark, sf_dir):
    """Branches with the times of both ends, the longest way down to a leaf; leaves have none."""
    t = X.trees(spark, sf_dir)
    tips = trees.leaves(t).select("tree", "node")
    down = trees.ancestors(t, tips).groupBy("tree", F.col("anc").alias("node")).agg(F.max("dist").alias("time"))
    inner = down.join(tips, ["tree", "node"], "left_anti")
    return t.where("parent IS NOT NULL").join(inner.withColumnRenamed("time", "below"), ["tree", "node"], "left").join(inner.select("tree", F.col("node").alias("parent"), F.col("time").alias("above")), ["tree", "parent"])


@query(f"""WITH {_CLOCK} SELECT tree, {r(f'sum(-ln(len) - rho / {_SIGMA**2!r} - ln({_SIGMA!r}) - 0.5 * ln(2 * pi())) - max(n) * ln(max(whole)) - {0.5 * _OFF**2 / ascent.LOG_SIGMA_SD**2!r}', 'log_prior')},
{r(f'{1 / (1 + math.exp(-_RAW))!r} * (sum(-1 / {_SIGMA!r} - psi / {_SIGMA!r} + 2 * rho / {_SIGMA**3!r}) - {_OFF / ascent.LOG_SIGMA_SD**2 / _SIGMA!r})', 'raw_slope')} FROM k GROUP BY tree""")
def clock_spread_slopes(spark, sf_dir):
    """Log prior of each tree under a relaxed clock whose spread has a prior too, and its slope in the spread's free parameter."""
    return rounded(ascent.clock_slopes(_clock(spark, sf_dir), _RAW)[0].drop("sigma"), "log_prior", "raw_slope")


@query(f"""WITH {_CLOCK}, s AS (SELECT *, (psi / ({_SIGMA**2!r} * tau) - n / whole) / (1 + exp(-least(60, greatest(-60, 4.0 * delta)))) AS s FROM k),
e AS (SELECT tree, node, sum(s) AS s FROM (SELECT tree, parent AS node, s FROM s UNION ALL SELECT tree, node, -s FROM s WHERE node NOT LIKE 'L%') x GROUP BY tree, node)
SELECT tree, node, 'length' AS kind, {r(f'(-1 - psi / {_SIGMA**2!r}) / len', 'slope')} FROM k UNION ALL SELECT tree, node, 'time', {r('s - avg(s) OVER (PARTITION BY tree)', 'slope')} FROM e""")
def clock_node_slopes(spark, sf_dir):
    """Slopes of that prior in every branch's length and every inner node's time."""
    _, lengths, times = ascent.clock_slopes(_clock(spark, sf_dir), _RAW)
    return rounded(lengths.withColumn("kind", F.lit("length")).unionByName(times.withColumn("kind", F.lit("time"))), "slope")


# --- geometry, joins, slopes -------------------------------------------------

_CURVED = AnalysisConfig(hyperbolic=True, curvature=4.0)


@query(f"""WITH {X.POINTS}, u AS (
  SELECT a.ds, a.taxon AS i, b.taxon AS j, greatest(1.0, sqrt(1 + list_inner_product(a.x, a.x)) * sqrt(1 + list_inner_product(b.x, b.x)) - list_inner_product(a.x, b.x)) AS u, list_distance(a.x, b.x) AS flat {_PAIRS})
SELECT ds, i, j, {r('flat', 'flat')}, {r('ln(u + sqrt(u * u - 1)) / 2', 'curved')} FROM u""")
def geometry_distances(spark, sf_dir):
    """Distances by the geometry that an analysis names."""
    p = X.points(spark, sf_dir)
    curved = embedding.point_distances(p, _CURVED).withColumnRenamed("d", "curved")
    return rounded(embedding.point_distances(p).withColumnRenamed("d", "flat").join(curved, ["ds", "i", "j"]), "flat", "curved")


@query(f"WITH {JOIN1}, t AS (SELECT ds, taxon, row_number() OVER (PARTITION BY ds ORDER BY taxon) - 1 AS at FROM points) SELECT best.ds, CAST(a.at AS INTEGER) AS u, CAST(b.at AS INTEGER) AS v, CAST(n AS INTEGER) AS w, CAST(n AS INTEGER) AS n, {r('d', 'd_uv')}, {r('s_i', 's_u')}, {r('s_j', 's_v')} FROM best JOIN t a ON a.ds = best.ds AND a.taxon = i JOIN t b ON b.ds = best.ds AND b.taxon = j")
def nj_tape_start(spark, sf_dir):
    """The first entry of every data set's tape of joins."""
    tape = inference.join_tape(distances.euclidean(X.points(spark, sf_dir)))
    return rounded(tape.where("step = 0").drop("step"), "d_uv", "s_u", "s_v")


@query()
def nj_tape(spark, sf_dir):
    """The tape of joins of every data set."""
    return rounded(inference.join_tape(distances.euclidean(X.points(spark, sf_dir))), "d_uv", "s_u", "s_v")


@query()
def midpoint_trees(spark, sf_dir):
    """Neighbour-joining trees with the root in the middle of the longest way."""
    return rounded(inference.rerooted(inference.build_trees(distances.euclidean(X.points(spark, sf_dir)), "nj")), "length")


@query()
def initial_embedding(spark, sf_dir):
    """Five coordinates for each taxon from the distances of its data set."""
    x = embedding.embed(distances.euclidean(X.points(spark, sf_dir)))
    return x.withColumn("x", F.transform("x", lambda v: F.round(v, 6) + F.lit(0.0)))


@query()
def mean_trees(spark, sf_dir):
    """Tree of the mean distances over the draws around the points."""
    from cladewise.plans.queries import SAMPLES, _draws

    d = distances.euclidean(_draws(spark, sf_dir).withColumn("ds", F.col("ds") * SAMPLES + F.col("sample")))
    mean = d.withColumn("ds", F.floor(F.col("ds") / SAMPLES)).groupBy("ds", "i", "j").agg(F.avg("d").alias("d"))
    return rounded(inference.build_trees(mean, "nj"), "length")


@query(f"""WITH b AS (SELECT o_orderkey AS branch, greatest(CAST(o_totalprice AS DOUBLE) / 1e5, 1e-6) AS t FROM orders), e AS (SELECT branch, exp(-1.25 * t) AS e FROM b)
SELECT branch, {r('(1 - e) / 5 + e', 'stay')}, {r('(1 - e) / 5', 'move')}, {r('-e', 'stay_slope')}, {r('e / 4', 'move_slope')} FROM e""")
def migration_transition(spark, sf_dir):
    """Probabilities of five equally likely states over a branch, and their slopes in its length."""
    t = (F.col("o_totalprice").cast("double") / 1e5).alias("t")
    b = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("branch"), t)
    stay, move = states.stay_and_move(F.col("t"), 5)
    d_stay, d_move = states.stay_and_move_slopes(F.col("t"), 5)
    return rounded(b.select("branch", stay.alias("stay"), move.alias("move"), d_stay.alias("stay_slope"), d_move.alias("move_slope")), "stay", "move", "stay_slope", "move_slope")
