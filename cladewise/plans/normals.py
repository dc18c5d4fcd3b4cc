"""Registered queries of low-rank normal distributions and of the rejection sampler with rising envelopes, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladewise.functions import scalars as S
from cladewise.operators import lowrank, rejection
from cladewise.plans import fixtures as X
from cladewise.plans.queries import _normal_sql
from cladewise.plans.registry import query, r, rounded

RANK, DRAWN = 2, 4

_FACTORS = f"""{X.POINTS}, e AS (SELECT ds, taxon, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS dim, unnest(x) AS v FROM points),
f AS (SELECT ds, taxon, sqrt(0.01 / 2) * {_normal_sql('1', 'ds', 'taxon', '0')} AS r0, sqrt(0.01 / 2) * {_normal_sql('1', 'ds', 'taxon', '1')} AS r1 FROM points),
g AS (SELECT ds, sum(r0 * r0) AS g00, sum(r0 * r1) AS g01, sum(r1 * r1) AS g11, sum(r0 * r0) * sum(r1 * r1) - pow(sum(r0 * r1), 2) AS det FROM f GROUP BY ds)"""
_NUMBERS = f"""z AS (SELECT ds, dim, CAST(2 * h + side AS BIGINT) AS sample, (1 - 2 * side) * n0 AS n0, (1 - 2 * side) * n1 AS n1 FROM (
  SELECT ds, dim, h, {_normal_sql('1', 'ds', 'h', 'dim', '0')} AS n0, {_normal_sql('1', 'ds', 'h', 'dim', '1')} AS n1 FROM (SELECT DISTINCT ds, dim FROM e) q CROSS JOIN (SELECT unnest(range({DRAWN // 2})) AS h) p) n CROSS JOIN (SELECT unnest([0, 1]) AS side) s),
dr AS (SELECT e.ds, z.sample, e.taxon, e.dim, r0, r1, n0, n1, r0 * n0 + r1 * n1 AS off, v + r0 * n0 + r1 * n1 AS v FROM e JOIN f ON f.ds = e.ds AND f.taxon = e.taxon JOIN z ON z.ds = e.ds AND z.dim = e.dim)"""


def _lowrank(spark, sf_dir):
    p = X.points(spark, sf_dir)
    return p, lowrank.first_factors(p, RANK), lowrank.noise(p, RANK, DRAWN)


@query(f"WITH {_FACTORS}, {_NUMBERS} SELECT ds, sample, taxon, dim, {r('v', 'v')} FROM dr")
def lowrank_draws(spark, sf_dir):
    """Mirrored draws around the points with a covariance of rank two over the taxa."""
    p, f, z = _lowrank(spark, sf_dir)
    return rounded(lowrank.draws(p, f, z, RANK).select("ds", "sample", "taxon", F.posexplode("x").alias("dim", "v")), "v")


@query(f"""WITH {_FACTORS}, {_NUMBERS}, b AS (SELECT ds, sample, dim, sum(r0 * off) AS b0, sum(r1 * off) AS b1 FROM dr GROUP BY ds, sample, dim),
a AS (SELECT b.ds, sample, g00, g01, g11, det, (g11 * b0 - g01 * b1) / det AS a0, (g00 * b1 - g01 * b0) / det AS a1 FROM b JOIN g ON g.ds = b.ds)
SELECT ds, sample, {r('sum(-ln(2 * pi()) - ln(det) / 2 - (a0 * a0 + a1 * a1) / 2)', 'log_density')}, {r('sum(-ln(2 * pi()) - ln(det) / 2 - (g11 * a0 * a0 - 2 * g01 * a0 * a1 + g00 * a1 * a1) / det / 2)', 'embedded')} FROM a GROUP BY ds, sample""")
def lowrank_density(spark, sf_dir):
    """Log density of each draw, by both conventions."""
    p, f, z = _lowrank(spark, sf_dir)
    return rounded(lowrank.log_density(lowrank.draws(p, f, z, RANK), p, f, RANK), "log_density", "embedded")


_ONE = f"SELECT ds, CAST(1 AS INTEGER) AS rank, sum(rr) AS tr, ln(sum(rr)) AS ld FROM (SELECT ds, 0.01 * pow({_normal_sql('1', 'ds', 'taxon', '0')}, 2) AS rr FROM points) o GROUP BY ds"


@query(f"""WITH {_FACTORS}, k AS ({_ONE} UNION ALL SELECT ds, 2, g00 + g11, ln(det) FROM g),
s AS (SELECT ds, sum(v * v) AS sq, count(*) AS full_n, max(dim) + 1 AS d FROM e GROUP BY ds)
SELECT k.ds, rank, {r('d * tr', 'trace')}, {r('sq', 'mean_square')}, {r('d * ld', 'log_det')}, {r('(d * tr + sq - full_n - d * ld) / 2', 'divergence')} FROM k JOIN s ON s.ds = k.ds""")
def lowrank_forms(spark, sf_dir):
    """Trace, squared mean, log determinant and divergence for covariances of rank one and two."""
    p = X.points(spark, sf_dir)
    one, two = (lowrank.forms(p, lowrank.first_factors(p, k), k).withColumn("rank", F.lit(k)) for k in (1, 2))
    return rounded(one.unionByName(two), "trace", "mean_square", "log_det", "divergence")


@query(f"""WITH {_FACTORS}, {_NUMBERS}, s AS (SELECT ds, max(dim) + 1 AS d FROM e GROUP BY ds),
w AS (SELECT ds, taxon, sum(v * n0) / {DRAWN} AS w0, sum(v * n1) / {DRAWN} AS w1 FROM dr GROUP BY ds, taxon),
q AS (SELECT f.ds, f.taxon, d, r0, r1, (g11 * r0 - g01 * r1) / det AS p0, (g00 * r1 - g01 * r0) / det AS p1, w0, w1 FROM f JOIN g ON g.ds = f.ds JOIN s ON s.ds = f.ds JOIN w ON w.ds = f.ds AND w.taxon = f.taxon)
SELECT ds, taxon, CAST(axis AS INTEGER) AS axis, {r('d * (CASE WHEN axis = 0 THEN r0 - p0 ELSE r1 - p1 END)', 'divergence')}, {r('d * (CASE WHEN axis = 0 THEN p0 ELSE p1 END)', 'entropy')}, {r('CASE WHEN axis = 0 THEN w0 ELSE w1 END', 'square')} FROM q CROSS JOIN (SELECT unnest([0, 1]) AS axis) a""")
def lowrank_slopes(spark, sf_dir):
    """Slopes in the factors: of the divergence, of the entropy, and of half the mean square of the drawn points by the way back through the draws."""
    p, f, z = _lowrank(spark, sf_dir)
    drawn = lowrank.draws(p, f, z, RANK).withColumnRenamed("x", "g")
    sides = {"divergence": lowrank.divergence_slopes(p, f, RANK), "entropy": lowrank.divergence_slopes(p, f, RANK, True), "square": lowrank.factor_slopes(drawn, z, RANK)}
    rows = None
    for name, s in sides.items():
        each = s.select("ds", "taxon", F.posexplode("slope").alias("axis", name))
        rows = each if rows is None else rows.join(each, ["ds", "taxon", "axis"])
    return rounded(rows, *sides)


# --- rejection with rising envelopes ---------------------------------------

WANTED, LATER = 200, 1 << 40
_PROPOSALS = f"prop AS (SELECT user_id // {X.CELLS} AS ds, event_id + CASE WHEN event_id % 4 = 0 THEN 0 ELSE {LATER} END AS draw, CAST(day(ts) % 12 AS BIGINT) AS shell, value / 100 AS lw, event_id % 4 = 0 AS pilot FROM events WHERE value IS NOT NULL)"


def proposals(spark, sf_dir):
    """Events as proposals, a data set for each run of users; every fourth is a pilot, and shells are days."""
    e = X.table(spark, sf_dir, "events")
    pilot = F.col("event_id") % 4 == 0
    return e.select(F.floor(F.col("user_id") / X.CELLS).alias("ds"), (F.col("event_id") + F.when(pilot, 0).otherwise(LATER)).alias("draw"), (F.dayofmonth("ts") % 12).cast("long").alias("shell"), (F.col("value") / 100).alias("lw"), pilot.alias("pilot"))


_T = "coalesce(CAST(shell AS DOUBLE) / nullif(last, 0), 0)"
REJECTION = f"""{_PROPOSALS},
o AS (SELECT *, max(shell) OVER (PARTITION BY ds) AS last, count(*) OVER (PARTITION BY ds, shell) AS m, row_number() OVER (PARTITION BY ds, shell ORDER BY lw, draw) - 1 AS up, row_number() OVER (PARTITION BY ds, shell ORDER BY lw DESC, draw DESC) AS down FROM prop WHERE pilot),
pe AS (SELECT ds, shell, max(lw + 0.35 + {_T} * (0.60 - 0.35)) FILTER (up = floor(least(0.9999, 0.990 + {_T} * (0.999 - 0.990)) * (m - 1))) AS bound, coalesce(stddev_samp(lw) FILTER (down <= greatest(20, floor(0.2 * m))), 0) AS spread FROM o GROUP BY ds, shell),
ev AS (SELECT c.ds, c.shell, max(bound) OVER w AS bound, max(spread) OVER w AS spread FROM (SELECT ds, unnest(range(12)) AS shell FROM (SELECT DISTINCT ds FROM pe) d) c LEFT JOIN pe ON pe.ds = c.ds AND pe.shell = c.shell WINDOW w AS (PARTITION BY c.ds ORDER BY c.shell)),
en AS (SELECT ds, shell, coalesce(bound, min(bound) OVER (PARTITION BY ds)) AS bound, coalesce(spread, min(spread) OVER (PARTITION BY ds)) AS spread FROM ev),
ra AS (SELECT ds, shell, CAST(-1 AS BIGINT) AS since, bound, spread, 0 AS n FROM en
  UNION ALL SELECT p.ds, p.shell, min(p.draw), arg_min(p.lw, p.draw) + greatest(0.25, 2 * ra.spread, 1.05 * (arg_min(p.lw, p.draw) - ra.bound)) * pow(1.6, ra.n), ra.spread, ra.n + 1
  FROM ra JOIN prop p ON p.ds = ra.ds AND p.shell = ra.shell AND NOT p.pilot AND p.draw > ra.since AND p.lw > ra.bound GROUP BY p.ds, p.shell, ra.since, ra.bound, ra.spread, ra.n),
sp AS (SELECT *, lead(since) OVER (PARTITION BY ds, shell ORDER BY since) AS until FROM ra),
lu AS (SELECT *, ln({S.uniform_sql('1', 'ds', 'draw')}) AS lu FROM prop),
ju AS (SELECT p.* FROM lu p JOIN sp ON sp.ds = p.ds AND sp.shell = p.shell AND p.draw > sp.since AND (until IS NULL OR p.draw <= until) WHERE lu <= lw - bound AND (pilot OR lw <= bound)),
tk AS (SELECT j.ds, j.draw, j.pilot, min(r.since) FILTER (r.since > j.draw AND lu > lw - r.bound) AS "end" FROM ju j JOIN ra r ON r.ds = j.ds AND r.shell = j.shell GROUP BY j.ds, j.draw, j.pilot),
ch AS (SELECT ds, draw AS since, 1 AS step FROM tk UNION ALL SELECT ds, "end", -1 FROM tk WHERE "end" IS NOT NULL),
st AS (SELECT ds, min(since) AS stop FROM (SELECT ds, since, sum(step) OVER (PARTITION BY ds ORDER BY since) AS run FROM ch) c WHERE run >= {WANTED} GROUP BY ds),
fu AS (SELECT ds, draw AS upto FROM (SELECT ds, draw, row_number() OVER (PARTITION BY ds ORDER BY draw) AS k FROM tk WHERE pilot) c WHERE k = {WANTED}),
rt AS (SELECT p.ds, CAST(count(t.draw) AS DOUBLE) / count(*) AS rate FROM prop p LEFT JOIN fu ON fu.ds = p.ds LEFT JOIN tk t ON t.ds = p.ds AND t.draw = p.draw WHERE p.pilot AND (upto IS NULL OR p.draw <= upto) GROUP BY p.ds),
kn AS (SELECT rt.ds, rate, stop FROM rt LEFT JOIN st ON st.ds = rt.ds),
ou AS (SELECT tk.ds, draw, CAST(row_number() OVER (PARTITION BY tk.ds ORDER BY draw) AS INTEGER) AS place FROM tk JOIN kn ON kn.ds = tk.ds WHERE rate >= 0.001 AND CASE WHEN stop IS NULL THEN "end" IS NULL ELSE draw <= stop AND ("end" IS NULL OR "end" > stop) END)"""


@query(f"WITH RECURSIVE {REJECTION} SELECT ds, draw, place FROM ou")
def adaptive_rejection(spark, sf_dir):
    """The first 200 accepted of each data set's events, whose envelopes rise where an event exceeds them."""
    return rejection.sample(proposals(spark, sf_dir), WANTED)[0]


@query(f"""WITH RECURSIVE {REJECTION} SELECT kn.ds, CASE WHEN rate < 0.001 THEN 'refused' WHEN stop IS NULL THEN 'short' ELSE 'done' END AS state,
  (SELECT count(*) FROM ou WHERE ou.ds = kn.ds) AS accepted, (SELECT count(*) FROM ra WHERE ra.ds = kn.ds AND n > 0 AND (stop IS NULL OR since <= stop)) AS raised, {r('rate', 'rate')} FROM kn""")
def adaptive_rejection_report(spark, sf_dir):
    """State, accepted draws, raised envelopes and pilots' acceptance of each data set."""
    return rounded(rejection.sample(proposals(spark, sf_dir), WANTED)[1], "rate")
