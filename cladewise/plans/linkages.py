"""Registered queries of average-linkage trees, with SQL that joins mutual neighbours round by round."""

from __future__ import annotations

from cladewise.operators import distances, linkage
from cladewise.plans import fixtures as X
from cladewise.plans.queries import EUCLIDEAN
from cladewise.plans.registry import query, r, rounded


def linkage_sql(source: str) -> str:
    """Tables ``jo`` (joins), ``ed`` (edges) of the data sets in ``source(ds, i, j, d)``; for use after ``WITH RECURSIVE``."""
    name = lambda c, n: f"CASE WHEN {n} = 1 THEN 't' || {c} ELSE 'u' || {c} || '_' || {n} END"
    return f"""lk AS (SELECT 'p' AS kind, ds, i AS a, j AS b, d AS total, CAST(1 AS BIGINT) AS na, CAST(1 AS BIGINT) AS nb FROM {source}
  UNION ALL (WITH p AS (SELECT ds, a, b, total, na, nb FROM lk WHERE kind = 'p'),
    e AS (SELECT ds, a AS c, round(total / (na * nb), 9) AS m, a, b FROM p UNION ALL SELECT ds, b, round(total / (na * nb), 9), a, b FROM p),
    ch AS (SELECT ds, a, b FROM (SELECT *, row_number() OVER (PARTITION BY ds, c ORDER BY m, a, b) AS k FROM e) WHERE k = 1),
    mu AS (SELECT ds, a, b FROM ch GROUP BY ds, a, b HAVING count(*) = 2),
    mg AS (SELECT p.* FROM p JOIN mu ON mu.ds = p.ds AND mu.a = p.a AND mu.b = p.b),
    mp AS (SELECT ds, a AS o, a AS w, na + nb AS n FROM mg UNION ALL SELECT ds, b, a, na + nb FROM mg),
    rl AS (SELECT p.ds, coalesce(x.w, p.a) AS a, coalesce(y.w, p.b) AS b, total, coalesce(x.n, na) AS na, coalesce(y.n, nb) AS nb FROM p LEFT JOIN mp x ON x.ds = p.ds AND x.o = p.a LEFT JOIN mp y ON y.ds = p.ds AND y.o = p.b)
    SELECT 'p', ds, least(a, b), greatest(a, b), sum(total), any_value(CASE WHEN a < b THEN na ELSE nb END), any_value(CASE WHEN a < b THEN nb ELSE na END) FROM rl WHERE a <> b GROUP BY ds, least(a, b), greatest(a, b)
    UNION ALL SELECT 'm', ds, a, b, total, na, nb FROM mg)),
jo AS (SELECT ds, {name('a', '(na + nb)')} AS node, {name('a', 'na')} AS l, {name('b', 'nb')} AS r, na AS left_n, nb AS right_n, total / (2 * na * nb) AS height FROM lk WHERE kind = 'm'),
ch2 AS (SELECT ds, l AS node, node AS parent, height FROM jo UNION ALL SELECT ds, r, node, height FROM jo),
ed AS (SELECT c.ds, c.node, c.parent, greatest(0.0, c.height - coalesce(o.height, 0)) AS length FROM ch2 c LEFT JOIN jo o ON o.ds = c.ds AND o.node = c.node
  UNION ALL SELECT ds, node, NULL, 0.0 FROM jo WHERE NOT EXISTS (SELECT 1 FROM ch2 WHERE ch2.ds = jo.ds AND ch2.node = jo.node))"""


_EUCLIDEAN = f"WITH RECURSIVE {EUCLIDEAN}, {linkage_sql('d')}"


def _joins(spark, sf_dir):
    return linkage.merges(distances.euclidean(X.points(spark, sf_dir)))


@query(f"{_EUCLIDEAN} SELECT ds, node, parent, {r('length', 'length')} FROM ed")
def upgma_trees(spark, sf_dir):
    """Average-linkage tree of each data set, as edges."""
    return rounded(linkage.edges(_joins(spark, sf_dir)), "length")


@query(f"{_EUCLIDEAN} SELECT ds, node, l AS \"left\", r AS \"right\", left_n, right_n, {r('height', 'height')} FROM jo")
def average_linkage_heights(spark, sf_dir):
    """Joins of each data set, with sizes and heights."""
    return rounded(_joins(spark, sf_dir), "height")


@query(f"""{_EUCLIDEAN}, me AS (SELECT ds, node, node AS leaf FROM ed WHERE node LIKE 't%' UNION ALL SELECT me.ds, ed.parent, me.leaf FROM me JOIN ed ON ed.ds = me.ds AND ed.node = me.node WHERE ed.parent IS NOT NULL),
gn AS (SELECT ds, node, sum(g) AS g FROM (SELECT ds, parent AS node, 1.0 AS g FROM ed WHERE parent IS NOT NULL AND length > 0 UNION ALL SELECT ds, node, -1.0 FROM ed WHERE parent IS NOT NULL AND length > 0) GROUP BY ds, node)
SELECT jo.ds, least(a.leaf, b.leaf) AS i, greatest(a.leaf, b.leaf) AS j, {r('g / (2 * left_n * right_n)', 'slope')} FROM jo JOIN gn ON gn.ds = jo.ds AND gn.node = jo.node JOIN me a ON a.ds = jo.ds AND a.node = jo.l JOIN me b ON b.ds = jo.ds AND b.node = jo.r""")
def average_linkage_slopes(spark, sf_dir):
    """Slope of each tree's whole length in each distance."""
    return rounded(linkage.distance_slopes(_joins(spark, sf_dir)), "slope")
