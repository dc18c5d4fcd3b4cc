"""Registered queries of likelihoods on average-linkage trees and on customers' trees, with SQL that goes through the levels by recursion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from cladewise.functions import matrices as M
from cladewise.functions import scalars as S
from cladewise.operators import crispr, distances, linkage, pruning
from cladewise.plans import fixtures as X
from cladewise.plans.linkages import linkage_sql
from cladewise.plans.queries import CELLS, _counts_sql
from cladewise.plans.registry import query, r, rounded
from cladewise.sources import models
from cladewise.sources.shared import stored

LEAST, FLOOR, NEVER = 1e-3, "1e-300", "-1e9"
P = Callable[[int, int], str]

_JC = f"""{_counts_sql('alignment')}, d AS (SELECT ds, i, j, CASE WHEN compared = 0 THEN NULL WHEN CAST(differ AS DOUBLE) / compared >= 0.75 THEN 3.0 ELSE -0.75 * ln(1 - 4.0 * differ / compared / 3) END AS d FROM c)"""
_POISSON = f"""{_counts_sql('cells')}, d AS (SELECT ds, i, j, CASE WHEN compared = 0 OR differ >= compared THEN 3.0 ELSE least(3.0, -ln(1 - CAST(differ AS DOUBLE) / compared)) END AS d FROM c)"""
DEPTHS = """dp AS (SELECT ds, node, parent, length, 0 AS depth FROM ed WHERE parent IS NULL UNION ALL SELECT e.ds, e.node, e.parent, e.length, dp.depth + 1 FROM dp JOIN ed e ON e.ds = dp.ds AND e.parent = dp.node)"""


def _up_sql(k: int, first: str, send: str, cells: str = "cells_", more: str = "") -> str:
    """Tables ``up`` (log values ``v`` of each node and site) and ``ms`` (with ``x``, the values scaled, and ``e``, what is sent up, scaled).

    ``first``: whether a cell ``c`` may be state ``{a}``; ``send``: what a node
    sends for state ``{a}`` is up to the caller, by ``x0`` ... and ``t``; ``more``: a join that it needs.
    """
    v = lambda f, sep=", ": sep.join(f(a) for a in range(k))
    top = f"greatest({v(lambda a: f'v{a}')})"
    scaled = f"SELECT s.*, {v(lambda a: f'exp(v{a} - top) AS x{a}')} FROM (SELECT up.*, greatest(dp.length, {LEAST}) AS t, dp.length AS raw, {top} AS top FROM up JOIN dp ON dp.ds = up.ds AND dp.node = up.node) s"
    sent = f"SELECT y.*, {v(lambda a: f'greatest({send(a)}, {FLOOR}) AS e{a}')} FROM ({scaled}) y {more}"
    leaf = f"SELECT dp.ds, dp.node, dp.parent, dp.depth, c.site, {v(lambda a: f'CAST(CASE WHEN {first.format(a=a)} THEN 0 ELSE {NEVER} END AS DOUBLE) AS v{a}')} FROM dp JOIN {cells} c ON c.ds = dp.ds AND c.node = dp.node"
    return f"""up AS ({leaf} WHERE dp.depth = (SELECT max(depth) FROM dp)
  UNION ALL (WITH w AS ({sent} WHERE y.depth > 0),
    g AS (SELECT ds, parent AS node, site, {v(lambda a: f'sum(top + ln(e{a})) AS v{a}')} FROM w GROUP BY ds, parent, site)
    SELECT g.ds, g.node, dp.parent, dp.depth, g.site, {v(lambda a: f'v{a}')} FROM g JOIN dp ON dp.ds = g.ds AND dp.node = g.node
    UNION ALL {leaf} WHERE dp.depth = (SELECT max(depth) - 1 FROM w))),
ms AS ({sent})"""


def _value(k: int, share: Callable[[int], str]) -> str:
    return "top + ln(greatest(" + " + ".join(f"{share(a)} * x{a}" for a in range(k)) + f", {FLOOR}))"


_BASES = "cells_ AS (SELECT ds, 't' || taxon AS node, unnest(codes) AS c, generate_subscripts(codes, 1) - 1 AS site FROM alignment)"
_DNA = f"WITH RECURSIVE {X.ALIGNMENT}, {_JC}, {linkage_sql('d')}, {DEPTHS}, {_BASES}"
_SAME_BASE = "c.c < 0 OR c.c = {a}"
_MOVE, _MORE = "(1 - exp(-4.0 / 3 * t)) / 4", "exp(-4.0 / 3 * t)"


def _jc_send(a: int) -> str:
    return f"{_MOVE} * (x0 + x1 + x2 + x3) + {_MORE} * x{a}"


_JC_UP = f"{_DNA}, {_up_sql(4, _SAME_BASE, _jc_send)}"


def _alignment_tree(spark, sf_dir):
    a = X.alignment(spark, sf_dir)
    joins = linkage.merges(distances.jukes_cantor(a))
    return a, joins, stored(linkage.edges(joins))


@query(f"{_JC_UP} SELECT ds, CAST(count(*) AS INTEGER) AS sites, {r('sum(' + _value(4, lambda a: '0.25') + ')', 'log_likelihood')} FROM ms WHERE depth = 0 GROUP BY ds")
def dna_loglik(spark, sf_dir):
    """Jukes-Cantor log likelihood of each data set's alignment on its average-linkage tree."""
    a, _, edges = _alignment_tree(spark, sf_dir)
    return rounded(pruning.dna_likelihood(edges, a), "log_likelihood")


SUBSAMPLE = 16


@query(f"""{_JC_UP}, pt AS (SELECT ds, min(site) AS pattern, count(*) AS n FROM (SELECT ds, site, list(c ORDER BY node) AS codes FROM cells_ GROUP BY ds, site) x GROUP BY ds, codes),
sh AS (SELECT *, sum(n) OVER (PARTITION BY ds ORDER BY pattern) AS upto, sum(n) OVER (PARTITION BY ds) AS whole FROM pt),
un AS (SELECT ds, draw, {S.uniform_sql('1', 'ds', 'draw')} * whole AS u FROM (SELECT DISTINCT ds, whole FROM sh) h CROSS JOIN (SELECT unnest(range({SUBSAMPLE})) AS draw) d),
dn AS (SELECT sh.ds, pattern, count(*) * any_value(whole) / {SUBSAMPLE} AS weight FROM sh JOIN un ON un.ds = sh.ds AND u < upto AND u >= upto - n GROUP BY sh.ds, pattern)
SELECT ms.ds, CAST(round(sum(weight)) AS INTEGER) AS sites, {r('sum(weight * (' + _value(4, lambda a: '0.25') + '))', 'log_likelihood')} FROM ms JOIN dn ON dn.ds = ms.ds AND dn.pattern = ms.site WHERE depth = 0 GROUP BY ms.ds""")
def subsampled_loglik(spark, sf_dir):
    """The same from 16 sites of each data set, drawn by their patterns' counts."""
    a, _, edges = _alignment_tree(spark, sf_dir)
    return rounded(pruning.dna_likelihood(edges, a, draws=SUBSAMPLE), "log_likelihood")


def _hky(a: int, b: int) -> str:
    """Probability of base b after base a, in closed form; bases of even number are purines."""
    side = "pr" if b % 2 == 0 else "py"
    if (a - b) % 2:
        return f"(p{b} * (1 - exp(-beta * t)))"
    slow, fast = f"p{b} + p{b} * (1 / {side} - 1) * exp(-beta * t)", f"exp(-beta * t * (1 + {side} * (kappa - 1)))"
    return f"({slow} + ({side} - p{b}) / {side} * {fast})" if a == b else f"({slow} - p{b} / {side} * {fast})"


_FREQS = """fr AS (SELECT *, p0 + p2 AS pr, p1 + p3 AS py, 4.0 AS kappa, 1 / (2 * ((p0 + p2) * (p1 + p3) + 4.0 * (p0 * p2 + p1 * p3))) AS beta FROM (
  SELECT ds, (count(*) FILTER (c = 0) + 1) / (count(*) + 4) AS p0, (count(*) FILTER (c = 1) + 1) / (count(*) + 4) AS p1, (count(*) FILTER (c = 2) + 1) / (count(*) + 4) AS p2, (count(*) FILTER (c = 3) + 1) / (count(*) + 4) AS p3 FROM cells_ WHERE c >= 0 GROUP BY ds))"""
_HKY_UP = f"{_DNA}, {_FREQS}, {_up_sql(4, _SAME_BASE, lambda a: ' + '.join(f'{_hky(a, b)} * x{b}' for b in range(4)), more='JOIN fr ON fr.ds = y.ds')}"


HKY_SQL = f"{_HKY_UP} SELECT ms.ds, CAST(count(*) AS INTEGER) AS sites, {r('sum(' + _value(4, lambda a: f'p{a}') + ')', 'log_likelihood')} FROM ms JOIN fr ON fr.ds = ms.ds WHERE depth = 0 GROUP BY ms.ds"


@query(HKY_SQL)
def hky_loglik(spark, sf_dir):
    """As ``dna_loglik`` with transitions four times as likely and the data's own frequencies."""
    a, _, edges = _alignment_tree(spark, sf_dir)
    return rounded(pruning.dna_likelihood(edges, a, "hky"), "log_likelihood")


@query(HKY_SQL)
def model_text_loglik(spark, sf_dir):
    """The same under models that were written as text, one for each data set, and read again."""
    a, _, edges = _alignment_tree(spark, sf_dir)
    freqs = pruning.base_frequencies(a).withColumn("rates", M.reversible(F.array(*[F.lit(x) for x in (1.0, 4.0, 1.0, 1.0, 4.0, 1.0)]), F.col("freqs"), 4, True))
    text = models.write(freqs.select(F.col("tree").cast("string").alias("path"), F.lit("ACGT").alias("alphabet"), F.lit("HKY85").alias("kind"), "freqs", "rates", F.lit(None).cast("string").alias("newick")))
    given = stored(models.parse(stored(text)).withColumn("ds", F.col("path").cast("long")))
    return rounded(pruning.dna_likelihood(edges, a, "given", given=given), "log_likelihood")


_D_MOVE, _D_MORE = "exp(-4.0 / 3 * t) / 3", "-4.0 / 3 * exp(-4.0 / 3 * t)"
_four = lambda f, sep=", ": sep.join(f(a) for a in range(4))
_JC_SLOPES = f"""{_JC_UP}, dn AS (SELECT ds, node, site, {_four(lambda a: f'ln(0.25) + v{a} AS w{a}')}, CAST(NULL AS DOUBLE) AS slope, raw FROM ms WHERE depth = 0
  UNION ALL SELECT ds, node, site, {_four(lambda a: f'ln({_MOVE} * (u0 + u1 + u2 + u3) + {_MORE} * u{a}) + v{a}')}, CASE WHEN raw >= {LEAST} THEN ({_four(lambda a: f'u{a} * ({_D_MOVE} * (x0 + x1 + x2 + x3) + ({_D_MORE}) * x{a})', ' + ')}) / ({_four(lambda a: f'u{a} * e{a}', ' + ')}) ELSE 0.0 END, raw
  FROM (SELECT *, {_four(lambda a: f'exp(r{a} - greatest(r0, r1, r2, r3)) AS u{a}')} FROM (SELECT ms.*, {_four(lambda a: f'dn.w{a} - ln(e{a}) AS r{a}')} FROM dn JOIN ms ON ms.ds = dn.ds AND ms.parent = dn.node AND ms.site = dn.site)))"""


def _dna_slopes(spark, sf_dir):
    a, joins, edges = _alignment_tree(spark, sf_dir)
    sweep, root, counts = pruning.dna_sweep(edges, a, least=LEAST)
    found = sweep.slopes(root, counts).select(F.col("tree").alias("ds"), "node", "length")
    held = found.join(edges.select("ds", "node", F.col("length").alias("given")), ["ds", "node"])
    return joins, held.select("ds", "node", F.when(F.col("given") >= LEAST, F.col("length")).otherwise(0.0).alias("g"))


@query(f"{_JC_SLOPES} SELECT ds, node, {r('sum(slope)', 'slope')} FROM dn WHERE slope IS NOT NULL GROUP BY ds, node")
def dna_length_slopes(spark, sf_dir):
    """Slope of each branch of the average-linkage trees in the likelihood of ``dna_loglik``."""
    return rounded(_dna_slopes(spark, sf_dir)[1].withColumnRenamed("g", "slope"), "slope")


@query(f"""{_JC_SLOPES}, sl AS (SELECT dn.ds, dn.node, any_value(ed.parent) AS parent, sum(slope) AS g FROM dn JOIN ed ON ed.ds = dn.ds AND ed.node = dn.node WHERE slope IS NOT NULL AND ed.length > 0 GROUP BY dn.ds, dn.node),
me AS (SELECT ds, node, node AS leaf FROM ed WHERE node LIKE 't%' UNION ALL SELECT me.ds, ed.parent, me.leaf FROM me JOIN ed ON ed.ds = me.ds AND ed.node = me.node WHERE ed.parent IS NOT NULL),
gn AS (SELECT ds, node, sum(g) AS g FROM (SELECT ds, parent AS node, g FROM sl UNION ALL SELECT ds, node, -g FROM sl) GROUP BY ds, node)
SELECT jo.ds, least(a.leaf, b.leaf) AS i, greatest(a.leaf, b.leaf) AS j, {r('g / (2 * left_n * right_n)', 'slope')} FROM jo JOIN gn ON gn.ds = jo.ds AND gn.node = jo.node JOIN me a ON a.ds = jo.ds AND a.node = jo.l JOIN me b ON b.ds = jo.ds AND b.node = jo.r""")
def dna_distance_slopes(spark, sf_dir):
    """Slope of that likelihood in each distance, back through the average linkage."""
    joins, g = _dna_slopes(spark, sf_dir)
    return rounded(linkage.distance_slopes(stored(joins), stored(g)), "slope")


@query()
def exchange_rate_slopes(spark, sf_dir):
    """Slope of each data set's likelihood in the six exchange rates of a general reversible model, and in the ratio of transitions."""
    a, _, edges = _alignment_tree(spark, sf_dir)
    sweep, root, counts = pruning.dna_sweep(edges, a, "gtr")
    found = pruning.exchange_slopes(sweep, root, counts, F.array(*[F.lit(1.0)] * 6))
    named = found.select(F.col("tree").alias("ds"), *[F.col("slopes")[k].alias(p) for k, p in enumerate(pruning.BASE_PAIRS)])
    return rounded(named.withColumn("kappa", F.col("AG") + F.col("CT")), *pruning.BASE_PAIRS, "kappa")


# --- barcodes -------------------------------------------------------------------

_EDITS, _NU, _LEADING = 3, 0.4, 0.05
_CODES = "cells_ AS (SELECT ds, 't' || taxon AS node, unnest(codes) AS c, generate_subscripts(codes, 1) - 1 AS site FROM cells)"
_BARCODE = f"WITH RECURSIVE {CELLS}, {_POISSON}, {linkage_sql('d')}, {DEPTHS}, {_CODES}"
_SAME_STATE = f"c.c = {{a}} OR (c.c < 0 AND {{a}} = {_EDITS + 1})"


def _barcode_send(a: int, t: str = "t") -> str:
    alive, quiet = f"exp(-{_NU} * {t})", f"(1 - exp(-{_NU} * {t}))"
    if a == 0:
        return f"{alive} * (exp(-{t}) * x0 + (1 - exp(-{t})) * ({' + '.join(f'q{e} * x{e}' for e in range(1, _EDITS + 1))})) + {quiet} * x{_EDITS + 1}"
    return f"x{a}" if a == _EDITS + 1 else f"{alive} * x{a} + {quiet} * x{_EDITS + 1}"


_ROOT = f"top + ln(greatest({_barcode_send(0, str(_LEADING))}, {FLOOR}))"
_ALIKE = f"rt AS (SELECT ds, {', '.join(f'CASE WHEN m >= {e} THEN 1.0 / m ELSE 0 END AS q{e}' for e in range(1, _EDITS + 1))} FROM (SELECT ds, greatest(max(c), 1) AS m FROM cells_ GROUP BY ds))"
_SHARES = f"rt AS (SELECT ds, site, {', '.join(f'coalesce(count(*) FILTER (c = {e}) / nullif(count(*) FILTER (c > 0), 0), 0) AS q{e}' for e in range(1, _EDITS + 1))} FROM cells_ GROUP BY ds, site)"


def _cell_tree(spark, sf_dir):
    m = X.cell_rows(spark, sf_dir)
    return m, stored(linkage.edges(linkage.merges(distances.poisson(m))))


@query(f"""{_BARCODE}, {_ALIKE}, {_up_sql(_EDITS + 2, _SAME_STATE, _barcode_send, more='JOIN rt ON rt.ds = y.ds')}
SELECT ms.ds, CAST(count(*) AS INTEGER) AS sites, {r(f'sum({_ROOT})', 'log_likelihood')} FROM ms JOIN rt ON rt.ds = ms.ds WHERE depth = 0 GROUP BY ms.ds""")
def crispr_loglik(spark, sf_dir):
    """Barcode log likelihood of each data set's cells on their average-linkage tree, all edits alike."""
    m, edges = _cell_tree(spark, sf_dir)
    return rounded(pruning.barcode_likelihood(edges, m), "log_likelihood")


@query(f"""{_BARCODE}, {_SHARES}, {_up_sql(_EDITS + 2, _SAME_STATE, _barcode_send, more='JOIN rt ON rt.ds = y.ds AND rt.site = y.site')}
SELECT ms.ds, CAST(count(*) AS INTEGER) AS sites, {r(f'sum({_ROOT})', 'log_likelihood')} FROM ms JOIN rt ON rt.ds = ms.ds AND rt.site = ms.site WHERE depth = 0 GROUP BY ms.ds""")
def crispr_sitewise_loglik(spark, sf_dir):
    """As ``crispr_loglik`` with each site's own shares of edits."""
    m, edges = _cell_tree(spark, sf_dir)
    shares = crispr.mutation_rates(X.mutations(spark, sf_dir), by_site=True).select("ds", "site", "state", F.col("empirical").alias("rate"))
    return rounded(pruning.barcode_likelihood(edges, m, rates=shares), "log_likelihood")


@query()
def barcode_parameter_slopes(spark, sf_dir):
    """Slopes of the barcode likelihood in the rate of silencing (the leading branch left aside) and in the sum of all lengths."""
    m, edges = _cell_tree(spark, sf_dir)
    sweep, root, counts = pruning.barcode_sweep(edges, m)
    return rounded(sweep.slopes(root, counts).groupBy(F.col("tree").alias("ds")).agg(F.sum("nu").alias("nu"), F.sum("length").alias("length")), "nu", "length")


@query(f"""{_BARCODE}, me AS (SELECT ds, node, node AS leaf FROM ed WHERE node LIKE 't%' UNION ALL SELECT me.ds, ed.parent, me.leaf FROM me JOIN ed ON ed.ds = me.ds AND ed.node = me.node WHERE ed.parent IS NOT NULL),
al AS (SELECT me.ds, me.node, c.site, min(c.c) FILTER (c.c >= 0) AS low, max(c.c) FILTER (c.c >= 0) AS high FROM me JOIN cells_ c ON c.ds = me.ds AND c.node = me.leaf WHERE me.node <> me.leaf GROUP BY me.ds, me.node, c.site)
SELECT ds, node, CAST(site AS INTEGER) AS site, CAST(CASE WHEN low IS NULL THEN -1 WHEN low = high THEN low ELSE 0 END AS INTEGER) AS allowed FROM al""")
def ancestral_restriction(spark, sf_dir):
    """States that the cells below leave to each inner node of the average-linkage trees, site by site."""
    m, edges = _cell_tree(spark, sf_dir)
    cells = m.select(F.col("ds").alias("tree"), F.concat(F.lit("t"), F.col("taxon").cast("string")).alias("node"), F.posexplode("codes").alias("site", "state"))
    return crispr.allowed_states(edges.withColumnRenamed("ds", "tree"), cells).withColumnRenamed("tree", "ds")


# --- migration with unequal rates ---------------------------------------------------

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
RATES = [0.1 * (1 + a + 2 * b) for a in range(5) for b in range(a + 1, 5)]
_PRIMARY = 2
_FULL = [[0.2 * RATES[a * (9 - a) // 2 + b - a - 1] if a < b else 0.2 * RATES[b * (9 - b) // 2 + a - b - 1] if b < a else 0.0 for b in range(5)] for a in range(5)]
_LEAVE = max(sum(row) for row in _FULL)
_JUMP = ", ".join(f"({a}, {b}, CAST({(_FULL[a][b] if a != b else -sum(_FULL[a])) / _LEAVE + (a == b)!r} AS DOUBLE))" for a in range(5) for b in range(5))
_POWERS = f"""jp AS (SELECT * FROM (VALUES {_JUMP}) x(a, b, v)), pw AS (SELECT 0 AS n, a, b, CAST(CASE WHEN a = b THEN 1 ELSE 0 END AS DOUBLE) AS v FROM jp UNION ALL SELECT n + 1, a, b, s FROM (SELECT pw.n, pw.a, jp.b, sum(pw.v * jp.v) AS s FROM pw JOIN jp ON jp.a = pw.b WHERE pw.n < 60 GROUP BY ALL))"""
_P = f"sum(exp(-{_LEAVE!r} * t + n * ln({_LEAVE!r} * t) - lgamma(n + 1)) * v)"
_STATES = f"""st AS (SELECT o_custkey AS tree, 'L' || o_orderkey AS node, CAST(o_orderpriority[1] AS INTEGER) - 1 AS s FROM orders),
lf AS (SELECT t.tree, t.parent AS node, pw.a, ln({_P}) AS m, t.node AS leaf FROM (SELECT *, greatest(length, 1e-6) AS t FROM trees) t JOIN st ON st.tree = t.tree AND st.node = t.node JOIN pw ON pw.b = st.s GROUP BY t.tree, t.node, t.parent, pw.a),
yv AS (SELECT tree, node, a, sum(m) AS v FROM lf GROUP BY tree, node, a),
yp AS (SELECT DISTINCT length, greatest(length, 1e-6) AS t FROM trees WHERE parent = 'R'), pt AS (SELECT length, a, b, {_P} AS p FROM yp CROSS JOIN pw GROUP BY length, a, b),
ym AS (SELECT yv.tree, yv.node, pt.a, sum(pt.p * exp(v - top)) AS e, any_value(top) AS top FROM (SELECT *, max(v) OVER (PARTITION BY tree, node) AS top FROM yv) yv JOIN trees t ON t.tree = yv.tree AND t.node = yv.node JOIN pt ON pt.length = t.length AND pt.b = yv.a GROUP BY yv.tree, yv.node, pt.a),
rv AS (SELECT tree, a, sum(top + ln(e)) AS v FROM ym GROUP BY tree, a), rs AS (SELECT *, max(v) OVER (PARTITION BY tree) AS top FROM rv)"""


def _state_sweep(spark, sf_dir, **options):
    return pruning.state_sweep(X.trees(spark, sf_dir), X.leaf_states(spark, sf_dir), PRIORITIES, RATES, **options)


@query(f"WITH RECURSIVE {X.TREES}, {_POWERS}, {_STATES} SELECT tree, {r('max(top) + ln(sum(exp(v - top)) / 5)', 'log_likelihood')}, {r(f'max(v) FILTER (a = {_PRIMARY})', 'from_primary')} FROM rs GROUP BY tree")
def migration_rates_loglik(spark, sf_dir):
    """Log likelihood of the leaf states of every customer's tree with an exchange rate for each two states, from any state at the root and from the primary one."""
    sweep, root, counts = _state_sweep(spark, sf_dir)
    fixed = root.withColumn("freqs", pruning.one_hot(F.lit(_PRIMARY), 5))
    return rounded(sweep.values(root, counts).join(sweep.values(fixed, counts).withColumnRenamed("log_likelihood", "from_primary"), "tree"), "log_likelihood", "from_primary")


@query()
def migration_rate_slopes(spark, sf_dir):
    """Slope of the likelihood over all customers' trees in each exchange rate."""
    sweep, root, counts = _state_sweep(spark, sf_dir)
    found = pruning.exchange_slopes(sweep, root, counts, F.array(*[F.lit(x) for x in RATES]), normal=False)
    pairs = F.array(*[F.lit(f"{a}|{b}") for i, a in enumerate(PRIORITIES) for b in PRIORITIES[i + 1 :]])
    each = found.select(F.posexplode("slopes").alias("k", "slope")).groupBy("k").agg(F.sum("slope").alias("slope"))
    return rounded(each.select(F.get(pairs, F.col("k")).alias("pair"), "slope"), "slope")
