"""Slopes of the relaxed clock's prior against differences, drawn sites, labelled tree lines."""

import math

import pytest

from cladewise.operators import ascent, newick, pruning

EDGES = [("A", "U", 0.3), ("B", "U", 0.9), ("C", "R", 1.2), ("U", "R", 0.5)]
TIMES = {"U": 0.4, "R": 1.1}


def _branches(spark, edges=EDGES, times=TIMES):
    rows = [(1, n, p, x, times[p], times.get(n)) for n, p, x in edges]
    return spark.createDataFrame(rows, "tree long, node string, parent string, length double, above double, below double")


def _value(spark, raw=0.2, edges=EDGES, times=TIMES, **options):
    return ascent.clock_slopes(_branches(spark, edges, times), raw, **options)[0].first()["log_prior"]


@pytest.mark.parametrize("options", [{}, {"prior": "gamma", "sigma_mean": 2.0}, {"prior": None}])
def test_slopes_equal_differences(spark, options):
    h, held = 1e-5, {} if options.get("prior") != "gamma" else None
    tree, lengths, times = ascent.clock_slopes(_branches(spark), 0.2, **options)
    top = tree.first()
    assert top["sigma"] == pytest.approx(0.4 + math.log1p(math.exp(0.2)))
    assert top["raw_slope"] == pytest.approx((_value(spark, 0.2 + h, **options) - _value(spark, 0.2 - h, **options)) / (2 * h), rel=1e-5)
    if held is not None:  # the gamma prior's scale follows the lengths, but is held in slopes
        for r in lengths.collect():
            by = lambda d, node=r["node"]: [(n, p, x + d * (n == node)) for n, p, x in EDGES]
            assert r["slope"] == pytest.approx((_value(spark, edges=by(h), **options) - _value(spark, edges=by(-h), **options)) / (2 * h), rel=1e-4)
    raw = {n: (_value(spark, times={**TIMES, n: t + h}, **options) - _value(spark, times={**TIMES, n: t - h}, **options)) / (2 * h) for n, t in TIMES.items()}
    mean = sum(raw.values()) / 2
    assert {r["node"]: pytest.approx(r["slope"], abs=1e-5) for r in times.collect()} == {n: v - mean for n, v in raw.items()}


def test_prior_must_be_known(spark):
    with pytest.raises(ValueError):
        ascent.clock_slopes(_branches(spark), 0.2, prior="beta")


def test_drawn_sites_stand_for_all(spark):
    counts = spark.createDataFrame([(1, 0, 7), (1, 3, 1), (2, 0, 5)], "tree long, pattern int, n long")
    got = pruning.subsample(counts, 10, 3).collect()
    assert {r["tree"]: pytest.approx(sum(x["n"] for x in got if x["tree"] == r["tree"])) for r in got} == {1: 8, 2: 5}
    many = {(r["tree"], r["pattern"]): r["n"] for r in pruning.subsample(counts, 4000, 3).collect()}
    assert many[1, 0] == pytest.approx(7, abs=0.2) and many[1, 3] == pytest.approx(1, abs=0.2)
    assert pruning.subsample(counts.where("n < 0"), 10).count() == 0


def test_lines_name_every_state(spark):
    edges = spark.createDataFrame([(7, "R", None, 0.0), (7, "B", "R", 0.25), (7, "A", "R", 1.0)], "tree long, node string, parent string, length double")
    states = spark.createDataFrame([(7, "R", "x"), (7, "A", "y")], "tree long, node string, state string")
    assert newick.nexus(edges, states).first()["line"] == "TREE sample_7 = [&R] (A[&state=y]:1.000000,B:0.250000)R[&state=x];"
