"""Slopes against finite differences."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cladewise.operators import distances
from cladewise.operators import gradients as G
from cladewise.operators import inference as I
from cladewise.plans import queries
from cladewise.plans.config import AnalysisConfig


def _case(n=7, sites=12, seed=3, states=4):
    rng = np.random.default_rng(seed)
    d = rng.uniform(0.3, 1.2, (n, n))
    d = np.triu(d, 1)
    return list(range(10, 10 + n)), d + d.T, rng.integers(-1, states, (n, sites))


@pytest.mark.parametrize("model", ["jc", "hky", "barcode"])
def test_slopes_of_lengths_and_parameters(model):
    names, d, codes = _case()
    found, counts = G.patterns(codes)
    assert counts.sum() == codes.shape[1]
    tree = G.JoinedTree(names, d)
    given = {"kappa": 3.0, "nu": 0.5, "leading": 0.2}
    value, slope, by = G.model_slopes(tree, found, counts, model, **given)
    edges = pd.DataFrame(I.neighbour_joining(names, d), columns=["node", "parent", "length"]).assign(length=lambda e: np.maximum(e["length"], 1e-3))
    if model == "jc":
        tips = {f"t{n}": t for n, t in zip(names, G.base_tips(codes))}
        assert value == pytest.approx(I.prune(edges, tips, I.jukes_cantor_matrix, np.full(4, 0.25)).sum())
    for u, _ in tree.edges():
        if tree.lengths[u] < 1e-3:
            continue
        up, down = tree.lengths.copy(), tree.lengths.copy()
        up[u] += 1e-5
        down[u] -= 1e-5
        two = [G.model_slopes(tree, found, counts, model, **given, lengths=x)[0] for x in (up, down)]
        assert slope[u] == pytest.approx((two[0] - two[1]) / 2e-5, rel=1e-4, abs=1e-5)
    for name, s in by.items():
        two = [G.model_slopes(tree, found, counts, model, **{**given, name: given[name] + e})[0] for e in (1e-5, -1e-5)]
        assert s == pytest.approx((two[0] - two[1]) / 2e-5, rel=1e-4, abs=1e-5)
    assert set(by) == {"jc": set(), "hky": {"kappa"}, "barcode": {"nu", "leading"}}[model]


def test_way_back_through_joins():
    """The last joins always tie, so rounding may change their order; then only both ways are compared with each other."""
    compared = 0
    for seed in range(6):
        names, d, _ = _case(8, seed=seed)
        tree = G.JoinedTree(names, d)
        g = np.random.default_rng(seed).normal(size=len(tree.lengths))
        back = tree.back(g)
        for a in range(8):
            for b in range(a + 1, 8):
                e = np.zeros_like(d)
                e[a, b] = e[b, a] = 1e-7
                up, down = G.JoinedTree(names, d + e), G.JoinedTree(names, d - e)
                assert g @ tree.forth(e / 1e-7) == pytest.approx(back[a, b], abs=1e-9)
                if all([s[:3] for s in t.steps] == [s[:3] for s in tree.steps] for t in (up, down)):
                    assert back[a, b] == pytest.approx(g @ (up.lengths - down.lengths) / 2e-7, abs=1e-5)
                    compared += 1
    assert compared > 30


def test_way_back_through_average_linkage():
    names, d, _ = _case(7, seed=5)
    rng = np.random.default_rng(0)
    g = {n: rng.normal() for n, p, _ in I.upgma(names, d) if p is not None}
    back = G.linkage_back(names, d, g)
    for a in range(7):
        for b in range(a + 1, 7):
            e = np.zeros_like(d)
            e[a, b] = e[b, a] = 1e-7
            two = [sum(g[n] * x for n, p, x in I.upgma(names, m) if p is not None) for m in (d + e, d - e)]
            assert back[a, b] == pytest.approx((two[0] - two[1]) / 2e-7, abs=1e-5)


@pytest.mark.parametrize("config", [AnalysisConfig(), AnalysisConfig(hyperbolic=True, curvature=2.0)])
def test_slopes_of_points(spark, config):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4, 3))
    g = {(i, j): float(rng.normal()) for i in range(4) for j in range(i + 1, 4)}

    def value(x):
        t = np.sqrt(1 + (x * x).sum(1))
        if config.curved:
            return sum(v * np.arccosh(t[i] * t[j] - x[i] @ x[j]) / np.sqrt(config.curvature) for (i, j), v in g.items())
        return sum(v * np.linalg.norm(x[i] - x[j]) for (i, j), v in g.items())

    points = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "ds long, taxon long, x array<double>")
    slopes = spark.createDataFrame([(0, i, j, v) for (i, j), v in g.items()], "ds long, i long, j long, g double")
    got = {(r["taxon"], r["dim"]): r["slope"] for r in G.point_slopes(slopes, points, config).collect()}
    for i in range(4):
        for k in range(3):
            e = np.zeros_like(x)
            e[i, k] = 1e-6
            assert got[i, k] == pytest.approx((value(x + e) - value(x - e)) / 2e-6, abs=1e-6)


def test_traces_come_near(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(0, i, rng.normal(size=20).tolist()) for i in range(50)], "ds long, row long, x array<double>")
    exact = rows.select(F.expr("aggregate(x, 0D, (a, v) -> a + v * v)").alias("s")).agg(F.sum("s")).first()[0]
    assert G.traces(rows, 400).first()["trace"] == pytest.approx(exact, rel=0.1)


def test_tree_slopes_of_a_table(spark):
    names, d, codes = _case(5)
    pairs = spark.createDataFrame([(1, names[a], names[b], float(d[a, b])) for a in range(5) for b in range(a + 1, 5)], "ds long, i long, j long, d double")
    seqs = spark.createDataFrame([(1, n, c.tolist()) for n, c in zip(names, codes)], "ds long, taxon long, codes array<int>")
    got = G.tree_slopes(pairs, seqs).groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in got} == {"likelihood": 1, "length": 8, "distance": 10}
    with pytest.raises(Exception, match="no sequence of taxon"):
        G.tree_slopes(pairs, seqs.where("taxon > 10")).collect()


@pytest.mark.parametrize("config", [AnalysisConfig(), AnalysisConfig(hyperbolic=True, curvature=2.0)])
def test_slopes_of_pairs_that_carry_their_points(spark, config):
    points = spark.createDataFrame([(n // 4, n, [float(n), 0.5 * n * n, 1.0]) for n in range(8)], "ds long, taxon long, x array<double>")
    carried = distances.pairs(points, "ds", "taxon", "x").withColumn("g", F.col("i") - 2.0 * F.col("j"))
    far, near = ({(r["taxon"], r["dim"]): r["slope"] for r in G.point_slopes(s, points, config).collect()} for s in (carried.drop("x_i", "x_j"), carried))
    assert near == pytest.approx(far) and len(near) == 24


def test_pairs_with_their_points_do_not_travel(spark, tmp_path):
    """No shuffle but that of the points: neither pairs nor their shares are dealt again."""
    rows = [(n, [float((n * k) % 7) for k in range(1, 4)]) for n in range(130)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    for name in ("point_slopes", "curved_point_slopes"):
        plan = queries.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert dealt and all("hashpartitioning(ds" in line and "dim" not in line and "taxon" not in line.split("hashpartitioning(")[1].split(")")[0] for line in dealt)
