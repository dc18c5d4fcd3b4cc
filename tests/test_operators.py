"""Hand-checked values, brute force on small inputs, and properties."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cladewise.functions import scalars as S
from cladewise.operators import crispr, distances, inference, newick, sampling, trees
from cladewise.sources.shared import stored


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_scalars(spark):
    lit = F.lit
    assert one(spark, S.jukes_cantor(lit(1), lit(4))) == pytest.approx(0.304098831, abs=1e-9)
    assert one(spark, S.jukes_cantor(lit(3), lit(4))) == 3.0 and one(spark, S.jukes_cantor(lit(0), lit(0))) is None
    assert one(spark, S.poisson(lit(1), lit(3))) == pytest.approx(0.405465108, abs=1e-9)
    assert one(spark, S.poisson(lit(3), lit(3))) == 3.0 and one(spark, S.poisson(lit(0), lit(0))) == 3.0
    assert one(spark, S.huber(lit(0.3))) == pytest.approx(0.045) and one(spark, S.huber(lit(2.0))) == pytest.approx(0.875)
    assert one(spark, S.acosh_stable(lit(1 + 1e-10))) == pytest.approx(1.41421356e-05, rel=1e-7)
    assert one(spark, S.acosh_stable(lit(1e12))) == pytest.approx(math.acosh(1e12))
    assert one(spark, S.softplus(lit(100.0))) == pytest.approx(60.0)
    x = F.array(lit(3.0), lit(4.0))
    image, log_det = S.radial_flow(x, 1.0, 2.0, 5.0)
    assert one(spark, image) == [6.0, 8.0] and one(spark, log_det) == pytest.approx(1.098612289)
    u, w = (lambda a, b: lambda d: F.when(d == 0, lit(a)).otherwise(lit(b)))(0.3, 0.1), lambda d: F.when(d == 0, lit(0.5)).otherwise(lit(0.0))
    image, log_det = S.planar_flow(F.array(lit(1.0), lit(2.0)), u, w, 0.25)
    assert one(spark, image) == pytest.approx([1.190544686, 2.063514895]) and one(spark, log_det) == pytest.approx(0.085707743)


def test_pair_index_is_a_bijection(spark):
    df = spark.createDataFrame([(i, j, 7) for i, j in itertools.combinations(range(7), 2)], "i long, j long, n long")
    assert [r.k for r in df.select("i", "j", S.pair_index(F.col("i"), F.col("j"), F.col("n")).alias("k")).orderBy("i", "j").collect()] == list(range(21))


def test_hyperbolic_distance(spark):
    df = spark.createDataFrame([(0, 1, [0.0]), (0, 2, [math.sinh(1.0)])], "ds long, taxon long, x array<double>")
    assert distances.hyperbolic(df).first().d == pytest.approx(1.0)


NAMES = ["A", "B", "C", "D"]


def frame(spark, values):
    return spark.createDataFrame([(0, a, b, float(v)) for (a, b), v in zip(itertools.combinations(NAMES, 2), values)], "ds long, i string, j string, d double")


def test_first_joins(spark):
    d = frame(spark, [5, 7, 8, 8, 9, 9])
    m = distances.first_join(d).first()
    assert (m.i, m.j) == ("A", "B")
    up = distances.first_update(d).collect()
    assert {(r.len_u, r.len_v) for r in up} == {(2.0, 3.0)} and {r.k: r.d for r in up} == {"C": 5.0, "D": 6.0}
    edges = {r.node: r.length for r in inference.build_trees(d, "nj").collect()}
    assert [edges[f"t{n}"] for n in NAMES] == [2.0, 3.0, 4.0, 5.0]
    edges = {r.node: r.length for r in inference.build_trees(frame(spark, [2, 6, 6, 6, 6, 4]), "upgma").collect()}
    assert [edges[f"t{n}"] for n in NAMES] == [1.0, 1.0, 2.0, 2.0]
    assert distances.validate(d).first().complete and distances.diameter(d).first().d == 9.0


def leaf_matrix(edges):
    parent = {n: (p, x) for n, p, x in edges}
    inner = {p for p, _ in parent.values()}
    out = {}
    paths = {}
    for n in parent:
        if n not in inner:
            path, dist, k = {}, 0.0, n
            while k is not None:
                path[k] = dist
                dist, k = dist + parent[k][1], parent[k][0]
            paths[n] = path
    for a, b in itertools.combinations(sorted(paths), 2):
        out[a, b] = min(x + paths[b][k] for k, x in paths[a].items() if k in paths[b])
    return out


@settings(max_examples=25, deadline=None)
@given(st.integers(3, 9), st.integers(0, 10_000))
def test_additive_matrix_gives_its_tree(n, seed):
    rng = np.random.default_rng(seed)
    nodes, edges = [f"t{i:02d}" for i in range(n)], []
    while len(nodes) > 1:
        a, b = rng.choice(len(nodes), 2, replace=False)
        new = f"i{len(edges)}"
        edges += [(nodes[a], new, float(rng.uniform(0.1, 2))), (nodes[b], new, float(rng.uniform(0.1, 2)))]
        nodes = [x for k, x in enumerate(nodes) if k not in (a, b)] + [new]
    want = leaf_matrix(edges + [(nodes[0], None, 0.0)])
    names = [f"{i:02d}" for i in range(n)]
    d = np.zeros((n, n))
    for (a, b), v in want.items():
        d[int(a[1:]), int(b[1:])] = d[int(b[1:]), int(a[1:])] = v
    got = leaf_matrix(inference.neighbour_joining(names, d))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_newick_round_trip(spark):
    texts = ["((A:1,B:2):0.5,(C:1.5,D:1):0.25);", "(A:1,(B:0.5,(C:1,(D:1,E:2):1):1):1);", "(A,B,C)"]
    df = spark.createDataFrame(list(enumerate(texts)), "tree long, newick string")
    edges = newick.to_edges(df)
    assert {r.tree for r in edges.where("parent IS NULL").collect()} == {0, 1, 2}
    back = {r.tree: r.newick for r in newick.from_edges(edges, 2).collect()}
    assert back[0] == "((A:1.00,B:2.00):0.50,(C:1.50,D:1.00):0.25);"
    again = newick.to_edges(spark.createDataFrame([(k, v) for k, v in back.items()], "tree long, newick string"))
    first, second = ({(r.tree, r.i, r.j): round(r.d, 6) for r in trees.leaf_distances(e).collect()} for e in (edges, again))
    assert first == second and first[1, "D", "E"] == 3.0
    with pytest.raises(ValueError):
        newick.parse("((A,B);")


def rf(spark, a, b):
    tree = lambda t: newick.to_edges(spark.createDataFrame([(0, t)], "tree long, newick string"))
    return trees.robinson_foulds(tree(a), tree(b)).first().rf


def test_robinson_foulds(spark):
    assert rf(spark, "((A,B),(C,D))", "((A,C),(B,D))") == 2
    assert rf(spark, "((A,B),(C,(D,E)))", "((A,C),(B,(D,E)))") == 2
    assert rf(spark, "((A,B),(C,(D,E)))", "(A,(B,(C,(D,E))))") == 0


def test_tree_length_prior(spark):
    df = spark.createDataFrame([(0, f"n{k}", "R", 10 / 6 - 1e-6) for k in range(6)] + [(0, "R", None, 0.0)], "tree long, node string, parent string, length double")
    r = trees.length_prior(df).first()
    assert r.yule == pytest.approx(-13.815510558) and r.gamma == pytest.approx(-2.916290732)


def test_barcode_transitions(spark):
    df = spark.createDataFrame([(0, 1.0)], "branch long, t double")
    p = {(r.a, r.b): r for r in crispr.transition(df, edits=2, nu=0.5).collect()}
    assert [p[0, b].p for b in range(4)] == pytest.approx([0.223130160, 0.191700250, 0.191700250, 0.393469340])
    near = {(r.a, r.b): r.p for r in crispr.transition(df.withColumn("t", F.lit(1.0 + 1e-6)), 2, 0.5).collect()}
    steeper = {(r.a, r.b): r.p for r in crispr.transition(df, 2, 0.5 + 1e-6).collect()}
    for k, row in p.items():
        assert row.dp_dt == pytest.approx((near[k] - row.p) / 1e-6, abs=1e-5) and row.dp_dnu == pytest.approx((steeper[k] - row.p) / 1e-6, abs=1e-5)
    m = inference.barcode_matrix(1.0, 2, 0.5)
    assert m.sum(1) == pytest.approx(1) and all(m[k] == pytest.approx(r.p) for k, r in p.items())


def test_pruning_equals_enumeration():
    edges = pd.DataFrame([("t1", "a", 0.3), ("t2", "a", 0.2), ("a", "r", 0.4), ("t3", "r", 0.1), ("r", None, 0.0)], columns=["node", "parent", "length"])
    tips = {"t1": np.eye(4)[[0, 1]], "t2": np.eye(4)[[0, 2]], "t3": np.stack([np.ones(4), np.eye(4)[3]])}
    got = inference.prune(edges, tips, inference.jukes_cantor_matrix, np.full(4, 0.25))
    P = inference.jukes_cantor_matrix
    for s in range(2):
        total = 0.0
        for root, a in itertools.product(range(4), repeat=2):
            total += 0.25 * P(0.4)[root, a] * (P(0.3)[a] @ tips["t1"][s]) * (P(0.2)[a] @ tips["t2"][s]) * (P(0.1)[root] @ tips["t3"][s])
        assert got[s] == pytest.approx(math.log(total))


def test_resampling_takes_as_many_as_it_has(spark):
    df = spark.createDataFrame([(0, i, float(i % 7)) for i in range(100)] + [(1, 0, 5.0)], "ds long, draw long, lw double")
    got = sampling.systematic_resample(df).groupBy("ds").agg(F.sum("times").alias("n")).collect()
    assert {r.ds: r.n for r in got} == {0: 100, 1: 1}
    whole, cut = ({(r.ds, r.draw): r.times for r in sampling.systematic_resample(df, stretch=n).collect()} for n in (1 << 16, 7))
    assert whole == cut
    w = sampling.importance_weights(df).groupBy("ds").agg(F.sum("w").alias("w")).collect()
    assert all(r.w == pytest.approx(1) for r in w)


def test_repair(spark):
    df = spark.createDataFrame([(0, "R", None, 0.0), (0, "a", "R", -1.0), (0, "b", "R", 2.0), (1, "R", None, 0.0), (1, "a", "R", 0.0)], "tree long, node string, parent string, length double")
    assert {(r.tree, r.node): r.length for r in trees.repair_lengths(df).collect()} == {(0, "R"): 0.0, (0, "a"): 1e-3, (0, "b"): 2.0, (1, "R"): 0.0, (1, "a"): 0.1}


def test_site_counts_of_long_alignments(spark):
    """More sites than a million, as in alignments of genomes."""
    n = 1_200_005
    code = F.when(F.col("id") == 0, F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: (k % 4).cast("int"))).otherwise(
        F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.when(k <= 1_100_000, (k + 1) % 4).when(k % 10 == 0, -1).otherwise(k % 4).cast("int")))
    got = distances.site_counts(spark.range(2).select(F.lit(7).alias("ds"), F.col("id").alias("taxon"), code.alias("codes"))).collect()
    assert [(r.compared, r.differ) for r in got] == [(n - 10_000, 1_100_000)]


def ladder(spark, n, tree=1):
    """A tree of n leaves as deep as can be: node k has leaf k and node k + 1 below it."""
    rows = [(tree, "n0", None, 0.0)] + [(tree, f"n{k}", f"n{k - 1}", 1.0) for k in range(1, n - 1)] + [(tree, f"L{k}", f"n{min(k, n - 2)}", 0.5) for k in range(n)]
    return spark.createDataFrame(rows, "tree long, node string, parent string, length double")


def test_deep_trees(spark):
    n = 1500
    deep = ladder(spark, n)
    h = {r.node: (r.height, r.depth) for r in trees.heights(deep).collect()}
    assert all(h[f"n{k}"] == (k, k) for k in range(n - 1)) and all(h[f"L{k}"] == (min(k, n - 2) + 0.5, min(k, n - 2) + 1) for k in range(n))
    sizes = {r["size"]: r["count"] for r in trees.split_prints(deep).groupBy("size").count().collect()}
    assert sizes == {k: 1 if 2 * k == n else 2 for k in range(2, n // 2 + 1)}
    small = ladder(spark, 90)
    d = {(r.i, r.j): r.d for r in trees.leaf_distances(small).collect()}
    at = [min(k, 88) for k in range(90)]
    assert len(d) == 90 * 89 // 2 and all(d[tuple(sorted((f"L{a}", f"L{b}")))] == abs(at[a] - at[b]) + 1.0 for a in range(90) for b in range(a))
    up = trees.ancestors(small, trees.leaves(small).select("tree", "node"))
    assert up.count() == sum(k + 2 for k in at) and up.where("dist <> greatest(steps - 0.5, 0)").isEmpty()
    named = {frozenset(r.split.split(",")) for r in trees.splits(small).collect()}
    assert len(named) == trees.split_prints(small).count() == 87
    moved = small.withColumn("node", F.when(F.col("node") == "L3", "L80").when(F.col("node") == "L80", "L3").otherwise(F.col("node")))
    r = trees.robinson_foulds(small, moved).first()
    other = {frozenset(x.split.split(",")) for x in trees.splits(moved).collect()}
    assert (r.n_left, r.n_right, r.common, r.rf) == (87, 87, len(named & other), len(named ^ other))


def test_circles_are_errors(spark):
    loop = spark.createDataFrame([(1, "a", "b", 1.0), (1, "b", "c", 1.0), (1, "c", "a", 1.0)], "tree long, node string, parent string, length double")
    with pytest.raises(ValueError, match="above itself"):
        trees.heights(loop)
    with pytest.raises(ValueError, match="above itself"):
        trees.ancestors(loop, loop.select("tree", "node"))


def test_allowed_states(spark):
    tree = spark.createDataFrame([(0, "R", None, 0.0), (0, "u", "R", 1.0), (0, "v", "u", 1.0), (0, "a", "v", 1.0), (0, "b", "v", 1.0), (0, "c", "u", 1.0), (0, "d", "R", 1.0)], "tree long, node string, parent string, length double")
    sites = {0: dict(a=2, b=2, c=2, d=2), 1: dict(a=2, b=-1, c=-1, d=3), 2: dict(a=-1, b=-1, c=-1, d=-1), 3: dict(a=0, b=1, c=1, d=1), 4: dict(a=-1, b=-1, c=4, d=-1)}
    cells = spark.createDataFrame([(0, n, s, x) for s, row in sites.items() for n, x in row.items()], "tree long, node string, site int, state int")
    got = {(r.site, r.node): r.allowed for r in crispr.allowed_states(tree, cells).collect()}
    assert got == {(s, n): x for s, row in enumerate([(2, 2, 2), (2, 2, 0), (-1, -1, -1), (0, 0, 0), (-1, 4, 4)]) for n, x in zip("vuR", row)}


def test_ways_back_through_flows_equal_differences(spark):
    rng = np.random.default_rng(5)
    x, g, u, w = rng.normal(size=(4, 3))
    b, alpha, beta, radius, share, h = 0.2, 1.3, 0.7, 1.9, 0.6, 1e-6
    lit = lambda v: F.array(*[F.lit(float(a)) for a in v])

    def radial(x, alpha, beta):
        r = np.linalg.norm(x)
        k = 1 / (alpha + r / radius)
        return g @ (x + beta * k * x) + share * (2 * np.log(1 + beta * k) + np.log(1 + beta * k - beta * k * k / radius * r))

    def planar(x, u, w, b):
        t = np.tanh(x @ w + b)
        return g @ (x + u * t) + share * np.log(abs(1 + (1 - t * t) * (w @ u)))

    def slope(f, at, k):
        def moved(s):
            args = [np.array(a, float) for a in at]
            flat = args[k].reshape(-1)
            return [f(*[a if n != k else (flat + s * e).reshape(args[k].shape) for n, a in enumerate(args)]) for e in np.eye(flat.size)]

        return (np.array(moved(h)) - np.array(moved(-h))) / (2 * h)

    got = [one(spark, c) for c in S.radial_flow_back(lit(x), lit(g), alpha, beta, radius, share)]
    assert all(np.allclose(v, slope(radial, (x, alpha, beta), k), atol=1e-6) for k, v in enumerate(got))
    got = [one(spark, c) for c in S.planar_flow_back(lit(x), lit(g), lit(u), lit(w), b, share)]
    assert all(np.allclose(v, slope(planar, (x, u, w, b), k), atol=1e-6) for k, v in enumerate(got))
    assert one(spark, S.radial_flow_back(lit([0.0, 0.0]), lit([1.0, 2.0]), 1.0, 2.0, 5.0)[0]) == [3.0, 6.0]


def test_trees_become_lines_in_one_pass(spark):
    """Trees are no groups of their own, and each has one line, also where its rows came from many partitions."""
    rows = [(t, n, p, x) for t in range(2500) for n, p, x in (("R", None, 0.0), ("b", "R", 0.5), ("a", "R", float(t)))]
    trees = spark.createDataFrame(rows, "tree long, node string, parent string, length double").repartition(5)
    marks = spark.createDataFrame([(t, "a", "x") for t in range(2500) if t % 2], "tree long, node string, state string")
    lines = newick.nexus(trees, marks)
    assert "FlatMapGroups" not in lines._jdf.queryExecution().executedPlan().toString()
    got = {r.tree: r.line for r in lines.collect()}
    assert lines.count() == len(got) == 2500
    assert all(got[t] == f"TREE sample_{t} = [&R] (a{'[&state=x]' if t % 2 else ''}:{t:.6f},b:0.500000)R;" for t in got)
    assert {r.tree: r.newick for r in newick.from_edges(trees, 1).collect()} == {t: f"(a:{t:.1f},b:0.5)R;" for t in range(2500)}


def test_splits_meet_only_nodes_with_an_edge_above(spark, monkeypatch):
    """Leaves meet their parents only: no stored table of either kind of split is longer than the tree."""
    kept = []

    def noted(df, **options):
        kept.append(stored(df, **options))
        return kept[-1]

    monkeypatch.setattr(trees, "stored", noted)
    monkeypatch.setattr(trees, "release", lambda *frames: None)
    rows = [(1, "R", None, 0.0)] + [(1, f"Y{k}", "R", 1.0) for k in range(4)] + [(1, f"L{k}", f"Y{k % 4}", 1.0) for k in range(40)]
    flat = spark.createDataFrame(rows, "tree long, node string, parent string, length double")
    named = {frozenset(r.split.split(",")) for r in trees.splits(flat).collect()}
    assert named == {frozenset(f"L{k}" for k in range(y, 40, 4)) for y in range(4)}
    assert {(r["size"]) for r in trees.split_prints(flat).collect()} == {10} and trees.split_prints(flat).count() == 4
    assert max(df.count() for df in kept) <= 45


def test_two_halves_are_one_split(spark):
    tree = spark.createDataFrame([(1, "R", None, 0.0), (1, "x", "R", 1.0), (1, "y", "R", 1.0), *[(1, n, "x" if n in "ab" else "y", 1.0) for n in "abcd"], (2, "only", None, 0.0)], "tree long, node string, parent string, length double")
    assert trees.split_prints(tree).count() == 1 and [tuple(r) for r in trees.splits(tree).collect()] == [(1, 2, "a,b")]
    got = {r.tree: (r.n_left, r.n_right, r.common, r.rf) for r in trees.robinson_foulds(tree, tree).collect()}
    assert got == {1: (1, 1, 1, 0), 2: (0, 0, 0, 0)}
