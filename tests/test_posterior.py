"""Draws, the fit, and sampled states."""

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladewise.functions import scalars as S
from cladewise.operators import embedding, gradients, inference, linkage, posterior, states, trees
from cladewise.plans.config import AnalysisConfig, Covariance
from cladewise.sources.shared import stored


def symmetric_matrix(t, k):
    """k states with equal rates, one change a unit of time expected."""
    same = np.exp(-t * k / (k - 1))
    return np.full((k, k), (1 - same) / k) + np.eye(k) * same


def test_draws_are_normal_and_mirrored(spark):
    p = spark.createDataFrame([(0, t, [0.0] * 4) for t in range(50)], "ds long, taxon long, x array<double>")
    a = {(r.sample, r.taxon): r.x for r in posterior.draws(p, 40, F.lit(2.0)).collect()}
    assert a == {(r.sample, r.taxon): r.x for r in posterior.draws(p.repartition(5), 40, F.lit(2.0)).collect()}
    assert all(np.allclose(a[2 * k, t], -np.array(a[2 * k + 1, t])) for k in range(20) for t in range(50))
    v = np.concatenate([a[2 * k, t] for k in range(20) for t in range(50)])
    assert abs(v.mean()) < 0.15 and abs(v.std() - 2) < 0.1


def test_fit_does_not_get_worse(spark):
    rng = np.random.default_rng(0)
    p = spark.createDataFrame([(d, t, rng.normal(size=3).tolist()) for d in range(2) for t in range(6)], "ds long, taxon long, x array<double>")
    s = spark.createDataFrame([(d, t, [int(v) for v in rng.integers(-1, 4, 30)]) for d in range(2) for t in range(6)], "ds long, taxon long, codes array<int>")
    for form in ("const", "diag"):
        fits = posterior.fit(p, s, AnalysisConfig(batch_size=4, least_batches=40, block=10, covariance=Covariance(form)), most=60)
        got = fits.collect()
        for d in range(2):
            first = next(r.elbo for r in got if r.ds == d and r.step == 0)
            best = [r for r in got if r.ds == d and r.taxon is not None]
            assert len(best) == 6 and best[0].elbo > first
            assert 40 <= max(r.step for r in got if r.ds == d and r.taxon is None) <= 60
        means = {(r.ds, r.taxon): (r.x, r.log_sigmas) for r in got if r.taxon is not None}
        for r in posterior.fitted_draws(fits, 2).collect():
            x, w = means[r.ds, r.taxon]
            assert all(abs(a - b) < 6 * np.exp(c) for a, b, c in zip(r.x, x, w))
    with pytest.raises(NotImplementedError):
        posterior.fit(p, s, AnalysisConfig(covariance=Covariance.LOWR))


def test_slopes_and_curvature_of_the_bound():
    rng = np.random.default_rng(4)
    x, codes = rng.normal(size=(6, 3)), rng.integers(-1, 4, (6, 20))
    target = posterior._Target(list(range(6)), codes, 3.0, "jc")
    value, slope = target.at(x)
    for i, k in itertools.product(range(6), range(3)):
        e = np.zeros_like(x)
        e[i, k] = 1e-6
        assert slope[i, k] == pytest.approx((target.at(x + e)[0] - target.at(x - e)[0]) / 2e-6, abs=1e-3)
    basis = np.eye(18).reshape(18, 6, 3)
    exact = 18 * target.curvature(x, basis)[1]
    near = target.curvature(x, rng.standard_normal((4000, 6, 3)))
    assert near[0] == pytest.approx(value) and near[1] == pytest.approx(exact, rel=0.1)


def test_sampled_states_follow_the_posterior(spark):
    n, rows, tips = 3000, [], []
    for tree in range(n):
        rows += [(tree, "R", None, 0.0), (tree, "a", "R", 0.6), (tree, "x", "a", 0.4), (tree, "y", "a", 0.8), (tree, "z", "R", 0.5)]
        tips += [(tree, "x", "A"), (tree, "y", "B"), (tree, "z", "B")]
    got = states.draw(spark.createDataFrame(rows, "tree long, node string, parent string, length double"), spark.createDataFrame(tips, "tree long, node string, state string")).where("node IN ('R', 'a')").collect()
    by_tree: dict = {}
    for r in got:
        by_tree.setdefault(r.tree, {})[r.node] = r.state
    seen = Counter((s["R"], s["a"]) for s in by_tree.values())
    P = lambda t: symmetric_matrix(t, 2)
    w = {("AB"[r], "AB"[a]): 0.5 * P(0.6)[r, a] * P(0.4)[a, 0] * P(0.8)[a, 1] * P(0.5)[r, 1] for r, a in itertools.product(range(2), repeat=2)}
    total = sum(w.values())
    assert all(seen[k] / n == pytest.approx(v / total, abs=0.04) for k, v in w.items())


def test_reversible_models():
    from cladewise.operators import inference

    assert np.allclose(inference.reversible((1,) * 6, np.full(4, 0.25))(0.7), inference.jukes_cantor_matrix(0.7))
    f = np.array([0.1, 0.2, 0.3, 0.4])
    move = inference.hky(4.0, f)
    assert np.allclose(move(0.3).sum(1), 1) and np.allclose(f @ move(0.3), f) and np.allclose(move(0.2) @ move(0.3), move(0.5))
    slope = (move(1e-6) - np.eye(4)) / 1e-6
    assert slope[0, 2] / f[2] == pytest.approx(4 * slope[0, 1] / f[1], rel=1e-3)


def test_state_likelihood(spark):
    t = spark.createDataFrame([(0, "R", None, 0.0), (0, "x", "R", 0.4), (0, "y", "R", 0.8)], "tree long, node string, parent string, length double")
    s = spark.createDataFrame([(0, "x", "A"), (0, "y", "B")], "tree long, node string, state string")
    P = lambda d: symmetric_matrix(d, 2)
    want = np.log(sum(0.5 * P(0.4)[r, 0] * P(0.8)[r, 1] for r in range(2)))
    assert states.likelihood(t, s).first().log_likelihood == pytest.approx(want)


def test_states_on_deep_trees_and_leaves_without_state(spark):
    """A caterpillar with a leaf of unknown state, against a sum over all states of inner nodes."""
    rows = [(1, "R", None, 0.0), (1, "a", "R", 0.3), (1, "b", "a", 0.2), (1, "x", "R", 0.5), (1, "y", "a", 0.4), (1, "z", "b", 0.1), (1, "w", "b", 0.6)]
    tips = [(1, "x", "p"), (1, "y", "q"), (1, "z", "q")]
    t, s = spark.createDataFrame(rows, "tree long, node string, parent string, length double"), spark.createDataFrame(tips, "tree long, node string, state string")
    length, P, at = {n: x for _, n, _, x in rows}, symmetric_matrix, {"x": 0, "y": 1, "z": 1}
    want = 0.0
    for R, a, b, w in itertools.product(range(2), repeat=4):
        q = {"R": R, "a": a, "b": b, "w": w, **at}
        want += 0.5 * np.prod([P(length[n], 2)[q[p], q[n]] for _, n, p, _ in rows if p])
    assert states.likelihood(t, s).first().log_likelihood == pytest.approx(np.log(want))
    drawn = {r.node: r.state for r in states.draw(t, s).collect()}
    assert drawn.keys() == length.keys() and all(drawn[n] == "pq"[i] for n, i in at.items())


def test_chi_square():
    assert S.chi_square(3.841458820694124, 1) == pytest.approx(0.95) and S.chi_square(0, 4) == 0
    for k in (1, 2, 64, 500):
        for q in (0.01, 0.5, 0.99):
            assert S.chi_square(S.chi_square_quantile(q, k), k) == pytest.approx(q, abs=1e-9)


def test_linkage_joins_as_one_pair_at_a_time_does(spark):
    """Trees against joining the closest pair again and again, slopes against the dense way back and a difference."""
    rng = np.random.default_rng(1)
    x = {(ds, t): rng.normal(size=3) for ds, n in ((0, 23), (1, 2), (2, 9)) for t in range(n)}
    d = {(ds, i, j): float(np.linalg.norm(x[ds, i] - x[ds, j])) for ds, i in x for e, j in x if ds == e and i < j}
    frame = lambda d: spark.createDataFrame([(*k, v) for k, v in d.items()], "ds long, i long, j long, d double")
    joins = linkage.merges(frame(d))
    got = linkage.edges(joins).collect()
    weights = spark.createDataFrame([(r.ds, r.node, float(k % 5 - 2)) for k, r in enumerate(sorted(got))], "ds long, node string, g double")
    slope = {(r.ds, *sorted((int(r.i[1:]), int(r.j[1:])))): r.slope for r in linkage.distance_slopes(joins, weights).collect()}
    assert slope.keys() == d.keys()

    def clades(edges):
        up = {n: p for n, p, _ in edges}
        out = {n: set() for n in up}
        for leaf in (n for n in up if n[0] == "t"):
            here = leaf
            while here is not None:
                out[here].add(leaf)
                here = up[here]
        return {frozenset(out[n]): (n, length) for n, _, length in edges}

    g = {(r.ds, r.node): r.g for r in weights.collect()}
    for ds in range(3):
        names = sorted(t for e, t in x if e == ds)
        m = np.array([[d.get((ds, *sorted((i, j))), 0.0) for j in names] for i in names])
        want, have = clades(inference.upgma(names, m)), clades([(r.node, r.parent, r.length) for r in got if r.ds == ds])
        assert want.keys() == have.keys() and all(want[c][1] == pytest.approx(have[c][1]) for c in want)
        back = gradients.linkage_back(names, m, {want[c][0]: g[ds, have[c][0]] for c in want})
        assert all(slope[ds, i, j] == pytest.approx(back[i, j]) for i in names for j in names if i < j)
    whole = lambda d: linkage.edges(linkage.merges(frame(d))).agg(F.sum("length")).first()[0]
    pair = (2, 1, 7)
    moved = whole({**d, pair: d[pair] + 1e-4}) - whole(d)
    assert moved / 1e-4 == pytest.approx({(r.ds, r.i, r.j): r.slope for r in linkage.distance_slopes(joins).collect()}[2, "t1", "t7"])


def test_linkage_of_equal_distances_and_of_none(spark):
    same = spark.createDataFrame([(0, i, j, 1.0) for i in range(6) for j in range(i + 1, 6)], "ds long, i long, j long, d double")
    assert {(r.left, r.right, r.height) for r in linkage.merges(same).where("left_n = 1 AND right_n = 1").collect()} >= {("t0", "t1", 0.5)}
    assert linkage.edges(linkage.merges(same)).count() == 11
    assert linkage.merges(same.where("false")).count() == 0


def test_rf_asks_for_equal_leaves_and_lca_is_the_deepest(spark):
    edges = lambda leaves: spark.createDataFrame([(1, "R", None, 0.0), (1, "u", "R", -2.0)] + [(1, n, "u", 1.0) for n in leaves] + [(1, "z", "R", 1.0)], "tree long, node string, parent string, length double")
    with pytest.raises(Exception, match="different leaves in tree 1"):
        trees.robinson_foulds(edges("abc"), edges("abd")).collect()
    assert {(r.i, r.j): r.d for r in trees.leaf_distances(edges("ab")).collect()} == {("a", "b"): 2.0, ("a", "z"): 0.0, ("b", "z"): 0.0}


def test_embeddings_give_the_distances_back():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20, 4))
    between = lambda x: np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.allclose(between(embedding.classical(between(x), 4)), between(x))

    def curved(x):
        up = np.sqrt(1 + (x * x).sum(1))
        return np.arccosh(np.maximum(1.0, up[:, None] * up[None] - x @ x.T))

    # the matrix of cosines splits into one axis up and four in space; where the points balance, the eigenpairs are these axes
    y = np.r_[x, -x] * 0.3
    assert np.allclose(curved(embedding.hyperboloid(curved(y), 4)), curved(y), atol=1e-5)
    assert embedding.classical(np.zeros((1, 1)), 3).shape == (1, 3)


def test_embed_takes_the_geometry_of_the_analysis(spark):
    d = spark.createDataFrame([(0, 1, 2, 1.0), (0, 1, 3, 2.0), (0, 2, 3, 1.0)], "ds long, i long, j long, d double")
    flat = {r.taxon: r.x for r in embedding.embed(d, AnalysisConfig(dimensionality=2)).collect()}
    assert np.hypot(*np.subtract(flat[1], flat[3])) == pytest.approx(2.0)
    assert embedding.embed(d, AnalysisConfig(dimensionality=2, hyperbolic=True)).count() == 3


def test_midpoint_root_halves_the_longest_way():
    rng = np.random.default_rng(4)
    for n in (2, 3, 5, 12):
        x = rng.normal(size=(n, 3))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        plain = inference.neighbour_joining(list(range(n)), d)
        moved = inference.midpoint(plain)

        def paths(edges):
            up = {a: (p, length) for a, p, length in edges if p is not None}
            out = {}
            for leaf in (f"t{k}" for k in range(n)):
                here, far = leaf, 0.0
                out[leaf] = {leaf: 0.0}
                while here in up:
                    here, far = up[here][0], far + up[here][1]
                    out[leaf][here] = far
            return out

        a, b = paths(plain), paths(moved)
        whole = lambda p, i, j: min(p[i][k] + p[j][k] for k in p[i] if k in p[j])
        pairs = list(itertools.combinations(a, 2))
        assert all(whole(a, i, j) == pytest.approx(whole(b, i, j)) for i, j in pairs)
        top = sorted((max(p.values()) for p in b.values()), reverse=True)
        assert top[0] == pytest.approx(max(whole(a, i, j) for i, j in pairs) / 2) == pytest.approx(top[1])


def test_fit_refuses_what_it_would_ignore(spark):
    p = spark.createDataFrame([(0, t, [float(t), 0.0]) for t in range(4)], "ds long, taxon long, x array<double>")
    s = spark.createDataFrame([(0, t, [t, 0, 1]) for t in range(3)], "ds long, taxon long, codes array<int>")
    for options in ({"hyperbolic": True}, {"planar_flow": True}, {"tree_prior": "yule"}, {"ultrametric": True}):
        with pytest.raises(NotImplementedError, match=next(iter(options))):
            posterior.fit(p, s, AnalysisConfig(**options))
    with pytest.raises(Exception, match="taxon 3 has not both"):
        posterior.fit(p, s, most=1).collect()


def test_several_trees_at_once_as_each_by_itself():
    rng = np.random.default_rng(4)
    for n in (3, 4, 9, 40):
        codes, counts = gradients.patterns(rng.integers(-1, 4, (n, 30)))
        trees = [gradients.JoinedTree(list(range(n)), posterior.distance_matrix(rng.standard_normal((n, 3)), 2.0)) for _ in range(3)]
        tips = np.stack(gradients.base_tips(codes)).transpose(0, 2, 1)
        for tree, (value, slope) in zip(trees, gradients.jukes_cantor_slopes(trees, tips, counts)):
            one, each, _ = gradients.model_slopes(tree, codes, counts)
            assert value == pytest.approx(one, rel=1e-12)
            assert slope == pytest.approx(each, rel=1e-9, abs=1e-9)


def test_joins_find_the_first_pair_of_least_criterion():
    rng = np.random.default_rng(5)
    for n in (3, 4, 7, 20):
        d = np.round(rng.random((n, n)), 1)
        d = np.triu(d, 1) + np.triu(d, 1).T
        steps, before, room = inference.joined(d)
        live = list(range(n))
        for u, v, w, m, *_ in steps:
            assert m == len(live) and before[w - n].tolist() == live
            sub = room[np.ix_(live, live)]
            q = (m - 2) * sub - sub.sum(1)[:, None] - sub.sum(1)
            pairs = [(q[a, b], live[a], live[b]) for a in range(m) for b in range(a + 1, m)]
            assert m == 2 or (u, v) == next(p[1:] for p in pairs if p[0] == min(pairs)[0])
            live = [x for x in live if x not in (u, v)] + [w]


def test_levels_end_with_the_last_edge(spark, monkeypatch):
    kept = []

    def noted(df, **options):
        kept.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, **options)

    monkeypatch.setattr(states, "stored", noted)
    rows = [(1, "R", None, 0.0), (1, "a", "R", 1.0), (1, "b", "R", 0.5), (1, "c", "a", 0.5), (1, "d", "a", 2.0)]
    tree = spark.createDataFrame(rows, "tree long, node string, parent string, length double")
    assert [df.count() for df in states.levels(tree)] == [1, 2, 2]
    assert len(kept) == 3 and not [p for p in kept if "Broadcast" in p]
    drawn = spark.createDataFrame([(1, n, s) for n, s in zip("Rabcd", "xyxyx")], "tree long, node string, state string")
    got = {(r.node, r.from_state, r.to_state, r.start_time, r.end_time) for r in trees.migrations(tree, drawn).collect()}
    assert got == {("a", "x", "y", 0.0, 1.0), ("d", "y", "x", 1.0, 3.0)}


@pytest.mark.parametrize("name", ["posterior_fit", "fitted_mean_trees"])
def test_registered_fits_do_their_whole_work(spark, tmp_path, name):
    """Ten draws a step, 200 steps at least, and no end but that of the fit itself."""
    from cladewise.operators import distances
    from cladewise.plans import fixtures
    from cladewise.plans.queries import QUERIES

    rng = np.random.default_rng(6)
    rows = [(64 * d + t, rng.uniform(-1, 1, 3).tolist()) for d in range(2) for t in range(5)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES[name](spark, str(tmp_path)).collect()
    fits = stored(posterior.fit(fixtures.points(spark, tmp_path), fixtures.alignment(spark, tmp_path), AnalysisConfig()))
    if name == "posterior_fit":
        assert sorted(got, key=str) == sorted(fits.collect(), key=str)
        assert all(sum(r.ds == d and r.taxon is None and r.step > 0 for r in got) >= 200 for d in range(2))
    else:
        want = inference.build_trees(distances.euclidean(posterior.fitted_points(fits)), "nj").collect()
        key = lambda r: (r.ds, r.node)
        assert [(r.ds, r.node, r.parent) for r in sorted(got, key=key)] == [(r.ds, r.node, r.parent) for r in sorted(want, key=key)]
        assert all(a.length == pytest.approx(b.length, abs=2e-6) for a, b in zip(sorted(got, key=key), sorted(want, key=key)) if b.length is not None)
