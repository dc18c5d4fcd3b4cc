"""Likelihoods level by level against dense pruning, slopes against differences, exponentials against eigenpairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladewise.operators import inference, linkage, pruning, trees
from cladewise.sources.shared import stored

RATES = (1.0, 2.0, 3.0, 0.5, 4.0, 1.5)
NODES = [("r", None, 0.0), ("a", "r", 0.3), ("t3", "r", 0.7), ("b", "a", 0.2), ("t0", "b", 0.1), ("t1", "b", 0.4), ("t2", "a", 0.0005), ("t4", "a", 0.6)]


def matrix(rates, pi):
    k = len(pi)
    q = np.zeros((k, k))
    q[np.triu_indices(k, 1)] = rates
    q = (q + q.T) * pi
    np.fill_diagonal(q, -q.sum(1))
    return q


def exp(q):
    values, vectors = np.linalg.eig(q)
    return (vectors @ np.diag(np.exp(values)) @ np.linalg.inv(vectors)).real


def slow(nodes, tips, move, root):
    """Log likelihood of one site by pruning, children before parents."""
    kids: dict = {}
    for n, p, t in nodes:
        kids.setdefault(p, []).append((n, t))

    def inside(n):
        own = tips.get(n, np.ones(len(root)))
        for child, t in kids.get(n, []):
            own = own * (move(max(t, 1e-3)) @ inside(child))
        return own

    return float(np.log(root @ inside(kids[None][0][0])))


@pytest.fixture(scope="module")
def tree(spark):
    return spark.createDataFrame([(0, *n) for n in NODES], "ds long, node string, parent string, length double")


def columns(values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_exponentials_and_their_slopes(spark):
    rng = np.random.default_rng(0)
    k = 5
    rates, pi = rng.uniform(0.2, 3, 10), rng.dirichlet(np.ones(k) * 3)
    got = pruning.reversible_branches(spark.createDataFrame([(1e-6,), (0.3,), (40.0,)], "t double"), columns(rates), columns(pi), k, normal=False, slopes=True).collect()
    for r in got:
        assert np.allclose(r.p, exp(matrix(rates, pi) * r.t), atol=1e-12)
        for n in (0, 3, 9):
            step = np.eye(10)[n] * 1e-6
            assert np.allclose(r.d[n], (exp(matrix(rates + step, pi) * r.t) - exp(matrix(rates - step, pi) * r.t)) / 2e-6, atol=1e-6)


def test_dna_values_and_slopes(spark, tree):
    rng = np.random.default_rng(2)
    codes = rng.integers(-1, 4, size=(5, 9))
    codes[:, 7] = codes[:, 2]  # a pattern that stands twice
    seq = spark.createDataFrame([(0, i, [int(c) for c in codes[i]]) for i in range(5)], "ds long, taxon long, codes array<int>")
    freqs = (np.bincount(codes[codes >= 0], minlength=4) + 1.0) / ((codes >= 0).sum() + 4.0)
    tips = lambda s: {f"t{i}": np.eye(4)[codes[i, s]] if codes[i, s] >= 0 else np.ones(4) for i in range(5)}

    def whole(rates, nodes=NODES, pi=freqs):
        move = inference.reversible(rates, pi)
        return sum(slow(nodes, tips(s), move, pi) for s in range(9))

    flat = np.full(4, 0.25)
    assert pruning.dna_likelihood(tree, seq).first().log_likelihood == pytest.approx(whole((1,) * 6, pi=flat))
    sweep, root, counts = pruning.dna_sweep(tree, seq, "gtr", rates=RATES, slopes=True)
    assert sweep.values(root, counts).first().log_likelihood == pytest.approx(whole(RATES))
    found = {r.node: r for r in sweep.slopes(root, counts).collect()}
    for k, (node, parent, t) in enumerate(NODES):
        if parent and t > 1e-3:
            bumped = lambda h: whole(RATES, [(n, p, x + h * (i == k)) for i, (n, p, x) in enumerate(NODES)])
            assert found[node].length == pytest.approx((bumped(1e-5) - bumped(-1e-5)) / 2e-5, rel=1e-4, abs=1e-6)
    at_once = pruning.exchange_slopes(sweep, root, counts, columns(RATES)).first().slopes
    assert np.allclose(at_once, [sum(r[pair] for r in found.values()) for pair in pruning.BASE_PAIRS])
    for n, pair in enumerate(pruning.BASE_PAIRS):
        moved = [whole(tuple(np.array(RATES) + h * np.eye(6)[n])) for h in (1e-5, -1e-5)]
        assert sum(r[pair] for r in found.values()) == pytest.approx((moved[0] - moved[1]) / 2e-5, rel=1e-4, abs=1e-6)


def test_barcodes_with_rates_of_sites(spark, tree):
    rng = np.random.default_rng(3)
    codes = rng.integers(-1, 4, size=(5, 4))
    seq = spark.createDataFrame([(0, i, [int(c) for c in codes[i]]) for i in range(5)], "ds long, taxon long, codes array<int>")
    share = {(s, e): float(w) for s in range(4) for e, w in zip((1, 2, 3), rng.dirichlet(np.ones(3)))}
    rates = spark.createDataFrame([(0, s, e, w) for (s, e), w in share.items()], "ds long, site int, state int, rate double")

    def move(t, s, nu):
        m = inference.barcode_matrix(t, 3, nu)
        m[0, 1:4] *= 3 * np.array([share[s, e] for e in (1, 2, 3)])
        return m

    def whole(nu, nodes=NODES, leading_nu=None):
        tips = lambda s: {f"t{i}": np.eye(5)[codes[i, s] if codes[i, s] >= 0 else 4] for i in range(5)}
        return sum(slow(nodes, tips(s), lambda t: move(t, s, nu), move(0.05, s, leading_nu or nu)[0]) for s in range(4))

    sweep, root, counts = pruning.barcode_sweep(tree, seq, rates=rates)
    assert sweep.values(root, counts).first().log_likelihood == pytest.approx(whole(0.4))
    found = {r.node: r for r in sweep.slopes(root, counts).collect()}
    assert sum(r.nu for r in found.values()) == pytest.approx((whole(0.4 + 1e-5, leading_nu=0.4) - whole(0.4 - 1e-5, leading_nu=0.4)) / 2e-5, rel=1e-4)
    bumped = lambda h: whole(0.4, [(n, p, x + h * (n == "b")) for n, p, x in NODES])
    assert found["b"].length == pytest.approx((bumped(1e-5) - bumped(-1e-5)) / 2e-5, rel=1e-4)


def test_states_with_unequal_rates_and_a_primary_state(spark, tree):
    nodes = tree.withColumnRenamed("ds", "tree")
    states = {"t0": "p", "t1": "q", "t2": "s", "t3": "p"}  # that of t4 is not known
    leaf = spark.createDataFrame([(0, n, s) for n, s in states.items()], "tree long, node string, state string")
    names, rates, pi = ["p", "q", "s"], [0.5, 1.5, 0.8], np.array([0.2, 0.5, 0.3])

    def whole(rates, root):
        q = matrix(rates, pi)
        kids = {n: np.eye(3)[names.index(s)] for n, s in states.items()}
        return slow(NODES, kids, lambda t: exp(q * t), root)

    options = dict(names=names, rates=rates, freqs=pi.tolist(), least=1e-3)
    sweep, root, counts = pruning.state_sweep(nodes, leaf, **options, slopes=True)
    assert sweep.values(root, counts).first().log_likelihood == pytest.approx(whole(rates, pi))
    found = sweep.slopes(root, counts).collect()
    for n, pair in enumerate(("p|q", "p|s", "q|s")):
        step = 1e-5 * np.eye(3)[n]
        assert sum(r[pair] for r in found) == pytest.approx((whole(rates + step, pi) - whole(rates - step, pi)) / 2e-5, rel=1e-4)
    at_once = pruning.exchange_slopes(sweep, root, counts, columns(rates), normal=False).first().slopes
    assert np.allclose(at_once, [sum(r[pair] for r in found) for pair in ("p|q", "p|s", "q|s")])
    _, fixed, _ = pruning.state_sweep(nodes, leaf, **options, primary="q")
    assert sweep.values(fixed, counts).first().log_likelihood == pytest.approx(whole(rates, np.eye(3)[1]))
    with pytest.raises(ValueError, match="no state x"):
        pruning.state_sweep(nodes, leaf, **options, primary="x")


def test_modes_of_one_model_stand_for_matrices_of_branches(spark):
    """Also where roots are equal; branches carry no matrices, and both ways give the same values and slopes."""
    nodes = spark.createDataFrame([(1, "R", None, 0.0), (1, "a", "R", 1e-6), (1, "b", "R", 0.7), (1, "c", "b", 2.5), (1, "d", "b", 0.3)], "tree long, node string, parent string, length double")
    leaf = spark.createDataFrame([(1, "a", "p"), (1, "c", "q"), (1, "d", "p")], "tree long, node string, state string")
    for rates in ([1.0] * 3, [0.2, 1.5, 0.7]):
        found = []
        for slopes in (False, True):
            sweep, root, counts = pruning.state_sweep(nodes, leaf, ["p", "q", "r"], rates, slopes=slopes)
            found.append([sweep.values(root, counts).first().log_likelihood, *pruning.exchange_slopes(sweep, root, counts, columns(rates), normal=False).first().slopes])
            if not slopes:
                assert sweep.branches.columns == ["tree", "node", "t"]
        assert found[0] == pytest.approx(found[1], rel=1e-9)


def test_rounds_and_levels_send_no_table_through_the_driver(spark, monkeypatch):
    plans = []

    def noted(df, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, **options)

    for module in (linkage, pruning, trees):
        monkeypatch.setattr(module, "stored", noted)
    rows = [(0, t, [(t * s) % 3 - (t == s) for s in range(6)]) for t in range(8)]
    cells = spark.createDataFrame(rows, "ds long, taxon long, codes array<int>")
    pairs = spark.createDataFrame([(0, i, j, 1.0 + (i * j) % 5) for i in range(8) for j in range(i + 1, 8)], "ds long, i long, j long, d double")
    edges = stored(linkage.edges(linkage.merges(pairs)))
    sweep, root, counts = pruning.barcode_sweep(edges, cells)
    plans += [df._jdf.queryExecution().executedPlan().toString() for df in (linkage.edges(linkage.merges(pairs)), sweep.values(root, counts), sweep.slopes(root, counts))]
    assert len(plans) > 10 and not [p for p in plans if "Broadcast" in p]
