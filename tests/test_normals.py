"""Low-rank normals against dense linear algebra, and the adaptive rejection sampler against a loop over draws."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladewise.functions import matrices as M
from cladewise.functions import scalars as S
from cladewise.operators import lowrank, rejection, sampling


def test_cholesky(spark):
    rng = np.random.default_rng(3)
    for k in (1, 2, 4):
        b = rng.normal(size=(k, k))
        a, v = b @ b.T + np.eye(k), rng.normal(size=k)
        df = spark.createDataFrame([(a.tolist(), v.tolist())], "a array<array<double>>, v array<double>").withColumn("l", M.cholesky(F.col("a"), k))
        row = df.select("l", M.log_det(F.col("l")).alias("d"), M.backward(F.col("l"), M.forward(F.col("l"), F.col("v"), k), k).alias("x")).first()
        want = np.linalg.cholesky(a)
        for i in range(k):
            assert row.l[i] == pytest.approx(want[i, : i + 1])
        assert row.d == pytest.approx(np.linalg.slogdet(a)[1]) and row.x == pytest.approx(np.linalg.solve(a, v))


def test_low_rank_against_dense(spark):
    rng, n, d, k = np.random.default_rng(5), 7, 4, 3
    x = rng.normal(size=(n, d))
    p = spark.createDataFrame([(1, i, x[i].tolist()) for i in range(n)], "ds long, taxon long, x array<double>")
    f = lowrank.first_factors(p, k)
    R = np.array([row.r for row in f.orderBy("taxon").collect()])
    G = R.T @ R
    z = lowrank.noise(p, k, 4)
    numbers = {row.sample: np.array(row.z).reshape(d, k) for row in z.collect()}
    assert np.allclose(numbers[0], -numbers[1]) and not np.allclose(numbers[0], numbers[2])
    drawn = lowrank.draws(p, f, z, k)
    for row in drawn.collect():
        assert row.x == pytest.approx(x[row.taxon] + numbers[row.sample] @ R[row.taxon])
    for row in lowrank.log_density(drawn, p, f, k).collect():
        base = -0.5 * d * (k * math.log(2 * math.pi) + np.linalg.slogdet(G)[1])
        zs = numbers[row.sample]
        assert row.log_density == pytest.approx(base - 0.5 * (zs**2).sum())
        assert row.embedded == pytest.approx(base - 0.5 * np.einsum("da,ab,db->", zs, np.linalg.inv(G), zs))

    def divergence(R):
        return 0.5 * (d * np.trace(R @ R.T) + (x**2).sum() - n * d - d * np.linalg.slogdet(R.T @ R)[1])

    assert lowrank.forms(p, f, k).first().divergence == pytest.approx(divergence(R))
    square = lambda R: np.mean([0.5 * ((x + (zs @ R.T).T) ** 2).sum() for zs in numbers.values()])
    slopes = {row.taxon: row.slope for row in lowrank.divergence_slopes(p, f, k).collect()}
    back = {row.taxon: row.slope for row in lowrank.factor_slopes(drawn.withColumnRenamed("x", "g"), z, k).collect()}
    for i in range(n):
        for j in range(k):
            h = np.zeros_like(R)
            h[i, j] = 1e-6
            assert slopes[i][j] == pytest.approx((divergence(R + h) - divergence(R - h)) / 2e-6, rel=1e-5, abs=1e-4)
            assert back[i][j] == pytest.approx((square(R + h) - square(R - h)) / 2e-6, rel=1e-5, abs=1e-6)


def test_singular_factors_have_no_density(spark):
    p = spark.createDataFrame([(1, 0, [1.0])], "ds long, taxon long, x array<double>")
    f = lowrank.first_factors(p, 2)
    got = lowrank.forms(p, f, 2).first().log_det
    assert got is None or math.isnan(got) or got < -20


def looped(rows, bounds, n, lu):
    """Draw by draw: ``rows`` of (draw, shell, lw, pilot) in order."""
    bound, times, kept, raised = {s: b for s, (b, _) in bounds.items()}, dict.fromkeys(bounds, 0), {}, []
    for draw, shell, lw, pilot in rows:
        if not pilot and lw > bound[shell]:
            bound[shell] = lw + max(0.25, 2 * bounds[shell][1], 1.05 * (lw - bound[shell])) * 1.6 ** times[shell]
            times[shell] += 1
            raised.append((draw, shell))
            kept = {k: v for k, v in kept.items() if v[0] != shell or lu[k] <= v[1] - bound[shell]}
        elif lu[draw] <= lw - bound[shell]:
            kept[draw] = (shell, lw)
            if len(kept) == n:
                break
    return sorted(kept), raised


def frame(spark, rows):
    return spark.createDataFrame([(ds, *r) for ds, rs in rows.items() for r in rs], "ds long, draw long, shell long, lw double, pilot boolean")


def test_rejection_with_planted_excess(spark):
    rng = np.random.default_rng(11)
    rows = {}
    for ds in range(3):
        lw = rng.normal(size=900)
        rows[ds] = [(i, int(rng.integers(0, 4)), float(lw[i]), i < 200) for i in range(900)]
    for at, by in ((230, 5.0), (300, 9.0), (310, 40.0)):  # far above any envelope, the third in a shell of its own
        rows[1][at] = (at, 2 if by < 40 else 3, by, False)
    df = frame(spark, rows)
    bounds = {}
    for b in rejection.pilot_bounds(df.where("pilot"), 4).collect():
        bounds.setdefault(b.ds, {})[b.shell] = (b.bound, b.spread)
    lu = {(x.ds, x.draw): x.u for x in df.select("ds", "draw", F.log(S.uniform(F.lit(1), F.col("ds"), F.col("draw"))).alias("u")).collect()}
    for n in (5, 60, 10_000):
        draws, report = rejection.sample(df, n, shells=4)
        got, states = {}, {x.ds: x for x in report.collect()}
        for x in draws.orderBy("ds", "draw").collect():
            got.setdefault(x.ds, []).append(x.draw)
        for ds in rows:
            want, raised = looped(rows[ds], bounds[ds], n, {d: u for (s, d), u in lu.items() if s == ds})
            assert got.get(ds, []) == want
            assert states[ds].raised == len(raised) and states[ds].accepted == len(want)
            assert states[ds].state == ("done" if len(want) == n else "short")
            if ds == 1 and n == 60:
                assert len(raised) >= 1


def test_rejection_refuses_and_survives_odd_rows(spark):
    rows = {
        0: [(0, 0, 100.0, True)] + [(i, 1, 0.0, i < 3000) for i in range(1, 3100)],  # one pilot sets the bound of all
        1: [(i, 0, 0.1, False) for i in range(9)],
        2: [(0, 0, float("nan"), True), (1, 0, None, True), (2, 0, 1.0, True), (3, 0, float("inf"), False)],
        3: [(i, 0, 0.0, i < 40) for i in range(80)],
    }
    draws, report = rejection.sample(frame(spark, rows), 10, shells=2)
    states = {x.ds: x.state for x in report.collect()}
    assert states[0] == "refused" and 1 not in states and states[2] in ("short", "refused") and states[3] == "done"
    assert {x.ds for x in draws.collect()} <= {2, 3}
    empty, nothing = rejection.sample(frame(spark, rows).where("false"), 10)
    assert empty.count() == 0 and nothing.count() == 0


def test_margins_rise_outwards(spark):
    df = frame(spark, {0: [(i, i % 3, 0.0, True) for i in range(30)]})
    got = {x.shell: x.bound for x in sampling.envelopes(df, margin=(0.3, 0.5)).collect()}
    assert got == pytest.approx({0: 0.3, 1: 0.4, 2: 0.5})
