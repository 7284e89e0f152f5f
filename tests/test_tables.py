"""Models by table, learning on the fuzzy grid, and least squares far from the origin."""

import numpy as np
import pytest

from tidewater.functions import laws, tables
from tidewater.functions.model import example_model, nearest_open_loop
from tidewater.operators import fuzzy, learn, recursions, sem

MODEL = nearest_open_loop(example_model())


def test_table_of_a_model_is_that_model(spark):
    covs = np.array([[MODEL.pair_cov(j, k) for k in (0, 1)] for j in (0, 1)])
    rows = tables.from_covariances(covs, MODEL.mean[:, :1], MODEL.mean[:, 1:], 100 * MODEL.joint)
    got = tables.model(tables.as_table(spark, rows), 2)
    assert got.joint == pytest.approx(MODEL.joint) and got.gamma == pytest.approx(MODEL.gamma)
    for a, b in zip(got.regression(), MODEL.regression(), strict=True):
        assert a == pytest.approx(b)
    y = np.random.default_rng(1).normal(50, 20, (30, 1))
    a, b = (recursions.unknown_regimes(y, np.array([30]), m) for m in (got, MODEL))
    assert a["smooth"] == pytest.approx(b["smooth"])


def test_learned_table_and_gaps(spark):
    rng = np.random.default_rng(2)
    rows = [(s, n, int(r), float(10 * r + a), float(5 * r + a + b)) for s in (1, 2) for n, (r, a, b) in enumerate(zip(rng.integers(0, 2, 60), rng.normal(size=60), rng.normal(size=60), strict=True))]
    rows += [(3, 0, 2, 21.0, 11.0), (3, 1, 1, 9.0, 4.0)]
    df = spark.createDataFrame(rows, "s int, n int, r int, x double, y double")
    table = tables.learned(df, ["s"], "n", "r", "x", "y")
    got = {(t.j, t.k): t for t in table.collect()}
    z = {r: np.array([[x, y] for _, _, q, x, y in rows if q == r]).mean(axis=0) for r in (0, 1, 2)}
    steps = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if a[0] == b[0] and (a[2], b[2]) == (0, 1)]
    centred = np.array([[*(np.array(a[3:]) - z[0]), *(np.array(b[3:]) - z[1])] for a, b in steps])
    want = centred.T @ centred / len(centred)
    assert got[0, 1].n == len(steps) and all(got[0, 1][f"c_{a}{b}"] == pytest.approx(want[a, b]) for a, b in tables.ENTRIES)
    own = tables.model(table, 3)
    pooled = own.pairs[2, 0]
    assert own.pairs[2, 1] == pytest.approx(pooled) and np.abs(own.regression()[0][:, :, 1, 0]).max() < 1e-9
    with pytest.raises(ValueError, match="regimes"):
        tables.model(table, 4)
    out = fuzzy.tabulated(df.select("s", "n", "y"), own, np.array([0.0, 0.5, 1.0]), 1, ["s"])
    assert out.count() == len(rows) and out.filter("filter IS NULL").count() == 0


def test_squares_far_from_the_origin(spark):
    """Means 1e6 times the spread: coefficients and residual variances are right to 1e-6."""
    rng = np.random.default_rng(3)
    n, rows = 3000, []
    x, y = 1e6 + rng.normal(size=n), 2e6 + rng.normal(size=n)
    e = 0.1 * rng.normal(size=(n, 2))
    for t in range(1, n):
        y[t] = 2e6 + 0.5 * (y[t - 1] - 2e6) + e[t, 0]
        x[t] = 1e6 + 0.3 * (x[t - 1] - 1e6) - 0.2 * (y[t - 1] - 2e6) + 0.7 * (y[t] - 2e6) + e[t, 1]
    rows = [(1, t, float(x[t]), float(y[t]), 0) for t in range(n)]
    df = spark.createDataFrame(rows, "s int, n int, x double, y double, r int")
    (got,) = sem.regressions(sem.weighted_steps(df, ["s"], "n", "x", "y", 1, "r")).collect()
    a = np.column_stack([x[:-1] - 1e6, y[:-1] - 2e6, y[1:] - 2e6, np.ones(n - 1)])
    m, res = np.linalg.lstsq(a, x[1:] - 1e6, rcond=None)[:2]
    assert got.m[:3] == pytest.approx(m[:3], abs=1e-6) and got.lambda2 == pytest.approx(res[0] / (n - 1), rel=1e-6)
    p, res = np.linalg.lstsq(a[:, [1, 3]], y[1:] - 2e6, rcond=None)[:2]
    assert got.p[0] == pytest.approx(p[0], abs=1e-6) and got.pi2 == pytest.approx(res[0] / (n - 1), rel=1e-6)
    (plain,) = learn.regression_sums(df, ["s"], "n", "r", "x", "y").collect()
    assert plain.p0 == pytest.approx(p[0], abs=1e-6) and plain.pi2 == pytest.approx(res[0] / (n - 1), rel=1e-6)


def test_posterior_over_chunks_is_the_same(spark):
    from tests.test_operators import example_regression

    own, rng = example_regression()
    df = spark.createDataFrame([(s, n, float(v), float(w) if (s, n) != (2, 5) else None) for s in (1, 2) for n, (v, w) in enumerate(rng.normal(1, 1.5, (90, 2)))], "s long, n int, x double, y double")
    a, b = (sorted(sem.posterior(df, ["s"], "n", "x", "y", own, seed=3, **k).collect(), key=lambda r: (r.s, r.n)) for k in ({}, {"long": 10, "chunk": 17}))
    for one, two in zip(a, b, strict=True):
        assert one.r == two.r and (one.gamma is None) == (two.gamma is None)
        if one.gamma is not None:
            assert one.gamma == pytest.approx(two.gamma, abs=1e-9) and one.psi == pytest.approx(two.psi, abs=1e-9)
    assert a[95].r is None and a[95].gamma is None


def test_fuzzy_learning_recovers_a_law(spark):
    """Simulated on the grid by a 2ter law: the law is refitted from drawn chains, not from the labels."""
    rng, cells = np.random.default_rng(5), 2
    law = laws.law("2ter:0.3:0.2:0.05")
    r, w, density = laws.matrix(law, cells)
    joint = density * w[:, None] * w
    joint /= joint.sum()
    rows = []
    for s in range(6):
        k = rng.choice(4, p=joint.sum(axis=1))
        x = y = 0.0
        for n in range(700):
            k = rng.choice(4, p=joint[k] / joint[k].sum())
            y = 0.2 * y + 12.0 * r[k] + rng.normal() * 0.4
            x = 0.3 * x + 0.5 * y + 8.0 * r[k] + rng.normal() * 0.4
            rows.append((s, n, float(x), float(y), int(k) if rng.random() > 0.25 else int(rng.integers(4))))
    df = spark.createDataFrame(rows, "s int, n int, x double, y double, r int")
    own, got, labels, trace = sem.learn_fuzzy(df, ["s"], "n", "x", "y", cells, 4, start=df)
    first = trace[0]["law"].p
    error = lambda p: abs(p["alpha0"] - 0.3) + abs(p["alpha1"] - 0.2) + abs(p["beta"] - 0.05)
    assert error(got.p) < 0.06 < error(first) and own.joint.sum() == pytest.approx(1)
    assert labels.count() == len(rows) and own.transition == pytest.approx(joint / joint.sum(axis=1, keepdims=True), abs=0.08)
