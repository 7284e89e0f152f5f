"""Recursions against dense conditioning of Gaussians and enumeration of all regime paths on short series."""

import itertools

import numpy as np
import pytest

from tidewater.functions import laws
from tidewater.functions.model import RegimeModel, example_model, nearest_open_loop, reversed_model
from tidewater.operators import fuzzy, recursions
from tidewater.operators.dense import conditioned

MODEL, OPEN = example_model(), nearest_open_loop(example_model())


def wide_model() -> RegimeModel:
    """Two hidden and two observed dimensions, three regimes."""
    rng = np.random.default_rng(3)
    gamma, sigma, mean = np.zeros((3, 4, 4)), np.zeros((3, 3, 4, 4)), rng.normal(0, 2, (3, 4))
    for j in range(3):
        a = rng.normal(0, 1, (4, 4))
        gamma[j] = a @ a.T + 2 * np.eye(4)
    for j, k in np.ndindex(3, 3):
        sigma[j, k] = 0.3 * np.linalg.cholesky(gamma[j]) @ rng.uniform(-0.5, 0.9, (4, 4)) @ np.linalg.cholesky(gamma[k]).T * 0.5
    joint = rng.uniform(0.5, 1, (3, 3))
    joint = (joint + joint.T) / (joint + joint.T).sum()
    return RegimeModel(mean, gamma, sigma, joint, 2)


def series(model, sizes, seed):
    rng = np.random.default_rng(seed)
    y = rng.normal(model.mean[:, model.n_x :].mean(), 15 if model.n_x == 1 else 2, (sum(sizes), model.mean.shape[1] - model.n_x))
    return y, rng.integers(0, len(model.mean), sum(sizes)), np.array(sizes)


@pytest.mark.parametrize("model", [MODEL, wide_model()], ids=["scalar", "wide"])
def test_known_regimes(model):
    y, r, sizes = series(model, [1, 5, 4, 7], 1)
    got = recursions.known_regimes(y, r.astype(float), sizes, model)
    at = 0
    for n in sizes:
        own = slice(at, at + n)
        for i in range(n):
            e, v, _ = conditioned(model, r[own], y[own], i + 1)
            assert got["filter"][at + i] == pytest.approx(e[i]) and got["filter_var"][at + i] == pytest.approx(v[i])
            if i:
                e, _, _ = conditioned(model, r[own], y[own], i)
                assert got["predict"][at + i] == pytest.approx(e[i])
        e, v, log = conditioned(model, r[own], y[own], n)
        assert got["smooth"][own] == pytest.approx(e) and got["smooth_var"][own] == pytest.approx(v)
        assert got["log_likelihood"][own] == pytest.approx(log)
        at += n


def test_fractions_agree_with_whole_regimes_and_lie_between():
    y, r, sizes = series(MODEL, [6, 3], 2)
    near = np.where(r == 1, 1 - 1e-9, 1e-9)
    a, b = (recursions.known_regimes(y, v.astype(float), sizes, MODEL) for v in (r, near))
    assert a["smooth"] == pytest.approx(b["smooth"], rel=1e-6)


def paths(model, y, upto):
    """p(path | first `upto` observations) and moments of all x given it too."""
    out = []
    for r in itertools.product(range(len(model.mean)), repeat=len(y)):
        p = model.marginal[r[0]] * np.prod([model.transition[j, k] for j, k in zip(r, r[1:], strict=False)])
        e, v, log = conditioned(model, list(r), y, upto)
        out.append((r, p * np.exp(log), e, v))
    total = sum(p for _, p, _, _ in out)
    return [(r, p / total, e, v) for r, p, e, v in out]


@pytest.mark.parametrize("model", [OPEN, nearest_open_loop(wide_model())], ids=["scalar", "wide"])
def test_unknown_regimes(model):
    y, _, sizes = series(model, [4, 1, 5], 4)
    got = recursions.unknown_regimes(y, sizes, model)
    at = 0
    for n in sizes:
        own = y[at : at + n]
        for upto, names in [(i + 1, ("filter", "filter_var", "p_filter")) for i in range(n)] + [(n, ("smooth", "smooth_var", "p_smooth"))]:
            every = paths(model, own, upto)
            for i in range(n) if names[0] == "smooth" else [upto - 1]:
                mean = sum(p * e[i] for _, p, e, _ in every)
                second = sum(p * (v[i] + np.outer(e[i], e[i])) for _, p, e, v in every)
                share = [sum(p for r, p, _, _ in every if r[i] == k) for k in range(len(model.mean))]
                assert got[names[0]][at + i] == pytest.approx(mean) and got[names[1]][at + i] == pytest.approx(second - np.outer(mean, mean), abs=1e-8)
                assert got[names[2]][at + i] == pytest.approx(share)
        for i in range(1, n):
            assert got["predict"][at + i] == pytest.approx(sum(p * e[i] for _, p, e, _ in paths(model, own, i)))
        at += n


def test_posterior_chain_sample():
    y, _, _ = series(OPEN, [4], 5)
    times = 20_000
    got = recursions.unknown_regimes(y, np.array([4]), OPEN)
    rows = np.tile(np.arange(4), times)
    sizes, uniforms = np.full(times, 4), np.random.default_rng(6).random(4 * times)
    drawn = recursions.path_sample(got["link"][rows], got["p_smooth"][rows], got["beta"][rows], sizes, uniforms).reshape(times, 4)
    for r, p, _, _ in paths(OPEN, y, 4):
        assert (drawn == r).all(axis=1).mean() == pytest.approx(p, abs=4 * np.sqrt(p * (1 - p) / times) + 1e-3)


def test_double_filter_is_exact_for_one_regime():
    """With one regime and no feedback either way, the double filter is the smoother."""
    one = RegimeModel(OPEN.mean[:1], OPEN.gamma[:1], OPEN.sigma[:1, :1], np.ones((1, 1)))
    s = one.sigma[0, 0].copy()
    gain = one.gamma[0][0, 1] / one.gamma[0][1, 1]
    s[1, 0], s[0, 1] = gain * s[1, 1], gain * s[1, 1]
    both = RegimeModel(one.mean, one.gamma, s[None, None], one.joint)
    y, _, sizes = series(both, [6, 2], 7)
    want = recursions.unknown_regimes(y, sizes, both)
    got = recursions.double_filter(y, sizes, both)
    back = recursions.reversed_rows(sizes)
    backward = recursions.unknown_regimes(y[back], sizes, reversed_model(both))
    alone = both.mean[0, 0] + gain * (y - both.mean[0, 1])
    assert got == pytest.approx(want["filter"] + backward["filter"][back] - alone)


@pytest.mark.parametrize("cells", [0, 1, 3])
def test_fuzzy_grid_is_a_law(cells):
    own, r, w = fuzzy.grid_model(OPEN, laws.law("2ter:0.1356:0.1177:0.05"), cells)
    assert own.joint.sum() == pytest.approx(1) and len(r) == len(w) == cells + 2
    y, _, sizes = series(OPEN, [3], 8)
    own = nearest_open_loop(own)
    got = recursions.unknown_regimes(y, sizes, own)
    every = paths(own, y, 3)
    assert got["smooth"][1] == pytest.approx(sum(p * e[1] for _, p, e, _ in every))


def test_tables_with_ties_of_size_nulls_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(recursions, "ROWS", 5)
    rows = [(u, i, 40.0 + 3 * i + (u or 0), i % 2) for u in (None, 1, 2, 3) for i in range(4 + (u or 0))]
    df = spark.createDataFrame(rows, "user_id long, n int, y double, r int")
    got = recursions.kalman(df, MODEL, ["user_id"], outputs=("smooth", "log_likelihood")).collect()
    for u in (None, 1, 2, 3):
        own = sorted((g.n, g.smooth) for g in got if g.user_id == u)
        y = np.array([[x[2]] for x in rows if x[0] == u])
        e, _, log = conditioned(MODEL, [i % 2 for i in range(len(y))], y, len(y))
        assert [s for _, s in own] == pytest.approx(e[:, 0]) and {round(g.log_likelihood, 6) for g in got if g.user_id == u} == {round(log, 6)}
    assert recursions.kalman(df.limit(0), MODEL, ["user_id"]).count() == 0
