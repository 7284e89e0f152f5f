"""Quadrature in cells, and forecasts against enumeration of regime paths."""

import itertools

import numpy as np
import pytest

from tests.test_recursions import OPEN, paths, series, wide_model
from tidewater.functions import laws
from tidewater.functions.model import nearest_open_loop
from tidewater.operators import fuzzy, recursions

LAW = laws.law("2ter:0.1356:0.1177:0.05")


def test_error_of_nodes_falls_faster_than_of_centres():
    y, _, sizes = series(OPEN, [40], 3)
    smoothed = lambda cells, nodes: recursions.unknown_regimes(y, sizes, fuzzy.grid_model(OPEN, LAW, cells, nodes)[0])["smooth"][:, 0]
    fine = smoothed(120, 1)
    error = {(c, n): np.abs(smoothed(c, n) - fine).max() for c, n in itertools.product((2, 4, 8), (1, 2))}
    for cells in (2, 4, 8):
        assert error[cells, 2] < 0.5 * error[cells, 1]
    assert error[2, 1] / error[8, 1] < error[2, 2] / max(error[8, 2], 1e-9) or error[8, 2] < 0.1 * error[8, 1]


@pytest.mark.parametrize(("cells", "nodes"), [(0, 1), (3, 1), (3, 2), (2, 3)])
def test_points_integrate_and_cells_hold_their_nodes(cells, nodes):
    r, w = laws.points(cells, nodes)
    assert len(r) == cells * nodes + 2 and (np.diff(r) > 0).all() and w[1:-1].sum() == pytest.approx(float(cells > 0))
    if cells:
        assert (w[1:-1] * r[1:-1] ** (2 * nodes - 1)).sum() == pytest.approx(1 / (2 * nodes))
    p = np.arange(1.0, len(r) + 1)[None]
    assert fuzzy.by_cell(p, nodes).sum() == p.sum() and fuzzy.by_cell(p, nodes).shape == (1, cells + 2)


@pytest.mark.parametrize("model", [OPEN, nearest_open_loop(wide_model())], ids=["scalar", "wide"])
def test_forecasts_against_paths(model):
    """x and y one and two steps after the last row: paths of all regimes, conditioned on the rows that are seen."""
    y, _, _ = series(model, [3], 5)
    found = recursions.forecast_columns(recursions.unknown_regimes(y, np.array([3]), model), y, model, 2)
    long = np.concatenate([y, np.zeros((2, y.shape[1]))])
    every = paths(model, long, 3)
    f, _, c = model.regression()
    for h in (1, 2):
        mean = sum(p * e[2 + h] for _, p, e, _ in every)
        second = sum(p * (v[2 + h] + np.outer(e[2 + h], e[2 + h])) for _, p, e, v in every)
        assert found["x_ahead"][2][h - 1] == pytest.approx(mean[0])
        assert found["x_ahead_var"][2][h - 1] == pytest.approx(second[0, 0] - mean[0] ** 2)
        assert found["p_ahead"][2][h - 1] == pytest.approx([sum(p for r, p, _, _ in every if r[2 + h] == k) for k in range(len(model.mean))])
    one = sum(p * (f[r[2], r[3]] @ np.concatenate([e[2], y[2]]) + c[r[2], r[3]])[model.n_x] for r, p, e, _ in every)
    assert found["y_ahead"][2][0] == pytest.approx(one)


def test_predicted_rows_are_aligned(spark):
    rows = [(u, i, 40.0 + 3 * i + 10 * u) for u in (1, 2) for i in range(5)] + [(3, 0, None), (3, 1, 50.0)]
    df = spark.createDataFrame(rows, "user_id long, n int, y double")
    for long in (1000, 0):
        got = {(r.user_id, r.n): r for r in recursions.predicted(df, OPEN, ["user_id"], 3, long=long, chunk=4).collect()}
        prior = recursions.prior_ahead(OPEN, 3)
        for u in (1, 2):
            for i in range(5):
                for h in (1, 2, 3):
                    want = got[u, i - h].x_ahead[h - 1] if i >= h else prior[i][0]
                    assert got[u, i][f"x_{h}"] == pytest.approx(want)
        assert got[3, 0].x_ahead is None and got[3, 1].x_1 is None and got[3, 1].x_2 == pytest.approx(prior[1][0])


def test_filter_on_chunks_is_the_same(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(u, i, float(v)) for u in (1, 2) for i, v in enumerate(rng.normal(50, 15, 60))], "user_id long, n int, y double")
    a, b = (sorted(fuzzy.fuzzy(df, OPEN, LAW, 2, ["user_id"], nodes=2, **k).collect(), key=lambda r: (r.user_id, r.n)) for k in ({}, {"long": 10, "chunk": 17}))
    for x, z in zip(a, b, strict=True):
        for c in ("filter", "smooth", "predict", "p_filter", "p_smooth", "r_mean", "r_filter", "r_smooth"):
            assert (x[c] is None) == (z[c] is None) and (x[c] is None or x[c] == pytest.approx(z[c], rel=1e-8, abs=1e-9))
