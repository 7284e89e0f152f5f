"""Observations so far off that a regime's likelihood underflows: weights are compared with logarithms, not with zeros."""

import numpy as np
import pandas as pd
import pytest

from tidewater.operators import recursions, scan
from tidewater.plans.catalogue import OPEN

Y = np.array([[40.0], [3.0], [830.0], [12.0], [60.0]])


def law_back(p0, y0, y):
    """p(j | k, y up to the row) by logarithms, and the state's mean given k."""
    f, q, c = OPEN.regression()
    d = y - f[:, :, 1, 1] * y0 - c[:, :, 1]
    log = np.log(p0)[:, None] + np.log(OPEN.transition) - 0.5 * (d**2 / q[:, :, 1, 1] + np.log(q[:, :, 1, 1]))
    back = np.exp(log - log.max(axis=0))
    return back / back.sum(axis=0), q[:, :, 0, 1] / q[:, :, 1, 1] * d + f[:, :, 0, 1] * y0 + c[:, :, 0]


def test_an_outlier_keeps_laws_and_moments():
    found = recursions.unknown_regimes(Y, np.array([len(Y)]), OPEN)
    f, _, _ = OPEN.regression()
    back, h = law_back(found["p_filter"][1], Y[1, 0], Y[2, 0])
    want = (back * (f[:, :, 0, 0] * found["e_regime"][1, :, 0][:, None] + h)).sum(axis=0)
    assert found["e_regime"][2, :, 0] == pytest.approx(want)
    assert np.isfinite(found["smooth"]).all() and np.isfinite(found["smooth_var"]).all()
    laws = recursions._transitions(found, OPEN, np.roll(found["log_p"], 1, axis=0), recursions._starts(np.array([len(Y)])))
    assert laws["t_back"][2] == pytest.approx(back.ravel())


@pytest.mark.parametrize("long", [recursions.LONG, 0])
def test_transitions_at_an_outlier(spark, long):
    rows = spark.createDataFrame(pd.DataFrame({"id": 1, "n": range(len(Y)), "y": Y[:, 0]}))
    found = recursions.regime_transitions(rows, OPEN, ["id"], long=long, chunk=2).toPandas().sort_values("n")
    p = recursions.unknown_regimes(Y, np.array([len(Y)]), OPEN)["p_filter"]
    assert np.array(found["t_back"].iloc[2]) == pytest.approx(law_back(p[1], Y[1, 0], Y[2, 0])[0].ravel())


def test_an_observation_no_regime_expects_does_not_level_them():
    """Both regimes' densities underflow; the law is that of their ratio, in a whole series and in a chunk."""
    y = np.array([[3.0], [2500.0], [30.0]])
    found = recursions.unknown_regimes(y, np.array([3]), OPEN)
    work = scan.UnknownRegimes(OPEN)
    start = np.array([True, False, False])
    passed = work.passed(work.rows({"y": y}, start, None), work.first(), work.last())
    assert found["p_filter"][1] == pytest.approx([0, 1]) and passed["p_filter"][1] == pytest.approx([0, 1])
    assert passed["filter"] == pytest.approx(found["filter"]) and passed["smooth"] == pytest.approx(found["smooth"])
