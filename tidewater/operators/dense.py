"""Known regimes by conditioning on whole series at once: exact, for short series and as a check of the recursions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.model import RegimeModel
from .recursions import by_series, vectors


def joint_law(model: RegimeModel, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of z_1 .. z_N, stacked, given the regimes."""
    n, h = len(r), model.mean.shape[1]
    f, q, c = model.regression()
    mean, cov = np.zeros(n * h), np.zeros((n * h, n * h))
    mean[:h], cov[:h, :h] = model.mean[r[0]], model.gamma[r[0]]
    for i in range(1, n):
        j, k = r[i - 1], r[i]
        a, b = slice((i - 1) * h, i * h), slice(i * h, (i + 1) * h)
        mean[b] = f[j, k] @ mean[a] + c[j, k]
        cov[b, : i * h] = f[j, k] @ cov[a, : i * h]
        cov[: i * h, b] = cov[b, : i * h].T
        cov[b, b] = f[j, k] @ cov[a, a] @ f[j, k].T + q[j, k]
    return mean, cov


def conditioned(model: RegimeModel, r: np.ndarray, y: np.ndarray, upto: int) -> tuple[np.ndarray, np.ndarray, float]:
    """E and Cov of each x given the first `upto` observations, and the log density of these."""
    n, x, h = len(r), model.n_x, model.mean.shape[1]
    mean, cov = joint_law(model, r)
    seen = [i * h + d for i in range(upto) for d in range(x, h)]
    d, s = y[:upto].ravel() - mean[seen], cov[np.ix_(seen, seen)]
    gain = np.linalg.solve(s, cov[seen]).T
    e, v = mean + gain @ d, cov - gain @ cov[seen]
    at = [[i * h + d for d in range(x)] for i in range(n)]
    log = -0.5 * (np.linalg.slogdet(s)[1] + d @ np.linalg.solve(s, d) + len(d) * math.log(2 * math.pi))
    return np.array([e[i] for i in at]), np.array([v[np.ix_(i, i)] for i in at]), float(log)


def dense_smoother(df: DataFrame, model: RegimeModel, key: list[str], order: str = "n", y: str = "y", r: str = "r") -> DataFrame:
    """Adds smooth and smooth_var (scalar state) from the N x N covariance of each series' observations: for series of some hundred rows."""

    def some(rows: pd.DataFrame, sizes: np.ndarray) -> dict:
        values, regimes, at, means, variances = vectors(rows, y), rows[r].to_numpy(dtype=int), 0, [], []
        for n in sizes:
            e, v, _ = conditioned(model, regimes[at : at + n], values[at : at + n], n)
            means.append(e[:, 0])
            variances.append(v[:, 0, 0])
            at += n
        return {"smooth": np.concatenate(means), "smooth_var": np.concatenate(variances)}

    return by_series(df, key, order, "smooth double, smooth_var double", some)
