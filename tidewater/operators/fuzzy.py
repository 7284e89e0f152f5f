"""Filter, smoother and predictor for regimes in [0, 1], on a grid of atoms and cells.

A fuzzy regime is one of the grid's points, with the law's mass there as a hard regime's. A cell has one point, its
centre, or several Gauss-Legendre nodes: then what goes from cell to cell is the integral of law, density and moments
over the cell instead of their values at the centre, and the error falls with a higher power of the cells' width.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import scan
from ..functions.laws import Law, matrix
from ..functions.model import RegimeModel, interpolate
from .recursions import LONG, _lists, by_series, longest, unknown_regimes, vectors


def grid_model(model: RegimeModel, law: Law, cells: int, nodes: int = 1) -> tuple[RegimeModel, np.ndarray, np.ndarray]:
    """The model over grid points: corner matrices interpolated, and the law's weight of each point as a regime's probability.

    With weights folded into the joint law, a fuzzy regime is one of cells * nodes + 2 hard ones; no cells give the two atoms.
    """
    r, w, density = matrix(law, cells, nodes)
    joint = density * w[:, None] * w[None, :]
    joint = np.maximum(joint, 0) / joint.sum()
    pairs = np.array([[model.pair_cov(j, k) for k in (0, 1)] for j in (0, 1)])
    h = model.gamma.shape[-1]
    covs = np.array([[interpolate(pairs, a, b) for b in r] for a in r])
    own = np.array([interpolate(pairs, a, a)[:h, :h] for a in r])
    mean = (1 - r)[:, None] * model.mean[0] + r[:, None] * model.mean[1]
    return RegimeModel(mean, own, covs[:, :, :h, h:], joint, model.n_x), r, w


def by_cell(p: np.ndarray, nodes: int) -> np.ndarray:
    """Masses of atoms and cells from those of points."""
    inner = p[:, 1:-1].reshape(len(p), -1, nodes).sum(axis=2)
    return np.column_stack([p[:, 0], inner, p[:, -1]])


def most_probable(p: np.ndarray, w: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The grid value with the largest mass (atoms) or density (cells); a cell wins ties, then 0, then 1."""
    density = p / w
    order = [*range(1, len(r) - 1), 0, len(r) - 1]
    return r[np.array(order)[density[:, order].argmax(axis=1)]]


def fuzzy(df: DataFrame, model: RegimeModel, law: Law, cells: int, key: list[str], order: str = "n", y: str = "y", nodes: int = 1, long: int = LONG, chunk: int = scan.CHUNK) -> DataFrame:
    """Adds filter, smooth, predict, p_filter and p_smooth (masses of atoms and cells), r_mean, r_filter, r_smooth for fuzzy unknown regimes.

    `nodes` points stand for each cell. A row without y has null estimates, and the next one begins anew.
    """
    own, r, _ = grid_model(model, law, cells, nodes)
    return tabulated(df, own, r, cells, key, order, y, nodes, long, chunk)


def tabulated(df: DataFrame, own: RegimeModel, r: np.ndarray, cells: int, key: list[str], order: str = "n", y: str = "y", nodes: int = 1, long: int = LONG, chunk: int = scan.CHUNK) -> DataFrame:
    """fuzzy() with parameters of each pair of grid points as they are given (functions/tables.py), in place of interpolated corners."""
    added = "filter double, smooth double, predict double, p_filter array<double>, p_smooth array<double>, r_mean double, r_filter double, r_smooth double"
    grid, w = np.concatenate([[0.0], (np.arange(cells) + 0.5) / max(cells, 1), [1.0]]), np.concatenate([[1.0], np.full(cells, 1 / max(cells, 1)), [1.0]])

    def columns(found: dict[str, np.ndarray]) -> dict:
        pf, ps = by_cell(found["p_filter"], nodes), by_cell(found["p_smooth"], nodes)
        none = np.isnan(pf[:, 0])
        best = lambda p: np.where(none, np.nan, most_probable(np.nan_to_num(p), w, grid))
        return {
            "filter": found["filter"][:, 0], "smooth": found["smooth"][:, 0], "predict": found["predict"][:, 0], "p_filter": _lists(pf), "p_smooth": _lists(ps),
            "r_mean": found["p_smooth"] @ r, "r_filter": best(pf), "r_smooth": best(ps),
        }

    if longest(df, key) > long:
        return scan.Scan(df, key, order, scan.UnknownRegimes(own, y), chunk).columns(added, lambda table, found, rows, at: columns(found))
    return by_series(df, key, order, added, lambda rows, sizes: columns(unknown_regimes(vectors(rows, y), sizes, own)))
