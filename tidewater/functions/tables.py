"""Models by table: a row for each pair of grid points, with the pair's own covariance, learned from labels or read from a file."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import RegimeModel, cov_to_fq

#: Entries of the covariance of (x, y, x', y') that are kept, as pairs of places.
ENTRIES = [(a, b) for a in range(4) for b in range(a, 4)]
NAMES = ["x", "y", "x_next", "y_next"]


@dataclass(frozen=True)
class TableModel(RegimeModel):
    """A RegimeModel whose steps have the covariance of their own pair: pairs (K, K, 2n, 2n), not shared among the pairs of a regime."""

    pairs: np.ndarray | None = None

    def pair_cov(self, j: int, k: int) -> np.ndarray:
        return self.pairs[j, k]

    def regression(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k_all, n = self.mean.shape
        f, q, c = np.zeros((k_all, k_all, n, n)), np.zeros((k_all, k_all, n, n)), np.zeros((k_all, k_all, n))
        for j, k in np.ndindex(k_all, k_all):
            cov = self.pairs[j, k]
            f[j, k], q[j, k] = cov_to_fq(cov[:n, :n], cov[:n, n:], cov[n:, n:])
            c[j, k] = self.mean[k] - f[j, k] @ self.mean[j]
        return f, q, c


def open_loop(pairs: np.ndarray, n_x: int = 1) -> np.ndarray:
    """Each pair's covariance with F_yx = 0: Cov(X, Y') becomes Cov(X, Y) Var(Y)^-1 Cov(Y, Y')."""
    out, n = pairs.copy(), pairs.shape[-1] // 2
    x = n_x
    for j, k in np.ndindex(pairs.shape[:2]):
        cov = out[j, k]
        cov[:x, n + x :] = cov[:x, x:n] @ np.linalg.solve(cov[x:n, x:n], cov[x:n, n + x :])
        cov[n + x :, :x] = cov[:x, n + x :].T
    return out


def learned(df: DataFrame, key: list[str], order: str, r: str, x: str, y: str) -> DataFrame:
    """j, k, n, mx, my, nx, ny (means of j's and of k's rows) and c_ab for the entries of the pair's covariance: one row for each pair of entries that occurs.

    Two aggregates; only the regimes' means are joined back.
    """
    from ..operators.learn import pairs

    means = df.groupBy(r).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    steps = pairs(df, key, order, [r, x, y]).withColumnsRenamed({r: "j", f"{r}_next": "k"})
    near = F.broadcast(means.select(F.col(r).alias("j"), F.col("_mx").alias("mx"), F.col("_my").alias("my")))
    far = F.broadcast(means.select(F.col(r).alias("k"), F.col("_mx").alias("nx"), F.col("_my").alias("ny")))
    values = [F.col(x) - F.col("mx"), F.col(y) - F.col("my"), F.col(f"{x}_next") - F.col("nx"), F.col(f"{y}_next") - F.col("ny")]
    moments = [F.avg(values[a] * values[b]).alias(f"c_{a}{b}") for a, b in ENTRIES]
    return steps.join(near, "j").join(far, "k").groupBy("j", "k", "mx", "my", "nx", "ny").agg(F.count("*").alias("n"), *moments)


def from_covariances(covs: np.ndarray, mean_x: np.ndarray, mean_y: np.ndarray, counts: np.ndarray | None = None) -> list[tuple]:
    """Rows of a table for covariances (K, K, 4, 4) of a parameter file and means (K, 1); counts (K, K) are the joint law's weights."""
    mean = np.column_stack([mean_x, mean_y])
    weight = np.ones(covs.shape[:2]) if counts is None else counts
    return [(j, k, *map(float, mean[j]), *map(float, mean[k]), float(weight[j, k]), *(float(covs[j, k][a, b]) for a, b in ENTRIES)) for j, k in np.ndindex(covs.shape[:2])]


def as_table(spark, rows: list[tuple]) -> DataFrame:
    names = ["mx", "my", "nx", "ny", "n", *(f"c_{a}{b}" for a, b in ENTRIES)]
    return spark.createDataFrame(rows, "j int, k int, " + ", ".join(f"{n} double" for n in names))


def model(table: DataFrame, regimes: int, joint: np.ndarray | None = None, least: int = 5) -> TableModel:
    """The model of a table with a row for each pair of entries 0 .. regimes - 1, at most regimes^2 rows, by their key.

    A pair without a row, of fewer than `least` steps or without a positive covariance has the covariance of all steps
    pooled, and means of its regimes. joint is the law of pairs, or else the shares of their steps. A regime without
    steps raises an error, as nothing tells its mean. Cov(X, Y') is that of F_yx = 0.
    """
    rows = {(row["j"], row["k"]): row for row in table.collect()}
    mean, filled, n = np.full((regimes, 2), np.nan), {}, np.zeros((regimes, regimes))
    for (j, k), row in rows.items():
        mean[j], mean[k], n[j, k] = (row["mx"], row["my"]), (row["nx"], row["ny"]), row["n"]
        cov = np.zeros((4, 4))
        for a, b in ENTRIES:
            cov[a, b] = cov[b, a] = row[f"c_{a}{b}"]
        filled[j, k] = cov
    if np.isnan(mean).any():
        raise ValueError(f"no step from or to regimes {np.flatnonzero(np.isnan(mean[:, 0])).tolist()}")
    total = sum(n[at] for at in filled)
    pooled = sum(n[at] * cov for at, cov in filled.items()) / total
    pairs = np.zeros((regimes, regimes, 4, 4))
    for j, k in np.ndindex(regimes, regimes):
        cov = filled.get((j, k))
        pairs[j, k] = cov if cov is not None and n[j, k] >= least and np.linalg.eigvalsh(cov).min() > 1e-9 * np.trace(cov) else pooled
    pairs = open_loop(pairs)
    own = np.array([sum((n[j, k] + 1e-12) * pairs[j, k][:2, :2] for k in range(regimes)) / (n[j].sum() + 1e-12 * regimes) for j in range(regimes)])
    law = n / n.sum() if joint is None else joint
    law = np.where(law.sum(axis=1, keepdims=True) > 0, law, 1e-12)
    return TableModel(mean, own, pairs[:, :, :2, 2:], law / law.sum(), 1, pairs)
