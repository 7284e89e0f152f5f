"""Stochastic learning of regimes from (x, y): regressions of each pair, posterior of the regimes, weighted least squares.

x' = M . (x, y, y', 1) + noise(Lambda2) and y' = P . (y, 1) + noise(Pi2), for each pair of regimes (j, k).
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import checkpointed
from ..functions.model import RegimeModel, model_from_regression
from ..functions import laws
from . import scan
from .learn import kmeans_labels, pairs, regime_moments, transition_counts
from .recursions import LONG, _lists, _starts as starts, by_series, longest

DRIVERS = ["x", "y", "y_next", "one"]


@dataclass(frozen=True)
class PairRegression:
    """m (K, K, 4), lambda2 (K, K), p (K, K, 2), pi2 (K, K), joint (K, K), and own moments of (x, y): mean (K, 2), gamma (K, 2, 2)."""

    m: np.ndarray
    lambda2: np.ndarray
    p: np.ndarray
    pi2: np.ndarray
    joint: np.ndarray
    mean: np.ndarray
    gamma: np.ndarray

    @property
    def transition(self) -> np.ndarray:
        weight = self.joint.sum(axis=1, keepdims=True)
        return np.where(weight > 0, self.joint / np.where(weight > 0, weight, 1), 1 / len(self.joint))

    def model(self) -> RegimeModel:
        return model_from_regression(self.m, self.lambda2, self.p, self.pi2, self.joint)


def _density(d: Column, variance: float) -> Column:
    return F.exp(-0.5 * d * d / variance) / float(np.sqrt(2 * np.pi * variance))


def pair_likelihood(df: DataFrame, key: list[str], order: str, x: str, y: str, own: PairRegression) -> DataFrame:
    """key, order, and l_j_k: the density of each row's successor under each pair of regimes; 0 where a variance is 0."""
    rows = pairs(df, key, order, [x, y])
    out = []
    for j, k in np.ndindex(own.joint.shape):
        m, p = own.m[j, k].tolist(), own.p[j, k].tolist()
        dx = F.col(f"{x}_next") - (m[0] * F.col(x) + m[1] * F.col(y) + m[2] * F.col(f"{y}_next") + m[3])
        dy = F.col(f"{y}_next") - (p[0] * F.col(y) + p[1])
        none = own.lambda2[j, k] <= 0 or own.pi2[j, k] <= 0
        out.append((F.lit(0.0) if none else _density(dx, float(own.lambda2[j, k])) * _density(dy, float(own.pi2[j, k]))).alias(f"l_{j}_{k}"))
    return rows.select(*key, order, *out)


class KnownPairs(scan.UnknownRegimes):
    """The chain of regimes with x and y known: a scan of K x K kernels, p(k | j) times the density of the step under (j, k).

    Where no pair explains a step at all, it says nothing. A row without x or y has no law, and the next begins anew.
    """

    def __init__(self, own: PairRegression, x: str = "x", y: str = "y") -> None:
        k = len(own.joint)
        self.own, self.columns, self.width = own, [x, y], k
        self.model = SimpleNamespace(n_x=0, mean=np.zeros((k, 0)), transition=own.transition)
        self.fxx = self.own_cov = np.zeros((k, k, 0, 0))

    def rows(self, values: dict[str, np.ndarray], start: np.ndarray, before: dict | None) -> dict:
        own, k_all = self.own, self.width
        z = np.column_stack([values[c].reshape(len(start)) for c in self.columns])
        good = ~np.isnan(z).any(axis=1)
        z = np.where(good[:, None], z, 0.0)
        a, good0 = np.concatenate([z[:1], z[:-1]]), np.concatenate([[False], good[:-1]])
        if before is not None and not start[0] and all(before[c] is not None and not np.isnan(before[c]) for c in self.columns):
            a[0], good0[0] = [before[c] for c in self.columns], True
        start = start | ~good0 | ~good
        likely = np.zeros((len(z), k_all, k_all))
        drivers = np.column_stack([a, z[:, 1], np.ones(len(a))])
        for j, k in np.ndindex(k_all, k_all):
            if own.lambda2[j, k] > 0 and own.pi2[j, k] > 0:
                dx, dy = z[:, 0] - drivers @ own.m[j, k], z[:, 1] - (own.p[j, k, 0] * a[:, 1] + own.p[j, k, 1])
                likely[:, j, k] = np.exp(-0.5 * (dx**2 / own.lambda2[j, k] + dy**2 / own.pi2[j, k])) / (2 * np.pi * np.sqrt(own.lambda2[j, k] * own.pi2[j, k]))
        kernel = own.transition * likely
        kernel[kernel.sum(axis=(1, 2)) == 0] = own.transition
        kernel += scan.FLOOR
        kernel[start] = 1.0
        begun = np.zeros((len(z), k_all))
        for k in range(k_all):
            gap = z - own.mean[k]
            begun[:, k] = own.joint.sum(axis=1)[k] * np.exp(-0.5 * (gap @ np.linalg.inv(own.gamma[k]) * gap).sum(axis=1)) / np.sqrt(np.linalg.det(own.gamma[k]))
        begun += scan.FLOOR
        none = np.zeros((len(z), k_all, k_all, 0))
        return {"u": kernel, "lu": np.log(kernel), "h": none, "base": none, "start": start, "good": good, "begun": begun / begun.sum(axis=1, keepdims=True), "y": z}


def posterior(df: DataFrame, key: list[str], order: str, x: str, y: str, own: PairRegression, seed: int | None = None, long: int = LONG, chunk: int = scan.CHUNK) -> DataFrame:
    """Adds gamma (array K), psi (array K*K for the step to the row, zeros where a series begins) and, with a seed, r: a draw of the regimes' posterior chain.

    Series of over `long` rows are cut into chunks; the draw is the same then, as maps of chunks compose.
    """
    u = (F.pmod(F.xxhash64(F.lit(seed or 0), *key, order), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    rows, work = df.withColumn("_u", u), KnownPairs(own, x, y)
    kinds, path = "gamma array<double>, psi array<double>", scan.Path(work.width)

    def laws(found: dict, rows: dict) -> dict:
        psi = found["p_before"][:, :, None] * found["link"] * found["beta"][:, None, :]
        psi /= np.maximum(psi.sum(axis=(1, 2)), 1e-300)[:, None, None]
        psi[rows["start"]] = 0.0
        return {"gamma": _lists(found["p_smooth"]), "psi": list(psi.reshape(len(psi), -1))}

    if longest(df, key) > long:
        whole = scan.Scan(rows, key, order, work, chunk)
        if seed is None:
            return whole.columns(kinds, lambda table, found, rows, at: laws(found, rows)).drop("_u")
        return scan.draw_paths(whole, "_u", kinds, lambda table, found, rows, at: laws(found, rows)).drop("_u")

    def some(table: pd.DataFrame, sizes: np.ndarray) -> dict:
        values = {x: table[x].to_numpy(dtype=float)[:, None], y: table[y].to_numpy(dtype=float)}
        elements = work.rows(values, starts(sizes), None)
        found = work.passed(elements, work.first(), work.last())
        out = laws(found, elements)
        if seed is not None:
            drawn = pd.array(path.drawn(path.maps(found["link"], found["p_smooth"], found["beta"], elements["start"], table["_u"].to_numpy()), 0), dtype="Int64")
            drawn[~elements["good"]] = None
            out["r"] = drawn
        return out

    return by_series(rows, key, order, kinds + ("" if seed is None else ", r int"), some).drop("_u")


def weighted_steps(df: DataFrame, key: list[str], order: str, x: str, y: str, regimes: int, r: str | None = None) -> DataFrame:
    """j, k, _w and x, y, y_next, x_next of each step: its weight is its psi, or 1 for the pair of its labels where r is given."""
    names = {x: "x", y: "y", f"{x}_next": "x_next", f"{y}_next": "y_next"}
    values = [F.col(c).cast("double").alias(n) for c, n in names.items()]
    if r:
        return pairs(df, key, order, [x, y, r]).select(F.col(r).alias("j"), F.col(f"{r}_next").alias("k"), F.lit(1.0).alias("_w"), *values)
    rows = pairs(df, key, order, [x, y, "psi"]).select(*values, F.posexplode("psi_next").alias("_at", "_w"))
    return rows.withColumn("j", F.expr(f"_at div {regimes}").cast("int")).withColumn("k", F.expr(f"_at % {regimes}").cast("int"))


def weighted_sums(df: DataFrame, key: list[str], order: str, x: str, y: str, regimes: int, r: str | None = None) -> DataFrame:
    """j, k and the weighted sums of products of (x, y, y', 1, x'): one row for each pair, by a pre-aggregated sum."""
    columns = [*DRIVERS, "x_next"]
    named = {c: F.lit(1.0) if c == "one" else F.col(c) for c in columns}
    sums = [F.sum(F.col("_w") * named[a] * named[b]).alias(f"{a}_{b}") for i, a in enumerate(columns) for b in columns[i:]]
    return weighted_steps(df, key, order, x, y, regimes, r).groupBy("j", "k").agg(*sums)


def regressions(steps: DataFrame) -> DataFrame:
    """j, k, weight, m (array of 4), lambda2, p (array of 2), pi2: least squares of each pair of weighted_steps().

    Three aggregates over the steps, none of which takes a small number from large ones: the pairs' means, the products
    of what is centred on these, and the squares of the residuals. Between them K^2 rows come to the driver, where the
    systems of three unknowns are solved (singular ones by the pseudo-inverse). Pairs without weight have no row.
    """
    spark, columns = steps.sparkSession, ["x", "y", "y_next", "x_next"]
    heavy = steps.filter("_w > 0")
    means = heavy.groupBy("j", "k").agg(F.sum("_w").alias("weight"), *((F.sum(F.col("_w") * F.col(c)) / F.sum("_w")).alias(f"_{c}") for c in columns))
    means = spark.createDataFrame(means.collect(), means.schema)
    centred = heavy.join(F.broadcast(means), ["j", "k"]).select("j", "k", "_w", *((F.col(c) - F.col(f"_{c}")).alias(c) for c in columns), *(F.col(f"_{c}") for c in columns), "weight")
    products = centred.groupBy("j", "k").agg(*(F.sum(F.col("_w") * F.col(a) * F.col(b)).alias(f"{a}*{b}") for i, a in enumerate(columns) for b in columns[i:]), *(F.sum(F.col("_w") * F.col(c)).alias(f"{c}*") for c in columns))
    solved = []
    for row in products.join(F.broadcast(means), ["j", "k"]).collect():
        at = lambda a, b, row=row: row[f"{a}*{b}" if f"{a}*{b}" in row else f"{b}*{a}"] if b else row[f"{a}*"] if a else row["weight"]
        found = {}
        for name, known, target in (("m", ["x", "y", "y_next"], "x_next"), ("p", ["y"], "y_next")):
            own = [*known, ""]
            a = np.array([[at(*sorted((b, c), reverse=True)) if "" in (b, c) else at(b, c) for c in own] for b in own])
            v = np.array([at(*((b, target) if b else (target, "")))  for b in own])
            scale = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
            found[name] = np.linalg.lstsq(a / np.outer(scale, scale), v / scale, rcond=1e-12)[0] / scale
        solved.append((row["j"], row["k"], row["weight"], found["m"].tolist(), found["p"].tolist()))
    kinds = f"j {steps.schema['j'].dataType.simpleString()}, k {steps.schema['k'].dataType.simpleString()}, weight double, _m array<double>, _p array<double>"
    table = spark.createDataFrame(solved, kinds)
    m, p = (lambda i: F.col("_m")[i]), (lambda i: F.col("_p")[i])
    dx = F.col("x_next") - (m(0) * F.col("x") + m(1) * F.col("y") + m(2) * F.col("y_next") + m(3))
    dy = F.col("y_next") - (p(0) * F.col("y") + p(1))
    spread = centred.drop("weight").join(F.broadcast(table), ["j", "k"]).groupBy("j", "k").agg((F.sum(F.col("_w") * dx * dx) / F.sum("_w")).alias("lambda2"), (F.sum(F.col("_w") * dy * dy) / F.sum("_w")).alias("pi2"))
    whole = table.join(F.broadcast(means.drop("weight")), ["j", "k"]).join(spread, ["j", "k"])
    moved = m(3) + F.col("_x_next") - m(0) * F.col("_x") - m(1) * F.col("_y") - m(2) * F.col("_y_next")
    return whole.select("j", "k", "weight", F.array(m(0), m(1), m(2), moved).alias("m"), "lambda2", F.array(p(0), p(1) + F.col("_y_next") - p(0) * F.col("_y")).alias("p"), "pi2")


def fit_labels(df: DataFrame, key: list[str], order: str, x: str, y: str, r: str, regimes: int, weights: DataFrame | None = None) -> PairRegression:
    """Regressions (weighted by psi if `weights` has it, else by the labels), law and own moments from a chain of labels."""
    steps = weighted_steps(weights, key, order, x, y, regimes) if weights is not None else weighted_steps(df, key, order, x, y, regimes, r)
    m, lambda2 = np.zeros((regimes, regimes, 4)), np.zeros((regimes, regimes))
    p, pi2 = np.zeros((regimes, regimes, 2)), np.zeros((regimes, regimes))
    for row in regressions(steps).collect():
        at = row["j"], row["k"]
        m[at], lambda2[at], p[at], pi2[at] = row["m"], row["lambda2"], row["p"], row["pi2"]
    joint, mean, gamma = np.zeros((regimes, regimes)), np.zeros((regimes, 2)), np.tile(np.eye(2), (regimes, 1, 1))
    for row in transition_counts(df, key, order, r).collect():
        joint[row["j"], row["k"]] = row["n"]
    for row in regime_moments(df, r, x, y).collect():
        mean[row[r]] = row["mean_x"], row["mean_y"]
        gamma[row[r]] = [[row["var_x"], row["cov_xy"]], [row["cov_xy"], row["var_y"]]]
        gamma[row[r]] += 1e-9 * np.eye(2) * max(1.0, np.trace(gamma[row[r]]))
    return PairRegression(m, lambda2, p, pi2, joint / max(joint.sum(), 1), mean, gamma)


def learn(df: DataFrame, key: list[str], order: str, x: str, y: str, regimes: int, rounds: int, seed: int = 1) -> tuple[PairRegression, DataFrame, list[dict]]:
    """Stochastic expectation-maximisation from k-means labels: parameters, labelled rows, and a trace of the parameters by round.

    A round has two jobs over the rows: the posterior with a drawn chain, written as a checkpoint, and sums from it; the
    driver gets K^2 rows of sums.
    """
    rows = checkpointed(kmeans_labels(df, [x, y], y, regimes, seed).select(*key, order, x, y, F.col("label").alias("r")))
    own = fit_labels(rows, key, order, x, y, "r", regimes)
    trace = [{"round": 0, "m": own.m, "p": own.p, "lambda2": own.lambda2, "pi2": own.pi2, "joint": own.joint}]
    for step in range(1, rounds + 1):
        rows = checkpointed(posterior(rows.select(*key, order, x, y), key, order, x, y, own, seed + step))
        own = fit_labels(rows, key, order, x, y, "r", regimes, rows)
        trace.append({"round": step, "m": own.m, "p": own.p, "lambda2": own.lambda2, "pi2": own.pi2, "joint": own.joint})
    return own, rows, trace


FITS = {"2ter": (laws.fit_2ter, ("alpha0", "alpha1", "beta")), "4bis": (laws.fit_4bis, ("alpha", "beta", "delta", "lambda"))}


def on_grid(own: PairRegression, law: laws.Law, cells: int) -> PairRegression:
    """The same regressions with the joint law of grid points that a fuzzy law gives: masses of atoms, densities times widths of cells."""
    _, w, density = laws.matrix(law, cells)
    joint = np.maximum(density * w[:, None] * w[None, :], 0)
    return replace(own, joint=joint / joint.sum())


def fitted_law(labels: DataFrame, key: list[str], order: str, r: str, cells: int, family: str) -> laws.Law:
    """A law of the family from a chain of grid entries 0 .. cells + 1."""
    fit, names = FITS[family]
    value = F.when(F.col(r) == 0, 0.0).when(F.col(r) == cells + 1, 1.0).otherwise((F.col(r) - 0.5) / cells)
    row = fit(labels.select(*key, order, value.alias("_r")), key, order, "_r").first()
    return laws.law(":".join([family, *(repr(float(row[n])) for n in names)]))


def learn_fuzzy(df: DataFrame, key: list[str], order: str, x: str, y: str, cells: int, rounds: int, family: str = "2ter", seed: int = 1, start: DataFrame | None = None) -> tuple[PairRegression, laws.Law, DataFrame, list[dict]]:
    """learn() with regimes on the grid of atoms and cells and a law of a family, refitted from the drawn chain in each round.

    Entries 0 and cells + 1 are the atoms. The first labels are `start` (with a column r of entries) or k-means clusters
    in the order of y. The forward and backward passes have the law's masses for atoms and its densities times the
    cells' widths; the regressions of each pair of entries are weighted by its posterior. Pairs that no step has keep
    the regression of the nearest one that has.
    """
    labels = start if start is not None else kmeans_labels(df, [x, y], y, cells + 2, seed).withColumn("r", F.col("label"))
    rows = checkpointed(labels.select(*key, order, x, y, "r"))
    trace, weights = [], None
    for step in range(rounds + 1):
        law = fitted_law(rows, key, order, "r", cells, family)
        own = on_grid(filled(fit_labels(rows, key, order, x, y, "r", cells + 2, weights)), law, cells)
        trace.append({"round": step, "law": law, "m": own.m, "p": own.p, "lambda2": own.lambda2, "pi2": own.pi2})
        if step < rounds:
            rows = weights = checkpointed(posterior(rows.select(*key, order, x, y), key, order, x, y, own, seed + step))
    return own, law, rows, trace


def filled(own: PairRegression) -> PairRegression:
    """Pairs without a regression (no residual variance) take that of the nearest pair that has one."""
    there = np.argwhere((own.lambda2 > 0) & (own.pi2 > 0))
    if not len(there):
        return own
    m, lambda2, p, pi2 = own.m.copy(), own.lambda2.copy(), own.p.copy(), own.pi2.copy()
    for j, k in np.argwhere((own.lambda2 <= 0) | (own.pi2 <= 0)):
        at = tuple(there[np.abs(there - (j, k)).sum(axis=1).argmin()])
        m[j, k], lambda2[j, k], p[j, k], pi2[j, k] = own.m[at], own.lambda2[at], own.p[at], own.pi2[at]
    return replace(own, m=m, lambda2=lambda2, p=p, pi2=pi2)


def whitened_kmeans(df: DataFrame, columns: list[str], by: str, k: int, seed: int = 1) -> DataFrame:
    """kmeans_labels() on columns divided by their standard deviation."""
    scale = df.agg(*(F.stddev_pop(c).alias(c) for c in columns)).first()
    scaled = df.withColumns({f"_white_{c}": F.col(c) / F.lit(scale[c] or 1.0) for c in columns})
    return kmeans_labels(scaled, [f"_white_{c}" for c in columns], f"_white_{by}", k, seed).drop(*(f"_white_{c}" for c in columns))
