"""Simulation of series from a model; results depend on the seed and the series number only."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..cluster import ship_package
from ..functions.laws import Law
from ..functions.model import RegimeModel, is_admissible, square_root


def _one(model: RegimeModel, length: int, seed: int, series: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(np.random.SeedSequence([seed, series]))
    f, q, c = model.regression()
    roots = np.array([[square_root(m) for m in row] for row in q])
    z, r = np.zeros((length, model.mean.shape[1])), np.zeros(length, dtype=int)
    pick = lambda p: min(int(np.searchsorted(np.cumsum(p), rng.random())), len(p) - 1)
    r[0] = pick(model.marginal)
    z[0] = model.mean[r[0]] + square_root(model.gamma[r[0]]) @ rng.standard_normal(z.shape[1])
    for n in range(1, length):
        r[n] = pick(model.transition[r[n - 1]])
        j, k = r[n - 1], r[n]
        z[n] = f[j, k] @ z[n - 1] + c[j, k] + roots[j, k] @ rng.standard_normal(z.shape[1])
    return z, r


def simulate(spark: SparkSession, model: RegimeModel, series: int, length: int, seed: int, values: np.ndarray | None = None) -> DataFrame:
    """series, n, x, y (scalar model) and r: the regime's number, or its value where `values` are given."""
    ship_package(spark)

    def run(batches):
        for batch in batches:
            for s in batch["id"]:
                z, r = _one(model, length, seed, int(s))
                yield pd.DataFrame({"series": s, "n": range(length), "x": z[:, 0], "y": z[:, 1], "r": r.astype(float) if values is None else values[r]})

    return spark.range(series).mapInPandas(run, "series long, n int, x double, y double, r double")


def simulate_fuzzy(spark: SparkSession, model: RegimeModel, law: Law, cells: int, series: int, length: int, seed: int) -> DataFrame:
    """Series whose regime takes the values of a grid under a fuzzy law."""
    from .fuzzy import grid_model

    own, r, _ = grid_model(model, law, cells)
    return simulate(spark, own, series, length, seed, r)


def random_models(spark: SparkSession, gamma: np.ndarray, joint: np.ndarray, tries: int, seed: int, span: float = 1.0) -> DataFrame:
    """try and sigma (K*K*n*n, flat) of admissible models: random correlations between successive z that pass all positivity checks.

    Candidates are drawn and rejected in parallel; each depends on the seed and its number only.
    """
    ship_package(spark)
    k, n = len(joint), gamma.shape[-1]
    sd = np.sqrt(np.array([np.diag(g) for g in gamma]))

    def run(batches):
        for batch in batches:
            found = []
            for t in batch["id"]:
                rng = np.random.default_rng(np.random.SeedSequence([seed, int(t)]))
                sigma = rng.uniform(-span, span, (k, k, n, n)) * sd[:, None, :, None] * sd[None, :, None, :]
                if is_admissible(RegimeModel(np.zeros((k, n)), gamma, sigma, joint)):
                    found.append((t, sigma.ravel()))
            yield pd.DataFrame({"try": [t for t, _ in found], "sigma": [s for _, s in found]})

    return spark.range(tries).mapInPandas(run, "try long, sigma array<double>")


def quadrant_shares(simulated: DataFrame) -> DataFrame:
    """j, k, p: shares of the four quadrants among successive regimes of simulated series, to hold against the law's hard transition."""
    w = Window.partitionBy("series").orderBy("n")
    steps = simulated.select("r", F.lead("r").over(w).alias("s")).filter(F.col("s").isNotNull())
    counts = steps.groupBy((F.col("r") >= 0.5).cast("int").alias("j"), (F.col("s") >= 0.5).cast("int").alias("k")).agg(F.count("*").alias("_n"))
    return counts.select("j", "k", (F.col("_n") / F.sum("_n").over(Window.partitionBy())).alias("p"))


def experiments(spark: SparkSession, model: RegimeModel, count: int, length: int, seed: int) -> DataFrame:
    """mean, variance and n over simulated series of the filter's, smoother's and double filter's mean square error, and the share of wrong regimes."""
    from .metrics import error_ratio, mse
    from .recursions import double_filter_smoother, switching

    rows = simulate(spark, model, count, length, seed)
    restored = switching(rows, model, ["series"], outputs=("filter", "smooth", "r_smooth"))
    restored = double_filter_smoother(restored, model, ["series"])
    each = restored.groupBy("series").agg(mse("filter", "x").alias("filter"), mse("smooth", "x").alias("smooth"), mse("dfb_smooth", "x").alias("double_filter"), error_ratio("r_smooth", "r").alias("r_errors"))
    return each.agg(*(f(c).alias(f"{name}_{c}") for c in ("filter", "smooth", "double_filter", "r_errors") for name, f in (("mean", F.avg), ("variance", F.var_pop))), F.count("*").alias("n"))
