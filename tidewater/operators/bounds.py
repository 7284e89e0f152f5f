"""What an estimate that sees one observation only can reach: blind mean square errors of a scalar model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.model import RegimeModel


def blind_bounds(spark: SparkSession, model: RegimeModel, low: float = -50.0, high: float = 50.0, points: int = 20_001) -> DataFrame:
    """known, unknown: mean square error of E(x | y, r) and of E(x | y), the latter by the trapezoid rule on [low, high].

    The range must hold all but a little of y's law; the grid is a fixed number of rows.
    """
    g, mean, w = model.gamma, model.mean, model.marginal
    known = float(sum(w[k] * (g[k][0, 0] - g[k][0, 1] ** 2 / g[k][1, 1]) for k in range(len(w))))
    second = float(sum(w[k] * (g[k][0, 0] + mean[k][0] ** 2) for k in range(len(w))))
    step = (high - low) / (points - 1)
    y = F.lit(low) + F.col("id") * step
    density, weighted = F.lit(0.0), F.lit(0.0)
    for k in range(len(w)):
        v = float(g[k][1, 1])
        p = float(w[k]) / (2 * 3.141592653589793 * v) ** 0.5 * F.exp(-0.5 * (y - float(mean[k][1])) ** 2 / v)
        density = density + p
        weighted = weighted + p * (float(mean[k][0]) + float(g[k][0, 1] / v) * (y - float(mean[k][1])))
    at = F.when(F.col("id").isin(0, points - 1), step / 2).otherwise(step)
    squared = F.when(density > 0, weighted * weighted / density).otherwise(0.0)
    return spark.range(points).agg(F.lit(known).alias("known"), (second - F.sum(at * squared)).alias("unknown"))
