"""Error measures as aggregates; a null estimate or truth takes no part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mse(estimate: str, truth: str) -> Column:
    return F.avg(F.pow(F.col(estimate) - F.col(truth), 2))


def square_error(estimate: str, truth: str) -> Column:
    return F.pow(F.col(estimate) - F.col(truth), 2)


def mse_by_place(df: DataFrame, n: str, truth: str, estimates: list[str]) -> DataFrame:
    """n, method, mse, variance: mean square error of each estimate at each place, over the series that have it, and how it varies."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("method"), square_error(c, truth).alias("_e")) for c in estimates))).alias("_each")
    return df.select(n, each).select(n, "_each.*").groupBy(n, "method").agg(F.avg("_e").alias("mse"), F.var_pop("_e").alias("variance"))


def mean_covariances(df: DataFrame, n: str, columns: list[str]) -> DataFrame:
    """n, method, mean of each of the columns (state variances of several methods) at each place, over all series."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("method"), F.col(c).alias("_v")) for c in columns))).alias("_each")
    return df.select(n, each).select(n, "_each.*").groupBy(n, "method").agg(F.avg("_v").alias("mean"))


def report(df: DataFrame, key: list[str], truth: str, estimates: list[str], labels: tuple[str, str] | None = None, digits: int = 4) -> DataFrame:
    """One row for each key, rounded half to even: mean square errors of estimates and, of a pair of label columns, the share of errors."""
    columns = [F.bround(mse(c, truth), digits).alias(f"mse_{c}") for c in estimates]
    more = [F.bround(error_ratio(*labels), digits).alias("label_errors")] if labels else []
    return df.groupBy(*key).agg(F.count("*").alias("n"), *columns, *more)


def error_ratio(estimate: str, truth: str) -> Column:
    """Mean absolute difference; the share of errors for labels 0 and 1."""
    return F.avg(F.abs(F.col(estimate) - F.col(truth)))


def hard_share(r: str) -> Column:
    return F.avg(F.col(r).isin(0.0, 1.0).cast("double"))


def trimmed_mse(df: DataFrame, key: list[str], n: str, estimate: str, truth: str, cut: int = 3) -> DataFrame:
    """Mean square error per series without its first and last `cut` rows."""
    inside = df.withColumn("_last", F.max(n).over(Window.partitionBy(*key))).filter((F.col(n) >= cut) & (F.col(n) <= F.col("_last") - cut))
    return inside.groupBy(*key).agg(mse(estimate, truth).alias("mse"))


def over_experiments(per_series: DataFrame, value: str = "mse") -> DataFrame:
    """Mean and variance of a measure over experiments."""
    return per_series.agg(F.avg(value).alias("mean"), F.var_pop(value).alias("variance"), F.count(value).alias("n"))


def hardened(r: str) -> Column:
    """The nearest whole regime, half to even."""
    return F.bround(r)
