"""Supervised estimates from labelled series, as aggregates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import checkpointed
from ..functions.model import RegimeModel


def pairs(df: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """Each row with the next one of its series: c and c_next."""
    w = Window.partitionBy(*key).orderBy(order)
    out = df.select(*key, order, *columns, *(F.lead(c).over(w).alias(f"{c}_next") for c in columns), F.lead(F.lit(1)).over(w).alias("_more"))
    return out.filter("_more = 1").drop("_more")


def transition_counts(df: DataFrame, key: list[str], order: str, r: str) -> DataFrame:
    """j, k, n, p: steps between regimes within series, and their share of all steps."""
    counts = pairs(df, key, order, [r]).groupBy(F.col(r).alias("j"), F.col(f"{r}_next").alias("k")).agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))


def regime_moments(df: DataFrame, r: str, x: str, y: str) -> DataFrame:
    """r, n, means, variances and covariance (over all rows of the regime)."""
    return df.groupBy(r).agg(
        F.count("*").alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.var_pop(x).alias("var_x"), F.var_pop(y).alias("var_y"), F.covar_pop(x, y).alias("cov_xy"),
    )


def pair_moments(df: DataFrame, key: list[str], order: str, r: str, x: str, y: str) -> DataFrame:
    """j, k, n and the four covariances between (x, y) and the next (x, y), centred on the regimes' means."""
    means = df.groupBy(r).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    steps = pairs(df, key, order, [r, x, y])
    near = means.select(F.col(r).alias("j"), F.col("_mx").alias("_ax"), F.col("_my").alias("_ay"))
    far = means.select(F.col(r).alias("k"), F.col("_mx").alias("_bx"), F.col("_my").alias("_by"))
    joined = steps.withColumnsRenamed({r: "j", f"{r}_next": "k"}).join(near, "j").join(far, "k")
    product = lambda a, ma, b, mb: F.avg((F.col(a) - F.col(ma)) * (F.col(f"{b}_next") - F.col(mb)))
    return joined.groupBy("j", "k").agg(
        F.count("*").alias("n"), product(x, "_ax", x, "_bx").alias("xx"), product(x, "_ax", y, "_by").alias("xy"), product(y, "_ay", x, "_bx").alias("yx"), product(y, "_ay", y, "_by").alias("yy"),
    )


def fit_model(df: DataFrame, key: list[str], order: str, r: str, x: str, y: str, regimes: int) -> RegimeModel:
    """A RegimeModel from labels 0 .. regimes - 1; only the K^2 rows of moments come to the driver."""
    own = {row[r]: row for row in regime_moments(df, r, x, y).collect()}
    mean = np.array([[own[k]["mean_x"], own[k]["mean_y"]] for k in range(regimes)])
    gamma = np.array([[[own[k]["var_x"], own[k]["cov_xy"]], [own[k]["cov_xy"], own[k]["var_y"]]] for k in range(regimes)])
    sigma, joint = np.zeros((regimes, regimes, 2, 2)), np.zeros((regimes, regimes))
    for row in pair_moments(df, key, order, r, x, y).collect():
        sigma[row["j"], row["k"]] = [[row["xx"], row["xy"]], [row["yx"], row["yy"]]]
        joint[row["j"], row["k"]] = row["n"]
    return RegimeModel(mean, gamma, sigma, joint / joint.sum())


def fit_vectors(df: DataFrame, key: list[str], order: str, r: str, x: list[str], y: list[str], regimes: int) -> RegimeModel:
    """fit_model() for several hidden columns x and observed columns y; K^2 rows of moments come to the driver."""
    z, n = [*x, *y], len(x) + len(y)
    own = {row[r]: row for row in df.groupBy(r).agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(z)), *(F.covar_pop(a, b).alias(f"g{i}_{j}") for i, a in enumerate(z) for j, b in enumerate(z))).collect()}
    mean = np.array([[own[k][f"m{i}"] for i in range(n)] for k in range(regimes)])
    gamma = np.array([[[own[k][f"g{i}_{j}"] for j in range(n)] for i in range(n)] for k in range(regimes)])
    means = df.groupBy(r).agg(*(F.avg(c).alias(f"_m{i}") for i, c in enumerate(z)))
    near = F.broadcast(means.select(F.col(r).alias("j"), *(F.col(f"_m{i}").alias(f"_a{i}") for i in range(n))))
    far = F.broadcast(means.select(F.col(r).alias("k"), *(F.col(f"_m{i}").alias(f"_b{i}") for i in range(n))))
    steps = pairs(df, key, order, [r, *z]).withColumnsRenamed({r: "j", f"{r}_next": "k"}).join(near, "j").join(far, "k")
    products = [F.avg((F.col(a) - F.col(f"_a{i}")) * (F.col(f"{b}_next") - F.col(f"_b{j}"))).alias(f"s{i}_{j}") for i, a in enumerate(z) for j, b in enumerate(z)]
    sigma, joint = np.zeros((regimes, regimes, n, n)), np.zeros((regimes, regimes))
    for row in steps.groupBy("j", "k").agg(F.count("*").alias("n"), *products).collect():
        at = row["j"], row["k"]
        sigma[at], joint[at] = [[row[f"s{i}_{j}"] for j in range(n)] for i in range(n)], row["n"]
    return RegimeModel(mean, gamma, sigma, joint / joint.sum(), len(x))


def fit_averaged(df: DataFrame, key: list[str], order: str, r: str, x: str, y: str, regimes: int) -> RegimeModel:
    """A model from the covariances of steps: a regime's own one is the average of both diagonal blocks of its steps to itself.

    Where a pair's covariance is then not positive, its steps say nothing of each other (sigma 0). The table of pairs
    has K^2 rows at most. A regime that no step leads from itself to itself has the covariance of all its rows.
    """
    from ..functions.tables import learned

    rows = {(row["j"], row["k"]): row for row in learned(df, key, order, r, x, y).collect()}
    plain = fit_model(df, key, order, r, x, y, regimes)
    block = lambda row, a, b: np.array([[row[f"c_{min(i, j)}{max(i, j)}"] for j in (b, b + 1)] for i in (a, a + 1)])
    gamma, sigma = plain.gamma.copy(), np.zeros((regimes, regimes, 2, 2))
    for k in range(regimes):
        if (k, k) in rows:
            gamma[k] = (block(rows[k, k], 0, 0) + block(rows[k, k], 2, 2)) / 2
    for (j, k), row in rows.items():
        own = block(row, 0, 2)
        whole = np.block([[gamma[j], own], [own.T, gamma[k]]])
        sigma[j, k] = own if np.linalg.eigvalsh(whole).min() > 0 else 0.0
    return RegimeModel(plain.mean, gamma, sigma, plain.joint)


def regression_sums(df: DataFrame, key: list[str], order: str, r: str, x: str, y: str, weight: str | None = None) -> DataFrame:
    """p0, p1, pi2, n of y' = p0 y + p1 + e for each pair of regimes, by weighted least squares.

    The pairs' means, products of what is centred on them, and squares of residuals are three aggregates, so that
    nothing small is the difference of large sums; what is joined back has a row for each pair.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    steps = pairs(df, key, order, [r, y, *([weight] if weight else [])]).select(F.col(r).alias("j"), F.col(f"{r}_next").alias("k"), w.alias("_w"), F.col(y).alias("_a"), F.col(f"{y}_next").alias("_b"))
    mean = lambda c: F.sum(F.col("_w") * F.col(c)) / F.sum("_w")
    means = steps.groupBy("j", "k").agg(mean("_a").alias("_ma"), mean("_b").alias("_mb"))
    centred = steps.join(F.broadcast(means), ["j", "k"]).select("j", "k", "_w", (F.col("_a") - F.col("_ma")).alias("_a"), (F.col("_b") - F.col("_mb")).alias("_b"), "_ma", "_mb")
    sums = centred.groupBy("j", "k").agg((F.sum(F.col("_w") * F.col("_a") * F.col("_b")) / F.sum(F.col("_w") * F.col("_a") * F.col("_a"))).alias("p0"))
    rest = F.col("_b") - F.col("p0") * F.col("_a")
    return centred.join(F.broadcast(sums), ["j", "k"]).groupBy("j", "k").agg(
        F.count("*").alias("n"), F.first("p0").alias("p0"), F.first(F.col("_mb") - F.col("p0") * F.col("_ma")).alias("p1"), (F.sum(F.col("_w") * rest * rest) / F.sum("_w")).alias("pi2"),
    )


def kmeans_labels(df: DataFrame, columns: list[str], by: str, k: int, seed: int = 1) -> DataFrame:
    """Adds label: clusters of the columns, numbered by their centres' `by`."""
    vectors = VectorAssembler(inputCols=columns, outputCol="_v").transform(df)
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_c").fit(vectors)
    at = columns.index(by)
    rank = np.argsort(np.argsort([c[at] for c in model.clusterCenters()]))
    return model.transform(vectors).withColumn("label", F.element_at(F.array(*map(F.lit, rank.tolist())), F.col("_c") + 1)).drop("_v", "_c")


def iterate_fit(df: DataFrame, key: list[str], order: str, x: str, y: str, regimes: int, rounds: int, seed: int = 1) -> tuple[RegimeModel, DataFrame]:
    """Stochastic learning without labels: k-means labels, then rounds of fit, smoothing on y alone and a draw of the posterior chain."""
    from ..functions.model import nearest_open_loop
    from . import scan
    from .recursions import LONG, by_series, longest, path_sample, unknown_regimes, vectors

    labels = checkpointed(kmeans_labels(df, [x, y], y, regimes, seed).withColumnRenamed("label", "r").select(*key, order, x, y, "r"))
    model = nearest_open_loop(fit_model(labels, key, order, "r", x, y, regimes))
    for step in range(rounds):
        u = (F.pmod(F.xxhash64(F.lit(seed + step), *key, order), F.lit(1 << 30)) + 0.5) / float(1 << 30)

        def draw(rows: pd.DataFrame, sizes: np.ndarray, model=model) -> dict:
            found = unknown_regimes(vectors(rows, y), sizes, model)
            return {"r": path_sample(found["onward"], found["p_smooth"], np.ones_like(found["beta"]), sizes, rows["_u"].to_numpy())}

        given = labels.drop("r").withColumn("_u", u)
        if longest(given, key) > LONG:
            drawn = scan.draw_paths(scan.Scan(given, key, order, scan.UnknownRegimes(model, y)), "_u", "", lambda *_: {})
        else:
            drawn = by_series(given, key, order, "r int", draw)
        labels = checkpointed(drawn.drop("_u"))
        model = nearest_open_loop(fit_model(labels, key, order, "r", x, y, regimes))
    return model, labels
