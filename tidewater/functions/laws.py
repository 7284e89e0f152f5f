"""Laws of two successive fuzzy regimes in [0, 1]: atoms at 0 and 1, densities between, as Column expressions and NumPy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Law:
    """family: 1, 2, 2bis, 2ter, 3, 4, 4bis; p: its free parameters and those that normalisation fixes."""

    family: str
    p: dict[str, float]


def law(text: str) -> Law:
    """A law from its colon string, such as "2ter:0.14:0.12:0.0" (parameters in the order of the names below)."""
    family, *rest = text.split(":")
    v = [float(x) for x in rest]
    if family == "1":
        a, g = v
        p = {"alpha": a, "gamma": g, "beta": (1 - 5 * g) / 2 - a}
    elif family == "2":
        a, eta, d = v
        p = {"alpha": a, "eta": eta, "delta": d, "beta": (1 - 2.5 * (d + eta) + (d - eta) / 6) / 2 - a}
    elif family == "2bis":
        a, eta, d, lam = v
        core = eta + (d - eta) / 3
        p = {"alpha": a, "eta": eta, "delta": d, "lambda": lam, "beta": (1 - core - 2 * lam * eta) / 2 - a}
    elif family == "2ter":
        a0, a1, b = v
        p = {"alpha0": a0, "alpha1": a1, "beta": b, "eta": max(0.0, 3 / 8 * (1 - a0 - a1 - 2 * b))}
    elif family == "3":
        a, d = v
        p = {"alpha": a, "delta": d, "beta": 0.0, "gamma": (1 - 2 * a) / (d * (6 - d)), "lambda": None}
    elif family == "4":
        a, g, d = v
        g = min(g, (1 - 2 * a) / (d * (6 - d)) - 1e-10)
        p = {"alpha": a, "gamma": g, "delta": d, "beta": (1 - g * d * (6 - d)) / 2 - a, "lambda": None}
    elif family == "4bis":
        a, b, d, lam = v
        p = {"alpha": a, "beta": b, "delta": d, "lambda": lam, "gamma": (1 - 2 * (a + b)) / (d * (2 - d) + 2 * lam * d)}
    else:
        raise ValueError(f"unknown law {family}")
    if family not in ("2ter",) and p["beta"] < -1e-12:
        raise ValueError(f"parameters of {text} leave a negative weight")
    return Law(family, p)


def joint(own: Law, r: Column, s: Column) -> Column:
    """Joint density of (r, s) with respect to (atoms at 0 and 1) + length, on each axis."""
    p, gap = own.p, F.abs(r - s)
    atom_r, atom_s = r.isin(0.0, 1.0), s.isin(0.0, 1.0)
    corner, edge = atom_r & atom_s, atom_r | atom_s
    near0 = (r == 0.0) | (s == 0.0)
    inner = F.when(r.isin(0.0, 1.0), s).otherwise(r)
    if own.family == "1":
        diagonal, cross, on_edge, inside = p["alpha"], p["beta"], F.lit(p["gamma"]), F.lit(p["gamma"])
    elif own.family == "2":
        diagonal, cross = p["alpha"], p["beta"]
        on_edge = inside = p["eta"] + (p["delta"] - p["eta"]) * gap
    elif own.family == "2bis":
        diagonal, cross, inside = p["alpha"], p["beta"], p["eta"] + (p["delta"] - p["eta"]) * gap
        on_edge = p["lambda"] * p["eta"] * F.when(near0, 1 - inner).otherwise(inner)
    elif own.family == "2ter":
        diagonal, cross = F.when(r == 0.0, p["alpha0"]).otherwise(p["alpha1"]), p["beta"]
        on_edge = inside = p["eta"] * (1 - gap)
    else:
        diagonal, cross, d = p["alpha"], p["beta"], p["delta"]
        inside = F.when(gap <= d, p["gamma"]).otherwise(0.0)
        if p["lambda"] is None:
            on_edge = inside
        else:
            ramp = F.when(near0, 1 - inner / d).otherwise(inner / d + 1 - 1 / d)
            on_edge = F.when(gap <= d, p["lambda"] * p["gamma"] * ramp).otherwise(0.0)
    to = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(corner & (r == s), to(diagonal)).when(corner, to(cross)).when(edge, on_edge).otherwise(inside)


def marginal(own: Law, r: Column) -> Column:
    """Mass of r at an atom, density inside: the joint law summed over the next regime, in closed form."""
    p, d = own.p, own.p.get("delta")
    within = lambda low, high: F.greatest(F.lit(0.0), F.least(F.lit(1.0), high) - F.greatest(F.lit(0.0), low))
    if own.family == "1":
        atom, inside = F.lit(p["alpha"] + p["beta"] + p["gamma"]), F.lit(3 * p["gamma"])
    elif own.family == "2":
        atom = F.lit(p["alpha"] + p["beta"] + (p["eta"] + d) / 2)
        inside = (d - p["eta"]) * (r * r - r) + 1.5 * (p["eta"] + d)
    elif own.family == "2bis":
        atom = F.lit(p["alpha"] + p["beta"] + p["eta"] * p["lambda"] / 2)
        inside = p["eta"] * (p["lambda"] + 1) + (d - p["eta"]) * (0.5 + r * r - r)
    elif own.family == "2ter":
        atom = F.when(r == 0.0, p["alpha0"]).otherwise(p["alpha1"]) + p["beta"] + p["eta"] / 2
        inside = p["eta"] * (1.5 + r - r * r)
    else:
        scale = 1.0 if p["lambda"] is None else p["lambda"]
        atom = F.lit(p["alpha"] + p["beta"] + p["gamma"] * d * (1.0 if p["lambda"] is None else p["lambda"] / 2))
        low = F.lit(1.0) if p["lambda"] is None else 1 - r / d
        high = F.lit(1.0) if p["lambda"] is None else r / d + 1 - 1 / d
        edges = scale * (F.when(r <= d, low).otherwise(0.0) + F.when(1 - r <= d, high).otherwise(0.0))
        inside = p["gamma"] * (within(r - d, r + d) + edges)
    return F.when(r.isin(0.0, 1.0), atom).otherwise(inside)


def conditional(own: Law, r: Column, s: Column) -> Column:
    """Law of the next regime s given r, with respect to atoms and length; 0 where r has no weight."""
    weight = marginal(own, r)
    return F.when(weight > 0, joint(own, r, s) / weight).otherwise(0.0)


def hard_weight(own: Law) -> float:
    """Share of regimes that are exactly 0 or 1."""
    p = own.p
    if own.family == "2ter":
        return p["alpha0"] + p["alpha1"] + 2 * p["beta"] + p["eta"]
    edge = {"1": lambda: p["gamma"], "2": lambda: (p["eta"] + p["delta"]) / 2, "2bis": lambda: p["eta"] * p["lambda"] / 2}.get(
        own.family, lambda: p["gamma"] * p["delta"] * (1.0 if p["lambda"] is None else p["lambda"] / 2)
    )()
    return 2 * (p["alpha"] + p["beta"] + edge)


def hard_transition_closed(own: Law) -> np.ndarray:
    """Weights of the four quadrants of [0, 1]^2 in closed form (families 2, 2ter, and 3 and 4 with delta up to 1/2)."""
    p = own.p
    if own.family == "2":
        cross = p["beta"] + 3 * p["eta"] / 8 + 7 * p["delta"] / 8
        same = (0.5 - cross, 0.5 - cross)
    elif own.family == "2ter":
        cross = p["beta"] + 3 * p["eta"] / 8
        same = (p["alpha0"] + 23 * p["eta"] / 24, p["alpha1"] + 23 * p["eta"] / 24)
    elif own.family in ("3", "4") and p["delta"] <= 0.5:
        cross = p["beta"] + p["delta"] ** 2 * p["gamma"] / 2
        one = p["alpha"] + (2 * p["delta"] + 0.25 - (0.5 - p["delta"]) ** 2) * p["gamma"]
        same = (one, one)
    else:
        raise ValueError(f"no closed form for law {own.family}")
    return np.array([[same[0], cross], [cross, same[1]]])


def rescaled(value: Column, low: float, high: float) -> Column:
    """A value of [0, 1] on [low, high]."""
    return value * (high - low) + low


def drawn(density: np.ndarray, u: Column) -> Column:
    """A value of [0, 1] from a uniform u: the inverse of the distribution function of a density given on equal cells."""
    upto = np.cumsum(density) / np.sum(density)
    table = F.array(*map(F.lit, upto.tolist()))
    k = F.size(F.filter(table, lambda c: c < u))
    below = F.when(k == 0, 0.0).otherwise(F.get(table, k - 1))
    return (k + (u - below) / (F.get(table, k) - below)) / len(density)


def grid(spark: SparkSession, cells: int) -> DataFrame:
    """r (atoms and cell centres) and w (1 for an atom, the width of a cell)."""
    return spark.range(cells + 2).select(
        F.when(F.col("id") == 0, 0.0).when(F.col("id") == cells + 1, 1.0).otherwise((F.col("id") - 0.5) / cells).alias("r"),
        F.when(F.col("id").isin(0, cells + 1), 1.0).otherwise(1.0 / cells).alias("w"),
    )


def table(spark: SparkSession, own: Law, cells: int) -> DataFrame:
    """r, s, w (weight of the grid point) and p (joint density) over the grid: a fixed (cells + 2)^2 rows."""
    g = grid(spark, cells)
    both = g.select(F.col("r"), F.col("w").alias("_a")).join(g.select(F.col("r").alias("s"), F.col("w").alias("_b")))
    return both.select("r", "s", (F.col("_a") * F.col("_b")).alias("w"), joint(own, F.col("r"), F.col("s")).alias("p"))


def hard_transition(points: DataFrame) -> DataFrame:
    """j, k, p: weight of the four quadrants of [0, 1]^2 (a regime is hard 1 from 0.5 on)."""
    return points.groupBy((F.col("r") >= 0.5).cast("int").alias("j"), (F.col("s") >= 0.5).cast("int").alias("k")).agg(F.sum(F.col("w") * F.col("p")).alias("p"))


def _steps(labels: DataFrame, key: list[str], order: str, r: str) -> DataFrame:
    return labels.withColumn("_next", F.lead(r).over(Window.partitionBy(*key).orderBy(order))).filter(F.col("_next").isNotNull())


def fit_2ter(labels: DataFrame, key: list[str], order: str, r: str) -> DataFrame:
    """alpha0, alpha1, beta, eta of the 2ter law from labels: shares of 0 -> 0, 1 -> 1 and (halved) 0 <-> 1 among all steps within series."""
    share = lambda a, b: F.avg(((F.col(r) == a) & (F.col("_next") == b)).cast("double"))
    found = _steps(labels, key, order, r).agg(share(0.0, 0.0).alias("alpha0"), share(1.0, 1.0).alias("alpha1"), ((share(0.0, 1.0) + share(1.0, 0.0)) / 2).alias("beta"))
    return found.withColumn("eta", F.greatest(F.lit(0.0), 0.375 * (1 - F.col("alpha0") - F.col("alpha1") - 2 * F.col("beta"))))


def fit_4bis(labels: DataFrame, key: list[str], order: str, r: str, delta: float = 0.1) -> DataFrame:
    """alpha, beta, delta, lambda of the 4bis law from labels, for a given delta: from shares of hard steps and of steps that end hard."""
    same = ((F.col(r) == F.col("_next")) & F.col(r).isin(0.0, 1.0)).cast("double")
    cross = ((F.col(r) + F.col("_next") == 1.0) & F.col(r).isin(0.0, 1.0)).cast("double")
    found = _steps(labels, key, order, r).agg((F.avg(same) / 2).alias("alpha"), (F.avg(cross) / 2).alias("beta"), F.avg(F.col("_next").isin(0.0, 1.0).cast("double")).alias("_hard"))
    corners = 2 * (F.col("alpha") + F.col("beta"))
    lam = (2 - delta) * (F.col("_hard") - corners) / (1 - 2 * F.col("_hard") + corners)
    return found.select("alpha", "beta", F.lit(delta).alias("delta"), lam.alias("lambda"))


def fmc1(labels: DataFrame, r: str, coefficient: float = 1.0) -> DataFrame:
    """alpha, beta, delta, eta of a law of the second family from the share of hard labels, with beta and delta 0."""
    share = F.avg(F.col(r).isin(0.0, 1.0).cast("double")) * coefficient
    eta = 1.2 * (1 - F.col("_share")) / 2
    found = labels.agg(share.alias("_share")).withColumn("eta", eta)
    return found.select(((F.col("_share") - F.col("eta")) / 2).alias("alpha"), F.lit(0.0).alias("beta"), F.lit(0.0).alias("delta"), "eta")


def fmc2(labels: DataFrame, key: list[str], order: str, r: str, coefficient: float = 1.0, slope: float = 1.0) -> DataFrame:
    """alpha, beta, gamma, delta of a law of the fourth family: half the share of hard labels, and the steepest rise from a fuzzy one."""
    rise = F.max(F.when(~F.col(r).isin(0.0, 1.0), F.greatest(F.lit(0.0), F.col("_next") - F.col(r))))
    steep = _steps(labels, key, order, r).agg((F.coalesce(rise, F.lit(0.0)) * slope).alias("delta"))
    found = labels.agg((F.avg(F.col(r).isin(0.0, 1.0).cast("double")) / 2 * coefficient).alias("alpha")).join(F.broadcast(steep))
    gamma = F.when(F.col("delta") > 0, (1 - 2 * F.col("alpha")) / (6 * F.col("delta") - F.col("delta") * F.col("delta")))
    return found.select("alpha", F.lit(0.0).alias("beta"), gamma.alias("gamma"), "delta")


def points(cells: int, nodes: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Values and weights that integrate over [0, 1] with atoms at its ends: in each cell Gauss-Legendre nodes, one of them the centre."""
    at, share = np.polynomial.legendre.leggauss(nodes)
    inner = (np.arange(cells)[:, None] + (1 + at) / 2).ravel() / max(cells, 1)
    return np.concatenate([[0.0], inner, [1.0]]), np.concatenate([[1.0], np.tile(share / 2, cells) / max(cells, 1), [1.0]])


def matrix(own: Law, cells: int, nodes: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grid r, weights w and joint densities on it, for the recursions."""
    r, w = points(cells, nodes)
    a, b = np.meshgrid(r, r, indexing="ij")
    p, gap = own.p, np.abs(a - b)
    atom_a, atom_b = np.isin(a, (0, 1)), np.isin(b, (0, 1))
    near0, inner = (a == 0) | (b == 0), np.where(atom_a, b, a)
    d = p.get("delta", 1.0)
    if own.family in ("3", "4", "4bis"):
        inside = np.where(gap <= d, p["gamma"], 0.0)
        ramp = np.where(near0, 1 - inner / d, inner / d + 1 - 1 / d)
        edge = inside if p["lambda"] is None else inside * p["lambda"] * ramp
    elif own.family == "1":
        inside = edge = np.full_like(a, p["gamma"])
    elif own.family == "2ter":
        inside = edge = p["eta"] * (1 - gap)
    else:
        inside = p["eta"] + (p["delta"] - p["eta"]) * gap
        edge = inside if own.family == "2" else p["lambda"] * p["eta"] * np.where(near0, 1 - inner, inner)
    diagonal = np.where(a == 0, p.get("alpha0", p.get("alpha")), p.get("alpha1", p.get("alpha")))
    out = np.where(atom_a & atom_b, np.where(a == b, diagonal, p["beta"]), np.where(atom_a | atom_b, edge, inside))
    return r, w, out
