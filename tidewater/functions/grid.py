"""Discrete laws on a grid of [0, 1] (0, cells, 1): arrays of values in a column, or long tables of pairs.

Entries of an array are the mass at 0, a density for each cell, and the mass at 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def index_of(r: Column, cells: int) -> Column:
    """Entry (from 0) of the grid that a regime falls into; atoms by equality."""
    return F.when(r == 0.0, 0).when(r == 1.0, cells + 1).otherwise(F.floor(r * cells) + 1).cast("int")


def value_of(index: Column, cells: int) -> Column:
    """Regime of an entry: an atom, or the centre of a cell."""
    return F.when(index == 0, 0.0).when(index == cells + 1, 1.0).otherwise((index - 0.5) / cells)


def at(p: Column, r: Column, cells: int) -> Column:
    return F.get(p, index_of(r, cells))


def with_value(p: Column, index: Column, value: Column) -> Column:
    """The array with one entry set."""
    return F.transform(p, lambda x, i: F.when(i == index, value).otherwise(x))


def constant(value: float, cells: int) -> Column:
    return F.array_repeat(F.lit(float(value)), cells + 2)


def is_zero(p: Column) -> Column:
    return ~F.exists(p, lambda x: x != 0.0)


def weights(cells: int) -> Column:
    return F.array(F.lit(1.0), *[F.lit(1.0 / cells)] * cells, F.lit(1.0))


def _sum(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda s, x: s + x)


def integral(p: Column, cells: int) -> Column:
    """Masses plus the mean of the cells' densities."""
    return _sum(product(p, weights(cells)))


def product(p: Column, q: Column) -> Column:
    return F.zip_with(p, q, lambda x, y: x * y)


def normalised(p: Column, cells: int) -> Column:
    """The law of integral 1; a law that is 0 everywhere becomes the uniform one."""
    total = integral(p, cells)
    return F.when(total > 0, F.transform(p, lambda x: x / total)).otherwise(constant(1.0 / 3, cells))


def most_probable(p: Column, cells: int) -> Column:
    """Regime of the largest mass or density: a cell wins ties, the first of equal ones, then 0, then 1."""
    inner = F.slice(p, 2, cells)
    best = F.array_max(inner)
    cell = value_of(F.array_position(inner, best).cast("int"), cells)
    first, last = F.get(p, F.lit(0)), F.get(p, F.lit(cells + 1))
    return F.when((best >= first) & (best >= last), cell).when(first >= last, 0.0).otherwise(1.0)


def sampled(p: Column, u: Column, cells: int) -> Column:
    """Entry drawn by a uniform u from the law."""
    upto = F.aggregate(
        product(p, weights(cells)), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("i")),
        lambda acc, x: F.struct((acc["s"] + x).alias("s"), (acc["i"] + (acc["s"] + x < u * integral(p, cells)).cast("int")).alias("i")),
    )["i"]
    return F.least(upto, F.lit(cells + 1))


def marginal(pairs: DataFrame, on: str, keep: list[str] = [], weight: str = "w_other", p: str = "p") -> DataFrame:  # noqa: B006
    """Law of one regime from a table of pairs: sum over the other one's entries with their weights."""
    return pairs.groupBy(*keep, on).agg(F.sum(F.col(weight) * F.col(p)).alias(p))


def rectangle(pairs: DataFrame, r: tuple[float, float], s: tuple[float, float], keep: list[str] = []) -> DataFrame:  # noqa: B006
    """Weight of a table (r, s, w, p) inside a rectangle, borders included."""
    inside = F.col("r").between(*r) & F.col("s").between(*s)
    group = pairs.groupBy(*keep) if keep else pairs
    return group.agg(F.coalesce(F.sum(F.when(inside, F.col("w") * F.col("p"))), F.lit(0.0)).alias("p"))


def negative_variance(mean: Column, second: Column, tolerance: float = 1e-9) -> Column:
    """Whether moments are no moments of any law: a second one below the square of the first."""
    return second - mean * mean < -tolerance
