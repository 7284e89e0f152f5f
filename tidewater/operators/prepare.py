"""Preparation of series with DataFrame expressions: order, ranges, resampling, gaps, labels, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import checkpointed


def indexed(df: DataFrame, key: list[str], order: list[str], name: str = "n") -> DataFrame:
    """Adds the 0-based place of each row in its series."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)


def between(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Rows from start to end, both included."""
    return df.filter(F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def split_at(df: DataFrame, ts: str, at: str) -> tuple[DataFrame, DataFrame]:
    """Rows before, and from, a time: train and test."""
    when = F.lit(at).cast("timestamp")
    return df.filter(F.col(ts) < when), df.filter(F.col(ts) >= when)


def positions(df: DataFrame, first: int, last: int, n: str = "n") -> DataFrame:
    """The slice [first, last) of each indexed series."""
    return df.filter((F.col(n) >= first) & (F.col(n) < last))


def reversed_order(df: DataFrame, key: list[str], n: str = "n") -> DataFrame:
    """The same rows numbered from the last to the first."""
    return df.withColumn(n, F.max(n).over(Window.partitionBy(*key)) - F.col(n))


def daily_mean(df: DataFrame, key: list[str], ts: str, value: str) -> DataFrame:
    """key, day, value: mean of each day from a series' first to its last; null for a day without rows."""
    days = df.groupBy(*key, F.to_date(ts).alias("day")).agg(F.avg(value).alias(value))
    spans = days.groupBy(*key).agg(F.min("day").alias("_a"), F.max("day").alias("_b"))
    every = spans.select(*key, F.explode(F.expr("sequence(_a, _b, interval 1 day)")).alias("day"))
    return every.join(days, [*key, "day"], "left")


def interpolated(df: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Fills nulls on the line between neighbours, by place; nulls at the end take the last value, at the start stay."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    back = Window.partitionBy(*key).orderBy(order)
    ahead = back.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_n").alias("n"), F.col(value).alias("v")))
    out = df.withColumn("_n", n).withColumn("_p", F.last(known, True).over(back)).withColumn("_q", F.first(known, True).over(ahead))
    line = F.col("_p.v") + (F.col("_q.v") - F.col("_p.v")) * (F.col("_n") - F.col("_p.n")) / (F.col("_q.n") - F.col("_p.n"))
    filled = F.coalesce(F.col(value), F.when(F.col("_q.v").isNull(), F.col("_p.v")).otherwise(line))
    return out.withColumn(value, filled).drop("_n", "_p", "_q")


def stretched(df: DataFrame, key: list[str], order: str, columns: list[str], length: int) -> DataFrame:
    """key, n (0 to length - 1) and columns: each series on `length` equally spaced places from its first row to its last, by straight lines.

    A series of one row is constant. Each pair of neighbours gives the places between them, so no range join is needed.
    """
    w = Window.partitionBy(*key).orderBy(order)
    place = F.row_number().over(w) - 1
    rows = df.select(*key, *columns, place.alias("_i"), F.count("*").over(Window.partitionBy(*key)).alias("_n"), *(F.lead(c).over(w).alias(f"_{c}") for c in columns))
    scale = F.when(F.col("_n") > 1, (F.col("_n") - 1) / F.lit(float(max(length - 1, 1)))).otherwise(0.0)
    first = F.when(F.col("_i") == 0, 0).otherwise(F.floor(F.col("_i") / scale) + 1)
    last = F.when(F.col("_n") == 1, length - 1).when(F.col("_i") == F.col("_n") - 1, -1).otherwise(F.floor((F.col("_i") + 1) / scale))
    last = F.when((F.col("_n") > 1) & (F.col("_i") == F.col("_n") - 2), length - 1).otherwise(last)
    every = rows.withColumn("_scale", scale).withColumn("n", F.explode(F.when(last >= first, F.sequence(first.cast("long"), last.cast("long")))))
    t = F.col("n") * F.col("_scale") - F.col("_i")
    return every.select(*key, F.col("n").cast("int").alias("n"), *(F.when(t == 0, F.col(c)).otherwise(F.coalesce(F.col(c) + (F.col(f"_{c}") - F.col(c)) * t, F.col(c))).alias(c) for c in columns))


def timestamp_of(date: str, time: str, pattern: str | None = None) -> Column:
    """A timestamp from a text column with a date and one with a time; null if they don't parse."""
    both = F.concat_ws(" ", date, time)
    return F.try_to_timestamp(both, F.lit(pattern)) if pattern else F.try_to_timestamp(both)


def regular_times(n: Column, start: str, seconds: int = 3600) -> Column:
    """Timestamps of constant frequency: `start` at n = 0."""
    return F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + n * seconds)


def constant_runs(at: Column, starts: list[tuple[float, float]], before: float) -> Column:
    """Piecewise constant labels: `before` up to the first start (place, value), then each value from its start on."""
    out = F.lit(before)
    for place, value in starts:
        out = F.when(at >= place, value).otherwise(out)
    return out


def zipped(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Columns of both tables side by side, by place; both are numbered by range partition, not in one task.

    The ranges are checkpointed before they are counted: their bounds are sampled, and would differ from plan to plan.
    """
    def numbered(df: DataFrame, order: list[str]) -> DataFrame:
        ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
        dealt = checkpointed(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
        sizes = dealt.groupBy("_part").count()
        base = sizes.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
        return dealt.join(F.broadcast(base), "_part").withColumn("_place", F.col("_base") + F.col("_row").bitwiseAND(2**33 - 1)).drop("_part", "_row", "_base")

    return numbered(left, left_order).join(numbered(right, right_order), "_place").drop("_place")


def runs(df: DataFrame, key: list[str], order: str, flag: Column) -> DataFrame:
    """key, start, end, size of maximal runs of rows with the flag."""
    w = Window.partitionBy(*key).orderBy(order)
    marked = df.withColumn("_f", flag).withColumn("_s", F.sum(F.when(F.col("_f") & ~F.coalesce(F.lag("_f").over(w), F.lit(False)), 1).otherwise(0)).over(w)).filter("_f")
    return marked.groupBy(*key, "_s").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("size")).drop("_s")


def weekend(ts: str) -> Column:
    return F.weekday(ts) >= 5


def ramp(at: Column, points: list[tuple[float, float]]) -> Column:
    """Piecewise linear function through points (place, value), constant outside."""
    out = F.lit(points[-1][1])
    for (x0, v0), (x1, v1) in reversed(list(zip(points, points[1:], strict=False))):
        out = F.when(at < x1, v0 + (at - x0) * ((v1 - v0) / (x1 - x0))).otherwise(out)
    return F.when(at <= points[0][0], points[0][1]).otherwise(out)


def fuzzy_label(y: Column, low: float, high: float) -> Column:
    """0 up to low, 1 from high on, a straight line between."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (y - low) / (high - low)))
