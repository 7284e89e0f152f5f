"""Tables through files and back: each query writes a given table in a form, reads it again, and has the table itself as SQL."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import shared_path
from ..functions import tables
from ..operators import learn
from ..sources import series
from .catalogue import DAYS, day_series, query, read, rounded


def lines(df: DataFrame, path: str, value, end: str = "\n") -> str:
    """Writes one text line a row."""
    df.select(value.alias("value")).write.option("lineSep", end).text(path)
    return path


@query("SELECT event_id, user_id, event_type, value, CAST(ts AS VARCHAR)[:19] AS ts FROM events")
def csv_round_trip(spark, sf_dir):
    """A CSV table with a header."""
    path = shared_path(spark, "csv")
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))
    series.write_csv(rows, path)
    back = series.read_csv(spark, path, "event_id long, user_id long, event_type string, value double, ts string", ts="ts", ts_format="yyyy-MM-dd HH:mm:ss")
    return back.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT event_id, event_type, value, CAST(date_trunc('minute', ts) AS VARCHAR) AS ts FROM events")
def day_first_csv(spark, sf_dir):
    """Separated by semicolons, with dates day first."""
    path = shared_path(spark, "day-first")
    rows = read(spark, sf_dir, "events").select("event_id", F.date_format("ts", "dd/MM/yyyy HH:mm").alias("ts"), "event_type", "value")
    rows.write.option("header", True).option("sep", ";").csv(path)
    back = series.read_csv(spark, path, "event_id long, ts string, event_type string, value double", ts="ts", ts_format="dd/MM/yyyy HH:mm", sep=";")
    return back.select("event_id", "event_type", "value", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("SELECT o_orderkey, o_totalprice FROM orders")
def preamble_csv(spark, sf_dir):
    """Files with two lines and a header before their rows, lines ended by CR LF: one file for each order status."""
    path = shared_path(spark, "preamble")
    rows = read(spark, sf_dir, "orders").select(F.concat_ws(",", "o_orderkey", F.col("o_totalprice").cast("string")).alias("value"), F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id"))
    head = rows.select("_part").distinct().select(F.explode(F.array(*(F.struct(F.lit(t).alias("value"), F.lit(float(i - 3)).alias("_at")) for i, t in enumerate(("report", "all rows", "o_orderkey,o_totalprice"))))).alias("_h"), "_part")
    every = rows.select("value", "_part", F.col("_id").cast("double").alias("_at")).unionByName(head.select("_h.value", "_part", "_h._at"))
    every.repartition("_part").sortWithinPartitions("_part", "_at").select("value", "_part").write.partitionBy("_part").option("lineSep", "\r\n").text(path)
    return series.read_csv_after(spark, f"{path}/*", "o_orderkey long, o_totalprice double", 2)


@query("SELECT CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS n, value FROM events")
def numbers_round_trip(spark, sf_dir):
    """One number on each line, in order, over several files that are read as one."""
    path = shared_path(spark, "numbers")
    series.write_numbers(read(spark, sf_dir, "events").select("event_id", "value"), path, "event_id", "value")
    return series.read_numbers(spark, path, across=True)


@query("SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS n, o_totalprice, CAST(o_custkey AS DOUBLE) AS o_custkey FROM orders")
def matrix_round_trip(spark, sf_dir):
    """A matrix with commas and a line of names, written in order over several files that are read as one."""
    path = shared_path(spark, "matrix")
    series.write_matrix(read(spark, sf_dir, "orders"), path, "o_orderkey", {"price": "o_totalprice", "customer": "o_custkey"})
    return series.read_matrix(spark, path, across=True).select("n", F.col("values")[0].alias("o_totalprice"), F.col("values")[1].alias("o_custkey"))


@query(f"SELECT CAST(row_number() OVER (ORDER BY flag, day) - 1 AS BIGINT) AS n, round(x + 1e-7, 4) AS x, CAST(r AS DOUBLE) AS r, round(y + 1e-7, 4) AS y FROM ({DAYS})")
def dump_round_trip(spark, sf_dir):
    """A dump of sections x, r, y. Means of cents have ties at four digits, so both sides are moved off them."""
    path = shared_path(spark, "dump")
    days = day_series(spark, sf_dir).withColumn("at", F.struct("flag", "day"))
    series.write_sections(days, path, "at", {"hidden process X": "x", "markov chain R": "r", "observed process Y": "y"}, digits=9)
    back = series.read_sections(spark, path)
    return rounded(back.select(F.col("n").cast("long").alias("n"), (F.col("x") + 1e-7).alias("x"), "r", (F.col("y") + 1e-7).alias("y")), 4, "x", "y")


_MOMENTS = f"""WITH s AS MATERIALIZED ({DAYS}), m AS (SELECT r, avg(x) AS mx, avg(y) AS my FROM s GROUP BY 1), g AS (SELECT r, var_pop(x) AS gxx, covar_pop(x, y) AS gxy, var_pop(y) AS gyy FROM s GROUP BY 1),
    p AS (SELECT r AS j, x, y, lead(r) OVER w AS k, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM s WINDOW w AS (PARTITION BY flag ORDER BY day)), c AS (SELECT j, k, count(*) AS n FROM p WHERE k IS NOT NULL GROUP BY 1, 2)"""


@query(_MOMENTS + """ SELECT j, k, round(any_value(a.mx), 4) AS mean_x, round(any_value(a.my), 6) AS mean_y, round(any_value(g.gxx), 2) AS gxx, round(any_value(g.gxy), 3) AS gxy, round(avg((x - a.mx) * (x2 - b.mx)), 1) AS sxx,
    round(avg((y - a.my) * (y2 - b.my)), 5) AS syy, round(any_value(c.share), 6) AS joint FROM p JOIN (SELECT one.j AS cj, one.k AS ck, (one.n + two.n) / 2.0 / sum(one.n) OVER () AS share FROM c one JOIN c two ON two.j = one.k AND two.k = one.j) c ON cj = j AND ck = k JOIN m a ON a.r = j JOIN m b ON b.r = k JOIN g ON g.r = j GROUP BY 1, 2""")
def parameter_file_round_trip(spark, sf_dir):
    """A model learned from labels, its joint law made symmetric as a stationary one is, through a parameter file of covariances, means and law."""
    own = learn.fit_model(day_series(spark, sf_dir), ["flag"], "day", "r", "x", "y", 2)
    own = replace(own, joint=(own.joint + own.joint.T) / 2)
    path = shared_path(spark, "model")
    spark.createDataFrame([(series.model_text(own),)], "value string").coalesce(1).write.text(path)
    back, _ = series.read_model(spark, path)
    rows = [(j, k, *map(float, (*back.mean[j], back.gamma[j][0, 0], back.gamma[j][0, 1], back.sigma[j, k][0, 0], back.sigma[j, k][1, 1], back.joint[j, k]))) for j, k in np.ndindex(2, 2)]
    found = spark.createDataFrame(rows, "j int, k int, mean_x double, mean_y double, gxx double, gxy double, sxx double, syy double, joint double")
    for digits, names in ((4, ("mean_x",)), (6, ("mean_y", "joint")), (2, ("gxx",)), (3, ("gxy",)), (1, ("sxx",)), (5, ("syy",))):
        found = rounded(found, digits, *names)
    return found


@query(_MOMENTS + """ SELECT j, k, count(*) AS n, round(avg((x - a.mx) * (x2 - b.mx)), 1) AS c_02, round(avg((y - a.my) * (y2 - b.my)), 5) AS c_13 FROM p JOIN m a ON a.r = j JOIN m b ON b.r = k GROUP BY 1, 2""")
def pair_table_files(spark, sf_dir):
    """The learned table of pairs, in one folder for each regime, read back by key."""
    path = shared_path(spark, "pairs")
    series.partition_by_key(tables.learned(day_series(spark, sf_dir), ["flag"], "day", "r", "x", "y"), path, "j")
    return rounded(rounded(spark.read.parquet(path).select("j", "k", "n", "c_02", "c_13"), 1, "c_02"), 5, "c_13")
