"""Named queries over the driver tables, with DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship_package
from ..functions import grid, laws
from ..functions.model import (
    example_model, fq_to_cov, from_regression, is_open_loop, is_open_loop_from_cov, linear_state_space, nearest_open_loop, reversed_model, square_root, steady_state,
)
from ..operators import bounds, fuzzy, learn, metrics, prepare, recursions, sem, simulate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
LOW, HIGH = 5.0, 110.0
OPEN = nearest_open_loop(example_model())
LAWS = {"1": "1:0.2:0.05", "2": "2:0.07:0.24:0.09", "2bis": "2bis:0.1:0.2:0.1:0.5", "2ter": "2ter:0.1356:0.1177:0.05", "3": "3:0.2:0.3", "4": "4:0.15:0.6:0.2", "4bis": "4bis:0.1:0.1:0.3:0.5"}

EVENTS = """SELECT user_id, ts, event_id, value AS y, CASE WHEN event_type IN ('purchase', 'error') THEN 1 ELSE 0 END AS r,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events"""
DAYS = """SELECT l_returnflag AS flag, CAST(l_shipdate AS DATE) AS day, avg(l_extendedprice) AS x, avg(l_quantity) AS y,
    CASE WHEN avg(l_quantity) > 25.5 THEN 1 ELSE 0 END AS r FROM lineitem GROUP BY 1, 2"""


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, ts, event_id, y, r, n: a series for each user; a purchase or an error is regime 1."""
    rows = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("value").alias("y"), F.col("event_type").isin("purchase", "error").cast("int").alias("r"))
    return prepare.indexed(rows, ["user_id"], ["ts", "event_id"])


def day_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flag, day, x, y, r: a daily series for each return flag."""
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.to_date("l_shipdate").alias("day"))
    days = rows.agg(F.avg("l_extendedprice").alias("x"), F.avg("l_quantity").alias("y"))
    return days.withColumn("r", (F.col("y") > 25.5).cast("int"))


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Preparation


@query(f"SELECT user_id, event_id, CAST(n AS INTEGER) AS n FROM ({EVENTS})")
def series_index(spark, sf_dir):
    return event_series(spark, sf_dir).select("user_id", "event_id", "n")


@query(f"SELECT user_id, event_id, CAST(n AS INTEGER) AS n FROM ({EVENTS}) WHERE n >= 10 AND n < 20")
def series_slice(spark, sf_dir):
    return prepare.positions(event_series(spark, sf_dir), 10, 20).select("user_id", "event_id", "n")


@query("SELECT event_id, user_id, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'")
def time_range_filter(spark, sf_dir):
    return prepare.between(read(spark, sf_dir, "events"), "ts", "2024-01-05", "2024-01-12").select("event_id", "user_id", "value")


@query("SELECT ts >= TIMESTAMP '2024-01-20' AS test, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def time_split_train_test(spark, sf_dir):
    train, test = prepare.split_at(read(spark, sf_dir, "events"), "ts", "2024-01-20")
    both = train.withColumn("test", F.lit(False)).unionByName(test.withColumn("test", F.lit(True)))
    return both.groupBy("test").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"SELECT user_id, event_id, CAST(max(n) OVER (PARTITION BY user_id) - n AS INTEGER) AS n FROM ({EVENTS})")
def reverse_series(spark, sf_dir):
    return prepare.reversed_order(event_series(spark, sf_dir), ["user_id"]).select("user_id", "event_id", "n")


_DAILY = """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, avg(value) AS value FROM events GROUP BY 1, 2),
    e AS (SELECT user_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY 1),
    f AS (SELECT e.user_id, e.day, d.value, row_number() OVER (PARTITION BY e.user_id ORDER BY e.day) AS n FROM e LEFT JOIN d ON e.user_id = d.user_id AND e.day = d.day)"""


@query(_DAILY + " SELECT user_id, CAST(day AS VARCHAR) AS day, round(value, 6) AS value FROM f")
def resample_day_mean(spark, sf_dir):
    return rounded(prepare.daily_mean(read(spark, sf_dir, "events"), ["user_id"], "ts", "value"), 6, "value").withColumn("day", F.col("day").cast("string"))


@query(_DAILY + """, g AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN n END IGNORE NULLS) OVER p AS pn, last_value(value IGNORE NULLS) OVER p AS pv,
    first_value(CASE WHEN value IS NOT NULL THEN n END IGNORE NULLS) OVER q AS qn, first_value(value IGNORE NULLS) OVER q AS qv FROM f
    WINDOW p AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT user_id, CAST(day AS VARCHAR) AS day, round(coalesce(value, CASE WHEN qv IS NULL THEN pv ELSE pv + (qv - pv) * (n - pn) / (qn - pn) END), 6) AS value FROM g""")
def resample_fill_linear(spark, sf_dir):
    days = prepare.daily_mean(read(spark, sf_dir, "events"), ["user_id"], "ts", "value")
    return rounded(prepare.interpolated(days, ["user_id"], "day", "value"), 6, "value").withColumn("day", F.col("day").cast("string"))


@query("""WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders), b AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM events)
    SELECT o_orderkey, event_id FROM a JOIN b USING (n)""")
def positional_zip(spark, sf_dir):
    return prepare.zipped(read(spark, sf_dir, "orders").select("o_orderkey"), read(spark, sf_dir, "events").select("event_id"), ["o_orderkey"], ["event_id"])


@query(f"""WITH s AS (SELECT *, isodow(ts) >= 6 AS f FROM ({EVENTS})), t AS (SELECT *, sum(CASE WHEN f AND NOT coalesce(p, false) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY n) AS g
    FROM (SELECT *, lag(f) OVER (PARTITION BY user_id ORDER BY n) AS p FROM s)) SELECT user_id, CAST(min(n) AS INTEGER) AS start, CAST(max(n) AS INTEGER) AS "end", count(*) AS size FROM t WHERE f GROUP BY user_id, g""")
def weekend_runs(spark, sf_dir):
    return prepare.runs(event_series(spark, sf_dir), ["user_id"], "n", prepare.weekend("ts"))


@query(f"SELECT user_id, event_id, round(CASE WHEN n <= 5 THEN 0.0 WHEN n < 15 THEN (n - 5) * 0.1 WHEN n < 30 THEN 1.0 WHEN n < 50 THEN 1.0 + (n - 30) * (-0.05) ELSE 0.0 END, 6) AS label FROM ({EVENTS})")
def piecewise_ramp_labels(spark, sf_dir):
    label = prepare.ramp(F.col("n"), [(5, 0.0), (15, 1.0), (30, 1.0), (50, 0.0)])
    return event_series(spark, sf_dir).select("user_id", "event_id", F.round(label, 6).alias("label"))


@query("SELECT count(DISTINCT event_type) AS kinds, min(ts) AS first, max(ts) AS last, count(value) AS n FROM events WHERE regexp_matches(event_type, 'p|e')")
def span_and_distinct(spark, sf_dir):
    rows = read(spark, sf_dir, "events").filter(F.col("event_type").rlike("p|e"))
    return rows.agg(F.countDistinct("event_type").alias("kinds"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("value").alias("n"))


# Learning and metrics


@query(f"""WITH p AS (SELECT r AS j, lead(r) OVER (PARTITION BY user_id ORDER BY n) AS k FROM ({EVENTS})), c AS (SELECT j, k, count(*) AS n FROM p WHERE k IS NOT NULL GROUP BY 1, 2)
    SELECT j, k, n, round(n / sum(n) OVER (), 8) AS p FROM c""")
def transition_counts(spark, sf_dir):
    return rounded(learn.transition_counts(event_series(spark, sf_dir), ["user_id"], "n", "r"), 8, "p")


@query(f"""WITH p AS (SELECT r AS j, lead(r) OVER (PARTITION BY user_id ORDER BY n) AS k FROM ({EVENTS})), c AS (SELECT j, k, count(*) AS n FROM p WHERE k IS NOT NULL GROUP BY 1, 2)
    SELECT j, k, round(n / sum(n) OVER (PARTITION BY j), 8) AS p_cond, round(sum(n) OVER (PARTITION BY j) / sum(n) OVER (), 8) AS p_marginal FROM c""")
def transition_matrix(spark, sf_dir):
    from pyspark.sql import Window

    counts = learn.transition_counts(event_series(spark, sf_dir), ["user_id"], "n", "r")
    row = F.sum("n").over(Window.partitionBy("j"))
    return counts.select("j", "k", F.round(F.col("n") / row, 8).alias("p_cond"), F.round(row / F.sum("n").over(Window.partitionBy()), 8).alias("p_marginal"))


@query(f"""SELECT r, count(*) AS n, round(avg(x), 4) AS mean_x, round(avg(y), 6) AS mean_y, round(var_pop(x), 2) AS var_x, round(var_pop(y), 5) AS var_y, round(covar_pop(x, y), 3) AS cov_xy
    FROM ({DAYS}) GROUP BY 1""")
def regime_moments(spark, sf_dir):
    found = learn.regime_moments(day_series(spark, sf_dir), "r", "x", "y")
    for column, digits in (("mean_x", 4), ("mean_y", 6), ("var_x", 2), ("var_y", 5), ("cov_xy", 3)):
        found = rounded(found, digits, column)
    return found


@query(f"""WITH s AS MATERIALIZED ({DAYS}), m AS (SELECT r, avg(x) AS mx, avg(y) AS my FROM s GROUP BY 1), p AS (SELECT r AS j, x, y, lead(r) OVER w AS k, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM s WINDOW w AS (PARTITION BY flag ORDER BY day))
    SELECT j, k, count(*) AS n, round(avg((x - a.mx) * (x2 - b.mx)), 1) AS xx, round(avg((x - a.mx) * (y2 - b.my)), 3) AS xy, round(avg((y - a.my) * (x2 - b.mx)), 3) AS yx, round(avg((y - a.my) * (y2 - b.my)), 5) AS yy
    FROM p JOIN m a ON a.r = p.j JOIN m b ON b.r = p.k GROUP BY 1, 2""")
def pair_moments(spark, sf_dir):
    found = learn.pair_moments(day_series(spark, sf_dir), ["flag"], "day", "r", "x", "y")
    return rounded(rounded(rounded(found, 1, "xx"), 3, "xy", "yx"), 5, "yy")


@query(f"""WITH p AS (SELECT r AS j, y, lead(r) OVER w AS k, lead(y) OVER w AS y2 FROM ({DAYS}) WINDOW w AS (PARTITION BY flag ORDER BY day))
    SELECT j, k, count(*) AS n, round(regr_slope(y2, y), 6) AS p0, round(regr_intercept(y2, y), 5) AS p1, round(regr_syy(y2, y) / count(*) * (1 - regr_r2(y2, y)), 4) AS pi2 FROM p WHERE k IS NOT NULL GROUP BY 1, 2""")
def regression_by_pair(spark, sf_dir):
    found = learn.regression_sums(day_series(spark, sf_dir), ["flag"], "day", "r", "x", "y")
    return rounded(rounded(rounded(found, 6, "p0"), 5, "p1"), 4, "pi2")


_FUZZY = f"SELECT user_id, n, y, r AS hard, least(1.0, greatest(0.0, (y - {LOW}) / ({HIGH} - {LOW}))) AS r FROM ({EVENTS})"


def fuzzy_series(spark, sf_dir):
    rows = event_series(spark, sf_dir).withColumn("hard", F.col("r"))
    return rows.withColumn("r", prepare.fuzzy_label(F.col("y"), LOW, HIGH))


@query(f"""WITH p AS (SELECT r, lead(r) OVER (PARTITION BY user_id ORDER BY n) AS s FROM ({_FUZZY})), c AS (SELECT avg(CASE WHEN r = 0 AND s = 0 THEN 1.0 ELSE 0.0 END) AS alpha0,
    avg(CASE WHEN r = 1 AND s = 1 THEN 1.0 ELSE 0.0 END) AS alpha1, avg(CASE WHEN r + s = 1 AND r IN (0, 1) THEN 1.0 ELSE 0.0 END) / 2 AS beta FROM p WHERE s IS NOT NULL)
    SELECT round(alpha0, 8) AS alpha0, round(alpha1, 8) AS alpha1, round(beta, 8) AS beta, round(greatest(0.0, 0.375 * (1 - alpha0 - alpha1 - 2 * beta)), 8) AS eta FROM c""")
def law_fit_2ter(spark, sf_dir):
    return rounded(laws.fit_2ter(fuzzy_series(spark, sf_dir), ["user_id"], "n", "r"), 8, "alpha0", "alpha1", "beta", "eta")


@query(f"SELECT user_id, round(avg(CASE WHEN r IN (0, 1) THEN 1.0 ELSE 0.0 END), 8) AS hard_share FROM ({_FUZZY}) GROUP BY 1")
def hard_share(spark, sf_dir):
    return fuzzy_series(spark, sf_dir).groupBy("user_id").agg(F.round(metrics.hard_share("r"), 8).alias("hard_share"))


@query(f"SELECT user_id, round(avg(pow(r - hard, 2)), 6) AS mse, round(avg(abs(round_even(r, 0) - hard)), 6) AS errors FROM ({_FUZZY}) GROUP BY 1")
def label_errors(spark, sf_dir):
    rows = fuzzy_series(spark, sf_dir).withColumn("near", metrics.hardened("r"))
    return rows.groupBy("user_id").agg(F.round(metrics.mse("r", "hard"), 6).alias("mse"), F.round(metrics.error_ratio("near", "hard"), 6).alias("errors"))


@query(f"""WITH t AS (SELECT *, max(n) OVER (PARTITION BY user_id) AS m FROM ({_FUZZY})) SELECT user_id, round(avg(pow(r - hard, 2)), 6) AS mse FROM t WHERE n >= 3 AND n <= m - 3 GROUP BY 1""")
def mse_trimmed(spark, sf_dir):
    return rounded(metrics.trimmed_mse(fuzzy_series(spark, sf_dir), ["user_id"], "n", "r", "hard"), 6, "mse")


@query(f"WITH e AS (SELECT user_id, avg(pow(r - hard, 2)) AS mse FROM ({_FUZZY}) GROUP BY 1) SELECT round(avg(mse), 8) AS mean, round(var_pop(mse), 8) AS variance, count(*) AS n FROM e")
def mse_over_experiments(spark, sf_dir):
    each = fuzzy_series(spark, sf_dir).groupBy("user_id").agg(metrics.mse("r", "hard").alias("mse"))
    return rounded(metrics.over_experiments(each), 8, "mean", "variance")


# Laws of fuzzy regimes


def _law_parameters(family: str) -> dict[str, str]:
    """A law's parameters as SQL, those that normalisation fixes as formulas of the given ones."""
    v = [f"{float(x)!r}::DOUBLE" for x in LAWS[family].split(":")[1:]]
    if family == "1":
        return {"alpha": v[0], "gamma": v[1], "beta": f"((1 - 5 * {v[1]}) / 2 - {v[0]})"}
    if family == "2":
        a, e, d = v
        return {"alpha": a, "eta": e, "delta": d, "beta": f"((1 - 2.5 * ({d} + {e}) + ({d} - {e}) / 6) / 2 - {a})"}
    if family == "2bis":
        a, e, d, lam = v
        return {"alpha": a, "eta": e, "delta": d, "lambda": lam, "beta": f"((1 - ({e} + ({d} - {e}) / 3) - 2 * {lam} * {e}) / 2 - {a})"}
    if family == "2ter":
        a0, a1, b = v
        return {"alpha0": a0, "alpha1": a1, "beta": b, "eta": f"greatest(0.0, 0.375 * (1 - {a0} - {a1} - 2 * {b}))"}
    if family == "3":
        a, d = v
        return {"alpha": a, "delta": d, "beta": "0.0::DOUBLE", "gamma": f"((1 - 2 * {a}) / ({d} * (6 - {d})))"}
    if family == "4":
        a, g, d = v
        g = f"least({g}, (1 - 2 * {a}) / ({d} * (6 - {d})) - 1e-10)"
        return {"alpha": a, "gamma": g, "delta": d, "beta": f"((1 - {g} * {d} * (6 - {d})) / 2 - {a})"}
    a, b, d, lam = v
    return {"alpha": a, "beta": b, "delta": d, "lambda": lam, "gamma": f"((1 - 2 * ({a} + {b})) / ({d} * (2 - {d}) + 2 * {lam} * {d}))"}


def _joint_sql(family: str) -> str:
    p = _law_parameters(family)
    gap, inner, near0 = "abs(r - s)", "(CASE WHEN r IN (0, 1) THEN s ELSE r END)", "(r = 0 OR s = 0)"
    if family in ("3", "4", "4bis"):
        inside = f"CASE WHEN {gap} <= {p['delta']} THEN {p['gamma']} ELSE 0.0 END"
        ramp = f"(CASE WHEN {near0} THEN 1 - {inner} / {p['delta']} ELSE {inner} / {p['delta']} + 1 - 1 / {p['delta']} END)"
        edge = inside if family != "4bis" else f"CASE WHEN {gap} <= {p['delta']} THEN {p['lambda']} * {p['gamma']} * {ramp} ELSE 0.0 END"
    elif family == "1":
        inside = edge = p["gamma"]
    elif family == "2ter":
        inside = edge = f"{p['eta']} * (1 - {gap})"
    else:
        inside = f"({p['eta']} + ({p['delta']} - {p['eta']}) * {gap})"
        edge = inside if family == "2" else f"{p['lambda']} * {p['eta']} * (CASE WHEN {near0} THEN 1 - {inner} ELSE {inner} END)"
    diagonal = f"CASE WHEN r = 0 THEN {p['alpha0']} ELSE {p['alpha1']} END" if family == "2ter" else p["alpha"]
    return f"CASE WHEN r IN (0, 1) AND s IN (0, 1) THEN CASE WHEN r = s THEN {diagonal} ELSE {p['beta']} END WHEN r IN (0, 1) OR s IN (0, 1) THEN {edge} ELSE {inside} END"


def _marginal_sql(family: str) -> str:
    p = _law_parameters(family)
    if family == "1":
        atom, inside = f"{p['alpha']} + {p['beta']} + {p['gamma']}", f"3 * {p['gamma']}"
    elif family == "2":
        atom, inside = f"{p['alpha']} + {p['beta']} + ({p['eta']} + {p['delta']}) / 2", f"({p['delta']} - {p['eta']}) * (r * r - r) + 1.5 * ({p['eta']} + {p['delta']})"
    elif family == "2bis":
        atom, inside = f"{p['alpha']} + {p['beta']} + {p['eta']} * {p['lambda']} / 2", f"{p['eta']} * ({p['lambda']} + 1) + ({p['delta']} - {p['eta']}) * (0.5 + r * r - r)"
    elif family == "2ter":
        atom, inside = f"CASE WHEN r = 0 THEN {p['alpha0']} ELSE {p['alpha1']} END + {p['beta']} + {p['eta']} / 2", f"{p['eta']} * (1.5 + r - r * r)"
    else:
        d, bis = p["delta"], family == "4bis"
        atom = f"{p['alpha']} + {p['beta']} + {p['gamma']} * {d}" + (f" * {p['lambda']} / 2" if bis else "")
        low, high = (f"{p['lambda']} * (1 - r / {d})", f"{p['lambda']} * (r / {d} + 1 - 1 / {d})") if bis else ("1", "1")
        inside = f"{p['gamma']} * (least(1.0, r + {d}) - greatest(0.0, r - {d}) + CASE WHEN r <= {d} THEN {low} ELSE 0 END + CASE WHEN 1 - r <= {d} THEN {high} ELSE 0 END)"
    return f"CASE WHEN r IN (0, 1) THEN {atom} ELSE {inside} END"


def _grid_sql(family: str, cells: int) -> str:
    g = f"SELECT CASE WHEN i = 0 THEN 0.0::DOUBLE WHEN i = {cells + 1} THEN 1.0 ELSE (i - 0.5) / {cells} END AS v, CASE WHEN i IN (0, {cells + 1}) THEN 1.0::DOUBLE ELSE 1.0 / {cells} END AS w FROM range({cells + 2}) t(i)"
    return f"SELECT r, s, w, {_joint_sql(family)} AS p FROM (SELECT a.v AS r, b.v AS s, a.w * b.w AS w FROM ({g}) a CROSS JOIN ({g}) b)"


def _law_query(family: str) -> None:
    def grid(spark, sf_dir):
        return rounded(laws.table(spark, laws.law(LAWS[family]), 20), 8, "r", "s", "w", "p")

    QUERIES[f"law_joint_grid_{family}"] = grid
    SQL[f"law_joint_grid_{family}"] = f"SELECT round(r, 8) AS r, round(s, 8) AS s, round(w, 8) AS w, round(p, 8) AS p FROM ({_grid_sql(family, 20)})"


for _family in LAWS:
    _law_query(_family)


@query(" UNION ALL ".join(f"SELECT '{k}' AS family, CAST(r >= 0.5 AS INTEGER) AS j, CAST(s >= 0.5 AS INTEGER) AS k, round(sum(w * p), 5) AS p FROM ({_grid_sql(k, 100)}) GROUP BY 2, 3" for k in LAWS))
def law_hard_transition(spark, sf_dir):
    out = None
    for family, text in LAWS.items():
        part = laws.hard_transition(laws.table(spark, laws.law(text), 100)).select(F.lit(family).alias("family"), "j", "k", F.round("p", 5).alias("p"))
        out = part if out is None else out.unionByName(part)
    return out


@query(" UNION ALL ".join(f"SELECT '{k}' AS family, round(sum(w * p), 3) AS total FROM ({_grid_sql(k, 200)})" for k in LAWS))
def law_sum_to_one(spark, sf_dir):
    parts = [laws.table(spark, laws.law(t), 200).agg(F.round(F.sum(F.col("w") * F.col("p")), 3).alias("total")).select(F.lit(k).alias("family"), "total") for k, t in LAWS.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _by_family(rows: Callable[[str], DataFrame]) -> DataFrame:
    out = None
    for family in LAWS:
        part = rows(family)
        out = part if out is None else out.unionByName(part)
    return out


@query(" UNION ALL ".join(f"SELECT '{k}' AS family, 1.0::DOUBLE AS joint, 1.0::DOUBLE AS marginal, 1.0::DOUBLE AS conditional" for k in LAWS))
def law_totals(spark, sf_dir):
    """Integrals of the joint law, its marginal and its conditional given 0.1, on a fine grid: all are 1."""

    def one(family):
        own = laws.law(LAWS[family])
        joint = laws.table(spark, own, 400).agg(F.sum(F.col("w") * F.col("p")).alias("joint"))
        line = laws.grid(spark, 2000).agg(F.sum(F.col("w") * laws.marginal(own, F.col("r"))).alias("marginal"), F.sum(F.col("w") * laws.conditional(own, F.lit(0.1), F.col("r"))).alias("conditional"))
        return rounded(joint.join(F.broadcast(line)), 2, "joint", "marginal", "conditional").withColumn("family", F.lit(family))

    return _by_family(one)


def _line_sql(cells: int) -> str:
    return f"SELECT CASE WHEN i = 0 THEN 0.0::DOUBLE WHEN i = {cells + 1} THEN 1.0 ELSE (i - 0.5) / {cells} END AS r, CASE WHEN i IN (0, {cells + 1}) THEN 1.0::DOUBLE ELSE 1.0 / {cells} END AS w FROM range({cells + 2}) t(i)"


@query(" UNION ALL ".join(f"SELECT '{k}' AS family, round(r, 8) AS r, round({_marginal_sql(k)}, 8) AS m FROM ({_line_sql(20)})" for k in LAWS))
def law_marginal(spark, sf_dir):
    return _by_family(lambda k: rounded(laws.grid(spark, 20).select("r", laws.marginal(laws.law(LAWS[k]), F.col("r")).alias("m")), 8, "r", "m").withColumn("family", F.lit(k)))


@query(" UNION ALL ".join(f"SELECT '{k}' AS family, round(r, 8) AS r, round(s, 8) AS s, round(p / m, 8) AS c FROM (SELECT *, {_marginal_sql(k)} AS m FROM ({_grid_sql(k, 10)}))" for k in LAWS))
def law_conditional(spark, sf_dir):
    def one(family):
        own = laws.law(LAWS[family])
        return rounded(laws.table(spark, own, 10).select("r", "s", laws.conditional(own, F.col("r"), F.col("s")).alias("c")), 8, "r", "s", "c").withColumn("family", F.lit(family))

    return _by_family(one)


@query(" UNION ALL ".join(f"SELECT '{k}' AS family, round(sum({_marginal_sql(k)}), 8) AS hard FROM (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) t(r)" for k in LAWS))
def law_hard_weight(spark, sf_dir):
    return spark.createDataFrame([(k, laws.hard_weight(laws.law(t))) for k, t in LAWS.items()], "family string, hard double").withColumn("hard", F.round("hard", 8))


@query(" UNION ALL ".join(f"SELECT '{k}' AS family, CAST(r >= 0.5 AS INTEGER) AS j, CAST(s >= 0.5 AS INTEGER) AS k, round(sum(w * p), 2) AS p FROM ({_grid_sql(k, 400)}) GROUP BY 2, 3" for k in ("2", "2ter", "3", "4")))
def law_hard_transition_closed(spark, sf_dir):
    """Closed forms; the SQL integrates the joint law over the quadrants."""
    rows = [(f, j, k, float(laws.hard_transition_closed(laws.law(LAWS[f]))[j, k])) for f in ("2", "2ter", "3", "4") for j in (0, 1) for k in (0, 1)]
    return spark.createDataFrame(rows, "family string, j int, k int, p double").withColumn("p", F.round("p", 2))


_STEPS = f"SELECT r, lead(r) OVER (PARTITION BY user_id ORDER BY n) AS s FROM ({_FUZZY})"


@query(f"""WITH p AS (SELECT avg(CASE WHEN r = s AND r IN (0, 1) THEN 1.0 ELSE 0.0 END) / 2 AS alpha, avg(CASE WHEN r + s = 1 AND r IN (0, 1) THEN 1.0 ELSE 0.0 END) / 2 AS beta,
    avg(CASE WHEN s IN (0, 1) THEN 1.0 ELSE 0.0 END) AS hard FROM ({_STEPS}) WHERE s IS NOT NULL)
    SELECT round(alpha, 8) AS alpha, round(beta, 8) AS beta, 0.1::DOUBLE AS delta, round(1.9 * (hard - 2 * (alpha + beta)) / (1 - 2 * hard + 2 * (alpha + beta)), 6) AS lambda FROM p""")
def law_fit_4bis(spark, sf_dir):
    return rounded(rounded(laws.fit_4bis(fuzzy_series(spark, sf_dir), ["user_id"], "n", "r"), 8, "alpha", "beta"), 6, "lambda")


@query(f"""WITH p AS (SELECT 0.9 * avg(CASE WHEN r IN (0, 1) THEN 1.0 ELSE 0.0 END) AS h FROM ({_FUZZY})) SELECT round((h - 0.6 * (1 - h)) / 2, 8) AS alpha, 0.0::DOUBLE AS beta, 0.0::DOUBLE AS delta, round(0.6 * (1 - h), 8) AS eta FROM p""")
def law_fit_fmc1(spark, sf_dir):
    return rounded(laws.fmc1(fuzzy_series(spark, sf_dir), "r", 0.9), 8, "alpha", "eta")


@query(f"""WITH d AS (SELECT 0.5 * greatest(0.0, max(CASE WHEN r NOT IN (0, 1) THEN s - r END)) AS delta FROM ({_STEPS}) WHERE s IS NOT NULL), a AS (SELECT 0.9 * avg(CASE WHEN r IN (0, 1) THEN 1.0 ELSE 0.0 END) / 2 AS alpha FROM ({_FUZZY}))
    SELECT round(alpha, 8) AS alpha, 0.0::DOUBLE AS beta, round((1 - 2 * alpha) / (6 * delta - delta * delta), 8) AS gamma, round(delta, 8) AS delta FROM a, d""")
def law_fit_fmc2(spark, sf_dir):
    return rounded(laws.fmc2(fuzzy_series(spark, sf_dir), ["user_id"], "n", "r", 0.9, 0.5), 8, "alpha", "gamma", "delta")


# Grids


@query(f"SELECT user_id, CAST(n AS INTEGER) AS n, i AS entry, CASE WHEN i = 0 THEN 0.0::DOUBLE WHEN i = 5 THEN 1.0 ELSE (i - 0.5) / 4 END AS value FROM (SELECT *, CAST(CASE WHEN r = 0 THEN 0 WHEN r = 1 THEN 5 ELSE floor(r * 4) + 1 END AS INTEGER) AS i FROM ({_FUZZY}))")
def grid_lookup(spark, sf_dir):
    entry = grid.index_of(F.col("r"), 4)
    return fuzzy_series(spark, sf_dir).select("user_id", "n", entry.alias("entry"), grid.value_of(entry, 4).alias("value"))


def _histograms(spark, sf_dir):
    counts = fuzzy_series(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("_n"), *(F.sum((grid.index_of(F.col("r"), 4) == i).cast("double")).alias(f"_{i}") for i in range(6)))
    return counts.select("user_id", F.array(*(F.col(f"_{i}") / F.col("_n") * (1.0 if i in (0, 5) else 4.0) for i in range(6))).alias("p"))


_HISTOGRAM = "SELECT user_id, " + ", ".join(f"sum(CASE WHEN i = {i} THEN {1.0 if i in (0, 5) else 4.0} ELSE 0.0 END) / count(*) AS d{i}" for i in range(6)) + f" FROM (SELECT user_id, CASE WHEN r = 0 THEN 0 WHEN r = 1 THEN 5 ELSE floor(r * 4) + 1 END AS i FROM ({_FUZZY})) GROUP BY 1"


@query(f"""SELECT user_id, round(d0 + d5 + (d1 + d2 + d3 + d4) / 4, 8) AS total, round((d0 * d0 + d5 * d5 + (d1 * d1 + d2 * d2 + d3 * d3 + d4 * d4) / 4), 8) AS squared,
    CASE WHEN greatest(d1, d2, d3, d4) >= greatest(d0, d5) THEN CASE greatest(d1, d2, d3, d4) WHEN d1 THEN 0.125::DOUBLE WHEN d2 THEN 0.375 WHEN d3 THEN 0.625 ELSE 0.875 END WHEN d0 >= d5 THEN 0.0 ELSE 1.0 END AS mpm,
    CAST(CASE WHEN d0 > 0.4 THEN 0 WHEN d0 + d1 / 4 > 0.4 THEN 1 WHEN d0 + (d1 + d2) / 4 > 0.4 THEN 2 WHEN d0 + (d1 + d2 + d3) / 4 > 0.4 THEN 3 WHEN d0 + (d1 + d2 + d3 + d4) / 4 > 0.4 THEN 4 ELSE 5 END AS INTEGER) AS drawn,
    round(d0 / (d0 + d5 + (d1 + d2 + d3 + d4) / 4), 8) AS first FROM ({_HISTOGRAM})""")
def grid_histograms(spark, sf_dir):
    """Integral, product with itself, most probable value, a draw and normalisation of each user's law of regimes."""
    p = F.col("p")
    return _histograms(spark, sf_dir).select(
        "user_id", F.round(grid.integral(p, 4), 8).alias("total"), F.round(grid.integral(grid.product(p, p), 4), 8).alias("squared"), grid.most_probable(p, 4).alias("mpm"),
        grid.sampled(p, F.lit(0.4 + 1e-12), 4).alias("drawn"), F.round(F.get(grid.normalised(p, 4), F.lit(0)), 8).alias("first"),
    )


@query(f"SELECT round(r, 8) AS r, round(sum(w / (CASE WHEN r IN (0, 1) THEN 1 ELSE 0.05 END) * p), 8) AS p FROM ({_grid_sql('4', 20)}) GROUP BY 1")
def grid_marginal(spark, sf_dir):
    pairs = laws.table(spark, laws.law(LAWS["4"]), 20).withColumn("w_other", F.col("w") / F.when(F.col("r").isin(0.0, 1.0), 1.0).otherwise(0.05))
    return rounded(grid.marginal(pairs, "r"), 8, "r", "p")


@query(" UNION ALL ".join(f"SELECT '{k}' AS family, round(sum(CASE WHEN r BETWEEN 0.0 AND 0.3 AND s BETWEEN 0.2 AND 1.0 THEN w * p ELSE 0 END), 8) AS p FROM ({_grid_sql(k, 20)})" for k in LAWS))
def grid_rectangle(spark, sf_dir):
    return _by_family(lambda k: rounded(grid.rectangle(laws.table(spark, laws.law(LAWS[k]), 20), (0.0, 0.3), (0.2, 1.0)), 8, "p").withColumn("family", F.lit(k)))


# More preparation


@query(f"""WITH s AS (SELECT user_id, n, y, count(*) OVER (PARTITION BY user_id) AS m FROM ({EVENTS})), t AS (SELECT user_id, m, i, i * (m - 1) / 49.0::DOUBLE AS place FROM (SELECT DISTINCT user_id, m FROM s), range(50) r(i))
    SELECT t.user_id, CAST(i AS INTEGER) AS n, round(a.y + coalesce(b.y - a.y, 0) * (place - a.n), 5) AS y FROM t JOIN s a ON a.user_id = t.user_id AND a.n = least(floor(place + 1e-9), t.m - 1) LEFT JOIN s b ON b.user_id = t.user_id AND b.n = a.n + 1""")
def stretched_series(spark, sf_dir):
    return rounded(prepare.stretched(event_series(spark, sf_dir).select("user_id", "n", "y"), ["user_id"], "n", ["y"], 50), 5, "y")


@query(f"SELECT user_id, event_id, TIMESTAMP '2013-12-12 00:00:00' + INTERVAL 1 HOUR * n AS ts, CASE WHEN n < 10 THEN 0.0::DOUBLE WHEN n < 20 THEN 0.5 ELSE 1.0 END AS label FROM ({EVENTS})")
def regular_times(spark, sf_dir):
    return event_series(spark, sf_dir).select("user_id", "event_id", prepare.regular_times(F.col("n"), "2013-12-12 00:00:00").alias("ts"), prepare.constant_runs(F.col("n"), [(10, 0.5), (20, 1.0)], 0.0).alias("label"))


@query("SELECT event_id, date_trunc('second', ts) AS ts FROM events")
def date_and_time_text(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", F.date_format("ts", "dd/MM/yyyy").alias("d"), F.date_format("ts", "HH:mm:ss").alias("t"))
    return rows.select("event_id", prepare.timestamp_of("d", "t", "dd/MM/yyyy HH:mm:ss").alias("ts"))


@query("SELECT event_type, user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1, 2")
def equality_filter(spark, sf_dir):
    return read(spark, sf_dir, "events").filter(F.col("event_type") == "purchase").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))


@query(f"SELECT CAST(n AS INTEGER) AS n, 'r' AS method, round(avg(pow(r - hard, 2)), 8) AS mse, round(var_pop(pow(r - hard, 2)), 8) AS variance FROM ({_FUZZY}) GROUP BY 1 UNION ALL SELECT CAST(n AS INTEGER), 'half', round(avg(pow(0.5 - hard, 2)), 8), round(var_pop(pow(0.5 - hard, 2)), 8) FROM ({_FUZZY}) GROUP BY 1")
def mse_by_place(spark, sf_dir):
    return rounded(metrics.mse_by_place(fuzzy_series(spark, sf_dir).withColumn("half", F.lit(0.5)), "n", "hard", ["r", "half"]), 8, "mse", "variance")


@query(f"SELECT user_id, count(*) AS n, round_even(avg(pow(r - hard, 2)), 4) AS mse_r, round_even(avg(abs(round_even(r, 0) - hard)), 4) AS label_errors FROM ({_FUZZY}) GROUP BY 1")
def error_report(spark, sf_dir):
    rows = fuzzy_series(spark, sf_dir).withColumn("near", metrics.hardened("r"))
    return metrics.report(rows, ["user_id"], "hard", ["r"], ("near", "hard"))


# Filters


def _pair_values(model) -> str:
    """(j, k, fxx, fxy, fyx, fyy, qxx, qxy, qyy, cx, cy, t) of each pair, as SQL rows."""
    f, q, c = model.regression()
    rows = [(j, k, *f[j, k].ravel(), q[j, k][0, 0], q[j, k][0, 1], q[j, k][1, 1], *c[j, k], model.transition[j, k]) for j, k in np.ndindex(model.joint.shape)]
    return "VALUES " + ", ".join("(" + ", ".join(f"{float(v)!r}::DOUBLE" if i > 1 else str(v) for i, v in enumerate(r)) + ")" for r in rows)


def _own(model) -> list[tuple[float, ...]]:
    """(mean x, mean y, gain, rest of Var X, Var Y, weight) of each regime."""
    return [(m[0], m[1], g[0, 1] / g[1, 1], g[0, 0] - g[0, 1] ** 2 / g[1, 1], g[1, 1], p) for m, g, p in zip(model.mean, model.gamma, model.marginal, strict=True)]


def _known_sql(model) -> str:
    (a, b) = _own(model)
    pick = lambda i: f"CASE WHEN r = 1 THEN {float(b[i])!r}::DOUBLE ELSE {float(a[i])!r}::DOUBLE END"  # noqa: E731  else the recursion keeps a literal's two decimals
    return f"""WITH RECURSIVE s AS MATERIALIZED ({EVENTS}), p(j, k, fxx, fxy, fyx, fyy, qxx, qxy, qyy, cx, cy, t) AS ({_pair_values(model)}),
    f AS (SELECT user_id, n, y, r, {pick(0)} + ({pick(2)}) * (y - ({pick(1)})) AS e, {pick(3)} AS v, CAST(NULL AS DOUBLE) AS ahead,
    {pick(4)} AS s, y - ({pick(1)}) AS d, CAST(NULL AS DOUBLE) AS e2, CAST(NULL AS DOUBLE) AS p2, CAST(NULL AS DOUBLE) AS a FROM s WHERE n = 0 UNION ALL
    SELECT user_id, n, y, r, (fxx - qxy / qyy * fyx) * (e + kg * d) + qxy / qyy * y + (fxy - qxy / qyy * fyy) * y0 + cx - qxy / qyy * cy, qxx - qxy * qxy / qyy + (fxx - qxy / qyy * fyx) * (fxx - qxy / qyy * fyx) * (v - kg * kg * sv), fxx * e + fxy * y0 + cx,
    sv, d, e + kg * d, v - kg * kg * sv, fxx - qxy / qyy * fyx
    FROM (SELECT s.user_id, s.n, s.y, s.r, f.e, f.v, f.y AS y0, p.*, qyy + fyx * fyx * f.v AS sv, f.v * fyx / (qyy + fyx * fyx * f.v) AS kg, s.y - (fyx * f.e + fyy * f.y + cy) AS d
    FROM f JOIN s ON s.user_id = f.user_id AND s.n = f.n + 1 JOIN p ON p.j = f.r AND p.k = s.r))"""


@query(_known_sql(example_model()) + " SELECT user_id, CAST(n AS INTEGER) AS n, round(e, 6) AS filter, round(v, 6) AS filter_var, round(ahead, 6) AS predict FROM f")
def kalman_known_jumps(spark, sf_dir):
    found = recursions.kalman(event_series(spark, sf_dir).select("user_id", "n", "y", "r"), example_model(), ["user_id"], outputs=("filter", "filter_var", "predict"))
    found = found.withColumn("predict", F.when(~F.isnan("predict"), F.col("predict")))
    return rounded(found.select("user_id", "n", "filter", "filter_var", "predict"), 6, "filter", "filter_var", "predict")


@query(_known_sql(example_model()) + " SELECT user_id, count(*) AS n, round(avg(pow(e - y, 2)), 4) AS mse FROM f GROUP BY 1")
def kalman_mse_by_user(spark, sf_dir):
    found = recursions.kalman(event_series(spark, sf_dir).select("user_id", "n", "y", "r"), example_model(), ["user_id"], outputs=("filter",))
    return found.groupBy("user_id").agg(F.count("*").alias("n"), F.round(metrics.mse("filter", "y"), 4).alias("mse"))


@query(_known_sql(example_model()) + """, l AS MATERIALIZED (SELECT user_id, max(n) AS last, sum(-0.5 * (ln(s) + d * d / s + ln(2 * pi()))) AS log_likelihood FROM f GROUP BY 1),
    b AS (SELECT f.user_id, f.n, f.e AS sm, f.v AS sv FROM f JOIN l ON f.user_id = l.user_id AND f.n = l.last UNION ALL
    SELECT p.user_id, p.n, q.e2 + q.p2 * q.a / q.v * (b.sm - q.e), q.p2 + pow(q.p2 * q.a / q.v, 2) * (b.sv - q.v) FROM b JOIN f q ON q.user_id = b.user_id AND q.n = b.n JOIN f p ON p.user_id = b.user_id AND p.n = b.n - 1)
    SELECT user_id, CAST(n AS INTEGER) AS n, round(sm, 6) AS smooth, round(sv, 6) AS smooth_var, round(log_likelihood, 5) AS log_likelihood FROM b JOIN l USING (user_id)""")
def kalman_smoother(spark, sf_dir):
    found = recursions.kalman(event_series(spark, sf_dir).select("user_id", "n", "y", "r"), example_model(), ["user_id"], outputs=("smooth", "smooth_var", "log_likelihood"))
    return rounded(rounded(found.select("user_id", "n", "smooth", "smooth_var", "log_likelihood"), 6, "smooth", "smooth_var"), 5, "log_likelihood")


def _unknown_sql(model, rows: str = EVENTS, name: str = "f") -> str:
    """A recursive table `name`: user_id, n, y, p_k, e_k and l_j_k (the step's link) for each regime, from `rows` with place n."""
    own, ks = _own(model), range(len(model.mean))
    w0 = [f"{float(o[5])!r}::DOUBLE / sqrt({float(o[4])!r}::DOUBLE) * exp(-0.5 * pow(y - {float(o[1])!r}, 2) / {float(o[4])!r}::DOUBLE)" for o in own]
    e0 = [f"{float(o[0])!r}::DOUBLE + {float(o[2])!r}::DOUBLE * (y - {float(o[1])!r}::DOUBLE)" for o in own]
    f, q, c = model.regression()
    v = lambda x: f"{float(x)!r}::DOUBLE"
    cols = []
    for j, k in np.ndindex(model.joint.shape):
        qyy, g = q[j, k][1, 1], q[j, k][0, 1] / q[j, k][1, 1]
        d = f"(s.y - {v(f[j, k][1, 1])} * {name}.y - {v(c[j, k][1])})"
        cols += [f"{v(model.transition[j, k])} / sqrt({v(qyy)}) * exp(-0.5 * {d} * {d} / {v(qyy)}) AS u_{j}_{k}", f"{v(f[j, k][0, 0])} * {name}.e_{j} + {v(g)} * {d} + {v(f[j, k][0, 1])} * {name}.y + {v(c[j, k][0])} AS h_{j}_{k}"]
    column = {k: " + ".join(f"p_{j} * u_{j}_{k}" for j in ks) for k in ks}
    total = " + ".join(f"({column[k]})" for k in ks)
    first = ", ".join([f"({w0[k]}) / ({' + '.join(w0)}) AS p_{k}" for k in ks] + [f"{e0[k]} AS e_{k}" for k in ks] + [f"CAST(NULL AS DOUBLE) AS l_{j}_{k}" for j, k in np.ndindex(model.joint.shape)])
    then = ", ".join([f"({column[k]}) / ({total})" for k in ks] + [f"({' + '.join(f'p_{j} * u_{j}_{k} * h_{j}_{k}' for j in ks)}) / ({column[k]})" for k in ks] + [f"u_{j}_{k} / ({total})" for j, k in np.ndindex(model.joint.shape)])
    before = ", ".join(f"{name}.p_{k}" for k in ks)
    return f"""{name}_s AS MATERIALIZED ({rows}), {name} AS (SELECT user_id, n, y, {first} FROM {name}_s WHERE n = 0 UNION ALL
    SELECT user_id, n, y, {then} FROM (SELECT s.user_id, s.n, s.y, {before}, {', '.join(cols)} FROM {name} JOIN {name}_s s ON s.user_id = {name}.user_id AND s.n = {name}.n + 1))"""


def _smooth_sql(model) -> str:
    """Adds a recursive table g to f: user_id, n, and g_k, the smoothed probability of each regime."""
    ks = range(len(model.mean))
    beta = ", ".join(f"{' + '.join(f'q.l_{j}_{k} * b.b_{k}' for k in ks)} AS b_{j}" for j in ks)
    total = " + ".join(f"p_{k} * b_{k}" for k in ks)
    return f""", b AS (SELECT user_id, n, {', '.join(f'1.0::DOUBLE AS b_{k}' for k in ks)} FROM (SELECT *, max(n) OVER (PARTITION BY user_id) AS last FROM f) WHERE n = last UNION ALL
    SELECT b.user_id, b.n - 1, {beta} FROM b JOIN f q ON q.user_id = b.user_id AND q.n = b.n WHERE b.n > 0),
    g AS MATERIALIZED (SELECT user_id, n, {', '.join(f'p_{k} * b_{k} / ({total}) AS g_{k}' for k in ks)} FROM f JOIN b USING (user_id, n))"""


def _mixture_sql(weight: str, regimes: int, value: str = "f.e") -> str:
    return " + ".join(f"{weight}_{k} * {value}_{k}" for k in range(regimes))


@query("WITH RECURSIVE " + _unknown_sql(OPEN) + " SELECT user_id, CAST(n AS INTEGER) AS n, round(p_1, 6) AS p1, round(p_0 * e_0 + p_1 * e_1, 5) AS filter, CASE WHEN p_1 > p_0 THEN 1 ELSE 0 END AS r_filter FROM f")
def switching_filter(spark, sf_dir):
    found = recursions.switching(event_series(spark, sf_dir).select("user_id", "n", "y"), OPEN, ["user_id"], outputs=("filter", "p_filter", "r_filter"))
    return found.select("user_id", "n", F.round(F.col("p_filter")[1], 6).alias("p1"), F.round("filter", 5).alias("filter"), "r_filter")


@query("WITH RECURSIVE " + _unknown_sql(OPEN) + _smooth_sql(OPEN) + f""" SELECT user_id, CAST(n AS INTEGER) AS n, round(g_1, 6) AS p1, round({_mixture_sql("g", 2)}, 5) AS smooth,
    CASE WHEN g_1 > g_0 THEN 1 ELSE 0 END AS r_smooth FROM f JOIN g USING (user_id, n)""")
def switching_smoother(spark, sf_dir):
    found = recursions.switching(event_series(spark, sf_dir).select("user_id", "n", "y"), OPEN, ["user_id"], outputs=("smooth", "p_smooth", "r_smooth"))
    return found.select("user_id", "n", F.round(F.col("p_smooth")[1], 6).alias("p1"), F.round("smooth", 5).alias("smooth"), "r_smooth")


def _double_sql() -> str:
    """Forward filter f and smoothed regimes g, backward filter h on the reversed series, and the estimate from each observation alone."""
    alone = [f"({float(o[0])!r} + {float(o[2])!r}::DOUBLE * (f.y - {float(o[1])!r}))" for o in _own(OPEN)]
    total = " + ".join(f"g_{k} * (f.e_{k} + h.e_{k} - {alone[k]})" for k in (0, 1))
    turned = f"SELECT user_id, y, max(n) OVER (PARTITION BY user_id) - n AS n, n AS place FROM ({EVENTS})"
    return f"""WITH RECURSIVE {_unknown_sql(OPEN)} {_smooth_sql(OPEN)}, {_unknown_sql(reversed_model(OPEN), turned, "h")}
    SELECT f.user_id, CAST(f.n AS INTEGER) AS n, f.y, round({total}, 5) AS dfb_smooth FROM f JOIN g USING (user_id, n) JOIN h_s t ON t.user_id = f.user_id AND t.place = f.n JOIN h ON h.user_id = t.user_id AND h.n = t.n"""


@query(_double_sql())
def double_filter_smoother(spark, sf_dir):
    return rounded(recursions.double_filter_smoother(event_series(spark, sf_dir).select("user_id", "n", "y"), OPEN, ["user_id"]), 5, "dfb_smooth")


@query(f"SELECT user_id, CAST(n AS INTEGER) AS n, k AS regime, round(m + g * (y - my), 6) AS e, round(v, 6) AS v FROM ({EVENTS}) CROSS JOIN (VALUES " + ", ".join(f"({k}, {float(o[0])!r}, {float(o[1])!r}, {float(o[2])!r}, {float(o[3])!r})" for k, o in enumerate(_own(OPEN))) + ") p(k, m, my, g, v)")
def single_observation_posterior(spark, sf_dir):
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("regime"), (float(o[0]) + float(o[2]) * (F.col("y") - float(o[1]))).alias("e"), F.lit(float(o[3])).alias("v")) for k, o in enumerate(_own(OPEN)))))
    return rounded(event_series(spark, sf_dir).select("user_id", "n", each.alias("o")).select("user_id", "n", "o.*"), 6, "e", "v")


def _fuzzy_query(cells: int) -> None:
    """Filter and smoother on a grid; the SQL has the same grid's regimes, and the tie order of the most probable value."""

    def run(spark, sf_dir):
        rows = event_series(spark, sf_dir).select("user_id", "n", "y")
        found = fuzzy.fuzzy(rows, OPEN, laws.law(LAWS["2ter"]), cells, ["user_id"])
        return rounded(found.select("user_id", "n", "filter", "smooth", "r_mean", "r_filter", "r_smooth"), 5, "filter", "smooth", "r_mean")

    own, r, w = fuzzy.grid_model(OPEN, laws.law(LAWS["2ter"]), cells)
    ks = range(len(r))
    value = lambda k: f"{float(r[k])!r}::DOUBLE"
    order = [*ks[1:-1], ks[0], ks[-1]]
    density = lambda p, k: f"{p}_{k} / {float(w[k])!r}::DOUBLE"
    most = lambda p: "CASE " + " ".join(f"WHEN {density(p, k)} >= greatest({', '.join(density(p, j) for j in ks)}) THEN {value(k)}" for k in order) + " END"
    QUERIES[f"fuzzy_filter_s{cells}"] = run
    SQL[f"fuzzy_filter_s{cells}"] = f"""WITH RECURSIVE {_unknown_sql(own)} {_smooth_sql(own)} SELECT user_id, CAST(n AS INTEGER) AS n, round({_mixture_sql("f.p", len(r))}, 5) AS filter,
        round({_mixture_sql("g", len(r))}, 5) AS smooth, round({" + ".join(f"g_{k} * {value(k)}" for k in ks)}, 5) AS r_mean, {most("f.p")} AS r_filter, {most("g")} AS r_smooth FROM f JOIN g USING (user_id, n)"""


for _cells in (0, 1, 3):
    _fuzzy_query(_cells)


@query()
def simulate_hard(spark, sf_dir):
    return simulate.simulate(spark, example_model(), 20, 100, seed=3)


@query()
def simulate_fuzzy(spark, sf_dir):
    return simulate.simulate_fuzzy(spark, OPEN, laws.law(LAWS["4"]), 4, 20, 100, seed=3)


#: A regression of each pair of regimes at the scale of the daily series.
PAIRS = sem.PairRegression(
    np.array([[[0.3, 40.0, 900.0, 2000.0], [0.2, 30.0, 1000.0, 1500.0]], [[0.1, 50.0, 950.0, 1000.0], [0.25, 20.0, 1050.0, 500.0]]]), np.full((2, 2), 4.0e7),
    np.array([[[0.2, 19.0], [0.1, 25.0]], [[0.15, 20.0], [0.3, 19.0]]]), np.full((2, 2), 9.0), np.array([[0.3, 0.2], [0.2, 0.3]]), np.array([[36000.0, 24.0], [38000.0, 27.0]]), np.array([np.diag([4.0e7, 9.0])] * 2),
)


def _likelihood_sql() -> str:
    out = []
    for j, k in np.ndindex(2, 2):
        m, p, v, w = PAIRS.m[j, k], PAIRS.p[j, k], float(PAIRS.lambda2[j, k]), float(PAIRS.pi2[j, k])
        dx, dy = f"(x2 - ({m[0]} * x + {m[1]} * y + {m[2]} * y2 + {m[3]}))", f"(y2 - ({p[0]} * y + {p[1]}))"
        out.append(f"round(-0.5 * ({dx} * {dx} / {v!r}::DOUBLE + {dy} * {dy} / {w!r}::DOUBLE + ln(4 * pi() * pi() * {v * w!r}::DOUBLE)), 6) AS l_{j}_{k}")
    return f"SELECT flag, CAST(day AS VARCHAR) AS day, {', '.join(out)} FROM (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM ({DAYS}) WINDOW w AS (PARTITION BY flag ORDER BY day)) WHERE x2 IS NOT NULL"


@query(_likelihood_sql())
def pair_log_likelihood(spark, sf_dir):
    found = sem.pair_likelihood(day_series(spark, sf_dir), ["flag"], "day", "x", "y", PAIRS)
    return found.select("flag", F.col("day").cast("string").alias("day"), *(F.round(F.log(f"l_{j}_{k}"), 6).alias(f"l_{j}_{k}") for j, k in np.ndindex(2, 2)))


@query(f"""SELECT j, k, round(sum(1.0), 3) AS one_one, round(sum(x), 3) AS x_one, round(sum(y * y2), 4) AS y_y_next, round(sum(x * x2), -2) AS x_x_next, round(sum(y2 * x2), 1) AS y_next_x_next
    FROM (SELECT r AS j, lead(r) OVER w AS k, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM ({DAYS}) WINDOW w AS (PARTITION BY flag ORDER BY day)) WHERE k IS NOT NULL GROUP BY 1, 2""")
def weighted_sums_of_labels(spark, sf_dir):
    found = sem.weighted_sums(day_series(spark, sf_dir), ["flag"], "day", "x", "y", 2, "r")
    return found.select("j", "k", F.round("one_one", 3).alias("one_one"), F.round("x_one", 3).alias("x_one"), F.round("y_y_next", 4).alias("y_y_next"), F.round("x_x_next", -2).alias("x_x_next"), F.round("y_next_x_next", 1).alias("y_next_x_next"))


@query()
def regime_posterior(spark, sf_dir):
    """Forward, backward, pair posterior and a drawn chain with x and y known; tests hold it against all paths."""
    found = sem.posterior(day_series(spark, sf_dir).drop("r"), ["flag"], "day", "x", "y", PAIRS, seed=5)
    return found.select("flag", F.col("day").cast("string").alias("day"), F.round(F.get("gamma", F.lit(1)), 6).alias("gamma1"), F.round(F.get("psi", F.lit(3)), 6).alias("psi11"), "r")


@query()
def stochastic_learning(spark, sf_dir):
    """Parameters of each round of learning without labels."""
    _, _, trace = sem.learn(day_series(spark, sf_dir).drop("r"), ["flag"], "day", "x", "y", 2, 3)
    rows = [(t["round"], j, k, float(t["joint"][j, k]), *map(float, t["m"][j, k]), float(t["lambda2"][j, k]), *map(float, t["p"][j, k]), float(t["pi2"][j, k])) for t in trace for j, k in np.ndindex(2, 2)]
    return spark.createDataFrame(rows, "round int, j int, k int, joint double, m0 double, m1 double, m2 double, m3 double, lambda2 double, p0 double, p1 double, pi2 double")


@query()
def whitened_kmeans(spark, sf_dir):
    return sem.whitened_kmeans(day_series(spark, sf_dir), ["x", "y"], "y", 2).select("flag", "day", "label")


def _transitions_sql() -> str:
    each = " UNION ALL ".join(
        f"""SELECT user_id, n, {j} AS j, {k} AS k, q_{j} * {float(OPEN.transition[j, k])!r}::DOUBLE AS p, q_{j} * l_{j}_{k} / p_{k} AS b, l_{j}_{k} * b_{k} / ({' + '.join(f'l_{j}_{i} * b_{i}' for i in (0, 1))}) AS f,
        q_{j} * l_{j}_{k} * b_{k} / ({' + '.join(f'q_{i} * l_{i}_{h} * b_{h}' for i in (0, 1) for h in (0, 1))}) AS s FROM t WHERE n > 0""" for j, k in np.ndindex(2, 2)
    )
    return f"""WITH RECURSIVE {_unknown_sql(OPEN)} {_smooth_sql(OPEN)}, t AS (SELECT f.*, b_0, b_1, lag(p_0) OVER w AS q_0, lag(p_1) OVER w AS q_1 FROM f JOIN b USING (user_id, n) WINDOW w AS (PARTITION BY f.user_id ORDER BY f.n))
    SELECT user_id, CAST(n AS INTEGER) AS n, j, k, round(p, 6) AS predict, round(b, 6) AS back, round(f, 6) AS forward, round(s, 6) AS smooth FROM ({each})"""


@query(_transitions_sql())
def regime_transitions(spark, sf_dir):
    """Laws of each step: predicted, given the regime after, given the one before, and given all."""
    found = recursions.regime_transitions(event_series(spark, sf_dir).select("user_id", "n", "y"), OPEN, ["user_id"])
    names = {"t_predict": "predict", "t_back": "back", "t_forward": "forward", "t_smooth": "smooth"}
    each = F.posexplode(F.arrays_zip(*(F.col(c).alias(n) for c, n in names.items()))).alias("_at", "_law")
    rows = found.filter("t_smooth IS NOT NULL").select("user_id", "n", each)
    return rows.select("user_id", "n", F.expr("int(_at div 2)").alias("j"), F.expr("int(_at % 2)").alias("k"), *(F.round(f"_law.{n}", 6).alias(n) for n in names.values()))


def _bounds_sql() -> str:
    own, w = example_model(), example_model().marginal
    d = lambda x: f"{float(x)!r}::DOUBLE"
    known = " + ".join(f"{d(w[k])} * ({d(g[0, 0])} - {d(g[0, 1])} * {d(g[0, 1])} / {d(g[1, 1])})" for k, g in enumerate(own.gamma))
    second = " + ".join(f"{d(w[k])} * ({d(g[0, 0])} + {d(own.mean[k][0])} * {d(own.mean[k][0])})" for k, g in enumerate(own.gamma))
    p = [f"{d(w[k])} / sqrt(2 * pi() * {d(g[1, 1])}) * exp(-0.5 * pow(y - {d(own.mean[k][1])}, 2) / {d(g[1, 1])})" for k, g in enumerate(own.gamma)]
    e = [f"({d(own.mean[k][0])} + {d(g[0, 1])} / {d(g[1, 1])} * (y - {d(own.mean[k][1])}))" for k, g in enumerate(own.gamma)]
    return f"""SELECT round({known}, 6) AS known, round({second} - sum(step * CASE WHEN q > 0 THEN h * h / q ELSE 0 END), 5) AS unknown FROM (SELECT step, {p[0]} + {p[1]} AS q, {p[0]} * {e[0]} + {p[1]} * {e[1]} AS h
    FROM (SELECT -250 + i * 0.03::DOUBLE AS y, CASE WHEN i IN (0, 20000) THEN 0.015 ELSE 0.03 END AS step FROM range(20001) t(i)))"""


@query(_bounds_sql())
def blind_bounds(spark, sf_dir):
    return rounded(rounded(bounds.blind_bounds(spark, example_model(), -250.0, 350.0), 6, "known"), 5, "unknown")


@query(_known_sql(example_model()) + """, l AS MATERIALIZED (SELECT user_id, max(n) AS last FROM f GROUP BY 1),
    b AS (SELECT f.user_id, f.n, f.v AS sv FROM f JOIN l ON f.user_id = l.user_id AND f.n = l.last UNION ALL
    SELECT p.user_id, p.n, q.p2 + pow(q.p2 * q.a / q.v, 2) * (b.sv - q.v) FROM b JOIN f q ON q.user_id = b.user_id AND q.n = b.n JOIN f p ON p.user_id = b.user_id AND p.n = b.n - 1)
    SELECT CAST(n AS INTEGER) AS n, 'filter_var' AS method, round(avg(v), 6) AS mean FROM f GROUP BY 1 UNION ALL SELECT CAST(n AS INTEGER), 'smooth_var', round(avg(sv), 6) FROM b GROUP BY 1""")
def mean_state_variances(spark, sf_dir):
    found = recursions.kalman(event_series(spark, sf_dir).select("user_id", "n", "y", "r"), example_model(), ["user_id"], outputs=("filter_var", "smooth_var"))
    return rounded(metrics.mean_covariances(found, "n", ["filter_var", "smooth_var"]), 6, "mean")


@query()
def experiments(spark, sf_dir):
    return simulate.experiments(spark, OPEN, 50, 100, seed=3)


@query()
def simulated_quadrants(spark, sf_dir):
    return simulate.quadrant_shares(simulate.simulate_fuzzy(spark, OPEN, laws.law(LAWS["4"]), 10, 50, 200, seed=4))


@query()
def admissible_models(spark, sf_dir):
    own = example_model()
    return simulate.random_models(spark, own.gamma, own.joint, 500, seed=2, span=0.6)


@query()
def kmeans_labels(spark, sf_dir):
    return learn.kmeans_labels(day_series(spark, sf_dir), ["x", "y"], "y", 2).select("flag", "day", "label")


@query()
def iterated_fit(spark, sf_dir):
    model, _ = learn.iterate_fit(day_series(spark, sf_dir).drop("r"), ["flag"], "day", "x", "y", 2, 2)
    rows = [(k, *map(float, model.mean[k]), *map(float, model.gamma[k].ravel()), float(model.marginal[k])) for k in range(2)]
    return spark.createDataFrame(rows, "regime int, mean_x double, mean_y double, var_x double, cov_xy double, cov_yx double, var_y double, weight double")


# Model algebra on literal parameters


def _model_rows(spark: SparkSession, model) -> DataFrame:
    rows = [(j, k, *map(float, model.gamma[j].ravel()), *map(float, model.sigma[j, k].ravel()), *map(float, model.gamma[k].ravel())) for j, k in np.ndindex(model.joint.shape)]
    return spark.createDataFrame(rows, "j int, k int, gxx double, gxy double, gyx double, gyy double, sxx double, sxy double, syx double, syy double, hxx double, hxy double, hyx double, hyy double")


def _model_sql(model) -> str:
    rows = [(j, k, *model.gamma[j].ravel(), *model.sigma[j, k].ravel(), *model.gamma[k].ravel()) for j, k in np.ndindex(model.joint.shape)]
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(repr(float(v)) if i > 1 else str(v) for i, v in enumerate(r)) + ")" for r in rows) + ") m(j, k, gxx, gxy, gyx, gyy, sxx, sxy, syx, syy, hxx, hxy, hyx, hyy)"


_FQ = "round((sxx * gyy - syx * gxy) / det, 8) AS fxx, round((syx * gxx - sxx * gxy) / det, 8) AS fxy, round((sxy * gyy - syy * gxy) / det, 8) AS fyx, round((syy * gxx - sxy * gxy) / det, 8) AS fyy"


@query(f"SELECT j, k, {_FQ} FROM (SELECT *, gxx * gyy - gxy * gyx AS det FROM ({_model_sql(example_model())}))")
def cov_to_fq(spark, sf_dir):
    f = example_model().regression()[0]
    rows = [(j, k, *map(float, f[j, k].ravel())) for j, k in np.ndindex(2, 2)]
    return rounded(spark.createDataFrame(rows, "j int, k int, fxx double, fxy double, fyx double, fyy double"), 8, "fxx", "fxy", "fyx", "fyy")


@query(f"""SELECT j, round((gxx + d) / t, 8) AS xx, round(gxy / t, 8) AS xy, round((gyy + d) / t, 8) AS yy FROM (SELECT *, sqrt(det) AS d, sqrt(gxx + gyy + 2 * sqrt(det)) AS t FROM (SELECT *, gxx * gyy - gxy * gyx AS det FROM ({_model_sql(example_model())}) WHERE j = k))""")
def matrix_square_root(spark, sf_dir):
    """Roots of each regime's covariance; the SQL has the closed form of 2 x 2 matrices."""
    rows = [(j, *map(float, square_root(g)[[0, 0, 1], [0, 1, 1]])) for j, g in enumerate(example_model().gamma)]
    return rounded(spark.createDataFrame(rows, "j int, xx double, xy double, yy double"), 8, "xx", "xy", "yy")


@query(f"SELECT j, round(gxx, 6) AS gxx, round(gxy, 6) AS gxy, round(gyy, 6) AS gyy, round(sxx, 6) AS sxx, round(sxy, 6) AS sxy, round(syx, 6) AS syx, round(syy, 6) AS syy FROM ({_model_sql(example_model())}) WHERE j = k")
def fq_round_trip(spark, sf_dir):
    """Covariances from F and Q from covariances: the SQL has those given."""
    own, rows = example_model(), []
    f, q, _ = own.regression()
    for j in (0, 1):
        gamma, sigma = fq_to_cov(f[j, j], q[j, j])
        rows.append((j, *map(float, gamma[[0, 0, 1], [0, 1, 1]]), *map(float, sigma.ravel())))
    names = ["gxx", "gxy", "gyy", "sxx", "sxy", "syx", "syy"]
    return rounded(spark.createDataFrame(rows, "j int, " + ", ".join(f"{n} double" for n in names)), 6, *names)


@query(f"""SELECT j, k, round(sxx, 6) AS sxx, round(sxx * hxy / hxx, 6) AS sxy, round(sxx * gxy / gxx, 6) AS syx, round(sxx * gxy / gxx * hxy / hxx, 6) AS syy FROM ({_model_sql(example_model())})""")
def linear_state_space_model(spark, sf_dir):
    return rounded(_model_rows(spark, linear_state_space(example_model())).select("j", "k", "sxx", "sxy", "syx", "syy"), 6, "sxx", "sxy", "syx", "syy")


@query("""SELECT j, k, round(m0, 8) AS fxx, round(m1 + p0 * m2, 8) AS fxy, round(0.0::DOUBLE, 8) AS fyx, round(p0, 8) AS fyy, round(l + m2 * m2 * q, 6) AS qxx, round(m2 * q, 6) AS qxy, round(q, 6) AS qyy,
    round((m3 + p1 / (1 - p0) * (m1 + m2)) / (1 - m0), 6) AS mean_x, round(p1 / (1 - p0), 6) AS mean_y FROM (VALUES """ + ", ".join(
    "(" + ", ".join([str(j), str(k), *(f"{float(v)!r}::DOUBLE" for v in (*PAIRS.m[j, k], PAIRS.lambda2[j, k], *PAIRS.p[j, k], PAIRS.pi2[j, k]))]) + ")" for j, k in np.ndindex(2, 2)) + ") t(j, k, m0, m1, m2, m3, l, p0, p1, q)")
def regression_to_fq(spark, sf_dir):
    rows = []
    for j, k in np.ndindex(2, 2):
        f, q, mean = from_regression(PAIRS.m[j, k], PAIRS.lambda2[j, k], PAIRS.p[j, k], PAIRS.pi2[j, k])
        rows.append((j, k, *map(float, f.ravel()), *map(float, q[[0, 0, 1], [0, 1, 1]]), *map(float, mean)))
    names = ["fxx", "fxy", "fyx", "fyy", "qxx", "qxy", "qyy", "mean_x", "mean_y"]
    found = spark.createDataFrame(rows, "j int, k int, " + ", ".join(f"{n} double" for n in names))
    return rounded(rounded(found, 8, *names[:4]), 6, *names[4:])


@query("SELECT k, round(CASE k WHEN 0 THEN b ELSE a END / (a + b), 8) AS p FROM (VALUES (0), (1)) t(k), (SELECT 0.1::DOUBLE / 0.65 AS a, 0.1::DOUBLE / 0.35 AS b)")
def steady_state_law(spark, sf_dir):
    found = steady_state(example_model().transition)
    return spark.createDataFrame([(k, float(found[k])) for k in (0, 1)], "k int, p double").withColumn("p", F.round("p", 8))


@query(f"SELECT j, k, round(sxx, 8) AS sxx, round(gxy / gyy * syy, 8) AS sxy, round(syx, 8) AS syx, round(syy, 8) AS syy FROM ({_model_sql(example_model())})")
def nearest_open_loop_model(spark, sf_dir):
    return rounded(_model_rows(spark, nearest_open_loop(example_model())).select("j", "k", "sxx", "sxy", "syx", "syy"), 8, "sxx", "sxy", "syx", "syy")


@query(f"SELECT k AS j, j AS k, round(sxx, 8) AS sxx, round(syx, 8) AS sxy, round(sxy, 8) AS syx, round(syy, 8) AS syy FROM ({_model_sql(example_model())})")
def reverse_model(spark, sf_dir):
    return rounded(_model_rows(spark, reversed_model(example_model())).select("j", "k", "sxx", "sxy", "syx", "syy"), 8, "sxx", "sxy", "syx", "syy")


def _open_sql(name: str, model) -> str:
    feedback = "(sxy * gyy - syy * gxy) / (gxx * gyy - gxy * gyx)"
    residual = "sxy - gxy / gyy * syy"
    return f"SELECT '{name}' AS model, max(abs({feedback})) <= 1e-8 AS from_f, max(abs({residual})) <= 1e-8 AS from_cov FROM ({_model_sql(model)})"


@query(_open_sql("given", example_model()) + " UNION ALL " + _open_sql("nearest", OPEN))
def open_loop_check(spark, sf_dir):
    rows = [(name, is_open_loop(m), is_open_loop_from_cov(m)) for name, m in (("given", example_model()), ("nearest", OPEN))]
    return spark.createDataFrame(rows, "model string, from_f boolean, from_cov boolean")
