"""Queries of filters, smoothers and forecasts whose SQL starts from the covariances: regressions, grids and laws are computed in SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import laws, tables
from ..functions.model import example_model, nearest_open_loop
from ..operators import dense, fuzzy, learn, recursions, scan, sem
from .catalogue import _FUZZY, DAYS, EVENTS, LAWS, OPEN, PAIRS, QUERIES, SQL, day_series, event_series, fuzzy_series, query, read, rounded

#: Few series that grow with the table, each of many rows; the regime of an event is its user's parity.
TYPED = "SELECT event_type AS user_id, ts, event_id, value AS y, CAST(user_id % 2 AS DOUBLE) AS r, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS n FROM events"
LAW = LAWS["2ter"]


def typed_series(spark, sf_dir) -> DataFrame:
    """event_type, at, event_id, y, r: a series for each type of event, by time."""
    rows = read(spark, sf_dir, "events")
    return rows.select("event_type", F.struct("ts", "event_id").alias("at"), "event_id", F.col("value").alias("y"), (F.col("user_id") % 2).cast("double").alias("r"))


def share(df: DataFrame) -> int:
    """Rows of a chunk, so that also a small table is cut; never more than scan.CHUNK."""
    return min(scan.CHUNK, max(500, df.count() // 16))


def d(x) -> str:
    return f"{float(x)!r}::DOUBLE"


def mixed(values, w: str) -> str:
    return f"((1 - {w}) * {d(values[0])} + {w} * {d(values[1])})"


def regression_sql(rows: str, a: str, b: str, open_loop: bool) -> str:
    """Adds to rows the own law of regime b and F, Q, constant of the step a -> b, from the given covariances of the two corners."""
    model = example_model()
    g, m, s = model.gamma, model.mean, model.sigma
    corner = lambda i, k: [[(g[j][0, 1] / g[j][1, 1] * s[j, h][1, 1] if open_loop and (i, k) == (0, 1) else s[j, h][i, k]) for h in (0, 1)] for j in (0, 1)]
    lerp = lambda v: f"((1 - {a}) * {mixed(v[0], b)} + {a} * {mixed(v[1], b)})"
    own = lambda w, tail: ", ".join(f"{mixed([x[0], x[1]], w)} AS {n}{tail}" for n, x in (("mx", m[:, 0]), ("my", m[:, 1]), ("gxx", g[:, 0, 0]), ("gxy", g[:, 0, 1]), ("gyy", g[:, 1, 1])))
    sig = ", ".join(f"{lerp(corner(i, k))} AS s{i}{k}" for i in (0, 1) for k in (0, 1))
    return f"""SELECT *, n_gxx - (fxx * s00 + fxy * s10) AS qxx, n_gxy - (fxx * s01 + fxy * s11) AS qxy, n_gyy - (fyx * s01 + fyy * s11) AS qyy, n_mx - fxx * mx - fxy * my AS cx, n_my - fyx * mx - fyy * my AS cy FROM (
        SELECT *, (s00 * gyy - s10 * gxy) / det AS fxx, (s10 * gxx - s00 * gxy) / det AS fxy, (s01 * gyy - s11 * gxy) / det AS fyx, (s11 * gxx - s01 * gxy) / det AS fyy FROM (
        SELECT *, gxx * gyy - gxy * gxy AS det FROM (SELECT *, {own(a, '')}, {', '.join(x.replace(' AS ', ' AS n_') for x in own(b, '').split(', '))}, {sig} FROM ({rows}))))"""


def known_sql(rows: str) -> str:
    """Recursive tables f (filter e, v) and b (smoother sm, sv) for known regimes r of rows, whole or not."""
    steps = regression_sql(f"SELECT *, coalesce(lag(r) OVER (PARTITION BY user_id ORDER BY n), r) AS r0 FROM ({rows})", "r0", "r", False)
    return f"""WITH RECURSIVE s AS MATERIALIZED (SELECT user_id, event_id, n, y, n_mx, n_my, n_gxx, n_gxy, n_gyy, fxx, fxy, fyx, fyy, qxx, qxy, qyy, cx, cy, fxx - qxy / qyy * fyx AS a FROM ({steps})),
    f AS (SELECT user_id, event_id, n, y, n_mx + n_gxy / n_gyy * (y - n_my) AS e, n_gxx - n_gxy * n_gxy / n_gyy AS v, n_mx AS ahead, n_gyy AS sy, y - n_my AS dy, 0::DOUBLE AS e2, 0::DOUBLE AS p2, 0::DOUBLE AS a FROM s WHERE n = 0 UNION ALL
    SELECT user_id, event_id, n, y, a * (e + kg * dy) + qxy / qyy * (y - fyy * y0 - cy) + fxy * y0 + cx, qxx - qxy * qxy / qyy + a * a * (v - kg * kg * sy), fxx * e + fxy * y0 + cx, sy, dy, e + kg * dy, v - kg * kg * sy, a
    FROM (SELECT s.*, f.e, f.v, f.y AS y0, qyy + fyx * fyx * f.v AS sy, f.v * fyx / (qyy + fyx * fyx * f.v) AS kg, s.y - (fyx * f.e + fyy * f.y + cy) AS dy FROM f JOIN s ON s.user_id = f.user_id AND s.n = f.n + 1)),
    l AS MATERIALIZED (SELECT user_id, max(n) AS last, sum(-0.5 * (ln(sy) + dy * dy / sy + ln(2 * pi()))) AS log_likelihood FROM f GROUP BY 1), fm AS MATERIALIZED (SELECT * FROM f),
    b AS (SELECT f.user_id, f.n, f.e AS sm, f.v AS sv FROM fm f JOIN l ON f.user_id = l.user_id AND f.n = l.last UNION ALL
    SELECT q.user_id, q.n - 1, q.e2 + q.p2 * q.a / q.v * (b.sm - q.e), q.p2 + pow(q.p2 * q.a / q.v, 2) * (b.sv - q.v) FROM b JOIN fm q ON q.user_id = b.user_id AND q.n = b.n WHERE b.n > 0)"""


@query(known_sql(f"SELECT user_id, n AS event_id, n, y, r FROM ({_FUZZY})") + " SELECT user_id, CAST(f.n AS INTEGER) AS n, round(e, 6) AS filter, round(sm, 6) AS smooth FROM fm f JOIN b USING (user_id, n)")
def kalman_fuzzy_jumps(spark, sf_dir):
    rows = fuzzy_series(spark, sf_dir).select("user_id", "n", "y", "r")
    return rounded(recursions.kalman(rows, example_model(), ["user_id"], outputs=("filter", "smooth")).select("user_id", "n", "filter", "smooth"), 6, "filter", "smooth")


@query(known_sql(TYPED) + """ SELECT user_id AS event_type, event_id, round(e, 6) AS filter, round(v, 6) AS filter_var, round(sm, 6) AS smooth, round(sv, 6) AS smooth_var, round(log_likelihood, 4) AS log_likelihood
    FROM fm f JOIN b USING (user_id, n) JOIN l USING (user_id)""")
def kalman_chunks(spark, sf_dir):
    """Filter and smoother of long series that are cut into chunks over tasks."""
    rows = typed_series(spark, sf_dir)
    out = ("filter", "filter_var", "smooth", "smooth_var", "log_likelihood")
    found = recursions.kalman(rows, example_model(), ["event_type"], "at", outputs=out, long=0, chunk=share(rows))
    return rounded(rounded(found.select("event_type", "event_id", *out), 6, *out[:4]), 4, "log_likelihood")


def grid_sql(cells: int, nodes: int, corners: bool = False) -> str:
    """CTEs: pts (i, r, w), and m: one row with lists over points (marg, mx, my, gxy, gyy) and pairs (t and the regression), for the 2ter law (or the given joint law of two regimes)."""
    model, (a0, a1, beta) = example_model(), map(float, LAW.split(":")[1:])
    inner = {0: "", 1: f" UNION ALL SELECT c + 1, (c + 0.5::DOUBLE) / {cells}, 1.0::DOUBLE / {cells} FROM range({cells}) t(c)", 2: f" UNION ALL SELECT 2 * c + 1 + q, (c + 0.5::DOUBLE + (q - 0.5) / sqrt(3.0::DOUBLE)) / {cells}, 0.5::DOUBLE / {cells} FROM range({cells}) t(c), range(2) u(q)"}[nodes if cells else 0]
    eta = f"(3.0::DOUBLE / 8 * (1 - {d(a0)} - {d(a1)} - 2 * {d(beta)}))"
    density = f"CASE WHEN r0 IN (0, 1) AND r IN (0, 1) THEN CASE WHEN r0 <> r THEN {d(beta)} WHEN r = 0 THEN {d(a0)} ELSE {d(a1)} END ELSE {eta} * (1 - abs(r0 - r)) END"
    if corners:
        density = f"CASE WHEN r0 = 0 THEN {mixed(model.joint[0], 'r')} ELSE {mixed(model.joint[1], 'r')} END"
    both = f"SELECT a.i AS i, b.i AS k, a.r AS r0, b.r AS r, a.w AS w0, b.w AS w FROM pts a, pts b"
    names = ("t", "fxx", "fxy", "fyx", "fyy", "qyy", "g", "cx", "cy")
    return f"""pts AS (SELECT 0 AS i, 0.0::DOUBLE AS r, 1.0::DOUBLE AS w{inner} UNION ALL SELECT {cells * nodes + 1}, 1.0::DOUBLE, 1.0::DOUBLE),
    pairs AS (SELECT *, {density} * w0 * w AS j FROM ({regression_sql(both, 'r0', 'r', True)})),
    weighed AS (SELECT *, qxy / qyy AS g, j / sum(j) OVER () AS joint, j / sum(j) OVER (PARTITION BY i) AS t FROM pairs),
    m AS MATERIALIZED (SELECT * FROM (SELECT {', '.join(f'list({n} ORDER BY i, k) AS {n}' for n in names)} FROM weighed),
        (SELECT {', '.join(f'list({n} ORDER BY i) AS {n}0' for n in ('marg', 'mx', 'my', 'gxy', 'gyy'))} FROM (SELECT i, sum(joint) AS marg, any_value(mx) AS mx, any_value(my) AS my, any_value(gxy) AS gxy, any_value(gyy) AS gyy FROM weighed GROUP BY 1)),
        (SELECT list(r ORDER BY i) AS r FROM pts))"""


def lists_sql(rows: str, k: int) -> str:
    """Recursive tables f (p, e, u: lists) and b (beta) of the filter over the points of m."""
    each, pair = f"range(1, {k} + 1)", f"range(1, {k * k} + 1)"
    column = lambda x: f"list_transform({each}, lambda h: list_sum(list_transform({each}, lambda j: {x.format(i=f'((j - 1) * {k} + h)')})))"
    return f"""s AS MATERIALIZED ({rows}),
    f AS (SELECT user_id, n, y, list_transform(w, lambda x: x / list_sum(w)) AS p, list_transform({each}, lambda h: mx0[h] + gxy0[h] / gyy0[h] * (y - my0[h])) AS e, CAST(NULL AS DOUBLE[]) AS u FROM
        (SELECT *, list_transform({each}, lambda h: marg0[h] / sqrt(gyy0[h]) * exp(-0.5 * pow(y - my0[h], 2) / gyy0[h])) AS w FROM s, m WHERE n = 0) UNION ALL
    SELECT user_id, n, y, list_transform(col, lambda x: x / list_sum(col)), list_transform({each}, lambda h: mom[h] / col[h]), list_transform(u, lambda x: x / list_sum(col)) FROM (
        SELECT *, {column('fl[{i}]')} AS col, {column('fl[{i}] * (fxx[{i}] * e[j] + g[{i}] * dy[{i}] + fxy[{i}] * y0 + cx[{i}])')} AS mom FROM (
        SELECT *, list_transform({pair}, lambda i: p[(i - 1) // {k} + 1] * u[i]) AS fl FROM (
        SELECT *, list_transform({pair}, lambda i: t[i] / sqrt(qyy[i]) * exp(-0.5 * dy[i] * dy[i] / qyy[i])) AS u FROM (
        SELECT s.user_id, s.n, s.y, f.y AS y0, f.p, f.e, m.*, list_transform({pair}, lambda i: s.y - fyy[i] * f.y - cy[i]) AS dy FROM f JOIN s ON s.user_id = f.user_id AND s.n = f.n + 1, m))))),
    fm AS MATERIALIZED (SELECT * FROM f), last AS (SELECT user_id, max(n) AS n FROM fm GROUP BY 1),
    b AS (SELECT user_id, n, list_transform({each}, lambda h: 1.0::DOUBLE) AS beta FROM last UNION ALL
    SELECT q.user_id, q.n - 1, list_transform({each}, lambda j: list_sum(list_transform({each}, lambda h: q.u[(j - 1) * {k} + h] * b.beta[h]))) FROM b JOIN fm q ON q.user_id = b.user_id AND q.n = b.n WHERE b.n > 0),
    smoothed AS MATERIALIZED (SELECT user_id, n, y, p, e, list_transform(w, lambda x: x / list_sum(w)) AS ps FROM (SELECT fm.*, list_transform({each}, lambda h: fm.p[h] * b.beta[h]) AS w FROM fm JOIN b USING (user_id, n)))"""


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda h: {a}[h] * {b}[h]))"


def _grids(cells: int, nodes: int, name: str) -> None:
    """Fuzzy filter and smoother with grid, law, regression and quadrature written out in SQL."""
    k = cells * nodes + 2

    def run(spark, sf_dir):
        rows = event_series(spark, sf_dir).select("user_id", "n", "y")
        found = fuzzy.fuzzy(rows, OPEN, laws.law(LAW), cells, ["user_id"], nodes=nodes)
        fuzzy_mass = 1 - F.col("p_filter")[0] - F.element_at("p_filter", -1)
        return rounded(found.select("user_id", "n", "filter", "smooth", "r_mean", fuzzy_mass.alias("inside")), 5, "filter", "smooth", "r_mean", "inside")

    QUERIES[name] = run
    SQL[name] = f"""WITH RECURSIVE {grid_sql(cells, nodes)}, {lists_sql(EVENTS, k)} SELECT user_id, CAST(n AS INTEGER) AS n, round({dot('p', 'e')}, 5) AS filter, round({dot('ps', 'e')}, 5) AS smooth,
        round({dot('ps', 'm.r')}, 5) AS r_mean, round(1 - p[1] - p[{k}], 5) AS inside FROM smoothed, m"""


_grids(3, 2, "fuzzy_quadrature")
_grids(2, 1, "fuzzy_centres")


@query(f"""WITH RECURSIVE {grid_sql(0, 1, True)}, {lists_sql(TYPED, 2)} SELECT user_id AS event_type, event_id, round(p[2], 6) AS p_filter, round({dot('p', 'e')}, 5) AS filter, round(ps[2], 6) AS p_smooth, round({dot('ps', 'e')}, 5) AS smooth,
    CASE WHEN ps[2] > ps[1] THEN 1 ELSE 0 END AS r_smooth FROM smoothed JOIN (SELECT user_id, n, event_id FROM s) USING (user_id, n)""")
def switching_chunks(spark, sf_dir):
    """Unknown regimes of long series that are cut into chunks over tasks."""
    rows = typed_series(spark, sf_dir).drop("r")
    out = ("p_filter", "filter", "p_smooth", "smooth", "r_smooth")
    found = recursions.switching(rows, OPEN, ["event_type"], "at", outputs=out, long=0, chunk=share(rows))
    found = found.withColumns({c: F.col(c)[1] for c in ("p_filter", "p_smooth")}).select("event_type", "event_id", *out)
    return rounded(rounded(found, 6, "p_filter", "p_smooth"), 5, "filter", "smooth")


@query()
def path_chunks(spark, sf_dir):
    """A draw of the regimes' posterior chain of long series over chunks; tests hold its law against all paths."""
    rows = typed_series(spark, sf_dir).drop("r")
    u = (F.pmod(F.xxhash64(F.lit(11), "event_type", "event_id"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    whole = scan.Scan(rows.withColumn("_u", u), ["event_type"], "at", scan.UnknownRegimes(OPEN), share(rows))
    return scan.draw_paths(whole, "_u", "", lambda *_: {}).select("event_type", "event_id", "r")


def _forecast_sql(cells: int) -> str:
    k = cells + 2
    each = f"range(1, {k} + 1)"
    i = f"((j - 1) * {k} + h)"
    step = lambda p, x, y, tail: f"""SELECT *, list_transform({each}, lambda h: list_sum(list_transform({each}, lambda j: {p}[j] * t[{i}]))) AS p{tail},
        list_transform({each}, lambda h: list_sum(list_transform({each}, lambda j: {p}[j] * t[{i}] * (fxx[{i}] * {x} + fxy[{i}] * {y} + cx[{i}])))) AS x{tail},
        list_transform({each}, lambda h: list_sum(list_transform({each}, lambda j: {p}[j] * t[{i}] * (fyx[{i}] * {x} + fyy[{i}] * {y} + cy[{i}])))) AS y{tail}"""  # noqa: E731
    one = f"{step('p', 'e[j]', 'y', '1')} FROM fm, m"
    two = f"{step('p1', 'x1[j] / p1[j]', 'y1[j] / p1[j]', '2')} FROM ({one})"
    prior = {c: f"(SELECT {dot('marg0', f'm{c}0')} FROM m)" for c in "xy"}
    columns = ", ".join(f"round(coalesce(lag(list_sum({c}{h}), {h}) OVER w, {prior[c]}), 5) AS {c}_{h}" for h in (1, 2) for c in "xy")
    return f"""WITH RECURSIVE {grid_sql(cells, 1)}, {lists_sql(EVENTS, k)} SELECT user_id, CAST(n AS INTEGER) AS n, {columns}, round(p2[1], 6) AS p_ahead_2 FROM ({two}) WINDOW w AS (PARTITION BY user_id ORDER BY n)"""


@query(_forecast_sql(3))
def fuzzy_forecast(spark, sf_dir):
    """Each row as it was predicted one and two rows before, and the mass at regime 0 two rows ahead."""
    own, _, _ = fuzzy.grid_model(OPEN, laws.law(LAW), 3)
    found = recursions.predicted(event_series(spark, sf_dir).select("user_id", "n", "y"), own, ["user_id"], 2)
    names = [f"{c}_{h}" for h in (1, 2) for c in "xy"]
    return rounded(rounded(found.select("user_id", "n", *names, F.col("p_ahead")[1][0].alias("p_ahead_2")), 5, *names), 6, "p_ahead_2")


def _fuzzy_transitions_sql(cells: int) -> str:
    k = cells + 2
    each = f"range(1, {k} + 1)"
    at = f"(j - 1) * {k} + h"
    law = lambda x: f"list_transform(range(1, {k * k} + 1), lambda i: {x.format(j=f'(i - 1) // {k} + 1', h=f'(i - 1) % {k} + 1')})"
    return f"""WITH RECURSIVE {grid_sql(cells, 1)}, {lists_sql(EVENTS, k)}, two AS (SELECT c.user_id, c.n, c.u, b.beta, q.p FROM fm c JOIN fm q ON q.user_id = c.user_id AND q.n = c.n - 1 JOIN b ON b.user_id = c.user_id AND b.n = c.n),
    joint AS (SELECT user_id, n, {law('p[{j}] * m.t[i]')} AS predict, {law('p[{j}] * u[i] * beta[{h}]')} AS w FROM two, m)
    SELECT user_id, CAST(n AS INTEGER) AS n, round(list_sum(list_transform({each}, lambda h: predict[(h - 1) * {k} + h])), 6) AS stay_predict, round(list_sum(list_transform({each}, lambda h: w[(h - 1) * {k} + h])) / list_sum(w), 6) AS stay_smooth,
    round(w[{k * k}] / list_sum(w), 6) AS high_smooth FROM joint"""


@query(_fuzzy_transitions_sql(3))
def fuzzy_transitions(spark, sf_dir):
    """Laws of each step over the grid: the mass of staying in an atom or cell, predicted and given all rows."""
    own, r, _ = fuzzy.grid_model(OPEN, laws.law(LAW), 3)
    k = len(r)
    found = recursions.regime_transitions(event_series(spark, sf_dir).select("user_id", "n", "y"), own, ["user_id"]).filter("t_smooth IS NOT NULL")
    stay = lambda c: sum((F.col(c)[i * k + i] for i in range(1, k)), F.col(c)[0])
    return rounded(found.select("user_id", "n", stay("t_predict").alias("stay_predict"), stay("t_smooth").alias("stay_smooth"), F.col("t_smooth")[k * k - 1].alias("high_smooth")), 6, "stay_predict", "stay_smooth", "high_smooth")


# Learning


@query(f"""WITH s AS (SELECT r AS j, lead(r) OVER w AS k, x, y, lead(y) OVER w AS z, lead(x) OVER w AS t FROM ({DAYS}) WINDOW w AS (PARTITION BY flag ORDER BY day)),
    c AS (SELECT j, k, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, avg(t) AS mt, {', '.join(f'covar_pop({a}, {b}) AS {a}{b}' for a, b in ('xx', 'xy', 'xz', 'yy', 'yz', 'zz', 'xt', 'yt', 'zt', 'tt'))} FROM s WHERE k IS NOT NULL GROUP BY 1, 2),
    d AS (SELECT *, xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz) AS det FROM c),
    m AS (SELECT *, (xt * (yy * zz - yz * yz) - xy * (yt * zz - yz * zt) + xz * (yt * yz - yy * zt)) / det AS m0, (xx * (yt * zz - yz * zt) - xt * (xy * zz - yz * xz) + xz * (xy * zt - yt * xz)) / det AS m1,
        (xx * (yy * zt - yt * yz) - xy * (xy * zt - yt * xz) + xt * (xy * yz - yy * xz)) / det AS m2, yz / yy AS p0 FROM d)
    SELECT j, k, n, round(m0, 6) AS m0, round(m1, 3) AS m1, round(m2, 3) AS m2, round(mt - m0 * mx - m1 * my - m2 * mz, 1) AS m3, round(tt - m0 * xt - m1 * yt - m2 * zt, -1) AS lambda2, round(p0, 6) AS p0, round(mz - p0 * my, 5) AS p1, round(zz - p0 * yz, 5) AS pi2 FROM m""")
def pair_regressions(spark, sf_dir):
    """x' on x, y, y' and y' on y for each pair of labels, by aggregates without differences of large sums."""
    steps = sem.weighted_steps(day_series(spark, sf_dir), ["flag"], "day", "x", "y", 2, "r")
    found = sem.regressions(steps).withColumns({**{f"m{i}": F.col("m")[i] for i in range(4)}, **{f"p{i}": F.col("p")[i] for i in range(2)}}).withColumn("n", F.col("weight").cast("long"))
    for digits, names in ((6, ("m0", "p0")), (3, ("m1", "m2")), (1, ("m3",)), (-1, ("lambda2",)), (5, ("p1", "pi2"))):
        found = rounded(found, digits, *names)
    return found.select("j", "k", "n", "m0", "m1", "m2", "m3", "lambda2", "p0", "p1", "pi2")


#: Days with the entry of a grid of one cell: low, in between or high against their flag's own spread.
ENTRIES = f"""SELECT flag, day, x, y, CASE WHEN y <= m - 0.5 * d THEN 0 WHEN y >= m + 0.5 * d THEN 2 ELSE 1 END AS r FROM ({DAYS}) JOIN (SELECT flag, avg(y) AS m, stddev_pop(y) AS d FROM ({DAYS}) GROUP BY 1) USING (flag)"""


def entry_series(spark, sf_dir) -> DataFrame:
    days = day_series(spark, sf_dir).drop("r")
    spread = days.groupBy("flag").agg(F.avg("y").alias("_m"), F.stddev_pop("y").alias("_d"))
    r = F.when(F.col("y") <= F.col("_m") - 0.5 * F.col("_d"), 0).when(F.col("y") >= F.col("_m") + 0.5 * F.col("_d"), 2).otherwise(1)
    return days.join(F.broadcast(spread), "flag").select("flag", "day", "x", "y", r.alias("r"))


def _table_sql() -> str:
    """m of grid_sql() from a table of pairs learned from the entries."""
    value = ["(x - mx)", "(y - my)", "(x2 - nx)", "(y2 - ny)"]
    moments = ", ".join(f"avg({value[a]} * {value[b]}) AS c{a}{b}" for a, b in tables.ENTRIES)
    names = ("t", "fxx", "fxy", "fyx", "fyy", "qyy", "g", "cx", "cy")
    return f"""days AS MATERIALIZED ({ENTRIES}), mean AS (SELECT r, avg(x) AS mx, avg(y) AS my FROM days GROUP BY 1),
    steps AS (SELECT r AS i, x, y, lead(r) OVER w AS k, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM days WINDOW w AS (PARTITION BY flag ORDER BY day)),
    learned AS MATERIALIZED (SELECT i, k, mx, my, nx, ny, count(*) AS n, {moments} FROM steps JOIN mean ON mean.r = i JOIN (SELECT r AS r2, mx AS nx, my AS ny FROM mean) ON r2 = k GROUP BY ALL),
    open AS (SELECT * REPLACE (c01 / c11 * c13 AS c03), c00 * c11 - c01 * c01 AS det FROM learned),
    f AS (SELECT *, (c02 * c11 - c12 * c01) / det AS fxx, (c12 * c00 - c02 * c01) / det AS fxy, (c03 * c11 - c13 * c01) / det AS fyx, (c13 * c00 - c03 * c01) / det AS fyy FROM open),
    q AS (SELECT *, n / sum(n) OVER (PARTITION BY i) AS t, c23 - (fxx * c03 + fxy * c13) AS qxy, c33 - (fyx * c03 + fyy * c13) AS qyy, nx - fxx * mx - fxy * my AS cx, ny - fyx * mx - fyy * my AS cy FROM f),
    m AS MATERIALIZED (SELECT * FROM (SELECT {', '.join(f'list({n} ORDER BY i, k) AS {n}' for n in names)} FROM (SELECT *, qxy / qyy AS g FROM q)),
        (SELECT {', '.join(f'list({n} ORDER BY i) AS {n}0' for n in ('marg', 'mx', 'my', 'gxy', 'gyy'))} FROM (SELECT i, sum(n) / (SELECT sum(n) FROM learned) AS marg, any_value(mx) AS mx, any_value(my) AS my, sum(n * c01) / sum(n) AS gxy, sum(n * c11) / sum(n) AS gyy FROM q GROUP BY 1)))"""


@query(f"""WITH RECURSIVE {_table_sql().replace('f AS (', 'fq AS (').replace('FROM f)', 'FROM fq)')}, {lists_sql(f'SELECT flag AS user_id, row_number() OVER (PARTITION BY flag ORDER BY day) - 1 AS n, y, day FROM ({DAYS})', 3)}
    SELECT user_id AS flag, CAST(day AS VARCHAR) AS day, round({dot('p', 'e')}, 3) AS filter, round({dot('ps', 'e')}, 3) AS smooth, round(p[3], 6) AS high_filter, round(ps[3], 6) AS high_smooth FROM smoothed JOIN (SELECT user_id, n, day FROM s) USING (user_id, n)""")
def tabulated_filter(spark, sf_dir):
    """Filter and smoother with parameters of each pair of grid entries, learned into a table and read from it by key."""
    own = tables.model(tables.learned(entry_series(spark, sf_dir), ["flag"], "day", "r", "x", "y"), 3)
    found = fuzzy.tabulated(day_series(spark, sf_dir).select("flag", "day", "y"), own, np.array([0.0, 0.5, 1.0]), 1, ["flag"], "day")
    found = found.select("flag", F.col("day").cast("string").alias("day"), "filter", "smooth", F.col("p_filter")[2].alias("high_filter"), F.col("p_smooth")[2].alias("high_smooth"))
    return rounded(rounded(found, 3, "filter", "smooth"), 6, "high_filter", "high_smooth")


@query(f"WITH {_table_sql()} SELECT i AS j, k, n, round(mx, 4) AS mx, round(my, 6) AS my, round(c00, 1) AS c_00, round(c02, 1) AS c_02, round(c03, 3) AS c_03, round(c13, 6) AS c_13, round(c33, 6) AS c_33 FROM learned")
def pair_table(spark, sf_dir):
    """The table of pairs itself."""
    found = tables.learned(entry_series(spark, sf_dir), ["flag"], "day", "r", "x", "y").select("j", "k", "n", "mx", "my", "c_00", "c_02", "c_03", "c_13", "c_33")
    for digits, names in ((4, ("mx",)), (6, ("my", "c_13", "c_33")), (1, ("c_00", "c_02")), (3, ("c_03",))):
        found = rounded(found, digits, *names)
    return found


def _posterior_sql(own: sem.PairRegression, law: str) -> str:
    """Recursive tables of the chain with x and y known: laws p, beta and psi as lists. law: CTEs that end in t (list of K*K) and marg0 (K)."""
    k = len(own.joint)
    each, pair = f"range(1, {k} + 1)", f"range(1, {k * k} + 1)"
    lists = lambda v: "[" + ", ".join(d(x) for x in np.asarray(v).ravel()) + "]"
    m = "".join(f", {lists(own.m[:, :, i])} AS m{i}" for i in range(4)) + f", {lists(own.lambda2)} AS l2, {lists(own.p[:, :, 0])} AS p0, {lists(own.p[:, :, 1])} AS p1, {lists(own.pi2)} AS q2"
    first = f", {lists(own.mean[:, 0])} AS ax, {lists(own.mean[:, 1])} AS ay, {lists(own.gamma[:, 0, 0])} AS vx, {lists(own.gamma[:, 1, 1])} AS vy"
    return f"""{law}, m AS MATERIALIZED (SELECT *{m}{first} FROM law),
    s AS MATERIALIZED (SELECT *, list_transform({pair}, lambda i: t[i] / (2 * pi() * sqrt(l2[i] * q2[i])) * exp(-0.5 * (pow(x - (m0[i] * x0 + m1[i] * y0 + m2[i] * y + m3[i]), 2) / l2[i] + pow(y - (p0[i] * y0 + p1[i]), 2) / q2[i]))) AS u,
        list_transform({each}, lambda h: marg0[h] / sqrt(vx[h] * vy[h]) * exp(-0.5 * (pow(x - ax[h], 2) / vx[h] + pow(y - ay[h], 2) / vy[h]))) AS w
        FROM (SELECT flag, day, x, y, lag(x) OVER o AS x0, lag(y) OVER o AS y0, row_number() OVER o - 1 AS n FROM ({DAYS}) WINDOW o AS (PARTITION BY flag ORDER BY day)), m),
    f AS (SELECT flag, n, list_transform(w, lambda v: v / list_sum(w)) AS p FROM s WHERE n = 0 UNION ALL
        SELECT flag, n, list_transform(col, lambda v: v / list_sum(col)) FROM (SELECT s.flag, s.n, list_transform({each}, lambda h: list_sum(list_transform({each}, lambda j: f.p[j] * s.u[(j - 1) * {k} + h]))) AS col FROM f JOIN s ON s.flag = f.flag AND s.n = f.n + 1)),
    b AS (SELECT flag, max(n) AS n, list_transform({each}, lambda h: 1.0::DOUBLE) AS beta FROM s GROUP BY 1 UNION ALL
        SELECT flag, n - 1, list_transform(col, lambda v: v / list_sum(col)) FROM (SELECT s.flag, s.n, list_transform({each}, lambda j: list_sum(list_transform({each}, lambda h: s.u[(j - 1) * {k} + h] * b.beta[h]))) AS col FROM b JOIN s ON s.flag = b.flag AND s.n = b.n WHERE b.n > 0)),
    chain AS (SELECT s.flag, s.day, s.n, list_transform({each}, lambda h: f.p[h] * b.beta[h]) AS g, CASE WHEN s.n > 0 THEN list_transform({pair}, lambda i: e.p[(i - 1) // {k} + 1] * s.u[i] * b.beta[(i - 1) % {k} + 1]) END AS psi
        FROM s JOIN f ON f.flag = s.flag AND f.n = s.n JOIN b ON b.flag = s.flag AND b.n = s.n LEFT JOIN f e ON e.flag = s.flag AND e.n = s.n - 1)"""


_HARD = f"law AS (SELECT [{', '.join(d(x) for x in PAIRS.transition.ravel())}] AS t, [{', '.join(d(x) for x in PAIRS.joint.sum(axis=1))}] AS marg0)"


@query(f"WITH RECURSIVE {_posterior_sql(PAIRS, _HARD)} SELECT flag, CAST(day AS VARCHAR) AS day, round(g[2] / list_sum(g), 6) AS gamma1, round(coalesce(psi[4] / list_sum(psi), 0), 6) AS psi11 FROM chain")
def regime_posterior_law(spark, sf_dir):
    """Posterior of regimes and of their pairs with x and y known."""
    found = sem.posterior(day_series(spark, sf_dir).drop("r"), ["flag"], "day", "x", "y", PAIRS)
    return found.select("flag", F.col("day").cast("string").alias("day"), F.round(F.col("gamma")[1], 6).alias("gamma1"), F.round(F.col("psi")[3], 6).alias("psi11"))


def between(own: sem.PairRegression, r: np.ndarray) -> sem.PairRegression:
    """The regressions of two regimes at points of a grid, bilinear between them."""
    pair = lambda v: np.array([[(1 - a) * (1 - b) * v[0, 0] + (1 - a) * b * v[0, 1] + a * (1 - b) * v[1, 0] + a * b * v[1, 1] for b in r] for a in r])
    one = lambda v: np.array([(1 - a) * v[0] + a * v[1] for a in r])
    return sem.PairRegression(pair(own.m), pair(own.lambda2), pair(own.p), pair(own.pi2), pair(own.joint), one(own.mean), one(own.gamma))


_POINTS = between(PAIRS, np.array([0.0, 0.25, 0.75, 1.0]))
_FUZZY_LAW = f"{grid_sql(2, 1).split('m AS MATERIALIZED')[0].rstrip().rstrip(',')}, weights AS (SELECT i, sum(joint) AS marg FROM weighed GROUP BY 1), law AS (SELECT (SELECT list(t ORDER BY i, k) FROM weighed) AS t, (SELECT list(marg ORDER BY i) FROM weights) AS marg0)"


@query(f"WITH RECURSIVE {_posterior_sql(_POINTS, _FUZZY_LAW)} SELECT flag, CAST(day AS VARCHAR) AS day, round((g[2] + g[3]) / list_sum(g), 6) AS inside, round(coalesce(psi[6] / list_sum(psi), 0), 6) AS psi11 FROM chain")
def fuzzy_posterior(spark, sf_dir):
    """The same on a grid of two atoms and two cells, with a fuzzy law's masses: the mass inside, and that of staying in the first cell."""
    own = sem.on_grid(_POINTS, laws.law(LAW), 2)
    found = sem.posterior(day_series(spark, sf_dir).drop("r"), ["flag"], "day", "x", "y", own)
    return found.select("flag", F.col("day").cast("string").alias("day"), F.round(F.col("gamma")[1] + F.col("gamma")[2], 6).alias("inside"), F.round(F.col("psi")[5], 6).alias("psi11"))


@query()
def fuzzy_learning(spark, sf_dir):
    """The law of a family, refitted from a drawn chain in each round of learning on a grid of two cells."""
    _, _, _, trace = sem.learn_fuzzy(day_series(spark, sf_dir).drop("r"), ["flag"], "day", "x", "y", 2, 2)
    return spark.createDataFrame([(t["round"], *(float(t["law"].p[c]) for c in ("alpha0", "alpha1", "beta"))) for t in trace], "round int, alpha0 double, alpha1 double, beta double")


@query(known_sql(EVENTS.replace("THEN 1 ELSE 0 END AS r", "THEN 1.0 ELSE 0.0 END AS r")) + " SELECT user_id, CAST(f.n AS INTEGER) AS n, round(sm, 6) AS smooth, round(sv, 6) AS smooth_var FROM fm f JOIN b USING (user_id, n)")
def dense_smoother(spark, sf_dir):
    """Known regimes by whole covariance matrices of each series."""
    rows = event_series(spark, sf_dir).select("user_id", "n", "y", "r")
    return rounded(dense.dense_smoother(rows, example_model(), ["user_id"]).select("user_id", "n", "smooth", "smooth_var"), 6, "smooth", "smooth_var")


#: Days with two hidden and two observed columns; the regime is high quantity.
WIDE = """SELECT l_returnflag AS flag, CAST(l_shipdate AS DATE) AS day, avg(l_extendedprice) / 1000 AS x1, 100 * avg(l_discount) AS x2, avg(l_quantity) AS y1, 100 * avg(l_tax) AS y2,
    CASE WHEN avg(l_quantity) > 25.5 THEN 1 ELSE 0 END AS r FROM lineitem GROUP BY 1, 2"""


def wide_series(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.to_date("l_shipdate").alias("day"))
    days = rows.agg((F.avg("l_extendedprice") / 1000).alias("x1"), (100 * F.avg("l_discount")).alias("x2"), F.avg("l_quantity").alias("y1"), (100 * F.avg("l_tax")).alias("y2"))
    return days.withColumn("r", (F.col("y1") > 25.5).cast("int"))


def _wide_sql() -> str:
    """The estimate of both hidden columns from a day alone, by regime, with moments and the inverse of the 2 x 2 matrix in SQL."""
    cov = ", ".join(f"covar_pop({a}, {b}) AS {a}{b}" for a in ("x1", "x2", "y1", "y2") for b in ("y1", "y2"))
    gain = lambda x: f"m{x} + (({x}y1 * y2y2 - {x}y2 * y1y2) * (y1 - my1) + ({x}y2 * y1y1 - {x}y1 * y1y2) * (y2 - my2)) / (y1y1 * y2y2 - y1y2 * y1y2)"
    return f"""WITH s AS MATERIALIZED ({WIDE}), g AS (SELECT r, {', '.join(f'avg({c}) AS m{c}' for c in ('x1', 'x2', 'y1', 'y2'))}, {cov} FROM s GROUP BY 1)
    SELECT flag, CAST(day AS VARCHAR) AS day, round({gain('x1')}, 6) AS x1, round({gain('x2')}, 6) AS x2 FROM s JOIN g USING (r)"""


@query(_wide_sql())
def vector_alone(spark, sf_dir):
    """Two hidden columns from two observed ones, each day a series of its own: a learned vector model's filter on first rows."""
    days = wide_series(spark, sf_dir)
    own = learn.fit_vectors(days, ["flag"], "day", "r", ["x1", "x2"], ["y1", "y2"], 2)
    rows = days.select("flag", "day", F.array("y1", "y2").alias("y"), "r")
    found = recursions.kalman(rows, own, ["flag", "day"], "r", outputs=("filter",))
    return found.select("flag", F.col("day").cast("string").alias("day"), *(F.round(F.col("filter")[i], 6).alias(f"x{i + 1}") for i in (0, 1)))


@query()
def vector_filter(spark, sf_dir):
    """The same model over whole series, known and unknown regimes; tests hold vector models against dense conditioning and all paths."""
    days = wide_series(spark, sf_dir)
    own = learn.fit_vectors(days, ["flag"], "day", "r", ["x1", "x2"], ["y1", "y2"], 2)
    rows = days.select("flag", "day", F.array("y1", "y2").alias("y"), "r")
    known = recursions.kalman(rows, own, ["flag"], "day", outputs=("smooth",)).withColumnRenamed("smooth", "known")
    found = recursions.switching(known, nearest_open_loop(own), ["flag"], "day", outputs=("smooth", "p_smooth"))
    return found.select("flag", "day", *(F.col("known")[i].alias(f"known_x{i + 1}") for i in (0, 1)), *(F.col("smooth")[i].alias(f"x{i + 1}") for i in (0, 1)), F.col("p_smooth")[1].alias("p1"))


@query(f"""WITH s AS MATERIALIZED ({DAYS}), g AS (SELECT r, covar_pop(x, y) / var_pop(y) AS gain, avg(x) AS mx, avg(y) AS my FROM s GROUP BY 1), p AS (SELECT r AS j, x, y, lead(r) OVER w AS k, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM s WINDOW w AS (PARTITION BY flag ORDER BY day))
    SELECT j, k, round(any_value(a.gain) * avg((y - a.my) * (y2 - b.my)), 4) AS sxy, round(avg((y - a.my) * (y2 - b.my)), 5) AS syy, round(avg((y - a.my) * (x2 - b.mx)), 2) AS syx FROM p JOIN g a ON a.r = j JOIN g b ON b.r = k GROUP BY 1, 2""")
def open_loop_fit(spark, sf_dir):
    """The model without feedback that is nearest to the one that labels give."""
    own = nearest_open_loop(learn.fit_model(day_series(spark, sf_dir), ["flag"], "day", "r", "x", "y", 2))
    rows = [(j, k, *map(float, (own.sigma[j, k][0, 1], own.sigma[j, k][1, 1], own.sigma[j, k][1, 0]))) for j, k in np.ndindex(2, 2)]
    found = spark.createDataFrame(rows, "j int, k int, sxy double, syy double, syx double")
    return rounded(rounded(rounded(found, 4, "sxy"), 5, "syy"), 2, "syx")


@query(f"""WITH days AS MATERIALIZED ({DAYS}), mean AS (SELECT r, avg(x) AS mx, avg(y) AS my FROM days GROUP BY 1), steps AS (SELECT r AS j, x, y, lead(r) OVER w AS k, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM days WINDOW w AS (PARTITION BY flag ORDER BY day)),
    c AS (SELECT j, k, x - a.mx AS x, y - a.my AS y, x2 - b.mx AS x2, y2 - b.my AS y2 FROM steps JOIN mean a ON a.r = j JOIN mean b ON b.r = k),
    g AS (SELECT j AS i, (avg(x * x) + avg(x2 * x2)) / 2 AS xx, (avg(x * y) + avg(x2 * y2)) / 2 AS xy, (avg(y * y) + avg(y2 * y2)) / 2 AS yy FROM c WHERE j = k GROUP BY 1),
    s AS (SELECT j, k, avg(x * x2) AS a, avg(x * y2) AS b, avg(y * x2) AS c, avg(y * y2) AS d FROM c GROUP BY 1, 2),
    f AS (SELECT s.*, h.xx, h.xy, h.yy, n.xx AS nxx, n.xy AS nxy, n.yy AS nyy, (s.a * h.yy - s.c * h.xy) / (h.xx * h.yy - h.xy * h.xy) AS fxx, (s.c * h.xx - s.a * h.xy) / (h.xx * h.yy - h.xy * h.xy) AS fxy,
        (s.b * h.yy - s.d * h.xy) / (h.xx * h.yy - h.xy * h.xy) AS fyx, (s.d * h.xx - s.b * h.xy) / (h.xx * h.yy - h.xy * h.xy) AS fyy FROM s JOIN g h ON h.i = j JOIN g n ON n.i = k),
    q AS (SELECT *, nxx - (fxx * a + fxy * c) > 0 AND (nxx - (fxx * a + fxy * c)) * (nyy - (fyx * b + fyy * d)) > pow(nxy - (fxx * b + fxy * d), 2) AND xx > 0 AND xx * yy > xy * xy AS ok FROM f)
    SELECT j, k, round(xx, 2) AS gxx, round(xy, 4) AS gxy, round(yy, 6) AS gyy, round(CASE WHEN ok THEN a ELSE 0 END, 2) AS sxx, round(CASE WHEN ok THEN d ELSE 0 END, 6) AS syy FROM q""")
def averaged_fit(spark, sf_dir):
    """Own covariances as the average of both blocks of steps within a regime."""
    own = learn.fit_averaged(day_series(spark, sf_dir), ["flag"], "day", "r", "x", "y", 2)
    rows = [(j, k, *map(float, (own.gamma[j][0, 0], own.gamma[j][0, 1], own.gamma[j][1, 1], own.sigma[j, k][0, 0], own.sigma[j, k][1, 1]))) for j, k in np.ndindex(2, 2)]
    found = spark.createDataFrame(rows, "j int, k int, gxx double, gxy double, gyy double, sxx double, syy double")
    return rounded(rounded(rounded(found, 2, "gxx", "sxx"), 4, "gxy"), 6, "gyy", "syy")
