"""Filters, smoothers and predictors of the hidden state.

Each operator takes a table of series (key columns, an order column n, observation y, and where known the regime r) and
returns its rows with estimates. Where no series has more than LONG rows, the table is shuffled once by its key and
sorted, and a task works on many whole series at once, one step of all of them in each array operation. Longer series
are cut into chunks over many tasks (scan.py); the results are the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scan
from ..cluster import ship_package
from ..functions.model import RegimeModel, reversed_model
from .scan import beside, key_at, key_starts, log_sum, shares

FLOOR = 1e-300
#: Squared distances are told apart up to here.
MOST = 1e300
#: Rows of whole series that are worked on at once, if there are so many.
ROWS = 50_000
#: Rows of a series from which on it is cut into chunks.
LONG = 200_000
STATES = ("filter", "filter_var", "smooth", "smooth_var", "predict")


def longest(df: DataFrame, key: list[str]) -> int:
    """Rows of the longest series."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def by_series(df: DataFrame, key: list[str], order: str, added: str, some: Callable[[pd.DataFrame, np.ndarray], dict]) -> DataFrame:
    """Adds the columns that `some` gives for a table of whole, ordered series and the sizes of these.

    The table's own columns stay in Arrow, so that integers beside nulls come out as they were.
    """
    ship_package(df.sparkSession)
    kinds = T._parse_datatype_string(added)
    schema = T.StructType([*df.schema.fields, *kinds.fields])

    def worked(held: list[pa.RecordBatch], starts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        table, at = pa.Table.from_batches(held).combine_chunks(), np.flatnonzero(np.concatenate(starts))
        yield from beside(table, some(table.to_pandas(), np.diff([*at, table.num_rows])), kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, starts, rows, before = [], [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = key_starts(batch, key, before)
            before = key_at(batch, key, batch.num_rows - 1)
            cut = int(np.flatnonzero(new)[-1]) if rows + batch.num_rows >= ROWS and new.any() else 0
            if cut or (rows >= ROWS and new[0]):
                if cut:
                    held.append(batch.slice(0, cut))
                    starts.append(new[:cut])
                yield from worked(held, starts)
                held, starts, rows = [], [], 0
            held.append(batch.slice(cut))
            starts.append(new[cut:])
            rows += batch.num_rows - cut
        if held:
            yield from worked(held, starts)

    return df.repartition(*key).sortWithinPartitions(*key, order).mapInArrow(run, schema)


def vectors(rows: pd.DataFrame, column: str) -> np.ndarray:
    """Observations as (N, n_y), of a numeric or an array column; null is NaN."""
    values = rows[column]
    if values.dtype != object:
        return values.to_numpy(dtype=float)[:, None]
    lists = [v for v in values if isinstance(v, (list, np.ndarray))]
    if not lists:
        return pd.to_numeric(values).to_numpy(dtype=float)[:, None]
    none = np.full(len(lists[0]), np.nan)
    return np.stack([np.asarray(v, dtype=float) if isinstance(v, (list, np.ndarray)) else none for v in values])


def steps(sizes: np.ndarray) -> list[np.ndarray]:
    """Rows at each place of their series, the longest series first: step n + 1 has a part of the series of step n."""
    order = np.argsort(-sizes, kind="stable")
    first, left = (np.cumsum(sizes) - sizes)[order], sizes[order]
    return [first[: np.searchsorted(-left, -n, side="left")] + n for n in range(int(sizes.max(initial=0)))]


def last_rows(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - 1


def reversed_rows(sizes: np.ndarray) -> np.ndarray:
    """For each row the one that stands in its place when each series is reversed."""
    ends = np.cumsum(sizes)
    return np.repeat(2 * ends - sizes - 1, sizes) - np.arange(ends[-1] if len(ends) else 0)


def _dot(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (m @ v[..., None])[..., 0]


def _t(m: np.ndarray) -> np.ndarray:
    return np.swapaxes(m, -1, -2)


def _quadratic(v: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    return (v * _dot(inverse, v)).sum(axis=-1)


def _starts(sizes: np.ndarray) -> np.ndarray:
    new = np.zeros(int(sizes.sum()), dtype=bool)
    new[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    return new


def known_regimes(y: np.ndarray, r: np.ndarray, sizes: np.ndarray, model: RegimeModel, smooth: bool = True) -> dict[str, np.ndarray]:
    """Pairwise Kalman filter, one-step predictor, log-likelihood and, if wanted, fixed-interval smoother of series.

    r is a regime or a fraction between two neighbours in [0, K - 1], row by row. Rows without such an r have no
    estimates and the next one begins anew; a row without y is a step without observation.
    """
    if not len(y):
        none = np.zeros((0, model.n_x))
        return dict.fromkeys(("filter", "filter_var", "predict", "smooth", "smooth_var"), none) | {"log_likelihood": np.zeros(0)}
    work = scan.KnownRegimes(model)
    out = work.passed(work.rows({"y": y, "r": r}, _starts(sizes), None), work.first(), work.last(), smooth)
    total = np.add.reduceat(out.pop("log_l"), (np.cumsum(sizes) - sizes)[sizes > 0])
    return out | {"log_likelihood": np.repeat(total, sizes[sizes > 0])}


def unknown_regimes(y: np.ndarray, sizes: np.ndarray, model: RegimeModel, smooth: bool = True, start: tuple | None = None) -> dict[str, np.ndarray]:
    """Exact filter and, if wanted, smoother of state and regime for F_yx = 0; moments per regime, then their mixtures.

    `start` has weights, means and second moments of the regimes at each first row, where these are known already.
    A row without y has no estimates (NaN), and the row after it begins anew, as what follows depends on it.
    link holds, for the step to a row, p(r', y' | r) over p(y' | past): its backward products are the smoother, and
    its rows, reweighted, the regimes' posterior transition (onward: p(r' | r, all y)). Weights are kept as logarithms,
    so that a regime an outlier makes next to impossible keeps its moments and its share in later laws.
    """
    none = np.isnan(y).any(axis=1)
    if none.any() and start is None:
        piece = np.cumsum(_starts(sizes) | np.concatenate([[False], none[:-1]]))[~none]
        found = unknown_regimes(y[~none], np.unique(piece, return_counts=True)[1], model, smooth)
        out = {name: np.full((len(y), *value.shape[1:]), np.nan) for name, value in found.items()}
        for name, value in found.items():
            out[name][~none] = value
        return out
    x, k_all = model.n_x, len(model.mean)
    f, q, c = model.regression()
    fxx, fxy, fyy, qyy = f[:, :, :x, :x], f[:, :, :x, x:], f[:, :, x:, x:], q[:, :, x:, x:]
    inverse, constant = np.linalg.inv(qyy), qyy.shape[-1] * math.log(2 * math.pi)
    g = q[:, :, :x, x:] @ inverse
    own_cov = q[:, :, :x, :x] - g @ q[:, :, x:, :x]
    at = steps(sizes)
    after = np.concatenate(at[1:]) if len(at) > 1 else np.zeros(0, dtype=int)
    with np.errstate(divide="ignore"):
        log_transition = np.log(model.transition)
    d, lu, h = np.zeros((len(y), k_all, k_all, y.shape[1])), np.zeros((len(y), k_all, k_all)), np.zeros((len(y), k_all, k_all, x))
    before = y[after - 1][:, None, None, :]
    d[after] = y[after][:, None, None, :] - _dot(fyy, before) - c[:, :, x:]
    lu[after] = log_transition - 0.5 * (np.minimum(_quadratic(d[after], inverse), MOST) + np.linalg.slogdet(qyy)[1] + constant)
    h[after] = _dot(g, d[after]) + _dot(fxy, before) + c[:, :, :x]
    ps, lp = np.zeros((len(y), k_all)), np.zeros((len(y), k_all))
    es, vs = np.zeros((len(y), k_all, x)), np.zeros((len(y), k_all, x, x))
    ahead, log_link = np.full((len(y), x), np.nan), np.full((len(y), k_all, k_all), -np.inf)
    for n, rows in enumerate(at):
        if n == 0 and start:
            ps[rows], es[rows], vs[rows] = start
            with np.errstate(divide="ignore"):
                lp[rows] = np.log(ps[rows])
            continue
        if n == 0:
            inv0 = np.linalg.inv(model.gamma[:, x:, x:])
            d0 = y[rows][:, None, :] - model.mean[:, x:]
            with np.errstate(divide="ignore"):
                p = np.log(model.marginal) - 0.5 * (np.minimum(_quadratic(d0, inv0), MOST) + np.linalg.slogdet(model.gamma[:, x:, x:])[1] + constant)
            p -= p.max(axis=1, keepdims=True)
            lp[rows] = p - log_sum(p, 1)[:, None]
            ps[rows] = np.exp(lp[rows])
            gain = model.gamma[:, :x, x:] @ inv0
            es[rows] = e = model.mean[:, :x] + _dot(gain, d0)
            vs[rows] = model.gamma[:, :x, :x] - gain @ model.gamma[:, x:, :x] + e[..., :, None] * e[..., None, :]
            continue
        b = rows - 1
        p, e, v = ps[b], es[b], vs[b]
        joint = lp[b][:, :, None] + lu[rows]
        most = joint.max(axis=(1, 2))
        joint -= most[:, None, None]
        column = log_sum(joint, 1)
        total = log_sum(column, 1)
        w, log_link[rows] = shares(joint, 1), lu[rows] - (most + total)[:, None, None]
        lp[rows] = column - total[:, None]
        ps[rows] = np.exp(lp[rows])
        fe, hh = _dot(fxx, e[:, :, None, :]), h[rows]
        ahead[rows] = np.einsum("sj,jk,sjka->sa", p, model.transition, fe + _dot(fxy, y[b][:, None, None, :]) + c[:, :, :x])
        cross = fe[..., :, None] * hh[..., None, :]
        m2 = fxx @ v[:, :, None] @ _t(fxx) + cross + _t(cross) + own_cov + hh[..., :, None] * hh[..., None, :]
        es[rows], vs[rows] = np.einsum("sjk,sjka->ska", w, fe + hh), np.einsum("sjk,sjkab->skab", w, m2)

    def mixture(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = np.einsum("nj,nja->na", weights, es)
        return m, np.einsum("nj,njab->nab", weights, vs) - m[:, :, None] * m[:, None, :]

    fe, fv = mixture(ps)
    out = {"filter": fe, "filter_var": fv, "predict": ahead, "p_filter": ps, "log_p": lp, "e_regime": es, "v_regime": vs, "link": np.exp(np.minimum(log_link, 700.0)), "log_link": log_link}
    if smooth:
        beta = np.zeros((len(y), k_all))
        for rows in at[:0:-1]:
            beta[rows - 1] = log_sum(log_link[rows] + beta[rows][:, None, :], 2)
        p = shares(lp + beta, 1)
        se, sv = mixture(p)
        out |= {"smooth": se, "smooth_var": sv, "p_smooth": p, "beta": np.exp(np.minimum(beta, 700.0)), "log_beta": beta, "onward": shares(log_link + beta[:, None, :], 2)}
    return out


def _lists(value: np.ndarray) -> list:
    """Rows of an array; null where there is no estimate."""
    return [None if n else v for n, v in zip(np.isnan(value[:, 0]), value, strict=True)] if value.shape[1] else list(value)


def _columns(found: dict[str, np.ndarray], x: int, wanted: tuple[str, ...]) -> dict:
    """One-dimensional states as doubles, others as arrays."""
    out = {}
    for name in wanted:
        value = found[name]
        if name.startswith("p_"):
            out[name] = _lists(value)
        elif name in STATES:
            out[name] = value.reshape(len(value), -1)[:, 0] if x == 1 else _lists(value.reshape(len(value), -1))
        else:
            out[name] = value
    return out


def _kinds(wanted: tuple[str, ...], x: int) -> str:
    state = "double" if x == 1 else "array<double>"
    kind = lambda name: state if name in STATES else "array<double>" if name.startswith("p_") else "int" if name.startswith("r_") else "double"
    return ", ".join(f"{name} {kind(name)}" for name in wanted)


def kalman(df: DataFrame, model: RegimeModel, key: list[str], order: str = "n", y: str = "y", r: str = "r", outputs: tuple[str, ...] = (*STATES, "log_likelihood"), long: int = LONG, chunk: int = scan.CHUNK) -> DataFrame:
    """Adds `outputs` (of filter, filter_var, smooth, smooth_var, predict, log_likelihood) for known regimes r (integers, or fractions between neighbours).

    Nothing is smoothed unless asked for. Rows without a regime in [0, K - 1] have null estimates and the next one begins
    anew; a row without y is a step without observation; estimates that do not exist are null. Series of over `long` rows
    are cut into chunks.
    """
    smooth = any(c.startswith("smooth") for c in outputs)
    if longest(df, key) <= long:
        some = lambda rows, sizes: _columns(known_regimes(vectors(rows, y), rows[r].to_numpy(dtype=float), sizes, model, smooth), model.n_x, outputs)
        return by_series(df, key, order, _kinds(outputs, model.n_x), some)
    own = tuple(c for c in outputs if c != "log_likelihood")
    whole = scan.Scan(df, key, order, scan.KnownRegimes(model, y, r), chunk)
    added = ", ".join(x for x in (_kinds(own, model.n_x), "_log double") if x)
    rows = whole.columns(added, lambda table, found, rows, at: _columns(found, model.n_x, own) | {"_log": found["log_l"]}, smooth)
    if "log_likelihood" not in outputs:
        return rows.drop("_log")
    named = [F.col(c).alias(f"_key{i}") for i, c in enumerate(key)]
    totals = rows.groupBy(*named).agg(F.sum("_log").alias("log_likelihood"))
    same = [F.col(c).eqNullSafe(F.col(f"_key{i}")) for i, c in enumerate(key)]
    return rows.join(totals, same).select(*df.columns, *outputs)


def switching(df: DataFrame, model: RegimeModel, key: list[str], order: str = "n", y: str = "y", outputs: tuple[str, ...] = (*STATES, "p_filter", "p_smooth", "r_filter", "r_smooth"), long: int = LONG, chunk: int = scan.CHUNK) -> DataFrame:
    """Adds `outputs` for unknown regimes: those of kalman() but the likelihood, p_filter and p_smooth, and the most probable regimes (first one wins).

    A row without y has null estimates, and the row after it begins anew. Series of over `long` rows are cut into chunks.
    """
    smooth = any("smooth" in c for c in outputs)

    def columns(found: dict[str, np.ndarray]) -> dict:
        for c in ("p_filter", "p_smooth"):
            if c in found:
                best = pd.array(np.nan_to_num(found[c]).argmax(axis=1), dtype="Int64")
                best[np.isnan(found[c][:, 0])] = None
                found[f"r_{c[2:]}"] = best
        return _columns(found, model.n_x, outputs)

    kinds = _kinds(outputs, model.n_x)
    if longest(df, key) <= long:
        return by_series(df, key, order, kinds, lambda rows, sizes: columns(unknown_regimes(vectors(rows, y), sizes, model, smooth)))
    return scan.Scan(df, key, order, scan.UnknownRegimes(model, y), chunk).columns(kinds, lambda table, found, rows, at: columns(found), smooth)


def double_filter(y: np.ndarray, sizes: np.ndarray, model: RegimeModel) -> np.ndarray:
    """Smoothed state from a filter forward, one backward and single observations: sum_r p(r | all) (E_fwd + E_bwd - E_one)."""
    x, back = model.n_x, reversed_rows(sizes)
    forward, backward = unknown_regimes(y, sizes, model), unknown_regimes(y[back], sizes, reversed_model(model), smooth=False)
    gain = model.gamma[:, :x, x:] @ np.linalg.inv(model.gamma[:, x:, x:])
    one = model.mean[:, :x] + _dot(gain, y[:, None, :] - model.mean[:, x:])
    return np.einsum("nj,nja->na", forward["p_smooth"], forward["e_regime"] + backward["e_regime"][back] - one)


def double_filter_smoother(df: DataFrame, model: RegimeModel, key: list[str], order: str = "n", y: str = "y") -> DataFrame:
    """Adds dfb_smooth, the double-filter-based smoother (scalar state)."""
    return by_series(df, key, order, "dfb_smooth double", lambda rows, sizes: {"dfb_smooth": double_filter(vectors(rows, y), sizes, model)[:, 0]})


def _transitions(found: dict[str, np.ndarray], model: RegimeModel, before: np.ndarray, start: np.ndarray) -> dict:
    """before: logarithms of the regimes' law in the row before."""
    p = before[:, :, None]
    joint, onward = p + found["log_link"], found["log_link"] + found["log_beta"][:, None, :]
    out = {"t_predict": np.exp(p) * model.transition, "t_back": shares(joint, 1), "t_forward": shares(onward, 2), "t_smooth": shares(p + onward, (1, 2))}
    none = start | np.isnan(found["p_filter"][:, 0]) | np.isnan(before[:, 0])
    return {name: [None if n else v for n, v in zip(none, value.reshape(len(value), -1), strict=True)] for name, value in out.items()}


def regime_transitions(df: DataFrame, model: RegimeModel, key: list[str], order: str = "n", y: str = "y", long: int = LONG, chunk: int = scan.CHUNK) -> DataFrame:
    """Adds laws of the step to each row as arrays of K*K (j the regime before, k the row's; null where no row before has a law).

    t_predict: p(j, k | y before). t_back: p(j | k, y up to the row). t_forward: p(k | j, all y). t_smooth: p(j, k | all y).
    """
    kinds = ", ".join(f"{c} array<double>" for c in ("t_predict", "t_back", "t_forward", "t_smooth"))
    if longest(df, key) > long:
        return scan.Scan(df, key, order, scan.UnknownRegimes(model, y), chunk).columns(kinds, lambda table, found, rows, at: _transitions(found, model, found["log_before"], rows["start"]))

    def some(rows: pd.DataFrame, sizes: np.ndarray) -> dict:
        found = unknown_regimes(vectors(rows, y), sizes, model)
        return _transitions(found, model, np.roll(found["log_p"], 1, axis=0), _starts(sizes))

    return by_series(df, key, order, kinds, some)


def forecast_columns(found: dict[str, np.ndarray], y: np.ndarray, model: RegimeModel, horizon: int) -> dict:
    """Law of the regime and moments of x and y, 1 .. horizon steps after each row, without further observations.

    Given the regimes z is linear in the z before, so p_k, p_k E(z | k) and p_k E(z z' | k) move on exactly.
    """
    f, q, c = model.regression()
    x, t = model.n_x, model.transition
    p, n = found["p_filter"], len(y)
    tall = np.repeat(y[:, None, :], p.shape[1], axis=1)
    m = np.concatenate([found["e_regime"], tall], axis=2)
    v = np.zeros((n, p.shape[1], m.shape[2], m.shape[2]))
    v[..., :x, :x], cross = found["v_regime"], found["e_regime"][..., :, None] * tall[..., None, :]
    v[..., :x, x:], v[..., x:, :x], v[..., x:, x:] = cross, _t(cross), tall[..., :, None] * tall[..., None, :]
    names = ("x_ahead", "x_ahead_var", "y_ahead", "y_ahead_var")
    out = {name: np.zeros((n, horizon)) for name in names}
    laws = np.zeros((n, horizon, p.shape[1]))
    for h in range(horizon):
        fm = _dot(f, m[:, :, None, :])
        cm = fm[..., :, None] * c[..., None, :]
        second = f @ v[:, :, None] @ _t(f) + cm + _t(cm) + c[..., :, None] * c[..., None, :] + q
        flow = p[:, :, None] * t
        p = flow.sum(axis=1)
        safe = np.maximum(p, FLOOR)
        m, v = np.einsum("njk,njka->nka", flow, fm + c) / safe[..., None], np.einsum("njk,njkab->nkab", flow, second) / safe[..., None, None]
        mean, every = np.einsum("nk,nka->na", p, m), np.einsum("nk,nkab->nab", p, v)
        laws[:, h] = p
        for name, at in (("x_ahead", 0), ("y_ahead", x)):
            out[name][:, h], out[f"{name}_var"][:, h] = mean[:, at], every[:, at, at] - mean[:, at] ** 2
    none = np.isnan(found["p_filter"][:, 0])
    lists = lambda value: [None if n else v for n, v in zip(none, value, strict=True)]
    return {name: lists(value) for name, value in out.items()} | {"p_ahead": lists([row.tolist() for row in laws])}


def forecast(df: DataFrame, model: RegimeModel, key: list[str], horizon: int, order: str = "n", y: str = "y", long: int = LONG, chunk: int = scan.CHUNK) -> DataFrame:
    """Adds x_ahead, x_ahead_var, y_ahead, y_ahead_var and p_ahead: what each row says of the rows 1 .. horizon after it.

    The first dimension of x and of y; p_ahead has the regimes' law for each step. Null for a row without y.
    """
    kinds = "x_ahead array<double>, x_ahead_var array<double>, y_ahead array<double>, y_ahead_var array<double>, p_ahead array<array<double>>"
    if longest(df, key) > long:
        return scan.Scan(df, key, order, scan.UnknownRegimes(model, y), chunk).columns(kinds, lambda table, found, rows, at: forecast_columns(found, rows["y"], model, horizon), smooth=False)

    def some(rows: pd.DataFrame, sizes: np.ndarray) -> dict:
        values = vectors(rows, y)
        return forecast_columns(unknown_regimes(values, sizes, model, smooth=False), np.nan_to_num(values), model, horizon)

    return by_series(df, key, order, kinds, some)


def prior_ahead(model: RegimeModel, horizon: int) -> list[tuple[float, float]]:
    """E(x) and E(y) of the first `horizon` rows of a series before any is seen."""
    f, _, c = model.regression()
    p, m, out = model.marginal, model.mean, []
    for _ in range(horizon):
        mean = p @ m
        out.append((float(mean[0]), float(mean[model.n_x])))
        flow = p[:, None] * model.transition
        p = flow.sum(axis=0)
        m = np.einsum("jk,jka->ka", flow, _dot(f, m[:, None, :]) + c) / np.maximum(p, FLOOR)[:, None]
    return out


def predicted(df: DataFrame, model: RegimeModel, key: list[str], horizon: int, order: str = "n", y: str = "y", **more: int) -> DataFrame:
    """Adds x_h and y_h for h = 1 .. horizon: what the row h before says of a row, and for a series' first h rows what the prior says."""
    rows = forecast(df, model, key, horizon, order, y, **more)
    w, prior = Window.partitionBy(*key).orderBy(order), prior_ahead(model, horizon)
    rows = rows.withColumn("_place", F.row_number().over(w))
    for h in range(1, horizon + 1):
        for name, at in (("x", 0), ("y", 1)):
            first = F.get(F.array(*(F.lit(v[at]) for v in prior)), F.col("_place") - 1)
            rows = rows.withColumn(f"{name}_{h}", F.when(F.col("_place") <= h, first).otherwise(F.get(F.lag(f"{name}_ahead", h).over(w), F.lit(h - 1))))
    return rows.drop("_place")


def path_sample(links: np.ndarray, p_smooth: np.ndarray, beta: np.ndarray, sizes: np.ndarray, uniforms: np.ndarray) -> np.ndarray:
    """One draw of each series' regimes from their posterior chain: the first from its smoothed law, each next one given the one before."""
    out = np.zeros(len(p_smooth), dtype=int)
    for n, rows in enumerate(steps(sizes)):
        p = p_smooth[rows] if n == 0 else links[rows, out[rows - 1]] * beta[rows]
        upto = np.cumsum(p, axis=1)
        out[rows] = ((uniforms[rows] * upto[:, -1])[:, None] > upto).sum(axis=1).clip(max=p.shape[1] - 1)
    return out
