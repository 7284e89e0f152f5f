"""Recursions over series that span many tasks, as scans.

A step of a recursion is an element, and elements compose: a chunk of rows has a summary, the composition of its steps.
The table is dealt once by ranges of (key, order), so that a series of any length spreads over tasks, and kept as a
reliable checkpoint. One pass gives the summary of each chunk; the driver scans these, a few numbers for each chunk, to
the state that enters each chunk from before and to what the rows after it say; a second pass works within chunks.
A series' first row is an element that forgets the state before it, so chunks and series need not end together. Within
a task the same is done with pieces of about the square root of its rows, all pieces at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..cluster import checkpointed, ship_package
from ..functions.model import RegimeModel

FLOOR = 1e-300
#: Rows of a chunk: what a task holds, with a few hundred bytes a row.
CHUNK = 50_000


def _dot(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (m @ v[..., None])[..., 0]


def _t(m: np.ndarray) -> np.ndarray:
    return np.swapaxes(m, -1, -2)


def log_sum(a: np.ndarray, axis: int | tuple[int, ...]) -> np.ndarray:
    """Logarithm of the sum of exponentials; of nothing but -inf it is -inf."""
    most = a.max(axis=axis, keepdims=True)
    most = np.where(np.isneginf(most), 0.0, most)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(a - most).sum(axis=axis)) + most.squeeze(axis)


def shares(a: np.ndarray, axis: int | tuple[int, ...]) -> np.ndarray:
    """Exponentials over their sum; zeros where all are -inf."""
    most = a.max(axis=axis, keepdims=True)
    out = np.exp(a - np.where(np.isneginf(most), 0.0, most))
    total = out.sum(axis=axis, keepdims=True)
    return out / np.where(total == 0, 1.0, total)


def key_starts(table: pa.Table | pa.RecordBatch, key: list[str], before: tuple | None) -> np.ndarray:
    """Which rows begin a series, in rows sorted by key after a row with the key `before`; a null is a value of its own."""
    new = np.zeros(table.num_rows, dtype=bool)
    if not len(new):
        return new
    new[0] = before is None or before != key_at(table, key, 0)
    for c in key:
        codes = table.column(c).combine_chunks() if isinstance(table, pa.Table) else table.column(c)
        codes = pc.dictionary_encode(codes, null_encoding="encode")
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return new


def key_at(table: pa.Table | pa.RecordBatch, key: list[str], i: int) -> tuple:
    return tuple(table.column(c)[i].as_py() for c in key)


def pieces(n: int) -> list[np.ndarray]:
    """Rows at each place of pieces of about sqrt(n) rows, all pieces side by side; the last piece may be shorter."""
    size = max(1, math.isqrt(max(n - 1, 0)) + 1)
    at = np.arange(-(-n // size)) * size
    return [at[: np.searchsorted(at, n - s, side="left")] + s for s in range(min(size, n))]


class Work:
    """A recursion as a scan over rows. `columns` of the row before are needed for the step to a row.

    rows() makes what the passes need of a table; `start` marks rows that begin anew.
    """

    columns: list[str] = []

    def rows(self, values: dict[str, np.ndarray], start: np.ndarray, before: dict | None) -> dict:
        """Elements of all rows. `before` has the columns of the row before the first one, if that is of its series."""
        raise NotImplementedError

    def summary(self, rows: dict) -> np.ndarray:
        """The composition of all elements, as numbers."""
        raise NotImplementedError

    def first(self) -> np.ndarray:
        """Any state; the first row of all forgets it."""
        raise NotImplementedError

    def last(self) -> np.ndarray:
        """What no rows say of a state."""
        raise NotImplementedError

    def advance(self, state: np.ndarray, summary: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def retreat(self, said: np.ndarray, summary: np.ndarray) -> np.ndarray:
        raise NotImplementedError


class KnownRegimes(Work):
    """Elements of a Gaussian state z = (x, y) under known regimes.

    An element says that z given the state before and this row's y is Gaussian with mean A z + b and covariance C, and
    that y's density given the state before is that of information eta, J. An observed y is a part of z without
    variance; a null one is a step without observation. A row without a regime in [0, K - 1] is none: the row after it
    begins anew.
    """

    def __init__(self, model: RegimeModel, y: str = "y", r: str = "r") -> None:
        self.model, self.columns = model, [y, r]
        self.f, self.q, self.c = model.regression()

    def own(self, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and covariance of z for regimes r, fractions between neighbours."""
        low = np.clip(np.floor(r).astype(int), 0, len(self.model.mean) - 1)
        high, w = np.minimum(low + 1, len(self.model.mean) - 1), r - low
        mix = lambda m, w: (1 - w) * m[low] + w * m[high]
        return mix(self.model.mean, w[:, None]), mix(self.model.gamma, w[:, None, None])

    def steps(self, r: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """F, Q and constant of the steps from regimes r to regimes `after`; each row decides whether it mixes pairs."""
        k = len(self.model.mean) - 1
        low, high = (np.clip(np.floor(x).astype(int), 0, k) for x in (r, after))
        f, q, c = self.f[low, high], self.q[low, high], self.c[low, high]
        mixed = np.flatnonzero((low != r) | (high != after))
        if len(mixed):
            a, b, i, j = (x[mixed] for x in (r - low, after - high, low, high))
            a, b = a[:, None, None], b[:, None, None]
            i2, j2, s = np.minimum(i + 1, k), np.minimum(j + 1, k), self.model.sigma
            sigma = (1 - a) * (1 - b) * s[i, j] + (1 - a) * b * s[i, j2] + a * (1 - b) * s[i2, j] + a * b * s[i2, j2]
            (mean, gamma), (mean2, gamma2) = self.own(r[mixed]), self.own(after[mixed])
            f[mixed] = _t(np.linalg.solve(gamma, sigma))
            q[mixed] = gamma2 - f[mixed] @ sigma
            c[mixed] = mean2 - _dot(f[mixed], mean)
        return f, q, c

    def rows(self, values: dict[str, np.ndarray], start: np.ndarray, before: dict | None) -> dict:
        y, r = (values[c] for c in self.columns)
        x, h = self.model.n_x, self.model.mean.shape[1]
        good = (r >= 0) & (r <= len(self.model.mean) - 1)
        r = np.where(good, r, 0.0)
        r0 = np.concatenate([[0.0], r[:-1]])
        good0 = np.concatenate([[False], good[:-1]])
        if before is not None and not start[0]:
            held = before[self.columns[1]]
            good0[0] = held is not None and 0 <= held <= len(self.model.mean) - 1
            r0[0] = held if good0[0] else 0.0
        start = start | ~good0 | ~good
        f, q, c = self.steps(r0, r)
        mean, gamma = self.own(r)
        f[start], q[start], c[start] = 0.0, gamma[start], mean[start]
        seen = ~np.isnan(y).any(axis=1)
        inverse = np.linalg.inv(q[:, x:, x:])
        fy, d = f[:, x:], np.where(seen[:, None], y, 0.0) - c[:, x:]
        gain = np.zeros((len(y), h, h - x))
        gain[:, :x], gain[:, x:] = q[:, :x, x:] @ inverse, np.eye(h - x)
        on = seen[:, None, None]
        a = np.where(on, f - gain @ fy, f)
        b = np.where(seen[:, None], c + _dot(gain, d), c)
        cov = np.where(on, q - gain @ q[:, x:], q)
        to = _t(fy) @ inverse
        eta, info = np.where(seen[:, None], _dot(to, d), 0.0), np.where(on, to @ fy, 0.0)
        a[~good], b[~good], cov[~good], eta[~good], info[~good] = 0.0, 0.0, 0.0, 0.0, 0.0
        return {"elements": (a, b, (cov + _t(cov)) / 2, eta, info), "good": good, "start": start, "seen": seen & good, "f": f, "q": q, "c": c, "y": y}

    @staticmethod
    def compose(one: tuple, two: tuple) -> tuple:
        (a1, b1, c1, e1, j1), (a2, b2, c2, e2, j2) = one, two
        inverse = np.linalg.inv(np.eye(a1.shape[-1]) + c1 @ j2)
        left, right = a2 @ inverse, _t(a1) @ _t(inverse)
        return left @ a1, _dot(left, b1 + _dot(c1, e2)) + b2, left @ c1 @ _t(a2) + c2, _dot(right, e2 - _dot(j2, b1)) + e1, right @ j2 @ a1 + j1

    @staticmethod
    def forward(state: tuple, element: tuple) -> tuple:
        (m, p), (a, b, c, eta, info) = state, element
        left = a @ np.linalg.inv(np.eye(a.shape[-1]) + p @ info)
        return _dot(left, m + _dot(p, eta)) + b, left @ p @ _t(a) + c

    @staticmethod
    def backward(said: tuple, element: tuple) -> tuple:
        (eta, info), (a, b, c, own, own_info) = said, element
        right = _t(a) @ np.linalg.inv(np.eye(a.shape[-1]) + info @ c)
        return _dot(right, eta - _dot(info, b)) + own, right @ info @ a + own_info

    def _flat(self, parts: tuple) -> np.ndarray:
        return np.concatenate([p.ravel() for p in parts])

    def _shaped(self, flat: np.ndarray, kinds: str) -> tuple:
        h, out, at = self.model.mean.shape[1], [], 0
        for kind in kinds:
            size = h if kind == "v" else h * h
            out.append(np.asarray(flat[at : at + size]).reshape((h,) if kind == "v" else (h, h)))
            at += size
        return tuple(out)

    def _totals(self, elements: tuple, at: list[np.ndarray]) -> tuple:
        total = tuple(e[at[0]].copy() for e in elements)
        for rows in at[1:]:
            for all_, new in zip(total, self.compose(tuple(t[: len(rows)] for t in total), tuple(e[rows] for e in elements)), strict=True):
                all_[: len(rows)] = new
        return total

    def summary(self, rows: dict) -> np.ndarray:
        total = self._totals(rows["elements"], pieces(len(rows["y"])))
        out = tuple(t[0] for t in total)
        for i in range(1, len(total[0])):
            out = self.compose(out, tuple(t[i] for t in total))
        return self._flat(out)

    def first(self) -> np.ndarray:
        h = self.model.mean.shape[1]
        return np.zeros(h + h * h)

    last = first

    def advance(self, state: np.ndarray, summary: np.ndarray) -> np.ndarray:
        return self._flat(self.forward(self._shaped(state, "vm"), self._shaped(summary, "mvmvm")))

    def retreat(self, said: np.ndarray, summary: np.ndarray) -> np.ndarray:
        return self._flat(self.backward(self._shaped(said, "vm"), self._shaped(summary, "mvmvm")))

    def passed(self, rows: dict, state: np.ndarray, said: np.ndarray, smooth: bool = True) -> dict[str, np.ndarray]:
        """filter, filter_var, predict, log_l (of the row given those before) and, if wanted, smooth, smooth_var; NaN where there is none."""
        elements, x = rows["elements"], self.model.n_x
        n, h = rows["y"].shape[0], self.model.mean.shape[1]
        at = pieces(n)
        total = self._totals(elements, at)
        m, p = np.zeros((n, h)), np.zeros((n, h, h))
        m0, p0 = np.zeros((n, h)), np.zeros((n, h, h))
        enter, come = self._shaped(state, "vm"), []
        for i in range(len(at[0])):
            come.append(enter)
            enter = self.forward(enter, tuple(t[i] for t in total))
        now = tuple(np.stack(c) for c in zip(*come, strict=True))
        for of in at:
            now = tuple(v[: len(of)] for v in now)
            m0[of], p0[of] = now
            now = self.forward(now, tuple(e[of] for e in elements))
            m[of], p[of] = now
        f, q, c = rows["f"], rows["q"], rows["c"]
        ahead = _dot(f, m0) + c
        spread = f @ p0 @ _t(f) + q
        s, d = spread[:, x:, x:], rows["y"] - ahead[:, x:]
        log_l = -0.5 * (np.linalg.slogdet(s)[1] + (d * np.linalg.solve(s, d[..., None])[..., 0]).sum(axis=1) + (h - x) * math.log(2 * math.pi))
        out = {"filter": m[:, :x], "filter_var": p[:, :x, :x], "predict": np.where(rows["start"][:, None], np.nan, ahead[:, :x]), "log_l": np.where(rows["seen"], log_l, 0.0)}
        if smooth:
            leave, go = self._shaped(said, "vm"), []
            for i in reversed(range(len(at[0]))):
                go.append(leave)
                leave = self.backward(leave, tuple(t[i] for t in total))
            eta, info = (np.stack(g) for g in zip(*reversed(go), strict=True))
            etas, infos = np.zeros((n, h)), np.zeros((n, h, h))
            for of in reversed(at):
                k = len(of)
                etas[of], infos[of] = eta[:k], info[:k]
                eta[:k], info[:k] = self.backward((eta[:k], info[:k]), tuple(e[of] for e in elements))
            inverse = np.linalg.inv(np.eye(h) + p @ infos)
            out |= {"smooth": _dot(inverse, m + _dot(p, etas))[:, :x], "smooth_var": (inverse @ p)[:, :x, :x]}
        for name, value in out.items():
            if name != "log_l":
                value[~rows["good"]] = np.nan
        return out


class UnknownRegimes(Work):
    """Elements of regimes and their moments when F_yx = 0, scaled: p_k, p_k E(x), p_k E(xx') move on linearly.

    A row without y has no estimates, and the row after it begins anew, as what follows depends on it.
    """

    def __init__(self, model: RegimeModel, y: str = "y") -> None:
        self.model, self.columns = model, [y]
        x, k = model.n_x, len(model.mean)
        self.f, self.q, self.c = model.regression()
        self.fxx, self.fxy, self.fyy = self.f[:, :, :x, :x], self.f[:, :, :x, x:], self.f[:, :, x:, x:]
        qyy = self.q[:, :, x:, x:]
        self.inverse, self.logdet = np.linalg.inv(qyy), np.linalg.slogdet(qyy)[1] + qyy.shape[-1] * math.log(2 * math.pi)
        self.g = self.q[:, :, :x, x:] @ self.inverse
        self.own_cov = self.q[:, :, :x, :x] - self.g @ self.q[:, :, x:, :x]
        self.width = k * (1 + x + x * x)

    def _split(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k, x = len(self.model.mean), self.model.n_x
        lead = v.shape[:-1]
        return v[..., :k], v[..., k : k + k * x].reshape(*lead, k, x), v[..., k + k * x :].reshape(*lead, k, x, x)

    def _joined(self, p: np.ndarray, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        lead = p.shape[:-1]
        return np.concatenate([p, s.reshape(*lead, -1), t.reshape(*lead, -1)], axis=-1)

    def begun(self, y: np.ndarray) -> np.ndarray:
        """States after a first row."""
        model, x = self.model, self.model.n_x
        inverse = np.linalg.inv(model.gamma[:, x:, x:])
        d = y[:, None, :] - model.mean[:, x:]
        density = np.exp(-0.5 * ((d * _dot(inverse, d)).sum(axis=-1) + np.linalg.slogdet(model.gamma[:, x:, x:])[1] + d.shape[-1] * math.log(2 * math.pi)))
        p = model.marginal * density + FLOOR
        p /= p.sum(axis=1, keepdims=True)
        gain = model.gamma[:, :x, x:] @ inverse
        e = model.mean[:, :x] + _dot(gain, d)
        v = model.gamma[:, :x, :x] - gain @ model.gamma[:, x:, :x] + e[..., :, None] * e[..., None, :]
        return self._joined(p, p[..., None] * e, p[..., None, None] * v)

    def rows(self, values: dict[str, np.ndarray], start: np.ndarray, before: dict | None) -> dict:
        y = values[self.columns[0]]
        good = ~np.isnan(y).any(axis=1)
        y = np.where(good[:, None], y, 0.0)
        y0, good0 = np.concatenate([y[:1], y[:-1]]), np.concatenate([[False], good[:-1]])
        if before is not None and not start[0]:
            held = before[self.columns[0]]
            if held is not None and not np.isnan(np.atleast_1d(np.asarray(held, dtype=float))).any():
                y0[0], good0[0] = held, True
        start = start | ~good0 | ~good
        d = y[:, None, None, :] - _dot(self.fyy, y0[:, None, None, :]) - self.c[:, :, self.model.n_x :]
        with np.errstate(divide="ignore"):
            lu = np.log(self.model.transition) - 0.5 * (np.minimum((d * _dot(self.inverse, d)).sum(axis=-1), 1e300) + self.logdet)
        lu -= lu.max(axis=(1, 2), keepdims=True)
        lu[start] = 0.0
        u = np.exp(lu) + FLOOR
        base = _dot(self.fxy, y0[:, None, None, :]) + self.c[:, :, : self.model.n_x]
        u[start] = 1.0
        return {"u": u, "lu": lu, "h": _dot(self.g, d) + base, "base": base, "start": start, "good": good, "begun": self.begun(y), "y": y}

    def pushed(self, v: np.ndarray, rows: dict, of: np.ndarray) -> np.ndarray:
        """Vectors (m, B, width) moved over one row each, unscaled."""
        p, s, t = self._split(v)
        u, h = rows["u"][of][:, None], rows["h"][of][:, None]
        flow = p[..., :, None] * u
        fs = _dot(self.fxx, s[..., :, None, :])
        cross = fs[..., :, None] * h[..., None, :]
        after_s = (u[..., None] * fs + flow[..., None] * h).sum(axis=-3)
        hh = self.own_cov + h[..., :, None] * h[..., None, :]
        after_t = (u[..., None, None] * (self.fxx @ t[..., :, None, :, :] @ _t(self.fxx) + cross + _t(cross)) + flow[..., None, None] * hh).sum(axis=-4)
        out = self._joined(flow.sum(axis=-2), after_s, after_t)
        return np.where(rows["start"][of][:, None, None], p.sum(axis=-1, keepdims=True) * rows["begun"][of][:, None], out)

    def _totals(self, rows: dict, at: list[np.ndarray]) -> np.ndarray:
        k = len(self.model.mean)
        total = np.broadcast_to(np.eye(self.width), (len(at[0]), self.width, self.width)).copy()
        for of in at:
            new = self.pushed(total[: len(of)], rows, of)
            total[: len(of)] = new / np.maximum(new[..., :k].sum(axis=(1, 2)), FLOOR)[:, None, None]
        return total

    def summary(self, rows: dict) -> np.ndarray:
        total = self._totals(rows, pieces(len(rows["y"])))
        out = total[0]
        for one in total[1:]:
            out = out @ one
            out = out / out[:, : len(self.model.mean)].sum()
        return out.ravel()

    def first(self) -> np.ndarray:
        v = np.zeros(self.width)
        v[: len(self.model.mean)] = 1 / len(self.model.mean)
        return v

    def last(self) -> np.ndarray:
        return np.ones(len(self.model.mean))

    def advance(self, state: np.ndarray, summary: np.ndarray) -> np.ndarray:
        v = np.asarray(state) @ np.asarray(summary).reshape(self.width, self.width)
        return v / v[: len(self.model.mean)].sum()

    def retreat(self, said: np.ndarray, summary: np.ndarray) -> np.ndarray:
        k = len(self.model.mean)
        beta = np.asarray(summary).reshape(self.width, self.width)[:k, :k] @ np.asarray(said)
        return beta / beta.max()

    def passed(self, rows: dict, state: np.ndarray, said: np.ndarray, smooth: bool = True) -> dict[str, np.ndarray]:
        """What recursions.unknown_regimes() gives, for all rows of a chunk."""
        k, x, n = len(self.model.mean), self.model.n_x, len(rows["y"])
        at = pieces(n)
        total = self._totals(rows, at)
        v, v0 = np.zeros((n, self.width)), np.zeros((n, self.width))
        now, come = np.asarray(state), []
        for one in total:
            come.append(now)
            now = self.advance(now, one)
        now = np.stack(come)
        for of in at:
            v0[of] = now[: len(of)]
            now = self.pushed(now[: len(of), None], rows, of)[:, 0]
            now /= now[:, :k].sum(axis=1, keepdims=True)
            v[of] = now
        p, s, t = self._split(v)
        p0, s0, _ = self._split(v0)
        p0 = np.where(rows["start"][:, None], 1.0 / k, p0)
        link = rows["u"] / np.einsum("nj,njk->n", p0, rows["u"])[:, None, None]
        safe = np.maximum(p, FLOOR)
        e, second = s / safe[..., None], t / safe[..., None, None]
        flow = p0[:, :, None] * self.model.transition
        ahead = np.einsum("njk,njka->na", flow, _dot(self.fxx, (s0 / np.maximum(p0, FLOOR)[..., None])[:, :, None, :]) + rows["base"])

        def mixture(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            m = np.einsum("nj,nja->na", weights, e)
            return m, np.einsum("nj,njab->nab", weights, second) - m[:, :, None] * m[:, None, :]

        mean, var = mixture(p)
        out = {"filter": mean, "filter_var": var, "predict": np.where(rows["start"][:, None], np.nan, ahead), "p_filter": p, "e_regime": e, "v_regime": second, "link": link, "p_before": p0}
        out |= {"log_before": np.log(np.maximum(p0, FLOOR)), "log_link": rows["lu"]}
        if smooth:
            beta, leave, go = np.ones((n, k)), np.asarray(said), []
            for one in total[::-1]:
                go.append(leave)
                leave = self.retreat(leave, one)
            b = np.stack(go[::-1])
            for of in reversed(at):
                beta[of] = b[: len(of)]
                after = np.where(rows["start"][of][:, None], 1.0, (rows["u"][of] * b[: len(of)][:, None, :]).sum(axis=2))
                b[: len(of)] = after / after.max(axis=1, keepdims=True)
            both = p * beta
            beta /= both.sum(axis=1)[:, None]
            ps = p * beta
            mean, var = mixture(ps)
            out |= {"smooth": mean, "smooth_var": var, "p_smooth": ps, "beta": beta, "log_beta": np.log(np.maximum(beta, FLOOR))}
        for name in ("filter", "filter_var", "predict", "p_filter", "smooth", "smooth_var", "p_smooth"):
            if name in out:
                out[name][~rows["good"]] = np.nan
        return out


class Path(Work):
    """Draws of a chain as maps from the regime before to the regime: with the same uniforms they compose over chunks.

    The law of a row's regime given the one before is its link times what later rows say; a first row's is its smoothed
    law, whatever stood before.
    """

    def __init__(self, regimes: int) -> None:
        self.regimes = regimes

    def maps(self, link: np.ndarray, p: np.ndarray, beta: np.ndarray, start: np.ndarray, u: np.ndarray) -> np.ndarray:
        law = np.where(start[:, None, None], p[:, None, :], link * beta[:, None, :])
        upto = np.cumsum(np.nan_to_num(law), axis=2)
        return ((u[:, None] * upto[:, :, -1])[:, :, None] > upto).sum(axis=2).clip(max=self.regimes - 1)

    def drawn(self, maps: np.ndarray, state: int) -> np.ndarray:
        """The regime of each row, from that before the first one: maps of pieces, their scan, and a pass within pieces."""
        at = pieces(len(maps))
        total = self._totals(maps, at)
        now = np.zeros(len(at[0]), dtype=int)
        for i, one in enumerate(total):
            now[i] = state
            state = int(one[state])
        out = np.zeros(len(maps), dtype=int)
        for of in at:
            now = now[: len(of)]
            now = maps[of, now]
            out[of] = now
        return out

    def _totals(self, maps: np.ndarray, at: list[np.ndarray]) -> np.ndarray:
        total = np.tile(np.arange(self.regimes), (len(at[0]), 1))
        for of in at:
            total[: len(of)] = np.take_along_axis(maps[of], total[: len(of)], axis=1)
        return total

    def summary(self, maps: np.ndarray) -> np.ndarray:
        out = np.arange(self.regimes)
        for one in self._totals(maps, pieces(len(maps))):
            out = one[out]
        return out


def draw_paths(scan: Scan, seed: str, added: str, make: Callable[[pa.Table, dict, dict, int], dict]) -> DataFrame:
    """Scan.columns() with r: one draw of each series' regimes from their posterior chain, by the uniforms in the column `seed`; null where there is no estimate."""
    path = Path(len(scan.work.model.mean))

    def maps(table: pa.Table, found: dict, rows: dict) -> np.ndarray:
        return path.maps(found["link"], found["p_smooth"], found["beta"], rows["start"], numbers(table, seed))

    found = scan.summaries(lambda table, rows, found: path.summary(maps(table, found, rows)), with_estimates=True)
    state, enters = 0, {}
    for chunk in sorted(found):
        enters[chunk] = state
        state = int(found[chunk][state])
    shipped = scan.given.sparkSession.sparkContext.broadcast(enters)

    def drawn(table: pa.Table, found: dict, rows: dict, chunk: int) -> dict:
        r = pd.array(path.drawn(maps(table, found, rows), shipped.value[chunk]), dtype="Int64")
        r[~rows["good"]] = None
        return make(table, found, rows, chunk) | {"r": r}

    return scan.columns(f"{added}, r int" if added else "r int", drawn)


def chunked(df: DataFrame, key: list[str], order: str, rows: int = CHUNK) -> DataFrame:
    """df in chunks of about `rows` rows, ordered by (key, order) within and over them, with their number _chunk, as a reliable checkpoint."""
    parts = max(1, -(-df.count() // rows))
    ranged = df.repartitionByRange(parts, *key, order).sortWithinPartitions(*key, order)
    return checkpointed(ranged.withColumn("_chunk", F.spark_partition_id().cast("long")))


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    found = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(found).combine_chunks() if found else None


def numbers(table: pa.Table | pa.RecordBatch, column: str) -> np.ndarray:
    """A numeric column as doubles, or one of lists as (N, n), null as NaN."""
    data = table.column(column)
    if pa.types.is_list(data.type):
        rows = data.to_pylist()
        width = max((len(x) for x in rows if x is not None), default=1)
        return np.array([[np.nan if v is None else v for v in x] if x is not None else [np.nan] * width for x in rows], dtype=float)
    return pc.cast(data, pa.float64()).to_numpy(zero_copy_only=False) if isinstance(data, pa.Array) else pc.cast(data, pa.float64()).to_numpy()


def values_of(table: pa.Table | pa.RecordBatch, work: Work) -> dict[str, np.ndarray]:
    """The columns of a work: the first one (y) as (N, n_y), others as (N,)."""
    out = {c: numbers(table, c) for c in work.columns}
    y = out[work.columns[0]]
    return out | {work.columns[0]: y[:, None] if y.ndim == 1 else y}


def edges(chunks: DataFrame, key: list[str], columns: list[str]) -> dict[int, tuple]:
    """Of each chunk that has rows: the key of the row before it, and that row's columns."""
    names = list(dict.fromkeys([*key, *columns]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last = None, None
        for batch in batches:
            if batch.num_rows:
                first, last = batch.slice(0, 1) if first is None else first, batch.slice(batch.num_rows - 1)
        if first is not None:
            for end, one in ((False, first), (True, last)):
                yield pa.RecordBatch.from_arrays([pa.array([end]), *one.columns], names=["_end", *names, "_chunk"])

    rows = chunks.select(*names, "_chunk")
    found = rows.mapInArrow(run, T.StructType([T.StructField("_end", T.BooleanType()), *rows.schema.fields])).toArrow().to_pylist()
    out, before = {}, None
    for row in sorted(found, key=lambda r: (r["_chunk"], r["_end"])):
        if not row["_end"]:
            out[row["_chunk"]] = before
        else:
            before = (tuple(row[c] for c in key), {c: row[c] for c in columns})
    return out


class Scan:
    """A table in chunks, with the states that enter each of them, for one work."""

    def __init__(self, df: DataFrame, key: list[str], order: str, work: Work, rows: int = CHUNK) -> None:
        ship_package(df.sparkSession)
        self.given, self.key, self.work = df, key, work
        self.chunks = chunked(df, key, order, rows)
        self.before = df.sparkSession.sparkContext.broadcast(edges(self.chunks, key, work.columns))
        found = self.summaries(lambda table, rows: work.summary(rows))
        state, said, self.states = work.first(), work.last(), {}
        for chunk in sorted(found):
            self.states[chunk] = state
            state = work.advance(state, found[chunk])
        for chunk in sorted(found, reverse=True):
            self.states[chunk] = (self.states[chunk], said)
            said = work.retreat(said, found[chunk])
        self.shipped = df.sparkSession.sparkContext.broadcast(self.states)

    def _rows(self, table: pa.Table) -> tuple[dict, int]:
        chunk = table.column("_chunk")[0].as_py()
        held = self.before.value.get(chunk)
        start = key_starts(table, self.key, held[0] if held else None)
        return self.work.rows(values_of(table, self.work), start, held[1] if held else None), chunk

    def summaries(self, make: Callable[..., np.ndarray], with_estimates: bool = False) -> dict[int, np.ndarray]:
        """Some numbers for each chunk, on the driver, from its table and elements and, if wanted, its estimates."""
        self_ = self._light()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = _whole(batches)
            if table is not None:
                more = ()
                if with_estimates:
                    found, rows, chunk = self_.passed(table, True)
                    more = (found,)
                else:
                    rows, chunk = self_._rows(table)
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([np.asarray(make(table, rows, *more), dtype=float)])], names=["chunk", "numbers"])

        found = self.chunks.mapInArrow(run, "chunk long, numbers array<double>").collect()
        return {r["chunk"]: np.array(r["numbers"]) for r in found}

    def _light(self) -> Scan:
        """This, without what cannot be sent to a task."""
        out = object.__new__(Scan)
        out.key, out.work, out.before = self.key, self.work, self.before
        out.shipped = getattr(self, "shipped", None)
        return out

    def passed(self, table: pa.Table, smooth: bool) -> tuple[dict[str, np.ndarray], dict, int]:
        rows, chunk = self._rows(table)
        return self.work.passed(rows, *self.shipped.value[chunk], smooth), rows, chunk

    def columns(self, added: str, make: Callable[[pa.Table, dict, dict, int], dict], smooth: bool = True) -> DataFrame:
        """The rows of the table with the columns that `make` gives from a chunk's table, its estimates and its elements."""
        self_, names = self._light(), self.given.columns
        kinds = T._parse_datatype_string(added)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = _whole(batches)
            if table is not None:
                found, rows, chunk = self_.passed(table, smooth)
                yield from beside(table.select(names), make(table, found, rows, chunk), kinds)

        return self.chunks.mapInArrow(run, T.StructType([*self.given.schema.fields, *kinds.fields]))


def beside(table: pa.Table, made: dict, kinds: T.StructType) -> Iterator[pa.RecordBatch]:
    """The rows of a table, as they are, with further columns; NaN is null."""
    for field in to_arrow_schema(kinds):
        table = table.append_column(field.name, pa.array(pd.Series(made[field.name]) if not isinstance(made[field.name], list) else made[field.name], field.type, from_pandas=True))
    yield from table.to_batches(max_chunksize=10_000)
