"""The switching filter over streams: one state for each series, rows as they come."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..cluster import ship_package
from ..functions.model import RegimeModel
from ..operators.recursions import unknown_regimes

ADDED = "filter double, filter_var double, p_filter array<double>, r_filter int"


def filter_step(rows: pd.DataFrame, y: str, model: RegimeModel, before: tuple | None) -> tuple[dict, tuple | None]:
    """Estimates of ordered rows of one series that follow a state (last y, regimes' weights, means, second moments), and the new state.

    A state is a model of the row before: regimes by their weights, with these moments, so that the recursion goes on
    from it as from a series' first row. A row without y has no estimates and leaves no state: the next one begins anew.
    """
    values = rows[y].to_numpy(dtype=float)[:, None]
    none = np.isnan(values[:, 0])
    if none.any():
        out = {"filter": np.full(len(rows), np.nan), "filter_var": np.full(len(rows), np.nan), "p_filter": [None] * len(rows), "r_filter": pd.array([None] * len(rows), dtype="Int64")}
        cuts = [0, *(np.flatnonzero(np.diff(none)) + 1).tolist(), len(rows)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if none[a]:
                before = None
                continue
            found, before = filter_step(rows.iloc[a:b], y, model, before)
            for name, value in found.items():
                out[name][a:b] = value
        return out, before
    if before is None:
        found = unknown_regimes(values, np.array([len(values)]), model, smooth=False)
        skip = 0
    else:
        last, p, e, v = before
        found = unknown_regimes(np.concatenate([[[last]], values]), np.array([len(values) + 1]), model, smooth=False, start=(np.array(p), np.array(e)[:, None], np.array(v)[:, None, None]))
        skip = 1
    p = found["p_filter"]
    state = (float(values[-1, 0]), p[-1].tolist(), found["e_regime"][-1, :, 0].tolist(), found["v_regime"][-1, :, 0, 0].tolist())
    out = {"filter": found["filter"][skip:, 0], "filter_var": found["filter_var"][skip:, 0, 0], "p_filter": list(p[skip:]), "r_filter": p[skip:].argmax(axis=1)}
    return out, state


def switching_stream(df: DataFrame, model: RegimeModel, key: list[str], order: str = "n", y: str = "y") -> DataFrame:
    """Adds filter, filter_var, p_filter and r_filter to a stream (scalar model), in append mode.

    Rows of a series must come in order from batch to batch; within a batch they are sorted. A row whose place is not
    after its series' last one is late and gives no row. The state of a series is 3 K + 2 numbers, kept until the query ends.
    """
    ship_package(df.sparkSession)
    schema = T.StructType([*df.schema.fields, *T._parse_datatype_string(ADDED).fields])
    kind = df.schema[order].dataType.simpleString()
    keeps = T._parse_datatype_string(f"at {kind}, last double, p array<double>, e array<double>, v array<double>")

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order, kind="stable").reset_index(drop=True)
        at, before = None, None
        if state.exists:
            at, *before = state.get
            before = None if before[0] is None else before
            rows = rows[rows[order] > at].reset_index(drop=True)
        if len(rows):
            out, after = filter_step(rows, y, model, tuple(before) if before else None)
            state.update((rows[order].iloc[-1].item() if hasattr(rows[order].iloc[-1], "item") else rows[order].iloc[-1], *(after or (None, None, None, None))))
            yield rows.assign(**out)

    return df.groupBy(*key).applyInPandasWithState(run, schema, keeps, "append", GroupStateTimeout.NoTimeout)
