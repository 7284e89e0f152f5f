"""Filters over streams whose rows come late or out of order: rows wait until the watermark passes them, and go on in order."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..cluster import ship_package
from ..operators.recursions import _columns, _kinds
from ..operators.scan import Work


#: What follows a series' last released row: its time in microseconds, the recursion's state, the columns the next step needs, and late rows.
AFTER = T.StructType([T.StructField("at", T.LongType()), T.StructField("state", T.ArrayType(T.DoubleType())), T.StructField("before", T.ArrayType(T.DoubleType())), T.StructField("late", T.LongType())])


#: Event time in microseconds, in place of the timestamp: a number has no time zone on its way through Python.
AT = "_at"


def _ms(at: int) -> int:
    """Milliseconds, upwards: the watermark has passed a time only when it has passed all of its fractions."""
    return -(-at // 1000)


class InOrder(StatefulProcessor):
    """One series: the rows that wait, the state of the recursion after the last released row, and how many came too late.

    A timer stands at the first waiting row's time, and one `idle` milliseconds after the last released row: then the
    series' state goes, and a later row begins anew.
    """

    def __init__(self, work: Work, order: str, schema: T.StructType, outputs: tuple[str, ...], idle: int) -> None:
        self.work, self.order, self.schema, self.outputs, self.idle = work, order, schema, outputs, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.after = handle.getValueState("after", AFTER)

    def _held(self) -> tuple:
        return tuple(self.after.get()) if self.after.exists() else (None, None, None, 0)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        mark, (at, state, before, late) = timerValues.getCurrentWatermarkInMs(), self._held()
        came, missed = [], 0
        for row in rows:
            ts = row[AT]
            if ts is None or _ms(ts) <= mark or (at is not None and ts <= at):
                missed += 1
            else:
                came.append(row)
        if missed:
            self.after.update((at, state, before, late + missed))
        if came:
            self.waiting.appendList([tuple(row) for row in came])
            self.handle.registerTimer(_ms(min(row[AT] for row in came)))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        mark, (at, *_) = timerValues.getCurrentWatermarkInMs(), self._held()
        names = self.schema.names
        where, tie = names.index(AT), names.index(self.order)
        rows = [tuple(row) for row in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((row for row in rows if _ms(row[where]) <= mark), key=lambda row: (row[where], row[tie] is not None, row[tie]))
        rest = [row for row in rows if _ms(row[where]) > mark]
        if not ready:
            if not rows and at is not None and _ms(at) + self.idle <= mark:
                self.after.clear()
            return iter(())
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        out = self._released(ready)
        gone = _ms(ready[-1][where]) + self.idle
        if rest or gone > mark:
            self.handle.registerTimer(_ms(min(row[where] for row in rest)) if rest else gone)
        else:
            self.after.clear()
        return iter(out)

    def _released(self, rows: list[tuple]) -> list[Row]:
        work, names, (last, state, before, late) = self.work, self.schema.names, self._held()
        columns = work.columns
        values = {c: np.array([np.nan if row[names.index(c)] is None else row[names.index(c)] for row in rows], dtype=float) for c in columns}
        tail = [None if np.isnan(v[-1]) else float(v[-1]) for v in values.values()]
        values[columns[0]] = values[columns[0]][:, None]
        at = np.array([row[names.index(AT)] for row in rows])
        start = np.diff(at, prepend=at[0] if last is None else last) > 1000 * self.idle
        start[0] |= state is None
        entering = work.first() if state is None else np.array(state)
        made = work.rows(values, start, None if state is None else dict(zip(columns, before, strict=True)))
        found = _columns(work.passed(made, entering, work.last(), smooth=False), 1, self.outputs)
        self.after.update((int(at[-1]), work.advance(entering, work.summary(made)).tolist(), tail, late))
        plain = lambda v: None if v is None or (np.ndim(v) == 0 and np.isnan(v)) else v.tolist() if isinstance(v, np.ndarray) else float(v)
        full = Row(*names, *self.outputs, "late")
        return [full(*row, *(plain(found[c][i]) for c in self.outputs), late) for i, row in enumerate(rows)]

    def close(self) -> None:
        pass


def event_time_filter(df: DataFrame, work: Work, key: list[str], ts: str, order: str, delay: str = "10 minutes", idle: datetime.timedelta = datetime.timedelta(days=1), outputs: tuple[str, ...] = ("filter", "filter_var")) -> DataFrame:
    """A stream's rows with `outputs` of a scalar filter (scan.KnownRegimes, scan.UnknownRegimes, also of a fuzzy grid's model), in append mode.

    Rows of a series may come in any order from batch to batch: they wait until the watermark, `delay` behind the
    largest time seen, has passed them, and are released by (ts, order). The result is that of the batch filter over
    all rows that are not late: those behind the watermark, without a time, or not after the series' last released row
    give no row, and each released row carries in `late` how many of them its series has had. Where a series has no row for more than `idle` of event
    time it begins anew, and its state goes once the watermark has passed that.
    Needs the RocksDB state store.
    """
    ship_package(df.sparkSession)
    others = [c for c in df.columns if c != ts]
    rows = df.withWatermark(ts, delay).withColumn(AT, F.unix_micros(ts)).select(*others, AT)
    kinds = T._parse_datatype_string(_kinds(outputs, 1))
    schema = T.StructType([*rows.schema.fields, *kinds.fields, T.StructField("late", T.LongType())])
    processor = InOrder(work, order, rows.schema, outputs, int(idle.total_seconds() * 1000))
    found = rows.groupBy(*key).transformWithState(processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return found.withColumn(ts, F.timestamp_micros(AT)).select(*df.columns, *outputs, "late")
