"""Removal of byte strings of a given length that occur more than once, in one document or in several."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

ROOT = 0x9E3779B97F4A7C15 | 1
PIECE = 1 << 19
#: Suffixes in a cell, pass by pass, after the first pass over whole anchors.
PASSES = (38, 10, 1)
_BYTE = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 12), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Slices:
    """Hashes of any slices of a byte string, from one running sum modulo 2**64."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * _power(ROOT, n, "up"), out=self.sums[1:])
        self.down = _power(pow(ROOT, -1, 2**64), n + 1, "down")

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def each(self, length: int, start: int, n: int) -> np.ndarray:
        """of() for n slices of one length at start, start + 1, ..."""
        return mixed((self.sums[start + length : start + length + n] - self.sums[start : start + n]) * self.down[start : start + n] + np.uint64(length))


def least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    n = len(h) - w + 1
    grid = np.full(-(-len(h) // w) * w, 2**64 - 1, dtype=h.dtype)
    grid[: len(h)] = h
    grid = grid.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Rows at, first, last, core, hull: windows of `length` bytes that start at first to last have their least gram at `at`.

    Equal windows have their least gram at the same place, so they meet under the same core (the gram's hash). The hull
    is the hash of all bytes of these windows.
    """
    side = length - gram
    found = []
    for a in range(0, len(data) - length + 1, PIECE):
        part = data[a : a + PIECE + length - 1]
        n = len(part) - length + 1
        slices = Slices(part)
        h = slices.each(gram, 0, n + side)
        place = np.uint64(0xFFFFF)
        at = (least((h & ~place) | np.arange(len(h), dtype=np.uint64), side + 1) & place).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        last = np.append(first[1:], n) - 1
        at = at[first]
        found.append(np.stack([at + a, first + a, last + a, h[at].view(np.int64), slices.of(first, last + length).view(np.int64)]))
    return np.concatenate(found, axis=1)


def _bytes(text: object) -> np.ndarray:
    return np.frombuffer(text.encode() if isinstance(text, str) else b"", dtype=np.uint8)


def _find_anchors(batches: Iterator[pd.DataFrame], length: int, gram: int) -> Iterator[pd.DataFrame]:
    def table(found: list, ids: list) -> pd.DataFrame:
        at, first, last, core, hull = np.concatenate(found, axis=1)
        doc, uid, times = (np.array(x, dtype=np.int64) for x in zip(*ids, strict=True))
        return pd.DataFrame({"core": core, "hull": hull, "_doc": np.repeat(doc, times), "_uid": np.repeat(uid, times), "at": at, "first": first, "last": last})

    found, ids, rows = [], [], 0
    for batch in batches:
        for doc, uid, text in zip(batch["_doc"], batch["_uid"], batch["_text"], strict=True):
            data = _bytes(text)
            if len(data) >= length:
                found.append(anchors(data, length, gram))
                ids.append((doc, uid, found[-1].shape[1]))
                rows += ids[-1][2]
            if rows > 50_000:
                yield table(found, ids)
                found, ids, rows = [], [], 0
    if found:
        yield table(found, ids)


def _split(batches: Iterator[pd.DataFrame], length: int, width: int) -> Iterator[pd.DataFrame]:
    """Cuts runs of windows at multiples of `width` before their anchor; core: the bytes that all windows of such a cell share."""
    for batch in batches:
        for doc, uid, text, ats, firsts, lasts in zip(*(batch[c] for c in ("_doc", "_uid", "_text", "_at", "_first", "_last")), strict=True):
            data = _bytes(text)
            order = np.argsort(ats)
            ats, firsts, lasts = (np.asarray(x, dtype=np.int64)[order] for x in (ats, firsts, lasts))
            for a in range(0, len(ats), 4096):
                at, first, last = ats[a : a + 4096], firsts[a : a + 4096], lasts[a : a + 4096]
                low_cell, high_cell = (at - last) // width, (at - first) // width
                times = high_cell - low_cell + 1
                row = np.repeat(np.arange(len(at)), times)
                cell = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + low_cell[row]
                at, low, high = at[row], np.maximum(first[row], at[row] - (cell + 1) * width + 1), np.minimum(last[row], at[row] - cell * width)
                base = int(low.min())
                slices = Slices(data[base : int(high.max()) + length])
                core = slices.of(at - cell * width - base, at - (cell + 1) * width + 1 + length - base)
                core = mixed(core + cell.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
                yield pd.DataFrame({"core": core.view(np.int64), "hull": slices.of(low - base, high + length - base).view(np.int64), "_doc": doc, "_uid": uid, "at": at, "first": low, "last": high})


def _cut(batch: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, None]]:
    kept, spans = [], []
    for text, lows, highs in zip(batch["_bytes"], batch["_lows"], batch["_highs"], strict=True):
        raw = text.encode() if isinstance(text, str) else b""
        if lows is None or not len(lows):
            kept.append(raw)
            spans.append([])
            continue
        change = np.zeros(len(raw) + 1, dtype=np.int64)
        np.add.at(change, np.asarray(lows), 1)
        np.add.at(change, np.asarray(highs), -1)
        gone = (np.cumsum(change[:-1]) > 0).astype(np.int8)
        kept.append(np.frombuffer(raw, dtype=np.uint8)[gone == 0].tobytes())
        edges = np.flatnonzero(np.diff(gone, prepend=0, append=0))
        spans.append([{"start": int(s), "end": int(e)} for s, e in edges.reshape(-1, 2)])
    yield pd.DataFrame({"kept": pd.Series(kept, dtype=object), "spans": pd.Series(spans, dtype=object)}), None


def remove_repeats(docs: DataFrame, text: str = "text", length: int = 200, gram: int = 50, carry: list[str] | None = None) -> DataFrame:
    """Adds kept (the bytes that are left) and spans (removed runs, byte offsets) to the columns `carry` and the text.

    Each byte is removed that a string of `length` bytes covers which also starts anywhere else. Suffixes are ordered
    only through `length` bytes, in passes that each compare more of it: first the gram at the suffixes' anchor, then
    the bytes that all suffixes of a cell share, for cells of fewer and fewer suffixes around the anchor, down to one.
    After each pass groups of one leave; a cell all of whose bytes repeat as a whole is settled; groups that are equal
    after the last pass are exactly the repeated windows. A null text is empty; equal rows repeat each other; texts
    shorter than `length` are kept whole; an empty table gives an empty one. Columns named kept and spans are
    replaced. That bytes are equal is known by 64-bit hashes of them.
    """
    names = carry if carry is not None else [c for c in docs.columns if c not in (text, "kept", "spans")]
    carry = [f"_c{i}" for i in range(len(names))]
    keyed = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(names, carry, strict=True)), F.col(text).alias("_text"), F.coalesce(F.xxhash64(*[F.col(f"`{c}`") for c in names]), F.lit(0)).alias("_doc"), F.xxhash64(F.lit(7), text).alias("_uid"))
    ids = ["_doc", "_uid"]
    kinds = "core long, hull long, _doc long, _uid long, at int, first int, last int"
    texts = keyed.select(*ids, "_text")
    cells = texts.mapInPandas(lambda it: _find_anchors(it, length, gram), kinds)
    settled, tables = [], []
    for width in (*PASSES, None):
        judged = shared.save(_judge(cells), "repeats")
        tables.append(judged)
        settled.append(judged.filter("settled").select(*ids, "first", (F.col("last") + length).alias("end")))
        if width is None:
            break
        lists = judged.filter("open").groupBy(*ids).agg(*(F.collect_list(c).alias(f"_{c}") for c in ("at", "first", "last")))
        cells = texts.join(lists, ids).mapInPandas(lambda it, width=width: _split(it, length, width), kinds)
    removed = functools.reduce(DataFrame.unionByName, settled)
    spans = removed.groupBy(*ids).agg(F.collect_list("first").alias("_lows"), F.collect_list("end").alias("_highs"))
    joined = keyed.join(spans, ids, "left").select(*carry, "_text", F.col("_text").alias("_bytes"), "_lows", "_highs")
    return shared.beside(joined, [*carry, "_text"], "kept binary, spans array<struct<start: int, end: int>>", lambda: _cut).toDF(*names, text, "kept", "spans")


def _judge(cells: DataFrame) -> DataFrame:
    """settled: the cell's hull occurs twice; open: its core occurs in other hulls too (one cell stands for each hull)."""
    core = Window.partitionBy("core")
    order = core.orderBy("hull")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("hull").over(order) == F.col("hull"), F.lit(False))
    after = F.coalesce(F.lead("hull").over(order) == F.col("hull"), F.lit(False))
    return (
        cells.withColumn("_before", before).withColumn("settled", before | after)
        .withColumn("open", (F.first("hull").over(whole) != F.last("hull").over(whole)) & ~F.col("_before"))
        .filter("settled OR open").select("_doc", "_uid", "at", "first", "last", "settled", "open")
    )
