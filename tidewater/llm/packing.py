"""Packing documents into windows of tokens: combinations of lengths by non-negative least squares, the rest end to end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import shared
from .huffman import encoded

#: In combinations of three lengths one is a multiple of this share of the window.
GRID = 32
ROUNDS = 400


def combinations(counts: np.ndarray) -> np.ndarray:
    """Pairs and triples of lengths that fill the window len(counts), of lengths that occur; 0 stands for none.

    All pairs, and the triples in which a length is a multiple of a GRID-th of the window: at most about GRID / 2 for
    each length.
    """
    window = len(counts)
    a = np.arange(1, window // 2 + 1)
    pairs = np.column_stack([np.zeros_like(a), a, window - a])
    step = max(1, window // GRID)
    one, two = (x.ravel() for x in np.meshgrid(np.arange(1, window), np.arange(step, window, step)))
    three = np.sort(np.column_stack([one, two, window - one - two])[one + two < window], axis=1)
    every = np.concatenate([pairs, np.unique(three, axis=0)])
    there = counts > 0
    there[0] = True
    return every[there[every].all(axis=1)]


def repeats(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """x >= 0 that makes the lengths used by x of each pattern nearest to the counts, by accelerated projected gradients."""
    goal = counts.astype(float)
    goal[0] = 0

    def used(x: np.ndarray) -> np.ndarray:
        out = np.bincount(patterns.ravel(), weights=np.repeat(x, patterns.shape[1]), minlength=len(goal))
        out[0] = 0
        return out

    back = lambda y: y[patterns].sum(axis=1)  # noqa: E731  used() leaves 0 at length 0
    x = np.ones(len(patterns))
    for _ in range(30):
        x = back(used(x))
        bound = float(np.linalg.norm(x))
        if not bound:
            return np.zeros(len(patterns))
        x /= bound
    x = ahead = np.zeros(len(patterns))
    pace = 1.0
    for _ in range(rounds):
        after = np.maximum(0, ahead - back(used(ahead) - goal) / (1.02 * bound))
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = after + (pace - 1) / faster * (after - x)
        x, pace = after, faster
    return x


def rounded(patterns: np.ndarray, x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole repeats that the counts allow: x rounded down first, then as many of each pattern, the likeliest first, as are left; and what is left."""
    left, out = counts.astype(np.int64).tolist(), np.zeros(len(patterns), dtype=np.int64)
    order = np.argsort(-x, kind="stable").tolist()
    lists, floors = patterns.tolist(), np.floor(x + 1e-9).astype(np.int64).tolist()
    for limited in (True, False):
        for p in order:
            own = [n for n in lists[p] if n]
            n = min(left[k] // own.count(k) for k in own)
            n = min(n, floors[p]) if limited else n
            if n > 0:
                out[p] += n
                for k in own:
                    left[k] -= n
    return out, np.array(left, dtype=np.int64)


def plan(counts: np.ndarray) -> dict[str, np.ndarray | int]:
    """Where the documents of each length (0 < length < window) go, by their ranks among those of the same length.

    length, first, until, sequence, offset: ranks [first, until) of a length have one sequence each from `sequence` on,
    and stand at `offset` there. Ranks from used[length] on stand end to end, from `base` of their length, and are cut
    where windows begin; a last window that is not full becomes sequences of powers of two, which need no padding.
    """
    window = len(counts)
    patterns = combinations(counts)
    n, left = rounded(patterns, repeats(patterns, counts), counts) if len(patterns) else (np.zeros(0, dtype=np.int64), counts.astype(np.int64))
    used, rows, at = np.zeros(window, dtype=np.int64), [], 0
    for p in np.flatnonzero(n).tolist():
        offset = 0
        for k in patterns[p].tolist():
            if k:
                rows.append((k, used[k], used[k] + n[p], at, offset))
                used[k] += n[p]
                offset += k
        at += n[p]
    rows = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    left[0] = 0
    tokens = left * np.arange(window)
    total = int(tokens.sum())
    tail = [total // window * window]
    for bit in reversed(range(window.bit_length())):
        if total % window >> bit & 1:
            tail.append(tail[-1] + (1 << bit))
    return dict(zip(("length", "first", "until", "sequence", "offset"), rows.T, strict=True)) | {"used": used, "base": np.cumsum(tokens) - tokens, "tail": np.array(tail), "stream": at}


def _pieces(n: int, rank: int, full: int, tail_at: int, made: dict, window: int) -> Iterator[tuple[int, int, int, int]]:
    """start, length, sequence, offset of a document's pieces; full: the sequence of its first full window, tail_at: that of the first combination."""
    whole, size = divmod(n, window)
    for i in range(whole):
        yield i * window, window, full + i, 0
    if not size:
        return
    start, used = whole * window, int(made["used"][size])
    if rank < used:
        a, b = np.searchsorted(made["length"], [size, size + 1])
        i = a + int(np.searchsorted(made["first"][a:b], rank, side="right")) - 1
        yield start, size, tail_at + int(made["sequence"][i]) + rank - int(made["first"][i]), int(made["offset"][i])
        return
    at, stream = int(made["base"][size]) + (rank - used) * size, tail_at + made["stream"]
    last, end = int(made["tail"][0]), at + size
    while at < end:
        if at < last:
            sequence, begin = at // window, at // window * window
            stop = begin + window
        else:
            k = int(np.searchsorted(made["tail"], at, side="right")) - 1
            sequence, begin, stop = last // window + k, int(made["tail"][k]), int(made["tail"][k + 1])
        stop = min(stop, end)
        yield start, stop - at, stream + sequence, at - begin
        start, at = start + stop - at, stop


def placed_tokens(docs: DataFrame, path: str, window: int, key: str = "doc_id", text: str = "text", end_id: int = 1) -> DataFrame:
    """key, ids (binary), and a document's place: part (task), rest (ids beyond full windows), place (documents of the same rest before it in the part), full (full windows before it in the part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, met, full = TaskContext.get().partitionId(), np.zeros(window, dtype=np.int64), 0
        for batch in batches:
            for rows, ids in encoded(batch, path, end_id):
                places, fulls = [], []
                for n in map(len, ids):
                    places.append(int(met[n % window]))
                    fulls.append(full)
                    met[n % window] += 1
                    full += n // window
                cells = [rows.column(0), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([part] * len(ids), pa.int64())]
                cells += [pa.array(c, pa.int64()) for c in ([len(x) % window for x in ids], places, fulls)]
                yield pa.RecordBatch.from_arrays(cells, names=[key, "ids", "part", "rest", "place", "full"])

    rows = docs.select(key, text)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, ids binary, part long, rest long, place long, full long")


def pack(docs: DataFrame, path: str, window: int = 2048, key: str = "doc_id", text: str = "text", end_id: int = 1) -> DataFrame:
    """key, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset: pieces of documents in sequences.

    A document's ids and its end id give full windows, each a sequence, and a rest. Of the rests only the histogram
    over window - 1 lengths comes to the driver: combinations of two or three lengths that fill a window are repeated
    as often as non-negative least squares say, rounded down, and then as often as lengths are left. What is left
    stands end to end and is cut where windows begin, the last one into powers of two. So every sequence has `window`
    ids or a power of two, and only documents of that last part are cut elsewhere than at windows.

    A null text is empty and has the end id only; repeated rows, of one key or null ones too, are documents of their
    own; other columns are not read; an empty table gives no rows. Ids are written once (placed_tokens), as reading
    texts again might deal rows otherwise; a hot length is numbered part by part.
    """
    tokens = shared.save(placed_tokens(docs, path, window, key, text, end_id), "pack-tokens", compression="zstd")
    earlier = lambda by: (Window.partitionBy("rest") if by else Window.partitionBy()).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_rest = tokens.groupBy("part", "rest").agg(F.count("*").alias("_n"))
    ranks = shared.save(by_rest.select("part", "rest", "_n", F.coalesce(F.sum("_n").over(earlier(True)), F.lit(0)).alias("_rank")), "pack-ranks")
    by_part = tokens.groupBy("part").agg(F.sum(F.expr(f"octet_length(ids) div {4 * window}")).alias("_n"))
    fulls = shared.save(by_part.select("part", "_n", F.coalesce(F.sum("_n").over(earlier(False)), F.lit(0)).alias("_full")), "pack-windows")
    counts = np.zeros(window, dtype=np.int64)
    for row in ranks.groupBy("rest").agg(F.sum("_n").alias("n")).collect():
        counts[row["rest"]] = row["n"]
    made, windows = plan(counts), fulls.agg(F.sum("_n")).first()[0] or 0
    shipped = tokens.sparkSession.sparkContext.broadcast(made)
    names = ["start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kind = to_arrow_schema(tokens.select(key).schema).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shipped.value
        for batch in batches:
            columns = [c.to_pylist() for c in (batch.column(0), *batch.columns[2:])]
            held, room = [], 0

            def out(held: list) -> pa.RecordBatch:
                kinds = (kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=[key, *names])

            for i, (one, rank, full) in enumerate(zip(*columns, strict=True)):
                ids = batch.column(1)[i].as_py()
                for start, length, sequence, offset in _pieces(len(ids) // 4, rank, full, windows, plan, window):
                    held.append((one, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4, sequence, offset))
                    room += length
                if room > 1 << 20:
                    yield out(held)
                    held, room = [], 0
            if held:
                yield out(held)

    rows = tokens.join(shared.small(ranks.drop("_n")), ["part", "rest"]).join(shared.small(fulls.drop("_n")), "part")
    chosen = rows.select(F.col(key), "ids", (F.col("_rank") + F.col("place")).alias("rank"), (F.col("_full") + F.col("full")).alias("first"))
    name = tokens.schema[key].dataType.simpleString()
    return chosen.mapInArrow(run, f"`{key}` {name}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
