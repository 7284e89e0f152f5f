"""What a task of the phrase passes holds at once is bounded, however many shards and phrases it meets."""

import glob
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from tidewater.llm import phrases, shared


class Tasks:
    """Stands for a table: keeps the functions that run in its tasks."""

    def __init__(self):
        self.run = []
        self.sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda v: SimpleNamespace(value=v)))

    def mapInArrow(self, f, schema):  # noqa: N802
        self.run.append(f)
        return self

    def select(self, *_):
        return self

    repartition = sortWithinPartitions = select


def shards(n, places, words, rng):
    names = [None, None, *(("en", b"w%d" % i) for i in range(words))]
    rows = [phrases._row(rng.integers(2, words + 2, places + phrases.LONGEST - 1), places, names, 0) for _ in range(n)]
    return pa.Table.from_batches(rows).select(["own", "ids", "sizes", "blocks", "masks"]).combine_chunks().to_batches()


def test_a_task_holds_a_bounded_number_of_phrases():
    rng = np.random.default_rng(1)
    rows, places = shards(5, 1 << 18, 3000, rng), 5 << 18
    ids = np.unique(np.frombuffer(rows[0].column("ids")[0].as_py(), dtype="<i8"))
    every = np.full(1 << 15, np.uint64(2**64 - 1))
    tasks = Tasks()
    phrases._counted(tasks, (4, 5), {1: every, 2: every, 3: every}, 1, ids, 8)
    tracemalloc.start()
    sent = {4: 0, 5: 0}
    for batch in tasks.run[0](iter(rows)):
        for k, cell, n in zip(*(batch.column(c).to_pylist() for c in ("k", "counts", "rows")), strict=True):
            sent[k] += int(np.frombuffer(cell, dtype="<i4").sum())
            assert len(cell) == 4 * n
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sent == {4: places, 5: places}
    assert peak < 120e6


def test_cells_of_a_bucket_are_not_summed_again_for_each(monkeypatch):
    """Where a bucket has more phrases than a task gathers, each cell led to another sort of all of them."""
    monkeypatch.setattr(phrases, "GATHERED", 16)
    called = []
    old = phrases._summed
    monkeypatch.setattr(phrases, "_summed", lambda parts: called.append(1) or old(parts))
    order = np.arange(1000, 3000)
    tasks = Tasks()
    phrases._counted(tasks, (2,), {1: np.zeros(1, np.uint64)}, 2, order, 1)
    pairs = np.array([[i, i + 1] for i in range(1600)], dtype="<u4")
    cells = [pairs[i : i + 8] for i in range(0, 1600, 8)] * 2
    columns = [[0] * len(cells), [2] * len(cells), [8] * len(cells), [c.T.tobytes() for c in cells], [np.ones(8, "<i4").tobytes()] * len(cells)]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["bucket", "k", "rows", "words", "counts"])
    found = pa.Table.from_batches(list(tasks.run[1](iter([batch])))).to_pydict()
    assert sorted(map(tuple, found["ids"])) == [(1000 + i, 1001 + i) for i in range(1600)] and set(found["n"]) == {2}
    assert len(called) < 40


def test_shards_have_small_row_groups(spark):
    """A task reads and writes a row group at once: with few large rows it had them all."""
    rng = np.random.default_rng(2)
    text = " ".join(f"{w:x}" for w in rng.integers(1 << 40, 1 << 41, 200_000).tolist())
    docs = spark.createDataFrame([("en", text)] * 12, "lang string, text string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with shared.scratch(), shared.arrow_rows(spark, phrases.DOCUMENTS):
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(phrases.DOCUMENTS)
        saved = shared.save(phrases.bitmaps(docs, places=200_000), "test-shards", **phrases.SHARD_FILES)
        sizes = [m.row_group(i).total_byte_size for f in glob.glob(f"{saved.saved_path.removeprefix('file://')}/*.parquet") for m in [pq.ParquetFile(f).metadata] for i in range(m.num_row_groups)]
    assert len(sizes) > 3 and max(sizes) < 40 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
