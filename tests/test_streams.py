"""Shuffled rows over batches against the batch filter."""

import datetime

import numpy as np
import pytest

from tests.test_recursions import MODEL, OPEN
from tidewater.functions import laws
from tidewater.operators import fuzzy, recursions, scan
from tidewater.streaming.ordered import event_time_filter

START = datetime.datetime(2024, 1, 1)
SCHEMA = "s long, ts timestamp, n int, y double, r double"


def run(spark, tmp_path, batches, work, outputs, delay="1 hour", idle=datetime.timedelta(days=30)):
    source, rows = tmp_path / "in", []
    source.mkdir()
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"file://{tmp_path}/one")
        (next((tmp_path / "one").glob("part-*")).rename(source / f"{i:03d}.parquet"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{source}")
    found = event_time_filter(stream, work, ["s"], "ts", "n", delay, idle, outputs)
    query = found.writeStream.foreachBatch(lambda df, _: rows.extend(df.collect())).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(200)
    return rows


@pytest.mark.parametrize("kind", ["known", "unknown", "fuzzy"])
def test_shuffled_rows_give_the_batch_result(spark, tmp_path, kind):
    rng = np.random.default_rng(3)
    rows = [(s, START + datetime.timedelta(minutes=7 * n), n, float(rng.normal(50, 15)) if (s, n) != (1, 9) else None, float(n % 2)) for s in (9007199254740993, 1) for n in range(30)]
    late = [row for row in rows if row[2] == 4 and row[0] == 1]
    order = sorted((row for row in rows if row not in late), key=lambda row: row[2] + rng.uniform(0, 6))
    end = [(s, START + datetime.timedelta(days=3), 99, 1.0, 0.0) for s in (1, 9007199254740993)]
    batches = [order[:20], order[20:40], [*order[40:], *late], end[:1], end[1:]]
    if kind == "known":
        work, outputs = scan.KnownRegimes(MODEL), ("filter", "filter_var", "predict")
        batch = lambda df: recursions.kalman(df, MODEL, ["s"], outputs=outputs)
    else:
        own = OPEN if kind == "unknown" else fuzzy.grid_model(OPEN, laws.law("2ter:0.1356:0.1177:0.05"), 2)[0]
        work, outputs = scan.UnknownRegimes(own), ("filter", "filter_var", "p_filter")
        batch = lambda df: recursions.switching(df, own, ["s"], outputs=outputs)
    got = run(spark, tmp_path, batches, work, outputs)
    want = {(r.s, r.n): r for r in batch(spark.createDataFrame([row for row in rows if row not in late], SCHEMA)).collect()}
    got = {(r.s, r.n): r for r in got if r.n != 99}
    assert set(got) == set(want) and max(r.late for r in got.values() if r.s == 1) == 1
    for at, row in got.items():
        assert row.ts == START + datetime.timedelta(minutes=7 * row.n)
        for c in outputs:
            assert (row[c] is None) == (want[at][c] is None) and (row[c] is None or row[c] == pytest.approx(want[at][c], rel=1e-8))


def test_idle_series_begin_anew(spark, tmp_path):
    at = lambda hours: START + datetime.timedelta(hours=hours)
    batches = [[(1, at(0), 0, 40.0, 0.0), (1, at(1), 1, 60.0, 0.0)], [(2, at(40), 0, 1.0, 0.0)], [(2, at(60), 1, 1.0, 0.0)], [(1, at(61), 2, 70.0, 0.0)], [(2, at(100), 2, 1.0, 0.0)], [(2, at(130), 3, 1.0, 0.0)]]
    got = run(spark, tmp_path, batches, scan.KnownRegimes(MODEL), ("filter",), idle=datetime.timedelta(hours=10))
    one = {r.n: r["filter"] for r in got if r.s == 1}
    fresh = recursions.known_regimes(np.array([[70.0]]), np.array([0.0]), np.array([1]), MODEL)["filter"][0, 0]
    assert one[2] == pytest.approx(fresh)


def test_step_without_observation_begins_anew():
    import pandas as pd

    from tidewater.streaming.filters import filter_step

    y = pd.DataFrame({"y": [40.0, 55.0, None, 60.0, 70.0]})
    out, state = filter_step(y, "y", OPEN, None)
    want = recursions.unknown_regimes(y["y"].to_numpy()[:, None], np.array([5]), OPEN)
    assert out["filter"] == pytest.approx(want["filter"][:, 0], nan_ok=True) and out["p_filter"][2] is None and pd.isna(out["r_filter"][2])
    more, _ = filter_step(pd.DataFrame({"y": [65.0]}), "y", OPEN, state)
    whole = recursions.unknown_regimes(np.array([[60.0], [70.0], [65.0]]), np.array([3]), OPEN)
    assert more["filter"][0] == pytest.approx(whole["filter"][2, 0])
    assert filter_step(pd.DataFrame({"y": [1.0, None]}), "y", OPEN, None)[1] is None
