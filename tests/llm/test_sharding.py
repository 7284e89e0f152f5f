import itertools
import math
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import sharding


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 30), st.integers(0, 30), st.data())
def test_hypergeometric_stays_in_range(good, bad, data):
    drawn = data.draw(st.integers(0, good + bad))
    got = sharding.hypergeometric(np.random.default_rng(1), good, bad, drawn)
    assert max(0, drawn - bad) <= got <= min(good, drawn)


def test_hypergeometric_law():
    rng = np.random.default_rng(2)
    got = Counter(sharding.hypergeometric(rng, 7, 9, 6) for _ in range(20_000))
    for k in range(7):
        want = math.comb(7, k) * math.comb(9, 6 - k) / math.comb(16, 6)
        assert abs(got[k] / 20_000 - want) < 5 * math.sqrt(want * (1 - want) / 20_000) + 1e-9


def test_matrix_has_exact_margins():
    matrix = sharding.communication_matrix([5, 0, 17, 8], [10, 10, 10], 3)
    assert [sum(r) for r in matrix] == [5, 0, 17, 8] and [sum(c) for c in zip(*matrix, strict=True)] == [10, 10, 10]


def run(spark, rows, schema, **more):
    docs = spark.createDataFrame(rows, schema)
    out = sharding.shard(docs, **more)
    return docs, out, out.collect()


def check(rows, got, shards):
    by_shard = [sorted(r.slot for r in got if r.shard == s) for s in range(shards)]
    assert all(slots == list(range(len(slots))) for slots in by_shard)
    assert max(map(len, by_shard)) - min(map(len, by_shard)) <= 1
    assert Counter(tuple(r)[: len(rows[0])] for r in got) == Counter(rows)


def test_exact_sizes_nulls_repeats_and_clashing_names(spark):
    rows = [(i % 50 if i % 3 else None, ["a", "", None, "long " * 1000][i % 4], i // 60, "s") for i in range(300)]
    schema = "doc_id long, _mix string, _one int, _copy string"
    docs, out, got = run(spark, rows, schema, shards=7, partitions=16)
    assert out.columns == [*docs.columns, "shard", "slot"]
    check(rows, got, 7)
    again = sharding.shard(docs.repartition(3), shards=7, partitions=16).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_columns_named_like_the_results_are_replaced(spark):
    _, out, got = run(spark, [(i, i, "x") for i in range(10)], "doc_id long, shard int, slot string", shards=3)
    assert out.columns == ["doc_id", "shard", "slot"] and {r.shard for r in got} == {0, 1, 2}


def test_equal_rows_spread_over_the_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 7)
    rows = [(1, "same")] * 400 + [(i, "other") for i in range(400)]
    _, _, got = run(spark, rows, "doc_id long, text string", shards=10, partitions=8)
    check(rows, got, 10)
    spread = [sum(r.text == "same" for r in got if r.shard == s) for s in range(10)]
    assert min(spread) > 20 and max(spread) < 60
    inside = [r.slot for r in got if r.text == "same" and r.shard == 0]
    assert len(list(itertools.groupby(sorted(inside), key=lambda s, c=itertools.count(): s - next(c)))) > 5


def test_null_in_another_column_is_another_row(spark):
    rows = [("a", None), (None, "a"), (None, None), ("", "a")]
    _, _, got = run(spark, rows, "doc_id string, text string", shards=2)
    check(rows, got, 2)


def test_empty(spark):
    assert run(spark, [], "doc_id long, text string")[2] == []
