import numpy as np
import pytest

from tidewater.llm import mixture


def level(sizes, weights, most):
    """Targets by plain rounds: shares by weight, the excess over the caps dealt anew."""
    target, open_, left = np.zeros(len(sizes)), np.ones(len(sizes), dtype=bool), float(sum(sizes))
    while open_.any():
        share = np.where(open_, left * weights / weights[open_].sum(), 0)
        over = open_ & (share > most * sizes)
        if not over.any():
            return np.where(open_, share, target)
        target[over] = most * sizes[over]
        left -= target[over].sum()
        open_ &= ~over
    return target


def mixed(spark, rows, **more):
    return mixture.mix(spark.createDataFrame(rows, "doc_id long, source string, size long, target string"), **more).collect()


def test_targets_takes_and_reruns(spark):
    rng = np.random.default_rng(1)
    sources = ["b", "a", None, "ü", "A", "zz"]
    sizes = {"b": 40_000, "a": 200, None: 9_000, "ü": 90_000, "A": 30_000, "zz": 0}
    rows = []
    for s in sources:
        left = sizes[s]
        while left > 0:
            n = int(min(left, rng.integers(1, 3000)))
            rows.append((len(rows), s, n, "x"))
            left -= n
        rows += [(len(rows) + k, s, 0, "x") for k in range(2)]
    rows += [rows[0], (None, "b", 5, "x")]
    got = mixed(spark, rows)
    assert len(got) == len(rows)
    order = sorted((s for s in sources if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    own = np.array([sum(r[2] for r in rows if r[1] == s) for s in order], dtype=float)
    want = level(own, np.array([(5, 2, 1)[i % 3] for i in range(len(order))], dtype=float), 3)
    for s, n, t in zip(order, own, want, strict=True):
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {int(n)} and all(r.target == pytest.approx(t, abs=1e-6) for r in mine)
        assert sum(r.taken for r in mine) == pytest.approx(t, abs=1.5)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    again = mixed(spark, rows[::-1])
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_slots_are_spread_evenly(spark):
    """In every stretch of slots each source has its share, to a few slots: what low discrepancy means."""
    rows = [(s, 1 << 20, float(t), low, high) for s, t, low, high in (("a", 500_000, 0.0, 0.5), ("b", 300_000, 0.5, 0.8), ("c", 200_000, 0.8, 1.0))]
    targets = spark.createDataFrame(rows, "source_key string, source_size long, target double, _low double, _high double")
    slots = [r.source_key for r in mixture.schedule(targets, 1_000_000, 512).orderBy("slot").collect()]
    for a, b in ((0, 100), (37, 450), (900, 1800), (0, len(slots))):
        for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
            assert slots[a:b].count(s) == pytest.approx(share * (b - a), abs=5)


def test_empty_and_no_words(spark):
    assert mixed(spark, []) == []
    assert [(r.taken, r.target, r.source_size) for r in mixed(spark, [(1, "a", 0, "x"), (2, None, 0, "x")])] == [(0, 0.0, 0)] * 2
