"""Series cut into chunks over tasks against the same recursions over whole series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_recursions import MODEL, OPEN, paths, series, wide_model
from tidewater.functions.model import nearest_open_loop
from tidewater.operators import recursions, scan
from tidewater.operators.dense import conditioned


def table(spark, sizes, seed, model=MODEL, holes=False):
    """Series of given sizes, keys beyond 2**53 and a null among them, in random order."""
    rng = np.random.default_rng(seed)
    y, r, _ = series(model, sizes, seed)
    keys = [9007199254740993, 9007199254740995, None, 5, 6, 7][: len(sizes)]
    rows = []
    for u, n, at in zip(keys, sizes, np.cumsum([0, *sizes]), strict=False):
        for i in range(n):
            one = y[at + i].tolist() if y.shape[1] > 1 else float(y[at + i, 0])
            label = float(r[at + i])
            if holes and rng.random() < 0.1:
                one = None
            if holes and rng.random() < 0.1:
                label = [None, 0.5, 7.0, -1.0][rng.integers(4)]
            rows.append((u, i, one, label))
    rng.shuffle(rows)
    kind = "array<double>" if y.shape[1] > 1 else "double"
    return spark.createDataFrame([tuple(x) for x in rows], f"user_id long, n int, y {kind}, r double")


def same(a, b, columns):
    key = lambda r: (r.user_id is not None, r.user_id or 0, r.n)
    a, b = sorted(a.collect(), key=key), sorted(b.collect(), key=key)
    assert [key(r) for r in a] == [key(r) for r in b] and a
    for x, z in zip(a, b, strict=True):
        for c in columns:
            assert (x[c] is None) == (z[c] is None), (c, x, z)
            if x[c] is not None:
                assert x[c] == pytest.approx(z[c], rel=1e-8, abs=1e-9)


@pytest.mark.parametrize("holes", [False, True])
@pytest.mark.parametrize("model", [MODEL, wide_model()], ids=["scalar", "wide"])
def test_kalman(spark, model, holes):
    df = table(spark, [300, 40, 25, 1, 7], 1, model, holes)
    out = (*recursions.STATES, "log_likelihood")
    whole, cut = recursions.kalman(df, model, ["user_id"]), recursions.kalman(df, model, ["user_id"], long=100, chunk=37)
    same(whole, cut, out)
    assert cut.columns == whole.columns and recursions.kalman(df.limit(0), model, ["user_id"], long=-1).count() == 0


@pytest.mark.parametrize("holes", [False, True])
@pytest.mark.parametrize("model", [OPEN, nearest_open_loop(wide_model())], ids=["scalar", "wide"])
def test_switching(spark, model, holes):
    df = table(spark, [300, 40, 25, 1, 7], 2, model, holes)
    out = (*recursions.STATES, "p_filter", "p_smooth", "r_filter", "r_smooth")
    same(recursions.switching(df, model, ["user_id"]), recursions.switching(df, model, ["user_id"], long=100, chunk=37), out)


def test_null_observation_is_a_step_without_one():
    """Against dense conditioning on the observed rows only."""
    y, r, _ = series(MODEL, [6], 3)
    gone = y.copy()
    gone[2] = np.nan
    got = recursions.known_regimes(gone, r.astype(float), np.array([6]), MODEL)
    from tidewater.operators.dense import joint_law

    mean, cov = joint_law(MODEL, r)
    seen = [2 * i + 1 for i in range(6) if i != 2]
    gain = np.linalg.solve(cov[np.ix_(seen, seen)], cov[seen]).T
    e = mean + gain @ (np.delete(y[:, 0], 2) - mean[seen])
    assert got["smooth"][:, 0] == pytest.approx(e[::2])
    d, s = np.delete(y[:, 0], 2) - mean[seen], cov[np.ix_(seen, seen)]
    log = -0.5 * (np.linalg.slogdet(s)[1] + d @ np.linalg.solve(s, d) + len(d) * np.log(2 * np.pi))
    assert got["log_likelihood"] == pytest.approx(np.full(6, log))


def test_rows_decide_whether_they_mix():
    """A row with a fraction, one out of range or one without a regime does not change other series."""
    model = wide_model()
    y, r, sizes = series(model, [5, 6], 4)
    want = recursions.known_regimes(y, r.astype(float), sizes, model)["smooth"][:5]
    for odd in (0.5, 1.5, np.nan, 9.0, -0.1):
        r2 = r.astype(float)
        r2[7] = odd
        assert recursions.known_regimes(y, r2, sizes, model)["smooth"][:5] == pytest.approx(want)
    three = recursions.known_regimes(np.array([[50.0, 50.0]]), np.array([1.5]), np.array([1]), model)["filter"][0]
    gamma, mean = (model.gamma[1] + model.gamma[2]) / 2, (model.mean[1] + model.mean[2]) / 2
    assert three == pytest.approx(mean[:2] + gamma[:2, 2:] @ np.linalg.solve(gamma[2:, 2:], np.array([50.0, 50.0]) - mean[2:]))
    e, _, _ = conditioned(model, r[:5], y[:5], 5)
    assert want == pytest.approx(e)


def drawn(spark, df, chunk):
    u = (F.pmod(F.xxhash64("user_id", "n"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    whole = scan.Scan(df.withColumn("_u", u), ["user_id"], "n", scan.UnknownRegimes(OPEN), chunk)
    return scan.draw_paths(whole, "_u", "", lambda *_: {})


def test_paths_are_the_same_in_any_chunks(spark):
    df = table(spark, [200, 30, 1, 9], 5, OPEN).drop("r")
    a, b = drawn(spark, df, 1000), drawn(spark, df, 23)
    same(a, b, ["r"])
    y = pd.DataFrame([r.asDict() for r in a.collect()]).sort_values(["user_id", "n"])
    one = y[y.user_id == 9007199254740995]
    found = recursions.unknown_regimes(one["y"].to_numpy()[:, None], np.array([len(one)]), OPEN)
    want = recursions.path_sample(found["link"], found["p_smooth"], found["beta"], np.array([len(one)]), one["_u"].to_numpy())
    assert want.tolist() == one["r"].tolist()


def test_law_of_paths_over_chunks():
    """Maps of pieces composed: the law is that of all paths."""
    y, _, _ = series(OPEN, [4], 6)
    work, path, rng, times = scan.UnknownRegimes(OPEN), scan.Path(2), np.random.default_rng(7), 5000
    found = work.passed(rows := work.rows({"y": y}, np.array([True, False, False, False]), None), work.first(), work.last())
    out = np.zeros((times, 4), dtype=int)
    for t in range(times):
        maps = path.maps(found["link"], found["p_smooth"], found["beta"], rows["start"], rng.random(4))
        middle = path.summary(maps[:2])[0]
        out[t] = [*path.drawn(maps[:2], 1), *path.drawn(maps[2:], int(middle))]
    for r, p, _, _ in paths(OPEN, y, 4):
        assert (out == r).all(axis=1).mean() == pytest.approx(p, abs=4 * np.sqrt(p * (1 - p) / times) + 2e-3)
