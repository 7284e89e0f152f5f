"""Laws, grids, model algebra, learning, resampling, bounds and streams on small cases with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions import grid, laws, model
from tidewater.operators import bounds, learn, metrics, prepare, recursions, sem, simulate
from tidewater.plans.catalogue import LAWS
from tidewater.streaming import filters

MODEL = model.example_model()
OPEN = model.nearest_open_loop(MODEL)


@pytest.mark.parametrize("family", LAWS)
def test_laws_sum_to_one_and_have_their_marginals(spark, family):
    own = laws.law(LAWS[family])
    r, w, p = laws.matrix(own, 400)
    assert (w[:, None] * w * p).sum() == pytest.approx(1, abs=4e-3)
    at = [0.0, 1.0, *r[1:-1:40]]
    rows = spark.createDataFrame([(float(x),) for x in at], "r double").select("r", laws.marginal(own, F.col("r")).alias("m"), laws.conditional(own, F.col("r"), F.lit(0.0)).alias("c")).collect()
    for row in rows:
        i = int(np.argmin(np.abs(r - row.r)))
        assert row.m == pytest.approx((w * p[i]).sum(), abs=1e-2)
        assert row.c == pytest.approx(p[i, 0] / row.m, rel=1e-6)
    assert laws.hard_weight(own) == pytest.approx((w * p[0]).sum() + (w * p[-1]).sum(), abs=1e-3)


@pytest.mark.parametrize("family", ["2", "2ter", "3", "4"])
def test_closed_hard_transition(spark, family):
    own = laws.law(LAWS[family])
    got = {(x.j, x.k): x.p for x in laws.hard_transition(laws.table(spark, own, 200)).collect()}
    want = laws.hard_transition_closed(own)
    assert want.sum() == pytest.approx(1, abs=1e-9)
    assert all(got[j, k] == pytest.approx(want[j, k], abs=6e-3) for j in (0, 1) for k in (0, 1))


def test_law_fits(spark):
    labels = [0, 0, 0.3, 0.6, 1, 1, 1, 0, 0.2, 0]
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(labels)], "s int, n int, r double")
    two = laws.fit_2ter(df, ["s"], "n", "r").first()
    assert (two.alpha0, two.alpha1, two.beta) == pytest.approx((1 / 9, 2 / 9, 1 / 18)) and two.eta == pytest.approx(0.375 * (1 - 3 / 9 - 1 / 9))
    four = laws.fit_4bis(df, ["s"], "n", "r").first()
    assert (four.alpha, four.beta) == pytest.approx((1.5 / 9, 0.5 / 9)) and four["lambda"] == pytest.approx(1.9 * (6 / 9 - 4 / 9) / (1 - 12 / 9 + 4 / 9))
    one = laws.fmc1(df, "r", 0.9).first()
    assert one.eta == pytest.approx(0.6 * (1 - 0.63)) and one.alpha == pytest.approx((0.63 - one.eta) / 2)
    last = laws.fmc2(df, ["s"], "n", "r").first()
    assert last.delta == pytest.approx(0.4) and last.alpha == pytest.approx(0.35) and last.gamma == pytest.approx(0.3 / (2.4 - 0.16))


def test_drawn_values_follow_their_density(spark):
    density = np.array([1.0, 3, 0, 4])
    u = [0.01, 0.125, 0.3, 0.6, 0.99]
    got = [x.v for x in spark.createDataFrame([(x,) for x in u], "u double").select(laws.drawn(density, F.col("u")).alias("v")).collect()]
    assert got == pytest.approx(np.interp(u, [0, 0.125, 0.5, 0.5 + 1e-12, 1], [0, 0.25, 0.5, 0.75, 1]))
    assert spark.range(1).select(laws.rescaled(F.lit(0.5), 2, 6)).first()[0] == 4


def test_grid_primitives(spark):
    df = spark.createDataFrame([([0.2, 1.0, 0.6, 0.1],)], "p array<double>")
    one = lambda c: df.select(c).first()[0]
    p = F.col("p")
    assert one(grid.integral(p, 2)) == pytest.approx(0.2 + 0.8 + 0.1)
    assert sum(np.array(one(grid.normalised(p, 2))) * [1, 0.5, 0.5, 1]) == pytest.approx(1)
    assert [one(grid.index_of(F.lit(v), 2)) for v in (0.0, 0.2, 0.5, 0.9, 1.0)] == [0, 1, 2, 2, 3]
    assert [one(grid.value_of(F.lit(i), 2)) for i in range(4)] == [0.0, 0.25, 0.75, 1.0]
    assert one(grid.most_probable(p, 2)) == 0.25 and one(grid.at(p, F.lit(0.9), 2)) == 0.6
    assert one(grid.most_probable(grid.with_value(p, F.lit(3), F.lit(1.0)), 2)) == 0.25
    assert one(grid.most_probable(grid.with_value(p, F.lit(3), F.lit(1.1)), 2)) == 1.0
    assert [one(grid.sampled(p, F.lit(u), 2)) for u in (0.0, 0.2, 0.6, 0.7, 0.99)] == [0, 1, 1, 2, 3]
    assert not one(grid.is_zero(p)) and one(grid.is_zero(grid.constant(0.0, 2))) and one(grid.product(p, grid.weights(2))) == [0.2, 0.5, 0.3, 0.1]
    assert one(grid.negative_variance(F.lit(2.0), F.lit(3.0))) and not one(grid.negative_variance(F.lit(2.0), F.lit(4.0)))
    table = laws.table(spark, laws.law(LAWS["4"]), 20)
    total = grid.rectangle(table, (0.0, 1.0), (0.0, 1.0)).first()[0]
    assert total == pytest.approx(grid.rectangle(table, (0.0, 0.5), (0.0, 1.0)).first()[0] + grid.rectangle(table, (0.5, 1.0), (0.0, 1.0)).first()[0])


def test_model_checks():
    assert not model.is_open_loop_from_cov(MODEL) and model.is_open_loop_from_cov(OPEN)
    for j in (0, 1):
        f, q = model.cov_to_fq(MODEL.gamma[j], MODEL.sigma[j, j], MODEL.gamma[j])
        gamma, sigma = model.fq_to_cov(f, q)
        assert gamma == pytest.approx(MODEL.gamma[j]) and sigma == pytest.approx(MODEL.sigma[j, j])
    steep = model.RegimeModel(MODEL.mean, MODEL.gamma, MODEL.sigma * 4, MODEL.joint)
    assert model.is_admissible(MODEL) and not model.is_admissible(steep)
    assert model.is_open_loop(model.repaired_model(steep))
    assert model.square_root(MODEL.gamma[0]) @ model.square_root(MODEL.gamma[0]) == pytest.approx(MODEL.gamma[0])
    assert model.is_positive(model.nearest_positive(np.array([[1.0, 2], [2, 1]]))) and not model.is_positive(np.array([[1.0, 2], [2, 1]]))
    assert model.steady_state(np.array([[0.9, 0.1], [0.3, 0.7]])) == pytest.approx([0.75, 0.25])
    with pytest.raises(ValueError):
        model.checked_joint(np.array([[0.5, 0.4], [0.05, 0.05]]))


def test_random_models(spark):
    found = simulate.random_models(spark, MODEL.gamma, MODEL.joint, 300, 1, span=0.6).collect()
    assert 0 < len(found) < 300
    assert all(model.is_admissible(model.RegimeModel(np.zeros((2, 2)), MODEL.gamma, np.array(x.sigma).reshape(2, 2, 2, 2), MODEL.joint)) for x in found[:5])


def test_stretched(spark):
    rows = [("a", i, float(v), v * 2.0) for i, v in enumerate([0, 10, 5, 7])] + [("b", 0, 3.0, 1.0)] + [("c", i, float(i), 0.0) for i in range(7)]
    df = spark.createDataFrame(rows, "s string, i int, x double, z double")
    for length in (1, 2, 3, 10, 40):
        got = prepare.stretched(df, ["s"], "i", ["x", "z"], length).collect()
        for s in "abc":
            own = [x[2] for x in rows if x[0] == s]
            want = np.interp(np.linspace(0, len(own) - 1, length), range(len(own)), own)
            assert [x.x for x in sorted((g for g in got if g.s == s), key=lambda g: g.n)] == pytest.approx(want), (s, length)


def test_times_and_labels(spark):
    df = spark.createDataFrame([(0, "2018-01-02", "03:04:05"), (2, "x", "y")], "n int, d string, t string")
    got = df.select(prepare.timestamp_of("d", "t").alias("a"), prepare.regular_times(F.col("n"), "2013-12-12 00:00:00").alias("b"), prepare.constant_runs(F.col("n"), [(1, 0.5), (2, 1.0)], 0.0).alias("c")).collect()
    assert [(str(x.a), str(x.b), x.c) for x in got] == [("2018-01-02 03:04:05", "2013-12-12 00:00:00", 0.0), ("None", "2013-12-12 02:00:00", 1.0)]


def test_errors_by_place(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0, 0.0), (0, 1.0, 4.0, 1.0), (1, 0.0, 0.0, 2.0)], "n int, truth double, a double, b double")
    got = {(x.n, x.method): (x.mse, x.variance) for x in metrics.mse_by_place(df, "n", "truth", ["a", "b"]).collect()}
    assert got == {(0, "a"): (5.0, 16.0), (0, "b"): (0.5, 0.25), (1, "a"): (0.0, 0.0), (1, "b"): (4.0, 0.0)}
    assert {(x.n, x.method): x["mean"] for x in metrics.mean_covariances(df, "n", ["a"]).collect()} == {(0, "a"): 3.0, (1, "a"): 0.0}
    assert metrics.report(df, ["n"], "truth", ["a"], ("truth", "b")).orderBy("n").first().asDict() == {"n": 2, "mse_a": 5.0, "label_errors": 0.5}


def test_blind_bounds(spark):
    one = model.RegimeModel(MODEL.mean[:1], MODEL.gamma[:1], MODEL.sigma[:1, :1], np.ones((1, 1)))
    got = bounds.blind_bounds(spark, one, -200, 300).first()
    assert got.known == pytest.approx(100 - 90**2 / 400) and got.unknown == pytest.approx(got.known, rel=1e-6)
    both = bounds.blind_bounds(spark, MODEL, -300, 400).first()
    assert both.unknown > both.known


def test_regime_transitions(spark):
    rows = [(1, i, 40.0 + 7 * (i % 3)) for i in range(5)]
    got = recursions.regime_transitions(spark.createDataFrame(rows, "s int, n int, y double"), OPEN, ["s"]).orderBy("n").collect()
    full = recursions.switching(spark.createDataFrame(rows, "s int, n int, y double"), OPEN, ["s"]).orderBy("n").collect()
    assert got[0].t_smooth is None
    for before, own, x in zip(full, full[1:], got[1:], strict=False):
        smooth = np.array(x.t_smooth).reshape(2, 2)
        assert smooth.sum(axis=0) == pytest.approx(own.p_smooth) and smooth.sum(axis=1) == pytest.approx(before.p_smooth)
        assert np.array(x.t_back).reshape(2, 2).sum(axis=0) == pytest.approx([1, 1]) and np.array(x.t_forward).reshape(2, 2).sum(axis=1) == pytest.approx([1, 1])
        assert np.array(x.t_predict).reshape(2, 2).sum(axis=1) == pytest.approx(before.p_filter)


def example_regression():
    rng = np.random.default_rng(2)
    joint = np.array([[0.4, 0.1], [0.1, 0.4]])
    m = np.array([[[0.5, 0.1, 0.3, 0.0], [0.4, 0.0, 0.2, 1.0]], [[0.2, 0.1, 0.6, -1.0], [0.6, -0.2, 0.1, 2.0]]])
    p = np.array([[[0.5, 0.0], [0.3, 2.0]], [[0.2, -1.0], [0.7, 1.0]]])
    return sem.PairRegression(m, np.full((2, 2), 0.5), p, np.full((2, 2), 0.8), joint, np.array([[0.0, 0], [2, 2]]), np.array([np.eye(2) * 2] * 2)), rng


def test_posterior_against_enumeration(spark):
    import itertools

    own, rng = example_regression()
    z = rng.normal(1, 1, (5, 2))
    df = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(z)], "s int, n int, x double, y double")
    like = [[x[f"l_{j}_{k}"] for j in (0, 1) for k in (0, 1)] for x in sem.pair_likelihood(df, ["s"], "n", "x", "y", own).orderBy("n").collect()]
    like = np.array(like).reshape(-1, 2, 2)
    first = [own.joint.sum(axis=1)[k] * np.exp(-0.5 * (z[0] - own.mean[k]) @ np.linalg.inv(own.gamma[k]) @ (z[0] - own.mean[k])) / np.sqrt(np.linalg.det(own.gamma[k])) for k in (0, 1)]
    gamma, psi = np.zeros((5, 2)), np.zeros((5, 2, 2))
    for r in itertools.product((0, 1), repeat=5):
        w = first[r[0]] * np.prod([own.transition[r[i], r[i + 1]] * like[i, r[i], r[i + 1]] for i in range(4)])
        for i in range(5):
            gamma[i, r[i]] += w
            if i:
                psi[i, r[i - 1], r[i]] += w
    got = sem.posterior(df, ["s"], "n", "x", "y", own, seed=1).orderBy("n").collect()
    assert np.array([x.gamma for x in got]) == pytest.approx(gamma / gamma.sum(axis=1, keepdims=True))
    assert np.array([x.psi for x in got[1:]]).reshape(-1, 2, 2) == pytest.approx(psi[1:] / psi[1:].sum(axis=(1, 2), keepdims=True))
    assert {x.r for x in got} <= {0, 1} and got[0].psi == [0.0] * 4


def test_weighted_least_squares_recover_the_regressions(spark):
    own, rng = example_regression()
    rows, z, r = [], np.zeros(2), 0
    for n in range(4000):
        rows.append((1, n, float(z[0]), float(z[1]), r))
        k = int(rng.random() > own.transition[r, 0])
        y = own.p[r, k] @ [z[1], 1] + np.sqrt(0.8) * rng.normal()
        z, r = np.array([own.m[r, k] @ [z[0], z[1], y, 1] + np.sqrt(0.5) * rng.normal(), y]), k
    df = spark.createDataFrame(rows, "s int, n int, x double, y double, r int")
    fit = sem.fit_labels(df, ["s"], "n", "x", "y", "r", 2)
    assert fit.m == pytest.approx(own.m, abs=0.2) and fit.p == pytest.approx(own.p, abs=0.2) and fit.lambda2 == pytest.approx(own.lambda2, abs=0.1) and fit.joint == pytest.approx(own.joint, abs=0.05)
    learnt, labelled, trace = sem.learn(df.drop("r"), ["s"], "n", "x", "y", 2, 3)
    assert len(trace) == 4 and labelled.count() == 4000
    truth = {x[1]: x[4] for x in rows}
    agree = np.mean([truth[x.n] == x.r for x in labelled.collect()])
    assert max(agree, 1 - agree) > 0.6
    assert learn.iterate_fit(df.drop("r"), ["s"], "n", "x", "y", 2, 1)[1].count() == 4000


def test_experiments_and_quadrants(spark):
    got = simulate.experiments(spark, OPEN, 20, 60, 3).first()
    assert got.n == 20 and got.mean_smooth < got.mean_filter < 300 and got.mean_r_errors < 0.5
    own = laws.law(LAWS["4"])
    shares = {(x.j, x.k): x.p for x in simulate.quadrant_shares(simulate.simulate_fuzzy(spark, OPEN, own, 20, 40, 300, 1)).collect()}
    want = laws.hard_transition_closed(own)
    assert all(shares[j, k] == pytest.approx(want[j, k], abs=0.05) for j in (0, 1) for k in (0, 1))


def test_stream_goes_on_from_batch_to_batch(spark, tmp_path):
    rows = [(s, n, 40.0 + 10 * ((n * s) % 3)) for s in (1, 2, 3) for n in range(9)]
    schema = "s int, n int, y double"
    want = {(x.s, x.n): (x["filter"], x.r_filter) for x in recursions.switching(spark.createDataFrame(rows, schema), OPEN, ["s"], outputs=("filter", "r_filter")).collect()}
    for i in range(3):
        spark.createDataFrame([x for x in rows if 3 * i <= x[1] < 3 * i + 3 + (i < 2)], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in{i}")
    source = tmp_path / "in"
    source.mkdir()
    got = {}

    def take(batch, _):
        for x in batch.collect():
            assert (x.s, x.n) not in got
            got[x.s, x.n] = (x["filter"], x.r_filter)

    for i in range(3):
        for f in (tmp_path / f"in{i}").glob("*.parquet"):
            f.rename(source / f"{i}-{f.name}")
        stream = spark.readStream.schema(schema).parquet(f"file://{source}")
        query = filters.switching_stream(stream, OPEN, ["s"]).writeStream.foreachBatch(take).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in want)
