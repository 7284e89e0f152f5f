import numpy as np
import pytest

from tidewater.functions.model import example_model
from tidewater.sources import series


def put(folder, name, text):
    path = folder / name
    path.write_bytes(text.encode())
    return f"file://{path}"


def test_csv_forms(spark, tmp_path):
    path = put(tmp_path, "a.csv", "Timestamp;Host;Value\n 31/01/2018 10:15;h1; 3.5\n01/02/2018 00:00;h2;-1e2\n")
    rows = series.read_csv(spark, path, "ts string, host string, value double", ts="ts", ts_format="dd/MM/yyyy HH:mm", sep=";").collect()
    assert [(str(r.ts), r.host, r.value) for r in rows] == [("2018-01-31 10:15:00", "h1", 3.5), ("2018-02-01 00:00:00", "h2", -100.0)]
    path = put(tmp_path, "b.csv", "first\r\nsecond\r\na,b\r\n1,2.5\r\n\r\n3, 4\r\n")
    assert sorted(tuple(r) for r in series.read_csv_after(spark, path, "a int, b double", 2).collect()) == [(1, 2.5), (3, 4.0)]


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_numbers(spark, tmp_path, end):
    path = put(tmp_path, "n.txt", end.join(["1.5e+00", "", " -2 ", "3"]) + end)
    assert [tuple(r) for r in series.read_numbers(spark, path).orderBy("n").collect()] == [(0, 1.5), (1, -2.0), (2, 3.0)]


def test_matrix(spark, tmp_path):
    path = put(tmp_path, "m.csv", "lon,lat\n1, 2\n3.5,4\n")
    assert [(r.n, r["values"]) for r in series.read_matrix(spark, path).orderBy("n").collect()] == [(0, [1.0, 2.0]), (1, [3.5, 4.0])]


def test_section_dumps(spark, tmp_path):
    x, r, y = np.array([[1.25, -2, 3]]), np.array([[0, 1, 1]]), np.array([[1.0, 2, 3], [4, 5, 6]])
    path = put(tmp_path, "xry.txt", "#=====#\n# X R Y\n#=====#\n#\n" + series.sections_text({"hidden process X": x, "markov chain R": r, "observed process Y": y}))
    rows = series.read_sections(spark, path).orderBy("n").collect()
    assert [(q.n, q.x, q.r, q.y) for q in rows] == [(0, 1.25, 0.0, [1.0, 4.0]), (1, -2.0, 1.0, [2.0, 5.0]), (2, 3.0, 1.0, [3.0, 6.0])]
    assert " 1 1" in series.sections_text({"r": r}) and "0.5000" in series.sections_text({"r": np.array([[0.5]])})


def test_parameter_files(spark, tmp_path):
    own = example_model()
    found, law = series.read_model(spark, put(tmp_path, "p.param", series.model_text(own, "2ter:0.1:0.2:0.0")))
    assert law == "2ter:0.1:0.2:0.0"
    for name in ("mean", "gamma", "sigma", "joint"):
        assert getattr(found, name) == pytest.approx(getattr(own, name))
    corners, law = series.read_model(spark, put(tmp_path, "c.param", series.corners_text(own, "4:0.15:0.6:0.2", 4)))
    assert law == "4:0.15:0.6:0.2" and corners.gamma == pytest.approx(own.gamma, abs=1e-4) and corners.mean == pytest.approx(own.mean)
    rng = np.random.default_rng(1)
    given = {"m": rng.random((2, 2, 4)), "lambda2": rng.random((2, 2)), "p": rng.random((2, 2, 2)), "pi2": rng.random((2, 2))}
    law, back = series.read_regression(spark, put(tmp_path, "r.param", series.regression_text(*given.values(), "2ter:0.1:0.2:0.0")))
    assert law == "2ter:0.1:0.2:0.0" and all(back[k] == pytest.approx(v, abs=1e-4) for k, v in given.items())


def test_shipped_like_files(spark, tmp_path):
    """Transition and noise matrices instead of covariances: Q = B B'."""
    own = example_model()
    f, q, _ = own.regression()
    text = "".join(f"# A {j} {k}\n{series.plain_matrix(f[0, 0], 12)}\n" for j in (0, 1) for k in (0, 1))
    text += "".join(f"# B {j} {k}\n{series.plain_matrix(np.linalg.cholesky(q[0, 0]), 12)}\n" for j in (0, 1) for k in (0, 1))
    text += f"# mean of X\n{series.plain_matrix(own.mean[:, :1])}\n# mean of Y\n{series.plain_matrix(own.mean[:, 1:])}\n"
    found, _ = series.read_model(spark, put(tmp_path, "ab.param", text))
    assert found.gamma[0] == pytest.approx(own.gamma[0], rel=1e-6) and found.sigma[0, 0] == pytest.approx(own.sigma[0, 0], rel=1e-6)


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5), (2, 3.0)], "k int, v double")
    series.write_csv(df, f"file://{tmp_path}/csv", ["v"])
    assert sorted(r.v for r in spark.read.option("header", True).schema("v double").csv(f"file://{tmp_path}/csv").collect()) == [2.5, 3.0]
    series.partition_by_key(df, f"file://{tmp_path}/keys", "k")
    assert (tmp_path / "keys" / "k=1").is_dir()
    assert series.latex_matrix(np.eye(2)) == "\\begin{pmatrix} 1.00 & 0.00 \\\\ 0.00 & 1.00 \\end{pmatrix}"


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
@pytest.mark.parametrize("split", [1, 7, 64])
def test_lines_are_numbered_over_splits(spark, tmp_path, end, split):
    """A file of many splits, also such that cut line ends, blank lines and long lines."""
    lines = [("" if i % 7 == 3 else " " if i % 11 == 5 else f"{i}.5" * (1 if i % 13 else 1) + (" " * 40 if i % 13 == 0 else "")) for i in range(90)]
    path = put(tmp_path, "n.txt", end.join(lines) + end)
    held = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        df = series.read_numbers(spark, path)
        got = sorted((r.n, r.value) for r in df.collect())
        found = series._lines(spark, path)
        numbers = sorted((r._n, r._line) for r in found.collect())
        assert found.select("_block").distinct().count() > 1 or split == 64
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)
    want = [(i, x.strip()) for i, x in enumerate(lines) if x.strip()]
    assert numbers == want and got == [(k, float(x)) for k, (_, x) in enumerate(want)]


def test_tables_to_files_and_back(spark, tmp_path):
    rows = [(i, float(i) / 3, i % 3, float(i * i)) for i in range(200)]
    df = spark.createDataFrame(rows, "n int, x double, r int, y double").repartition(5)
    series.write_sections(df, f"file://{tmp_path}/dump", "n", {"hidden process X": "x", "markov chain R": "r", "observed process Y": "y"})
    got = series.read_sections(spark, f"file://{tmp_path}/dump").orderBy("n").collect()
    assert [(q.n, q.r, q.y) for q in got] == [(n, float(r), y) for n, _, r, y in rows] and all(abs(q.x - x[1]) < 6e-5 for q, x in zip(got, rows, strict=True))
    series.write_numbers(df, f"file://{tmp_path}/numbers", "n", "x")
    back = series.read_numbers(spark, f"file://{tmp_path}/numbers", across=True).orderBy("n").collect()
    assert [(q.n, q.value) for q in back] == [(n, x) for n, x, _, _ in rows]
