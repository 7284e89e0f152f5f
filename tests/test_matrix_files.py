"""A matrix over several files: one line of names in all, rows numbered over the files, no task that has all rows."""

from pathlib import Path

from pyspark.sql import functions as F

from tidewater.sources import series


def test_matrix_over_files(spark, tmp_path):
    path = str(tmp_path / "matrix")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        series.write_matrix(spark.range(1000).select((999 - F.col("id")).alias("k"), (F.col("id") * 0.5).alias("a"), F.when(F.col("id") != 7, F.col("id")).alias("b")), path, "k", {"first": "a", "second": "b"})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    texts = [p.read_text().splitlines() for p in sorted(Path(path).glob("part-*"))]
    assert len(texts) > 1 and max(map(len, texts)) < 1000
    assert sum(texts, [])[0] == "first, second" and sum(line == "first, second" for t in texts for line in t) == 1
    got = series.read_matrix(spark, path, across=True).orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(1000))
    assert [r["values"] for r in got] == [[(999 - i) * 0.5, None if i == 992 else float(999 - i)] for i in range(1000)]
