"""Each catalogue query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tidewater.plans import catalogue, files, restore  # noqa: F401  these add to the catalogue

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    return round(float(value), 9) if isinstance(value, (int, float)) or hasattr(value, "as_tuple") else str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(([plain(row[i]) for i in order] for row in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF_DIR)
    want = duck.execute(catalogue.SQL[name])
    columns, rows = table([d[0] for d in want.description], want.fetchall())
    own_columns, own_rows = table(got.columns, got.collect())
    assert own_columns == columns
    assert len(own_rows) == len(rows)
    for own, row in zip(own_rows, rows, strict=True):
        for a, b in zip(own, row, strict=True):
            assert a == (pytest.approx(b, rel=1e-9, abs=1.1e-6) if isinstance(b, float) else b)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF_DIR).limit(3).count() > 0
