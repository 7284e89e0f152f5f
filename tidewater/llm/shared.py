"""Helpers that several corpus operators use."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewater.cluster import ship_package

#: Words are maximal runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: A table of so many rows and bytes is broadcast at most; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32_000_000

_own_folder: list[str] = []
_scratch: list[list[DataFrame]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; only a local session (tests) may go without, with a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        made = tempfile.TemporaryDirectory(prefix="corpus-")
        atexit.register(made.cleanup)
        _own_folder.append(f"file://{made.name}")
    return _own_folder[0]


def save(df: DataFrame, name: str, compression: str = "snappy", **options: int) -> DataFrame:
    """Writes df as a Parquet table, with these options of the writer, in the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.options(compression=compression, **options).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.saved_path = path
    for held in _scratch[-1:]:
        held.append(back)
    return back


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Queries that run inside send so many rows to Python at once, not 10,000: for rows that are large, as a batch stands in memory in both processes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop(df: DataFrame) -> None:
    """Removes a table that save() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Tables that save() writes inside are dropped at the end; what is needed later is saved outside or with keep()."""
    _scratch.append([])
    try:
        yield
    finally:
        for df in _scratch.pop():
            drop(df)


def keep(df: DataFrame) -> DataFrame:
    """Takes a saved table out of the present scratch()."""
    for held in _scratch[-1:]:
        held[:] = [x for x in held if x is not df]
    return df


def fits(df: DataFrame, rows: int, size: int) -> bool:
    """Whether a saved table has at most so many rows and about so many bytes: 40 a row and those of its strings and lists of strings."""
    wide = [F.octet_length(f"`{c}`") for c, t in df.dtypes if t in ("string", "binary")] + [F.octet_length(F.array_join(f"`{c}`", "")) for c, t in df.dtypes if t == "array<string>"]
    n, *more = df.agg(F.count("*"), *(F.coalesce(F.sum(w), F.lit(0)) for w in wide)).first()
    return n <= rows and 40 * n + sum(more) <= size


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has BROADCAST_ROWS and BROADCAST_BYTES at most. df should be a saved table, as it is counted."""
    return F.broadcast(df) if fits(df, BROADCAST_ROWS, BROADCAST_BYTES) else df


def packed(df: DataFrame, *replaced: str) -> DataFrame:
    """One column `_row`, a struct of df's columns but `replaced`: no column that an operator adds can clash with them."""
    kept = df.drop(*replaced)
    return kept.select(F.struct(*(F.col(f"`{c}`") for c in kept.columns)).alias("_row"))


def unpacked(df: DataFrame, *more: str | Column) -> DataFrame:
    """The columns that packed() put away, and `more`."""
    return df.select("_row.*", *more)


def beside(df: DataFrame, carry: list[str], added: str, start: Callable[[], Callable[[pd.DataFrame], Iterable[tuple[pd.DataFrame, np.ndarray | None]]]]) -> DataFrame:
    """The columns `carry` of df beside the columns `added` (as DDL) that a function makes from the others.

    What is carried stays in Arrow: pandas would make doubles of integers beside a null. start() gives, once a task,
    the function from a batch of the other columns to tables, each with the batch's rows that its rows belong to
    (None: all of them in order; a negative one: none, and what is carried is null).
    """
    fields = T._parse_datatype_string(added)
    kinds = to_arrow_schema(fields)
    others = [c for c in df.columns if c not in carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for out, at in work(batch.select(others).to_pandas()):
                held = batch.select(carry)
                if at is not None:
                    held = held.take(pa.array(np.maximum(at, 0), mask=np.asarray(at) < 0))
                made = [pa.array(out[f.name], f.type, from_pandas=True) for f in kinds]
                yield pa.RecordBatch.from_arrays([*held.columns, *made], names=[*carry, *kinds.names])

    return df.select(*carry, *others).mapInArrow(run, T.StructType([*df.select(*carry).schema.fields, *fields.fields]))


def row_hash(seed: int, columns: list[Column]) -> Column:
    """A hash of some columns that tells a null from a missing place."""
    return F.xxhash64(F.lit(seed), *(x for c in columns for x in (c, c.isNull())))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def offsets(df: DataFrame, key: str, order: str, bucket: Column, value: str, ties: list[str], name: str) -> DataFrame:
    """Adds `name`: the sum of `value` over the rows of the same key that come before, in the order of `order`.

    `bucket` must not fall as `order` rises; a key is worked on bucket by bucket, so a hot key spreads over its buckets.
    `key` must not be null.
    """
    dealt = df.withColumn("_bucket", bucket)
    sums = dealt.groupBy(key, "_bucket").agg(F.sum(value).alias("_sum"))
    ahead = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(key, "_bucket", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_base"))
    within = Window.partitionBy(key, "_bucket").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.join(base, [key, "_bucket"])
        .withColumn(name, F.col("_base") + F.coalesce(F.sum(value).over(within), F.lit(0)))
        .drop("_bucket", "_base")
    )
