"""A corpus pipeline of five stages: quality rules, near copies, benchmark leaks, mixing and sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import decontaminate, jaccard, mixture, quality, shared, sharding


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the robust outlier test keep."""
    described = shared.save(quality.describe(docs), "pipeline-described")
    return quality.judge(described).filter("kept").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more."""
    shared.ship_package(spark)
    return jaccard.one_of_each(docs, n=5, percent=80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = shared.save(decontaminate.contaminated(docs.select("doc_id", "text"), benchmark), "pipeline-leaks")
    return decontaminate.without(docs, found)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, to the nearest whole number of times.

    Only the documents at the end of a source's last pass are taken in part, so rounding moves a source's words by a
    document or two. Documents without words, which the mix has no say in, stay once. Equal rows share what is taken.
    """
    rows = shared.packed(docs)
    rows = rows.withColumn("_one", shared.row_hash(0, [F.col("_row.doc_id"), F.col("_row.text"), F.col("_row.source")]))
    taken = mixture.mix(rows.select(F.col("_one").alias("doc_id"), F.col("_row.source").alias("source"), shared.n_words(F.col("_row.text")).alias("size")))
    times = (
        taken.groupBy(F.col("doc_id").alias("_one")).agg(F.sum("taken").alias("_taken"), F.sum("size").alias("_size"))
        .select("_one", F.when(F.col("_size") == 0, 1).otherwise(F.round(F.col("_taken") / F.greatest("_size", F.lit(1)))).cast("int").alias("_times")).filter("_times > 0")
    )
    times = shared.small(shared.save(times, "pipeline-times"))
    return shared.unpacked(rows.join(times, "_one").withColumn("_time", F.explode(F.sequence(F.lit(1), "_times"))))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in 40 shards, uniformly shuffled: the columns of documents, shard and slot."""
    return sharding.shard(docs, shards=40)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing sources to target weights", mixing),
    ("sharding", shards),
]

#: Components, the outlier fit and the shuffle aren't SQL; tests/llm/test_pipeline.py checks the stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES):
        with shared.scratch():
            after = shared.keep(shared.save(stage(spark, docs, sf_dir), f"pipeline-{number}"))
        if number:
            shared.drop(docs)
        docs = after
    return docs
