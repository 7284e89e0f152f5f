"""Ids beyond 2**53 beside a null come out of each operator as they went in."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidewater.llm import jaccard, lattice, repeats, wrappers

IDS = [9007199254740993, 9007199254740995, None, -9007199254740993, 3]


def documents(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice("abcdefgh") * 3 for _ in range(90)), "en") for k in IDS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)


def ids(df, name="doc_id"):
    return sorted((r[name] is not None, r[name] or 0) for r in df.collect())


WANT = sorted((k is not None, k or 0) for k in IDS)


def test_jaccard(spark):
    out = jaccard.jaccard_components(documents(spark))
    assert ids(out) == WANT and ids(out, "component_id") == WANT


def test_one_of_each(spark):
    docs = documents(spark)
    assert ids(jaccard.one_of_each(docs.unionByName(docs.filter("doc_id > 5")))) == WANT


def test_lattice(spark):
    docs = documents(spark).withColumn("held_out", F.col("doc_id") == 3)
    docs = docs.withColumn("held_out", F.coalesce("held_out", F.lit(False)))
    assert ids(lattice.score(docs, "held_out", public_tokenizers.path("piece_bpe_32k.model"))) == WANT


def test_repeats(spark):
    out = repeats.remove_repeats(documents(spark).select("doc_id", "text"))
    assert ids(out) == WANT and {bytes(r.kept).decode() for r in out.collect()} == {r.text for r in documents(spark).collect()}


@pytest.mark.parametrize("column", ["page_id"])
def test_wrappers(spark, column):
    pages = spark.createDataFrame([(k, "http://a.example/x", f"<html><body><p>Some text number {i} with words</p></body></html>") for i, k in enumerate(IDS)], f"{column} long, url string, html string").coalesce(1)
    out = wrappers.extract(pages)
    assert ids(out, column) == WANT and all("words" in r.text for r in out.collect())
