"""One query per operator, with production parameters over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, huffman, jaccard, lattice, mixture, packing, phrases, private, quality, repeats, shared, sharding, variants, wrappers


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir).select("doc_id", "source", shared.n_words(F.col("text")).alias("size"))
    return mixture.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(shared.documents(spark, sf_dir).select("doc_id", "text"))


def op3_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1
    docs = shared.documents(spark, sf_dir).select("doc_id", "text", "lang", held_out.alias("held_out"))
    return lattice.score(docs, "held_out", public_tokenizers.path("piece_bpe_32k.model"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
    )
    return sharding.shard(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = quality.describe(shared.documents(spark, sf_dir).select("doc_id", "text", "lang", "source")).drop("text")
    return quality.judge(shared.save(described, "quality")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir).select("doc_id", "text")
    return repeats.remove_repeats(docs).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private.find_private(shared.documents(spark, sf_dir).select("doc_id", "text"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, private.KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op8_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it holds; clean documents have none."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = decontaminate.contaminated(shared.documents(spark, sf_dir).select("doc_id", "text"), benchmark)
    return found.select("doc_id", "item_id", "n_windows", "n_item_windows", "exact")


def op9_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared.shared_folder(spark)}/token-files/{uuid.uuid4().hex}"
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    kind = huffman.kind_of(vocabulary)
    held = shared.save(huffman.tokenize(shared.documents(spark, sf_dir), vocabulary, kind=kind), "tokens", compression="zstd")
    huffman.write(held, path, kind=kind)
    shared.drop(held)
    return huffman.read(spark, path).select(
        "doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def op10_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.ship_package(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return wrappers.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(shared.documents(spark, sf_dir).select("lang", "text"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.forms(variants.word_counts(shared.documents(spark, sf_dir).select("doc_id", "text")))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = shared.documents(spark, sf_dir).select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def mixture_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1's part that SQL has: sizes and targets."""
    return op1_mixture(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5's part that SQL has: counts and the base rules."""
    return op5_quality(spark, sf_dir).drop("kept", "distance")


def private_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7's part that SQL has: how many spans of the base patterns."""
    return op7_private(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
MIXTURE_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT *, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY 1)),
r AS (SELECT *, 3.0::DOUBLE * source_size / w AS ratio FROM s),
l AS (SELECT *, (sum(source_size) OVER () - (sum(3 * source_size) OVER (ORDER BY ratio, i) - 3 * source_size))::DOUBLE / (sum(w) OVER () - (sum(w) OVER (ORDER BY ratio, i) - w)) AS level FROM r),
t AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, i LIMIT 1) * w) AS target FROM s)
SELECT doc_id, size, source_size, round(target, 4) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""
QUALITY_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
windows AS (SELECT doc_id, i, ws[i:i + 2] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(3) t(k) GROUP BY 1),
c AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    coalesce(l.n, 0) AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words FROM d LEFT JOIN lines l USING (doc_id) LEFT JOIN covered v USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
"""
_DIGITS = "list_transform(regexp_extract_all(m, '[0-9]'), lambda x: CAST(x AS INTEGER))"
PRIVATE_SQL = f"""
SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+')) AS BIGINT) AS n_email,
CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)'), lambda m: len(list_filter(string_split(m, '.'), lambda p: coalesce(TRY_CAST(p AS BIGINT) <= 255, false))) = 4)) AS BIGINT) AS n_ip,
CAST(len(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[0-9]([\\x20-]?[0-9])+'), lambda m: list_reverse({_DIGITS})),
    lambda b: len(b) BETWEEN 12 AND 19 AND list_sum(list_transform(b, lambda x, i: CASE WHEN i % 2 = 1 THEN x WHEN x > 4 THEN 2 * x - 9 ELSE 2 * x END)) % 10 = 0)) AS BIGINT) AS n_card,
CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '\\+[0-9][\\x20().0-9-]+[0-9]'), lambda m: len(regexp_extract_all(m, '[0-9]')) BETWEEN 9 AND 15)) AS BIGINT) AS n_phone FROM documents
"""

QUERIES = {"op1_mixture": op1_mixture, "op2_jaccard": op2_jaccard, "op3_lattice": op3_lattice, "op4_sharding": op4_sharding, "op5_quality": op5_quality, "op6_repeats": op6_repeats, "op7_private": op7_private, "op8_benchmark": op8_benchmark, "op9_huffman": op9_huffman, "op10_wrappers": op10_wrappers, "op11_phrases": op11_phrases, "op12_variants": op12_variants, "op13_packing": op13_packing, "mixture_targets": mixture_targets, "quality_counts": quality_counts, "private_counts": private_counts}
SQL: dict[str, str] = {"op11_phrases": phrases.SQL, "op12_variants": variants.SQL, "mixture_targets": MIXTURE_SQL, "quality_counts": QUALITY_SQL, "private_counts": PRIVATE_SQL}
