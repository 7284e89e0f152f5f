"""Mixing sources to target weights with a low-discrepancy schedule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: frac(phi) and frac(2**20 * phi) for the golden ratio phi: two parts keep the points exact to 1e-7 for 2**50 slots.
GOLDEN = 0.6180339887498949
GOLDEN_20 = 0.607787409740351
CELLS = 1024
SLOTS_PER_CHUNK = 1024


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """One row per source key: source_size, target, and its share [low, high) of the unit interval.

    Sources in code point order (null last) weigh `weights`, repeating. Targets share the whole size by weight; none
    exceeds `most` times its source's size. The level at which sources stop is found in closed form: in the order of
    cap / weight, the first source whose cap lies above the level that the ones before it leave.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    order = Window.orderBy("_ratio", "source_key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    steps = (
        sizes.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"))
        .withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double"))
        .withColumn("_cap", most * F.col("source_size").cast("double"))
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_left", F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_open", F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
        .withColumn("_level", F.when(F.col("_ratio") > F.col("_left") / F.col("_open"), F.col("_left") / F.col("_open")))
        .withColumn("_level", F.first("_level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("target", F.coalesce(F.least("_cap", F.col("_weight") * F.col("_level")), F.lit(0.0)))
    )
    share = F.col("target") / F.greatest(F.sum("target").over(every), F.lit(1e-300))
    upto = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return (
        steps.withColumn("_high", F.sum(share).over(upto))
        .select("source_key", "source_size", "target", F.lag("_high", 1, 0.0).over(by_name).alias("_low"), "_high")
    )


def schedule(targets: DataFrame, total: int, block: int) -> DataFrame:
    """The slots of the mix: slot, source_key, block, take (words taken from the block's start).

    Slot i has the point frac((i + 1) * phi), which falls into its source's share. Slots are ranked per source; rank r
    takes block r modulo the source's blocks. A source stops when its target, to a word, is reached; what the points
    leave of it (a few blocks) follows in slots at the end.
    """
    spark = targets.sparkSession
    n = -(-total // block)
    i = F.col("slot") + 1
    point = (F.floor(i / 2**20) * GOLDEN_20 + (i % 2**20) * GOLDEN) % 1.0
    wanted = F.round("target").cast("long")
    quotas = targets.withColumn("_wanted", wanted).withColumn("_blocks", F.ceil(F.col("source_size") / block)).withColumn(
        "_quota",
        F.when(F.col("source_size") > 0, F.expr("_wanted div source_size") * F.col("_blocks") + F.ceil((F.col("_wanted") % F.greatest("source_size", F.lit(1))) / block)).otherwise(0),
    )
    cells = quotas.filter("_quota > 0").select(
        "source_key", "_low", "_high",
        F.explode(F.sequence(F.floor(F.col("_low") * CELLS), F.least(F.floor(F.col("_high") * CELLS), F.lit(CELLS - 1)))).alias("_cell"),
    )
    points = spark.range(n).select(F.col("id").alias("slot")).withColumn("_point", point).withColumn("_cell", F.floor(F.col("_point") * CELLS)).withColumn("_one", F.lit(1))
    placed = points.join(cells, "_cell").filter("_point >= _low AND _point < _high").select("slot", "source_key", "_one")
    ranked = shared.offsets(placed, "source_key", "slot", F.floor(F.col("slot") / SLOTS_PER_CHUNK), "_one", [], "_rank").select("slot", "source_key", "_rank")
    counts = ranked.groupBy("source_key").agg(F.max("_rank").alias("_last"))
    rest = (
        quotas.filter("_quota > 0").join(counts, "source_key", "left")
        .filter("coalesce(_last, -1) + 1 < _quota")
        .select(F.lit(n).alias("slot"), "source_key", F.explode(F.expr("sequence(coalesce(_last, -1) + 1, _quota - 1)")).alias("_rank"))
    )
    return (
        ranked.unionByName(rest).join(quotas.filter("_quota > 0"), "source_key").filter("_rank < _quota")
        .withColumn("block", F.col("_rank") % F.col("_blocks"))
        .withColumn("take", F.least(F.lit(block), F.col("source_size") - F.col("block") * block, F.col("_wanted") - F.expr("_rank div _blocks") * F.col("source_size") - F.col("block") * block))
        .withColumn("block_size", F.least(F.lit(block), F.col("source_size") - F.col("block") * block))
        .select("slot", "source_key", "block", "block_size", "take")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block: int = 1024, seed: int = 11) -> DataFrame:
    """How much of each document a mix of all sources takes.

    docs: doc_id, source, size (words). Each source's documents, shuffled by a hash of doc_id and `seed`, form a stream
    that is cut into blocks of `block` words. Returns doc_id, source, size, source_size, target, taken, in which every
    row of docs has a row. A null source is a source; a document without words takes part with 0; repeated rows
    are documents of their own; an empty table gives an empty result. No document exceeds `most` times its size.
    """
    sizes = shared.save(
        docs.select(
            "doc_id", "source", F.col("size").cast("long").alias("size"),
            F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")).alias("source_key"),
            F.xxhash64(F.lit(seed), "doc_id").alias("_order"),
        ),
        "mix-sizes",
    )
    total = sizes.agg(F.sum("size")).first()[0] or 0
    targets = shared.save(source_targets(sizes, weights, most), "mix-targets")
    takes = schedule(targets, total, block).groupBy("source_key", "block").agg(
        F.sum((F.col("take") == F.col("block_size")).cast("long")).alias("_full"),
        F.max(F.when(F.col("take") < F.col("block_size"), F.col("take")).otherwise(0)).alias("_part"),
    )
    placed = shared.offsets(sizes.filter("size > 0"), "source_key", "_order", F.shiftright("_order", 52), "size", ["doc_id", "size"], "_start")
    start, end = F.col("_start") - F.col("block") * block, F.col("_start") + F.col("size") - F.col("block") * block
    low, high = F.greatest(start, F.lit(0)), F.least(end, F.lit(block))
    pieces = (
        placed.withColumn("block", F.explode(F.sequence(F.expr(f"_start div {block}"), F.expr(f"(_start + size - 1) div {block}"))))
        .join(takes, ["source_key", "block"], "left")
        .withColumn("_taken", F.coalesce(F.col("_full") * (high - low) + F.greatest(F.lit(0), F.least(high, F.col("_part")) - low), F.lit(0)))
    )
    taken = pieces.groupBy("source_key", "_start", "doc_id", "source", "size").agg(F.sum("_taken").alias("taken")).drop("_start")
    none = sizes.filter("size = 0").select("source_key", "doc_id", "source", "size", F.lit(0).cast("long").alias("taken"))
    return (
        taken.unionByName(none).join(targets.select("source_key", "source_size", "target"), "source_key")
        .select("doc_id", "source", "size", "source_size", "target", "taken")
    )
