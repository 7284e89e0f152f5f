"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

#: Equal rows that a task numbers at once.
COPIES = 10_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Number of good ones among `drawn` of good + bad, by inversion outward from the mode; fits any size of table."""
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    mode = min(max(low, (drawn + 1) * (good + 1) // (good + bad + 2)), high)
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p = math.exp(choose(good, mode) + choose(bad, drawn - mode) - choose(good + bad, drawn))
    u = rng.random() - p
    up = down = mode
    p_up = p_down = p
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows of each partition that go to each shard, distributed as in a uniform shuffle with exactly these shard sizes."""
    rng = np.random.default_rng(seed)
    left, matrix = list(sizes), []
    for n in counts:
        row, rest, open_ = [], n, sum(left)
        for s, room in enumerate(left):
            got = hypergeometric(rng, room, open_ - room, rest)
            open_ -= room
            left[s] -= got
            rest -= got
            row.append(got)
        matrix.append(row)
    return matrix


def shard(docs: DataFrame, shards: int = 40, seed: int = 17, partitions: int = 2048) -> DataFrame:
    """Adds shard (0 to shards - 1) and slot (gapless from 0 in its shard): a uniform shuffle of all rows.

    Shard sizes differ by one row at most. A row is known by two hashes of all its columns and, among equal rows, a
    number, so reruns and lost executors give the same result and equal rows are placed independently. Rows are dealt
    into `partitions` virtual partitions by these. The driver draws the matrix from the partitions' counts
    (partitions x shards numbers, a bound that does not grow with the table); each partition permutes its rows and
    cuts them by its row of the matrix, and each shard permutes what it gets. Only ids are placed; the rows themselves
    join them once. Nulls and empty texts are values like any other; columns `shard` and `slot` of docs are
    replaced, all other names may be used; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = shared.packed(docs, "shard", "slot")
    own = [F.col(f"_row.`{f.name}`") for f in rows.schema["_row"].dataType.fields]
    rows = rows.withColumn("_one", shared.row_hash(seed, own)).withColumn("_two", shared.row_hash(~seed, own))
    counts = rows.groupBy("_one", "_two").agg(F.count("*").alias("_copies"))
    first = F.explode(F.expr(f"sequence(0L, _copies - 1, {COPIES}L)"))
    chunks = counts.filter("_copies = 1").withColumn("_first", F.lit(0).cast("long")).unionByName(
        counts.filter("_copies > 1").withColumn("_first", first).repartition("_one", "_first")
    )
    copies = chunks.withColumn("_copy", F.explode(F.expr(f"sequence(_first, least(_first + {COPIES - 1}, _copies - 1))")))
    name = ["_one", "_two", "_copy"]
    ids = shared.save(
        copies.select(
            *name, "_copies", F.pmod(F.xxhash64(F.lit(seed), *name), F.lit(partitions)).cast("int").alias("_partition"), F.xxhash64(F.lit(seed + 1), *name).alias("_mix"),
        ),
        "shard-ids",
    )
    counted = {r[0]: r[1] for r in ids.groupBy("_partition").count().collect()}
    total = sum(counted.values())
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    numbers = sorted(counted)
    matrix = communication_matrix([counted[p] for p in numbers], sizes, seed)
    cuts = [(p, np.cumsum(row).tolist()) for p, row in zip(numbers, matrix, strict=True)]
    schema = T.StructType([T.StructField("_partition", T.IntegerType()), T.StructField("_cuts", T.ArrayType(T.LongType(), False))])
    cut = spark.createDataFrame(cuts, schema)
    local = Window.partitionBy("_partition").orderBy("_mix", *name)
    sent = shared.save(
        ids.withColumn("_place", F.row_number().over(local) - 1)
        .join(F.broadcast(cut), "_partition")
        .select(
            *name, "_copies", F.size(F.filter("_cuts", lambda c: c <= F.col("_place"))).alias("shard"), F.xxhash64(F.lit(seed + 2), *name).alias("_second"),
            F.lit(1).alias("_each"),
        ),
        "shard-sent",
    )
    shared.drop(ids)
    slots = shared.offsets(sent, "shard", "_second", F.shiftright("_second", 54), "_each", name, "slot")
    placed = shared.save(slots.select("_one", "_two", "_copies", "shard", F.col("slot").cast("long").alias("slot")), "shard-slots")
    shared.drop(sent)
    single = rows.join(shared.small(placed.filter("_copies = 1").drop("_copies")), ["_one", "_two"])
    repeated = placed.filter("_copies > 1").drop("_copies")
    one_each = rows.join(shared.small(repeated.select("_one", "_two").distinct()), ["_one", "_two"], "left_semi").groupBy("_one", "_two").agg(F.first("_row").alias("_row"))
    return shared.unpacked(single.select("_row", "shard", "slot").unionByName(one_each.join(repeated, ["_one", "_two"]).select("_row", "shard", "slot")), "shard", "slot")
