"""Quality rules: base counts and robust multivariate outliers per language and source, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Least standard deviation of each entry of the vector: spread below it says nothing about quality.
FLOORS = (1.0, 0.15, 1.0, 0.8, 0.2)
D = len(FLOORS)
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]
BINS_PER_LOG = 32
#: Estimates of so many languages and sources are broadcast (about 200 bytes each); more are joined by a shuffle.
BROADCAST_GROUPS = 50_000


def chi2_cdf(x: float, k: int) -> float:
    """Distribution function of chi-square with k degrees of freedom, by the series of the incomplete gamma function."""
    term = total = 1 / (k / 2)
    for n in range(1, 400):
        term *= x / 2 / (k / 2 + n)
        total += term
    return total * math.exp(-x / 2 + (k / 2) * math.log(x / 2) - math.lgamma(k / 2))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 1e-9, 400.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return low


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def describe(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long; 0 for a null text).

    Repeated windows of three words are found by sorting one long for each window: its hash with the lowest bits
    replaced by its place. Neighbours with equal hash bits are compared word by word. Columns of those names are
    replaced, all others may have any name; rows with a repeated key are described each; an empty table gives none.
    """
    whole = F.coalesce(F.col(f"_row.`{text}`"), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(shared.WORD))
    base = (
        shared.packed(docs, *COUNTS).withColumn("_words", shared.words(F.col(f"_row.`{text}`"))).withColumn("_lines", lines)
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", F.length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("_bits", F.length(F.bin("n_words")))
    )
    sorted_ = F.expr("""
        CASE WHEN n_words < 4 THEN array() ELSE sort_array(transform(sequence(0L, n_words - 3L), i ->
            shiftleft(shiftright(xxhash64(get(_words, int(i)), get(_words, int(i) + 1), get(_words, int(i) + 2)), _bits), _bits) | i)) END""").cast("array<bigint>")
    same = """(shiftright(x, _bits) = shiftright(get(_sorted, k + {0}), _bits)
        AND get(_words, int(x & _mask)) = get(_words, int(get(_sorted, k + {0}) & _mask))
        AND get(_words, int(x & _mask) + 1) = get(_words, int(get(_sorted, k + {0}) & _mask) + 1)
        AND get(_words, int(x & _mask) + 2) = get(_words, int(get(_sorted, k + {0}) & _mask) + 2))"""
    repeated = F.expr(f"filter(_sorted, (x, k) -> coalesce({same.format(-1)}, false) OR coalesce({same.format(1)}, false))")
    covered = F.expr("size(array_distinct(flatten(transform(_repeated, x -> array(x & _mask, (x & _mask) + 1, (x & _mask) + 2)))))")
    found = (
        base.withColumn("_mask", F.expr("shiftleft(1L, _bits) - 1")).withColumn("_sorted", sorted_)
        .withColumn("_repeated", repeated).withColumn("n_repeat_words", covered.cast("long"))
    )
    return shared.unpacked(found, *COUNTS)


def base_failed(least_words: int = 50, most_repeated: int = 50) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def vector() -> list[Column]:
    """Length, length of words, share of symbols, repeated lines, share of repeated words; logs and roots tame their tails."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log(n),
        F.log((F.col("word_chars") + 1) / n),
        F.log1p(100 * F.col("n_symbols") / n),
        F.log1p(F.col("n_dup_lines").cast("double")),
        F.sqrt(F.col("n_repeat_words") / n),
    ]


def _distance(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Adds _d2, the squared Mahalanobis distance, by forward substitution with each estimate's Cholesky factor."""
    out = rows.join(estimates, "_group", "left")
    for i in range(D):
        rest = F.col(f"_x{i}") - F.col(f"_m{i}")
        for j in range(i):
            rest = rest - F.col(f"_l{i}{j}") * F.col(f"_z{j}")
        out = out.withColumn(f"_z{i}", rest / F.col(f"_l{i}{i}"))
    total = sum((F.col(f"_z{i}") ** 2 for i in range(1, D)), F.col("_z0") ** 2)
    return out.withColumn("_d2", total).drop(*(f"_z{i}" for i in range(D)), *(f"_m{i}" for i in range(D)), *(f"_l{i}{j}" for i, j in PAIRS))


def _cholesky(moments: DataFrame, scale: float) -> DataFrame:
    """_m, _l and _logdet of each group and start from the weighted counts and sums of its subset.

    A variance under its floor is raised to it, which leaves the matrix positive.
    """
    out = moments
    for i in range(D):
        out = out.withColumn(f"_m{i}", F.col(f"_s{i}") / F.col("_n"))
    for i, j in PAIRS:
        cov = scale * (F.col(f"_q{i}{j}") / F.col("_n") - F.col(f"_m{i}") * F.col(f"_m{j}"))
        out = out.withColumn(f"_c{i}{j}", F.greatest(cov, F.lit(FLOORS[i] ** 2)) if i == j else cov)
    for i, j in PAIRS:
        rest = F.col(f"_c{i}{j}")
        for k in range(j):
            rest = rest - F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}")
        out = out.withColumn(f"_l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"_l{j}{j}"))
    logdet = sum((2 * F.log(f"_l{i}{i}") for i in range(1, D)), 2 * F.log("_l00"))
    return out.select("_group", "_start", *(f"_m{i}" for i in range(D)), *(f"_l{i}{j}" for i, j in PAIRS), logdet.alias("_logdet"))


def _spreads(rows: DataFrame) -> DataFrame:
    """Medians and quartile spreads of each entry and group, from counts on a grid of 1/64."""
    long = rows.select("_group", F.posexplode(F.array(*(F.floor(F.col(f"_x{i}") * 64) for i in range(D)))).alias("_entry", "_bin"))
    counts = long.groupBy("_group", "_entry", "_bin").count()
    upto = Window.partitionBy("_group", "_entry").orderBy("_bin")
    all_ = Window.partitionBy("_group", "_entry")
    share = counts.withColumn("_share", F.sum("count").over(upto) / F.sum("count").over(all_))
    at = lambda p: (F.min(F.when(F.col("_share") >= p, F.col("_bin"))) + 0.5) / 64
    spread = share.groupBy("_group", "_entry").agg(at(0.5).alias("_mid"), ((at(0.75) - at(0.25)) / 1.349).alias("_wide"))
    pick = lambda i, c: F.max(F.when(F.col("_entry") == i, F.col(c)))
    return spread.groupBy("_group").agg(
        *(pick(i, "_mid").alias(f"_m{i}") for i in range(D)),
        *((F.greatest(pick(i, "_wide"), F.lit(FLOORS[i])) if i == j else F.lit(0.0)).alias(f"_l{i}{j}") for i, j in PAIRS),
    )


def _subset(distances: DataFrame, share: float, scale: float) -> DataFrame:
    """Estimates from the `share` of each group's and start's rows with the least _d2.

    Counts and sums are pre-aggregated per distance bin of 1 / BINS_PER_LOG in the logarithm; bins are taken from the
    nearest on, and the last one by the weight that makes the share exact. So no group is one task's, however hot.
    """
    names = ["_n", *(f"_s{i}" for i in range(D)), *(f"_q{i}{j}" for i, j in PAIRS)]
    binned = distances.withColumn("_near", F.floor(F.log(F.greatest(F.col("_d2"), F.lit(1e-9))) * BINS_PER_LOG))
    sums = binned.groupBy("_group", "_start", "_near").agg(
        F.count("*").cast("double").alias("_n"),
        *(F.sum(f"_x{i}").alias(f"_s{i}") for i in range(D)),
        *(F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_q{i}{j}") for i, j in PAIRS),
    )
    upto, all_ = Window.partitionBy("_group", "_start").orderBy("_near"), Window.partitionBy("_group", "_start")
    weight = F.least(F.lit(1.0), (share * F.col("_all") - F.col("_before")) / F.col("_n"))
    inside = sums.withColumn("_before", F.sum("_n").over(upto) - F.col("_n")).withColumn("_all", F.sum("_n").over(all_)).withColumn("_weight", weight).filter("_weight > 0")
    return _cholesky(inside.groupBy("_group", "_start").agg(*(F.sum(F.col("_weight") * F.col(c)).alias(c) for c in names)), scale)


def estimates(rows: DataFrame, share: float, steps: int) -> DataFrame:
    """Minimum covariance determinant of each _group: concentration steps from three starts, of which the least determinant stays.

    Starts are the medians with quartile spreads, the half of the rows nearest to the medians in their farthest entry,
    and all rows. A step takes the `share` of a group's rows nearest to its present estimate; their mean and covariance
    are the next one. A step is one shuffle of pre-aggregated bins; all starts share it.
    """
    scale = share / chi2_cdf(chi2_quantile(share, D), D + 2)
    spread = shared.save(_spreads(rows), "quality-spreads")
    near = rows.join(spread, "_group")
    farthest = F.greatest(*(((F.col(f"_x{i}") - F.col(f"_m{i}")) / F.col(f"_l{i}{i}")) ** 2 for i in range(D)))
    drop = [*(f"_m{i}" for i in range(D)), *(f"_l{i}{j}" for i, j in PAIRS)]
    half = _subset(near.withColumn("_d2", farthest).withColumn("_start", F.lit(1)).drop(*drop), 0.5, 1.0)
    every = _subset(rows.withColumn("_d2", F.lit(1.0)).withColumn("_start", F.lit(2)), 1.0, 1.0)
    first = spread.withColumn("_start", F.lit(0)).withColumn("_logdet", F.lit(0.0))
    now = shared.save(first.unionByName(half).unionByName(every), "quality-estimates")
    shared.drop(spread)
    for _ in range(steps):
        after = shared.save(_subset(_distance(rows, now.drop("_logdet")), share, scale), "quality-estimates")
        shared.drop(now)
        now = after
    least = F.min_by(F.struct(*drop), F.struct("_logdet", "_start"))
    best = shared.save(now.groupBy("_group").agg(least.alias("_best")).select("_group", "_best.*"), "quality-best")
    shared.drop(now)
    return best


def judge(described: DataFrame, lang: str = "lang", source: str = "source", share: float = 0.75, steps: int = 5, level: float = 0.99, least_rows: int = 40) -> DataFrame:
    """Adds base_failed, kept and distance (squared; null where the method has no say) to the rows of describe().

    The rows that pass the base rules are fitted per language and source (a null is a value of its own). A row goes if
    its squared distance exceeds the `level` quantile of chi-square. Sources with under `least_rows` such rows in a
    language are fitted together, languages where these are too few as well all together; where even those are fewer,
    rows are kept unless a base rule fails. Columns named like the results are replaced, others may have any name; an
    empty table gives an empty result.
    """
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"_row.`{c}`")), F.lit("-"))
    own = [F.col(f"_row.{c}").alias(c) for c in COUNTS]
    marked = shared.packed(described, "base_failed", "kept", "distance").select("_row", *own, part(lang).alias("_lang"), part(source).alias("_source"))
    marked = marked.withColumn("base_failed", base_failed()).withColumns({f"_x{i}": c for i, c in enumerate(vector())})
    sizes = shared.save(marked.filter("NOT base_failed").groupBy("_lang", "_source").agg(F.count("*").alias("_rows")), "quality-groups")
    small = sizes.filter(F.col("_rows") < least_rows)
    language = small.groupBy("_lang").agg(F.sum("_rows").alias("_together"))
    pair = F.concat_ws("\x1f", F.lit("2"), "_lang", "_source")
    named = shared.save(
        sizes.join(language, "_lang", "left")
        .withColumn("_group", F.when(F.col("_rows") >= least_rows, pair).when(F.col("_together") >= least_rows, F.concat_ws("\x1f", F.lit("1"), "_lang")).otherwise(F.lit("0")))
        .select("_lang", "_source", "_group"), "quality-named",
    )
    hint = F.broadcast if named.count() <= BROADCAST_GROUPS else lambda x: x
    marked = marked.join(hint(named), ["_lang", "_source"], "left").withColumn("_group", F.coalesce("_group", F.lit("0")))
    rows = marked.filter("NOT base_failed").select("_group", *(f"_x{i}" for i in range(D)))
    enough = rows.groupBy("_group").agg(F.count("*").alias("_rows")).filter(F.col("_rows") >= least_rows).select("_group")
    found = estimates(rows, share, steps).join(enough, "_group")
    out = _distance(marked, hint(found)).withColumnRenamed("_d2", "distance")
    verdict = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= chi2_quantile(level, D))
    return shared.unpacked(out.withColumn("kept", verdict), "base_failed", "kept", "distance")
