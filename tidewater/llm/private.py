"""Personal data: base patterns, and identifiers found by contexts learned from them, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. A run's first character, or the end of the match before (\G), is the only place where a leftmost
#: match can start, and runs never give back characters that the next part cannot take: linear time on any text.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A word with a digit or an @ in it.
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _matches(text: Column, name: str, pattern: str) -> Column:
    """Matches as structs kind, nr, gap (length of the text before, since the last match), before (its end), after (start of what follows), found."""
    p, m = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(
        F.coalesce(text.rlike(pattern), F.lit(False)),
        F.transform(
            F.filter(F.arrays_zip(m.alias("m"), p.alias("p"), F.slice(p, 2, F.size(p)).alias("q")), lambda x: x["m"].isNotNull()),
            lambda x, i: F.struct(
                F.lit(name).alias("kind"), i.alias("nr"), F.length(x["p"]).alias("gap"),
                F.right(x["p"], F.lit(60)).alias("before"), F.left(x["q"], F.lit(30)).alias("after"), x["m"].alias("found"),
            ),
        ),
    ).otherwise(F.array())


def _valid() -> Column:
    """Whether a match of a base pattern stands: parts of an ip to 255, digits of cards (with the Luhn sum) and phones."""
    digits = F.regexp_replace("found", "[^0-9]", "")
    n = F.length(digits)
    luhn = F.expr("""aggregate(sequence(1, length(_digits)), 0, (s, i) -> s + CASE WHEN i % 2 = 1 THEN int(substr(_back, i, 1))
        ELSE int(substr('0246813579', int(substr(_back, i, 1)) + 1, 1)) END) % 10 = 0""")
    return (
        F.when(F.col("kind") == "ip", F.col("found").rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$"))
        .when(F.col("kind") == "card", F.when(n.between(12, 19), luhn).otherwise(False))
        .when(F.col("kind") == "phone", n.between(9, 15))
        .otherwise(True)
    )


def _shape(kind: str) -> Column:
    """Whether a candidate could be an identifier of the kind at all."""
    digits = F.length(F.regexp_replace("core", "[^0-9]", ""))
    return {
        "email": F.col("core").contains("@"),
        "ip": F.col("core").rlike(r"^[0-9A-Fa-f]+([.:\[\]]+[0-9A-Fa-f]+){3,7}$"),
        "card": F.col("core").rlike(r"^[0-9][0-9./-]*[0-9]$") & digits.between(12, 19),
        "phone": F.col("core").rlike(r"^[0-9+(][0-9()./-]*[0-9]$") & digits.between(6, 15),
    }[kind]


def _discover(candidates: DataFrame, rounds: int, support: int, confidence: float) -> DataFrame:
    """instance, kind of strings that patterns with high confidence find.

    The graph links each distinct string to its contexts: the two words before it, and the word before with the word
    after; a place with no word there has no such context. In each round a context scores, for each kind, the share of its strings that bear the kind (one string more
    in the divisor, `support` bearers at least, be they seeds or found since); a string without a kind takes a kind that its shape allows if contexts make it probable by
    1 - product(1 - score) >= `confidence`, and is a seed for the next round.
    """
    contexts = F.array(F.when(F.col("left2") != "", F.concat_ws("\x1f", F.lit("2"), "left2")), F.when((F.col("left1") != "") & (F.col("right1") != ""), F.concat_ws("\x1f", F.lit("1"), "left1", "right1")))
    edges = shared.save(
        candidates.select("instance", "core", "seed", F.explode(F.array_compact(contexts)).alias("pattern"))
        .groupBy("instance", "pattern").agg(F.max("seed").alias("seed"), F.min("core").alias("core")),
        "pii-edges",
    )
    totals = shared.save(edges.groupBy("pattern").agg(F.count("*").alias("_all")).filter(F.col("_all") >= support), "pii-totals")
    found = shared.save(edges.filter("seed IS NOT NULL").select("instance", F.col("seed").alias("kind")).distinct(), "pii-found")
    open_ = edges.filter("seed IS NULL").select("instance", "core", "pattern")
    for _ in range(rounds):
        votes = edges.join(found, "instance").groupBy("pattern", "kind").agg(F.count("*").alias("_bearing")).join(totals, "pattern")
        scored = votes.filter(F.col("_bearing") >= support).withColumn("_score", F.col("_bearing") / (F.col("_all") + 1.0)).filter(F.col("_score") >= 0.5)
        fits = F.coalesce(*(F.when((F.col("kind") == k), _shape(k)) for k in KINDS))
        likely = (
            open_.join(scored.select("pattern", "kind", "_score"), "pattern").filter(fits)
            .groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("_score"))))).alias("_p")).filter(F.col("_p") >= confidence)
            .groupBy("instance").agg(F.max_by("kind", "_p").alias("kind"))
        )
        after = shared.save(found.unionByName(likely.join(found, "instance", "left_anti")), "pii-found")
        shared.drop(found)
        found = after
    return found


def find_private(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = 3, support: int = 8, confidence: float = 0.9) -> DataFrame:
    """key, spans: array of (start, kind_nr, kind, end, base), sorted; code points, end exclusive.

    Base spans are leftmost, non-overlapping matches per kind that stand. They seed the search for contexts; spans with
    base = false are words in the contexts found, unless a base span overlaps them. Every row of docs gives a row;
    a null text is empty; repeated rows and keys are documents of their own.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    kinds = [_matches(whole, k, p) for k, p in PATTERNS.items()] + [_matches(whole, "word", CANDIDATE)]
    rows = shared.save(
        docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.when(whole.rlike("[0-9@]"), F.concat(*kinds)).alias("_matches")), "pii-matches"
    )
    order = Window.partitionBy("_row", "kind").orderBy("nr")
    placed = shared.save(
        rows.select("_row", F.inline("_matches")).withColumn("end", F.sum(F.col("gap") + F.length("found")).over(order).cast("int"))
        .withColumn("start", F.col("end") - F.length("found"))
        .withColumn("_digits", F.regexp_replace("found", "[^0-9]", "")).withColumn("_back", F.reverse("_digits"))
        .filter(_valid()).drop("_digits", "_back", "gap", "nr"),
        "pii-placed",
    )
    base = placed.filter("kind != 'word'").select("_row", "start", "kind", "end")
    lists = base.groupBy("_row").agg(F.collect_list(F.struct("start", "end", "kind")).alias("_base"))
    words = (
        placed.filter("kind = 'word'").join(lists, "_row", "left")
        .withColumn("core", F.regexp_extract("found", r"[A-Za-z0-9+(](?:.*[A-Za-z0-9])?", 0)).filter("core != ''")
        .withColumn("start", F.col("start") + F.expr("instr(found, core) - 1")).withColumn("end", F.col("start") + F.length("core"))
        .filter("size(filter(coalesce(_base, array()), b -> b.start < end AND b.end > start)) = 0")
        .select("_row", "start", "end", "core", F.lit(None).cast("string").alias("seed"), "before", "after")
    )
    seeds = placed.filter("kind != 'word'").select("_row", "start", "end", F.col("found").alias("core"), F.col("kind").alias("seed"), "before", "after")
    two = r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+)[\x20\x09-\x0D]+$"
    candidates = (
        seeds.unionByName(words)
        .withColumn("left1", F.lower(F.regexp_extract("before", r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+$", 1)))
        .withColumn("left2", F.lower(F.regexp_replace(F.regexp_extract("before", two, 1), shared.SPACE, " ")))
        .withColumn("right1", F.lower(F.regexp_extract("after", r"^[\x20\x09-\x0D]+([^\x20\x09-\x0D]+)", 1)))
        .withColumn("instance", F.lower("core")).drop("before", "after")
    )
    candidates = shared.save(candidates, "pii-candidates")
    found = _discover(candidates, rounds, support, confidence)
    new = candidates.filter("seed IS NULL").join(found, "instance").select("_row", "start", "kind", "end", F.lit(False).alias("base"))
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    spans = base.withColumn("base", F.lit(True)).unionByName(new).groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", number.alias("kind_nr"), "kind", "end", "base"))).alias("spans"))
    joined = rows.select("_row", "_key").join(spans, "_row", "left")
    return joined.select(F.col("_key").alias(key), F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))
