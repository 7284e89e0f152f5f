"""Documents whose n-gram sets have a Jaccard similarity above a threshold, as components."""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph, shared
from .repeats import mixed

CHUNK = 48
KNOWN = 1_000_000
#: Words whose hashes a task keeps, and shingles (8 bytes each) that a block of a trie join holds.
KNOWN_WORDS = 1_000_000
BLOCK_SHINGLES = 2_000_000
#: Partitions of the token space that a set tries in turn (see signatures()).
LEVELS = 12


class WordHashes(dict):
    """64-bit keyed hashes of words; a word met before costs a look-up."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=b"word").digest(), "little")
        return found


_hashes = WordHashes()


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of a text, A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    if len(_hashes) > KNOWN_WORDS:
        _hashes.clear()
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted set of hashes of n-word shingles; a shorter text is one shingle, one without words has none."""
    words = word_hashes(text)
    size = min(n, len(words))
    if not size:
        return words
    total = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        total = mixed(total * np.uint64(0x9FB21C651E98DF25) + words[i : len(words) - size + 1 + i])
    return np.unique(total)


def set_id(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "big", signed=True)


@functools.lru_cache
def _band_starts(threshold: Fraction) -> list[int]:
    """Least sizes of size bands, up to 2**40: a set's partners are at most one band away."""
    found = [1]
    while found[-1] < 2**40:
        found.append(int(found[-1] / threshold) + 1)
    return found


@functools.lru_cache(maxsize=4096)
def _band_plan(band: int, threshold: Fraction) -> int:
    """In how many tokens two linked sets of this band (one may be of the band before) can differ."""
    return int(2 * int(_band_starts(threshold)[band] / threshold) * (1 - threshold) / (1 + threshold))


@functools.lru_cache(maxsize=4096)
def _band_slack(band: int, threshold: Fraction) -> int:
    """Empty parts that a set may have at a level and still stop there: four of five of the band's smallest sets have no more."""
    k, n = _band_plan(band, threshold), _band_starts(threshold)[max(0, band - 1)]
    slack = 0
    while True:
        parts = k + 1 + slack
        mean = parts * (1 - 1 / parts) ** n
        term = total = math.exp(-mean)
        for i in range(1, slack + 1):
            term *= mean / i
            total += term
        if total >= 0.8:
            return slack
        slack += 1


def signatures(tokens: np.ndarray, threshold: Fraction) -> np.ndarray:
    """Two different sets above the threshold share a signature.

    In a band of sizes the two differ in k tokens at most, so of k + 1 + s parts of the token space s + 1 hold the same
    tokens in both. If one of the sets has at most s empty parts, one of these is not empty, and its hash is a
    signature; empty parts, which most sets of a band would share, are none. A set with more of them also has the
    signatures of the next level, which deals tokens into parts anew, so of two such sets one must stop, or both go on.
    The rare sets that stop at no level share one signature for each band. Each set has those of its band and of the next.
    """
    own = bisect.bisect_right(_band_starts(threshold), len(tokens)) - 1
    out = []
    for band in (own, own + 1):
        k = _band_plan(band, threshold)
        if k < 1:
            continue
        slack = _band_slack(band, threshold)
        parts = k + 1 + slack
        hashed = mixed(tokens + np.uint64(band))
        for level in range(LEVELS):
            part = ((mixed(tokens + np.uint64(level << 32)) if level else tokens) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            sums = np.zeros(len(tokens) + 1, dtype=np.uint64)
            np.cumsum(hashed[order], out=sums[1:])
            edges = np.zeros(parts + 1, dtype=np.int64)
            np.cumsum(np.bincount(part, minlength=parts), out=edges[1:])
            some = np.flatnonzero(np.diff(edges))
            salt = some.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(band + (level << 20))
            out.append(mixed((sums[edges[some + 1]] - sums[edges[some]]) + salt))
            if parts - len(some) <= slack:
                break
        else:
            out.append(mixed(np.array([band], dtype=np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def _describe(batch: pd.DataFrame, n: int) -> Iterator[tuple[pd.DataFrame, None]]:
    sizes, nodes = [], []
    for text in batch["_text"]:
        tokens = shingles(text, n)
        sizes.append(len(tokens))
        nodes.append(set_id(tokens) if len(tokens) else None)
    yield pd.DataFrame({"n_shingles": sizes, "node": pd.array(nodes, dtype="Int64")}), None


def _sign(batches: Iterator[pd.DataFrame], n: int, threshold: Fraction) -> Iterator[pd.DataFrame]:
    """node and signature; a set that this task has met before (it forgets after KNOWN sets) needs none again."""
    known: set[int] = set()
    nodes, signed, room = [], [], 0
    table = lambda: pd.DataFrame({"node": np.repeat(np.array(nodes, dtype=np.int64), [len(x) for x in signed]), "signature": np.concatenate(signed)})
    for batch in batches:
        for text in batch["_text"]:
            tokens = shingles(text, n)
            node = set_id(tokens)
            if not len(tokens) or node in known:
                continue
            known.add(node)
            nodes.append(node)
            signed.append(signatures(tokens, threshold).view(np.int64))
            room += len(signed[-1])
            if room > 100_000:
                yield table()
                nodes, signed, room = [], [], 0
        if len(known) > KNOWN:
            known.clear()
    if signed:
        yield table()


def trie_join(sets: list[np.ndarray], threshold: Fraction) -> np.ndarray:
    """Component labels of distinct sets, linked where their Jaccard similarity reaches the threshold.

    The sets, sorted by one order of tokens (the most frequent first, so that paths are shared for long), are the paths of a trie. It is walked once; the overlap of a shared path
    with all sets is counted once for the whole subtree, and a set is dropped from a subtree when, with all tokens that
    it or the subtree's longest path has left, it could not reach the threshold with the shortest one.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    vocabulary, flat, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(vocabulary), dtype=np.int64)
    rank[np.argsort(-often, kind="stable")] = np.arange(len(vocabulary))
    owner = np.repeat(np.arange(m), sizes)
    flat = rank[flat][np.lexsort((rank[flat], owner))]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    ids = [flat[begin[i] : begin[i + 1]] for i in range(m)]
    by_token = np.argsort(flat, kind="stable")
    posting = owner[by_token]
    at = np.searchsorted(flat[by_token], np.arange(len(vocabulary) + 1))
    ranks = owner * len(vocabulary) + flat
    order = sorted(range(m), key=lambda i: ids[i].tolist())
    label = np.arange(m)
    top, bottom = threshold.numerator, threshold.denominator
    stack = [(0, m, 0, np.zeros(m, dtype=np.int64), np.arange(m))]
    while stack:
        low, high, depth, overlap, alive = stack.pop()
        members = order[low:high]
        head, tail = ids[members[0]], ids[members[-1]]
        most = min(len(head), len(tail))
        same = head[depth:most] == tail[depth:most]
        shared_to = depth + (int(np.argmin(same)) if len(same) and not same.all() else len(same))
        shortest, longest = sizes[members].min(), sizes[members].max()
        while depth < shared_to and len(alive):
            some = head[depth : min(shared_to, depth + CHUNK)]
            lengths = at[some + 1] - at[some]
            where = np.repeat(at[some] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
            overlap = overlap + np.bincount(posting[where], minlength=m)
            depth += len(some)
            left = sizes[alive] - (np.searchsorted(ranks, alive * len(vocabulary) + some[-1], side="right") - begin[alive])
            best = overlap[alive] + np.minimum(left, longest - depth)
            alive = alive[best * (top + bottom) >= top * (sizes[alive] + shortest)]
        if not len(alive):
            continue
        if len(head) == depth:
            hit = alive[overlap[alive] * (top + bottom) >= top * (sizes[alive] + len(head))]
            labels = np.unique(label[hit])
            if len(labels) > 1:
                label[np.isin(label, labels)] = labels[0]
            low += 1
        while low < high:
            token = ids[order[low]][depth]
            a, b = low, high
            while a < b:
                mid = (a + b) // 2
                if ids[order[mid]][depth] > token:
                    b = mid
                else:
                    a = mid + 1
            stack.append((low, a, depth, overlap, alive))
            low = a
    return label


def _join(batch: pd.DataFrame, n: int, threshold: Fraction) -> pd.DataFrame:
    found: dict[int, np.ndarray] = {}
    for node, text in zip(batch["node"], batch["_text"], strict=True):
        if node not in found and set_id(tokens := shingles(text, n)) == node:
            found[node] = tokens
    nodes = np.array(sorted(found), dtype=np.int64)
    if len(nodes) < 2:
        return pd.DataFrame({"a": nodes[:0], "b": nodes[:0]})
    label = trie_join([found[x] for x in nodes.tolist()], threshold)
    linked = label != np.arange(len(nodes))
    return pd.DataFrame({"a": nodes[linked], "b": nodes[label[linked]]})


def _id_name(column: str) -> Column:
    """An id as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("-"))


def _linked(texts: DataFrame, held: DataFrame, placed: DataFrame, n: int, threshold: Fraction) -> DataFrame:
    """Links (a, b) found by trie joins of the nodes of each _hub, _one, _two in `placed`."""
    wanted = shared.small(shared.save(held.join(placed, "node"), "placed"))
    rows = texts.join(wanted, ["_uid", "_name"]).select("_hub", "_one", "_two", "node", "_text")
    return rows.groupBy("_hub", "_one", "_two").applyInPandas(lambda batch: _join(batch, n, threshold), "a long, b long")


def _stars(signed: DataFrame) -> DataFrame:
    """node, _hub: all nodes of a signature meet under one of them, the one that shares most signatures (then the least).

    So the copies of one text, each changed at other places, meet under few hubs: under the least changed ones.
    """
    upto = Window.partitionBy("signature").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = shared.save(signed.withColumn("_first", F.first("node").over(upto)).filter("node != _first").distinct(), "met")
    every = met.select("signature", "node").unionByName(met.select("signature", F.col("_first").alias("node")).distinct())
    often = shared.save(every.groupBy("node").agg(F.count("*").alias("_often")), "often")
    first = Window.partitionBy("signature").orderBy(F.col("_often").desc(), "node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = every.join(shared.small(often), "node").withColumn("_hub", F.first("node").over(first)).filter("node != _hub").select("node", "_hub").distinct()
    stars = shared.save(found, "stars")
    shared.drop(met)
    shared.drop(often)
    return stars


def _merged(stars: DataFrame, block: int) -> DataFrame:
    """The same stars, but large ones that overlap so much that all their nodes together make fewer pairs are one."""
    large = stars.groupBy("_hub").agg(F.count("*").alias("_size")).filter(F.col("_size") > block)
    large = shared.save(stars.join(shared.small(shared.save(large, "large")), "_hub"), "large-stars")
    if large.isEmpty():
        return stars
    roots = graph.components(large.select(F.col("node").alias("a"), F.col("_hub").alias("b")))
    hubs = shared.save(large.select("_hub", "_size").distinct().join(shared.small(roots), F.col("_hub") == F.col("node")).select("_hub", "_size", "root"), "large-hubs")
    together = roots.groupBy("root").agg(F.count("*").alias("_all"))
    apart = hubs.groupBy("root").agg(F.sum(F.col("_size").cast("double") * F.col("_size")).alias("_apart"))
    chosen = apart.join(together, "root").filter(F.col("_all").cast("double") * F.col("_all") <= F.col("_apart")).select("root")
    moved = shared.save(hubs.join(chosen, "root").select("_hub", "root"), "moved")
    to = F.coalesce("root", "_hub").alias("_hub")
    every = stars.join(shared.small(moved), "_hub", "left").select("node", to).unionByName(moved.select(F.col("_hub").alias("node"), F.col("root").alias("_hub")))
    found = shared.save(every.filter("node != _hub").distinct(), "stars")
    for done in (stars, large, hubs, moved):
        shared.drop(done)
    return found


def _members(docs: DataFrame, key: str, text: str, n: int, percent: int, block: int) -> DataFrame:
    """_id, _uid (hash of the text), n_shingles, _root (null without words) of each row."""
    threshold = Fraction(percent, 100)
    given = docs.select(F.col(key).alias("_id"), F.xxhash64(text).alias("_uid"), F.col(text).alias("_text"))
    described = shared.save(shared.beside(given, ["_id", "_uid"], "n_shingles long, node long", lambda: lambda batch: _describe(batch, n)), "shingled")
    signed = given.select("_text").mapInPandas(lambda it: _sign(it, n, threshold), "node long, signature long")
    stars = _stars(signed)
    stars_all = stars.unionByName(stars.select(F.col("_hub").alias("node"), "_hub").distinct())
    held = (
        described.join(shared.small(stars_all.select("node").distinct()), "node", "left_semi").groupBy("node", "n_shingles")
        .agg(F.min(F.struct("_uid", _id_name("_id").alias("_name"))).alias("_held")).select("node", "n_shingles", "_held.*")
    )
    held = shared.save(held, "held")
    stars = _merged(stars, block)
    sizes = (
        stars.join(shared.small(held.select("node", "n_shingles")), "node").groupBy("_hub").agg(F.count("*").alias("_size"), F.sum("n_shingles").alias("_room"))
        .select("_hub", F.greatest(F.ceil(F.col("_size") / block), F.ceil(F.col("_room") / BLOCK_SHINGLES)).cast("int").alias("_blocks"))
    )
    texts = given.withColumn("_name", _id_name("_id")).drop("_id")
    dealt = stars.join(sizes, "_hub").withColumn("_own", F.pmod(F.xxhash64("node"), "_blocks").cast("int"))
    with_hub = dealt.unionByName(dealt.select(F.col("_hub").alias("node"), "_hub", "_blocks", "_own").distinct())
    links = shared.save(_linked(texts, held.drop("n_shingles"), with_hub.select("node", "_hub", F.col("_own").alias("_one"), F.col("_own").alias("_two")), n, threshold), "links")
    open_ = sizes.filter("_blocks > 1")
    if not open_.isEmpty():
        more = _across(stars.join(open_, "_hub"), graph.components(links), block)
        more = _linked(texts, held.drop("n_shingles"), more, n, threshold)
        links = shared.save(links.unionByName(more), "links")
    roots = graph.components(links)
    for done in (stars, held):
        shared.drop(done)
    wordless = described.filter("node IS NULL").select("_id", "_uid", "n_shingles", F.col("node").alias("_root"))
    members = described.filter("node IS NOT NULL").join(shared.small(roots), "node", "left").select("_id", "_uid", "n_shingles", F.coalesce("root", "node").alias("_root"))
    found = shared.save(members.unionByName(wordless), "members")
    shared.drop(described)
    shared.drop(links)
    return found


def _across(stars: DataFrame, roots: DataFrame, block: int) -> DataFrame:
    """node, _hub, _one, _two: pairs of blocks of stars that were joined in several, but for those that links already connect.

    A block holds nodes of one component (so far) only, or of small ones; two blocks of one component need no join.
    """
    named = stars.join(shared.small(roots.withColumnRenamed("root", "_so_far")), "node", "left").withColumn("_so_far", F.coalesce("_so_far", "node"))
    counts = named.groupBy("_hub", "_so_far").agg(F.count("*").alias("_n"))
    several = counts.groupBy("_hub").agg(F.count("*").alias("_parts"), F.sum(F.when(F.col("_n") < block // 2, F.col("_n")).otherwise(0)).alias("_few")).filter("_parts > 1").drop("_parts")
    kind = F.when(F.col("_n") < block // 2, F.lit(None)).otherwise(F.col("_so_far"))
    pieces = F.greatest(F.ceil(F.when(F.col("_n") < block // 2, F.col("_few")).otherwise(F.col("_n")) * F.col("_blocks") / F.col("_all")), F.lit(1)).cast("int")
    placed = (
        named.join(counts, ["_hub", "_so_far"]).join(several, "_hub").join(counts.groupBy("_hub").agg(F.sum("_n").alias("_all")), "_hub")
        .withColumn("_kind", kind).withColumn("_own", F.xxhash64("_kind", F.pmod(F.xxhash64("node"), pieces)))
        .select("node", "_hub", "_kind", "_own")
    )
    blocks = placed.select("_hub", "_kind", "_own").distinct()
    other = blocks.select("_hub", F.col("_kind").alias("_other_kind"), F.col("_own").alias("_other"))
    pairs = (
        placed.join(other, "_hub").filter("_kind IS NULL OR _other_kind IS NULL OR _kind != _other_kind")
        .select("node", "_hub", F.least("_own", "_other").alias("_one"), F.greatest("_own", "_other").alias("_two"))
    )
    return pairs.distinct()


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90, block: int = 1000) -> DataFrame:
    """key, n_shingles, component_id: documents linked where 100 * intersection >= percent * union of their n-word sets.

    component_id is the least key that links reach. Documents with equal sets are one node. Nodes that share a
    signature are candidates and belong to the star of one of them; large stars that overlap are one. A star is joined by tries of `block` nodes
    (or BLOCK_SHINGLES) each; then pairs of blocks of a larger star that links don't connect yet are tasks of their own.
    A text without words, empty or null, is linked with nothing. Rows with a repeated key are documents of
    their own; a null key takes part but is never the least. An empty table gives an empty result.
    """
    members = _members(docs, key, text, n, percent, block)
    worded = members.filter("_root IS NOT NULL")
    least = worded.groupBy("_root").agg(F.min("_id").alias("component_id"))
    wordless = members.filter("_root IS NULL").withColumn("component_id", F.col("_id"))
    return worded.join(least, "_root").unionByName(wordless).select(F.col("_id").alias(key), "n_shingles", F.coalesce("component_id", "_id").alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, block: int = 1000) -> DataFrame:
    """The rows of docs without near copies: of each component the row with the least key stays, and all rows without words.

    Of equal rows one stays; of several texts under one key those go that are in another's component. Columns may
    have any name; an empty table gives an empty result.
    """
    members = _members(docs, key, text, n, percent, block)
    groups = members.filter("_root IS NOT NULL").groupBy("_root").agg(F.min(F.struct("_id", "_uid")).alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    marked = members.join(groups, "_root").select(_id_name("_id").alias("_name"), "_uid", F.struct("_id", "_uid").eqNullSafe(F.col("_first")).alias("_one")).distinct()
    marks = shared.save(marked, "marks")
    shared.drop(members)
    rows = shared.packed(docs).withColumn("_name", _id_name(f"_row.`{key}`")).withColumn("_uid", F.xxhash64(f"_row.`{text}`"))
    joined = rows.join(shared.small(marks), ["_name", "_uid"], "left")
    copy = F.row_number().over(Window.partitionBy("_name", "_uid").orderBy("_name"))
    first = joined.filter("_one").withColumn("_copy", copy).filter("_copy = 1")
    return shared.unpacked(joined.filter("_one IS NULL").select("_row").unionByName(first.select("_row")))
