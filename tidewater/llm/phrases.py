"""Collocations: compressed position bitmaps of words, phrases grown depth-first by shift and AND, popcounts summed over shards."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Places of a shard; a bitmap keeps its blocks of 16 places that are not zero.
SHARD = 1 << 19
BITS = 16
#: Blocks of bitmaps of root words that are extended together, to their full depth, before the next ones.
ROOTS = 1 << 15
#: Bits of the largest set of hashes that is broadcast (16 MB). Hashes that collide cost work, never results.
MOST_BITS = 27
#: Bytes of text that are cut into words at once.
SLICE = 1 << 18
#: Frequent words up to which their places in order stand for them between tasks (32 MB of numbers); beyond, their hashes do.
DENSE = 1 << 22
#: Phrases that a task gathers before it sums equal ones.
GATHERED = 1 << 18
#: Occurrences of phrases of one length in a bucket of the shuffle, at most about this many.
BUCKET = 1 << 20
#: Rows sent to Python at once: documents; shards, which have several MB each, and cells of counts.
DOCUMENTS, SHARDS = 1000, 8
#: Shards in Parquet: bytes of a row group, which is as much as a task holds at once; a shard has several MB, so its size is looked at after each.
SHARD_FILES = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
LONGEST = 5

#: A piece ends at each of . , ; : ! ? and line feed to carriage return; words are parted by space and tab.
_TABLE = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
_CUT = re.compile(rb"[ \n]")
_NONE, _GAP = 0, 1
_SHARD = ["own", "langs", "words", "numbers", "counts", "ids", "sizes", "blocks", "masks"]


class _Words(dict):
    """Numbers of a language's words in a shard; all languages of the shard share the count."""

    def __init__(self, lang: str, names: list) -> None:
        super().__init__({b"": _NONE, b"\n": _GAP})
        self.lang, self.names = lang, names

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self.names)
        self.names.append((self.lang, word))
        return found


def _slices(text: bytes, step: int) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + step)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def _row(seq: np.ndarray, own: int, names: list, seed: int) -> pa.RecordBatch:
    """A shard: its words, how often each starts in it, and the bitmaps of their places."""
    at = np.flatnonzero(seq > _GAP)
    order = np.argsort(seq[at], kind="stable")
    at = at[order]
    word, block = seq[at], at // BITS
    new = np.flatnonzero(np.diff(word * (len(seq) + 1) + block, prepend=-1))
    masks = np.bitwise_or.reduceat(1 << (at % BITS), new) if len(new) else new
    first = np.flatnonzero(np.diff(word[new], prepend=-1))
    which = word[new][first].tolist()
    ids = np.array([xxhash.xxh3_64_intdigest(names[w][0].encode() + b" " + names[w][1], seed) >> 1 for w in which], dtype="<i8")
    n = np.bincount(word[at < own], minlength=len(names))[which] if which else np.zeros(0, dtype=np.int64)
    cells = [ids.tobytes(), np.diff(np.append(first, len(new))).astype("<i4").tobytes(), block[new].astype("<u4").tobytes(), masks.astype("<u2").tobytes()]
    lists = [([names[w][0] for w in which], pa.string()), ([names[w][1].decode() for w in which], pa.string()), (ids, pa.int64()), (n, pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), *(pa.array([x], pa.list_(t)) for x, t in lists), *(pa.array([c], pa.binary()) for c in cells)], names=_SHARD)


def bitmaps(docs: DataFrame, lang: str = "lang", text: str = "text", seed: int = 0, places: int = SHARD, step: int = SLICE) -> DataFrame:
    """One row a shard: own (places), langs, words, numbers and counts of its words, and ids, sizes, blocks, masks: the bitmaps.

    A shard has `places` places of its own, and the LONGEST - 1 places after them, in which its last phrases end; ends of
    pieces are places without a bit, so no phrase crosses them. A word's number is a hash of language and word.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, words, held, n = [None, None], {}, [], 0

        def number(one: str, tokens: list) -> np.ndarray:
            own = words.get(one)
            if own is None:
                own = words[one] = _Words(one, names)
            return np.fromiter(map(own.__getitem__, tokens), dtype=np.int64, count=len(tokens))

        for batch in batches:
            for one, whole in zip(*batch.columns, strict=True):
                one = one.as_py()
                for part in _slices(whole.as_buffer().to_pybytes().lower().translate(_TABLE), step):
                    seq = number(one, part.replace(b"\n", b" \n ").split(b" "))
                    held.append(seq[seq != _NONE])
                    n += len(held[-1])
                held.append(np.array([_GAP]))
                n += 1
                while n >= places + LONGEST:
                    seq = np.concatenate(held)
                    yield _row(seq[: places + LONGEST - 1], places, names, seed)
                    old, rest = names, seq[places:]
                    names, words = [None, None], {}
                    used, back = np.unique(rest, return_inverse=True)
                    fresh = [w if w <= _GAP else int(number(old[w][0], [old[w][1]])[0]) for w in used.tolist()]
                    held, n = [np.array(fresh, dtype=np.int64)[back]], len(rest)
        if n:
            yield _row(np.concatenate(held), n, names, seed)

    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")), F.coalesce(F.col(text), F.lit("")))
    return rows.mapInArrow(cut, "own int, langs array<string>, words array<string>, numbers array<long>, counts array<long>, ids binary, sizes binary, blocks binary, masks binary")


def _hashes(words: np.ndarray) -> np.ndarray:
    """A hash of each row of ids."""
    h = np.full(len(words), words.shape[1], dtype=np.uint64)
    for column in words.T:
        h = (h ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - MOST_BITS)


def _held(bits: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Whether the set may have these phrases."""
    h = _hashes(words) & np.uint64(64 * len(bits) - 1)
    return (bits[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) > 0


def _extended(phrase: np.ndarray, block: np.ndarray, mask: np.ndarray, first: np.ndarray, words: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, ...]:
    """Phrases' bitmaps shifted by a place, and the AND of each block with the words' bitmaps that are not zero there."""
    up, carry = (mask << 1) & ((1 << BITS) - 1), mask >> (BITS - 1)
    a, b = np.flatnonzero(up), np.flatnonzero(carry)
    phrase, block, mask = np.concatenate([phrase[a], phrase[b]]), np.concatenate([block[a], block[b] + 1]), np.concatenate([up[a], carry[b]])
    start = first[block]
    size = first[block + 1] - start
    ends = np.cumsum(size)
    each = np.repeat(np.arange(len(block)), size)
    entry = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)
    both = mask[each] & masks[entry]
    hit = np.flatnonzero(both)
    each = each[hit]
    return phrase[each], words[entry[hit]], block[each], both[hit]


def grown(own: int, ids: np.ndarray, sizes: np.ndarray, blocks: np.ndarray, masks: np.ndarray, levels: tuple[int, ...], known: dict[int, np.ndarray], roots: int = ROOTS, code: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Phrases of a shard with as many words as `levels` say, as rows of ids (or of what `code` has for them), and how often each starts in the shard.

    `known` has sets of phrases by length; only phrases that these may have, as a whole and in their last words, are
    extended.
    """
    code = ids if code is None else code
    word, blocks, masks = np.repeat(np.arange(len(ids)), sizes), blocks.astype(np.int64), masks.astype(np.int64)
    order = np.argsort(blocks, kind="stable")
    by_word, by_mask = word[order], masks[order]
    first = np.searchsorted(blocks[order], np.arange(int(blocks.max(initial=0)) + 4))
    starts = np.where(blocks < own // BITS, masks, np.where(blocks == own // BITS, masks & ((1 << own % BITS) - 1), 0))
    ends = np.cumsum(sizes)
    cuts = np.unique(np.searchsorted(ends, np.arange(0, (ends[-1] if len(ends) else 0) + roots, roots)))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = slice(ends[a] - sizes[a], ends[b - 1]) if b < len(ids) else slice(ends[a] - sizes[a], None)
        phrase, names, block, mask = word[part], np.arange(len(ids))[:, None], blocks[part], starts[part]
        for size in range(2, max(levels) + 1):
            phrase, last, block, mask = _extended(phrase, block, mask, first, by_word, by_mask)
            found, phrase = np.unique(phrase * len(ids) + last, return_inverse=True)
            names = np.column_stack([names[found // len(ids)], found % len(ids)])
            counts = np.bincount(phrase, weights=np.bitwise_count(mask), minlength=len(found)).astype(np.int64)
            good, whole = np.ones(len(found), dtype=bool), ids[names]
            for n, bits in known.items():
                if n > 1 and (n == size or n < size and n + 1 not in known):
                    good &= _held(bits, whole[:, size - n :])
            if size in levels and good.any():
                yield code[names[good]], counts[good]
            if not good.any():
                break
            stay = good[phrase]
            phrase, block, mask = (np.cumsum(good) - 1)[phrase[stay]], block[stay], mask[stay]
            names = names[good]


def _used(ids: np.ndarray, sizes: np.ndarray, blocks: np.ndarray, masks: np.ndarray, frequent: np.ndarray | None, held: np.ndarray) -> tuple[np.ndarray, ...]:
    """A shard's bitmaps without those of words that are not frequent, and the code of each word: its place among the frequent ones, or its hash."""
    if frequent is None:
        used = _held(held, ids[:, None])
        code = ids
    else:
        code = np.minimum(np.searchsorted(frequent, ids), max(len(frequent) - 1, 0))
        used = frequent[code] == ids if len(frequent) else np.zeros(len(ids), dtype=bool)
    inside = np.repeat(used, sizes)
    return ids[used], sizes[used], blocks[inside], masks[inside], code[used].astype(np.int64 if frequent is None else np.uint32)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Equal rows once, with the sum of their counts, in order."""
    rows, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort(rows.T[::-1])
    rows, counts = rows[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])) if len(rows) else np.zeros(0, dtype=np.int64)
    return [(rows[new], np.add.reduceat(counts, new) if len(new) else counts)]


def _counted(shards: DataFrame, levels: tuple[int, ...], known: dict[int, np.ndarray], least: int, frequent: np.ndarray | None, buckets: int) -> DataFrame:
    """ids (array), n of all phrases of these lengths with n >= least.

    A task sums the phrases of its shards and sends, for each bucket of phrases, columns of words and counts; each
    bucket is summed in turn, a bounded number of phrases at a time.
    """
    spark = shards.sparkSession
    shipped = spark.sparkContext.broadcast((known, frequent))
    kind = "<u8" if frequent is None else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, order = shipped.value
        held, room = {k: [] for k in levels}, dict.fromkeys(levels, 0)

        def sent(k: int) -> Iterator[pa.RecordBatch]:
            (rows, counts), = held[k]
            at = (_hashes(rows.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(at, kind="stable")
            at, rows, counts = at[by], rows[by].astype(kind), counts[by]
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            each = list(zip(cuts[:-1], cuts[1:], strict=True))
            cells = [
                pa.array(at[cuts[:-1]], pa.int64()), pa.array([k] * len(each), pa.int32()), pa.array(np.diff(cuts), pa.int32()), pa.array([rows[a:b].T.tobytes() for a, b in each], pa.binary()),
                pa.array([counts[a:b].astype("<i8" if counts[a:b].max() > 2**31 - 1 else "<i4").tobytes() for a, b in each], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cells, names=["bucket", "k", "rows", "words", "counts"])

        for batch in batches:
            for i in range(batch.num_rows):
                own, *cells = (c[i] for c in batch.columns)
                own = own.as_py()
                ids, sizes, blocks, masks = (np.frombuffer(c.as_buffer(), dtype=t) for c, t in zip(cells, ("<i8", "<i4", "<u4", "<u2"), strict=True))
                *shard, code = _used(ids, sizes.astype(np.int64), blocks, masks, order, sets[1])
                for words, n in grown(own, *shard, levels, sets, code=code):
                    k = words.shape[1]
                    held[k].append((words, n))
                    room[k] += len(words)
                    if room[k] > 2 * GATHERED:
                        held[k] = _summed(held[k])
                        room[k] = len(held[k][0][0])
                        if room[k] > GATHERED:
                            yield from sent(k)
                            held[k], room[k] = [], 0
        for k in levels:
            if held[k]:
                held[k] = _summed(held[k])
                yield from sent(k)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, key, held, room, summed = shipped.value[1], None, [], 0, 0

        def ended() -> Iterator[pa.RecordBatch]:
            (rows, counts), = _summed(held)
            rows, counts = rows[counts >= least], counts[counts >= least]
            if len(rows):
                ids = rows.astype(np.int64) if order is None else order[rows]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * ids.shape[1], pa.int32()), pa.array(ids.ravel()))
                yield pa.RecordBatch.from_arrays([lists, pa.array(counts)], names=["ids", "n"])

        for batch in batches:
            for i in range(batch.num_rows):
                bucket, k, n, words, counts = (c[i].as_py() for c in batch.columns)
                if held and (bucket, k) != key:
                    yield from ended()
                    held, room, summed = [], 0, 0
                key = (bucket, k)
                held.append((np.frombuffer(words, dtype=kind).reshape(k, n).T, np.frombuffer(counts, dtype="<i8" if len(counts) == 8 * n else "<i4").astype(np.int64)))
                room += n
                if room > 2 * max(GATHERED, summed):
                    held = _summed(held)
                    room = summed = len(held[0][0])
        if held:
            yield from ended()

    sent = shards.select("own", "ids", "sizes", "blocks", "masks").mapInArrow(run, "bucket long, k int, rows int, words binary, counts binary")
    return sent.repartition("bucket", "k").sortWithinPartitions("bucket", "k").mapInArrow(merged, "ids array<long>, n long")


def _as_set(frequent: DataFrame, size: int) -> np.ndarray:
    """The hashes of phrases of a length as a set of bits, of at most 2**MOST_BITS: what is broadcast does not grow beyond."""
    own = frequent.filter(F.size("ids") == size)
    width = min(MOST_BITS, max(12, (16 * own.count()).bit_length()))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.array(batch.column(0).to_pylist(), dtype=np.int64).reshape(-1, size)
            yield pa.RecordBatch.from_arrays([pa.array((_hashes(words) & np.uint64((1 << width) - 1)).astype(np.int64))], names=["h"])

    slots = own.select("ids").mapInArrow(hashed, "h long").groupBy(F.shiftright("h", 6).alias("slot")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (width - 6), dtype=np.uint64)
    out[slots["slot"].to_numpy()] = slots["bits"].to_numpy().astype(np.uint64)
    return out


def collocations(docs: DataFrame, least: int = 100, covered: int = 100, top: int = 2000, lang: str = "lang", text: str = "text", places: int = SHARD, dense: int = DENSE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of 2 to 5 words that occur `least` times or more.

    Texts are lower-cased (A-Z), cut at `. , ; : ! ?` and line ends into pieces and these at spaces and tabs into words;
    phrases do not cross pieces. score is the least over the cuts of floor(1000 a n / (l r)), the first such cut counts,
    in decimals of 38 digits. A phrase inside a longer one that occurs `covered` percent as often goes.

    Words are numbered by a hash, taken anew if two of all words share one. Three passes over the bitmaps: pairs, triples,
    then four and five words. Each pass extends only what the one before
    found to be frequent over all shards; the sums of popcounts are exact, and the sets between passes may only let too
    much through. Nothing grows in one task: a shard has a bounded number of places, wherever a piece is cut. A null
    language is `und`, a null or empty text has no words, repeated rows count each time, an empty table gives no rows,
    other columns are not read.
    """
    seed = 0
    while True:
        with shared.arrow_rows(docs.sparkSession, DOCUMENTS):
            shards = shared.save(bitmaps(docs, lang, text, seed, places), "phrase-shards", compression="zstd", **SHARD_FILES)
        each = shards.select(F.explode(F.arrays_zip("langs", "words", "numbers", "counts")).alias("_w")).groupBy(F.col("_w.langs").alias("lang"), F.col("_w.words").alias("word"), F.col("_w.numbers").alias("id"))
        counts = shared.save(each.agg(F.sum("_w.counts").alias("n")), "phrase-words")
        one = counts.agg(F.count("*"), F.count_distinct("id")).first()
        if one[0] == one[1]:
            break
        shared.drop(shards)
        seed += 1
    words = shared.save(counts.filter(F.col("n") >= least), "phrase-frequent")
    totals = shared.save(counts.groupBy("lang").agg(F.sum("n").alias("total")), "phrase-totals")
    shared.drop(counts)
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (totals.agg(F.sum("total")).first()[0] or 0) // BUCKET)
    frequent = np.sort(words.select("id").toArrow()["id"].to_numpy()) if words.count() <= dense else None
    found = [words.select(F.array("id").alias("ids"), "n")]
    known = {1: _as_set(found[0], 1)}
    for levels in ((2,), (3,), (4, 5)):
        with shared.arrow_rows(docs.sparkSession, SHARDS):
            found.append(shared.save(_counted(shards, levels, known, least, frequent, buckets), f"phrases-{levels[0]}"))
        if len(levels) == 1:
            known[levels[0]] = _as_set(found[-1], levels[0])
    shared.drop(shards)
    every = found[0]
    for df in found[1:]:
        every = every.unionByName(df)
    return ranked(every, words, totals, covered, top)


def ranked(every: DataFrame, words: DataFrame, totals: DataFrame, covered: int, top: int) -> DataFrame:
    """Scores, drops and ranks phrases `every` (ids, n), whose parts it has too; words: id, lang, word; totals: lang, total."""
    size = F.size("ids")
    phrases = every.filter(size > 1)
    longer = phrases.filter(size > 2)
    inside = longer.select(F.explode(F.array(F.slice("ids", 1, size - 1), F.slice("ids", 2, size - 1))).alias("ids"), F.col("n").alias("_longer")).groupBy("ids").agg(F.max("_longer").alias("_longer"))
    left = phrases.join(inside, "ids", "left").filter(F.col("_longer").isNull() | (100 * F.col("_longer") < covered * F.col("n"))).select("ids", F.col("n").alias("a"))
    cuts = left.select("ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"_head": F.expr("slice(ids, 1, k)"), "_tail": F.expr("slice(ids, k + 1, size(ids))")})
    cuts = cuts.join(every.select(F.col("ids").alias("_head"), F.col("n").alias("l")), "_head").join(every.select(F.col("ids").alias("_tail"), F.col("n").alias("r")), "_tail")
    named = words.join(F.broadcast(totals), "lang") if totals.count() <= shared.BROADCAST_ROWS else words.join(totals, "lang")
    cuts = cuts.join(named.select("lang", F.col("id").alias("_first"), F.col("total").alias("n")), F.col("ids")[0] == F.col("_first"))
    exact = "cast({} as decimal(19, 0))"
    score = F.expr(f"(cast(1000 as decimal(4, 0)) * ({exact.format('a')} * {exact.format('n')})) div ({exact.format('l')} * {exact.format('r')})")
    best = cuts.groupBy("ids", "lang", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("_best"))
    scored = best.select("ids", "lang", "a", "n", "_best.l", "_best.r", "_best.score")
    order = [F.col("score").desc(), F.col("a").desc()]
    by_lang = Window.partitionBy("lang")
    some = scored.withColumn("_rank", F.rank().over(by_lang.orderBy(*order))).filter(F.col("_rank") <= top).drop("_rank")
    each = some.select("ids", "lang", "a", "l", "r", "n", "score", F.posexplode("ids").alias("_at", "id")).join(words.select("id", "word"), "id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "word"))), lambda x: x["word"]), " ")
    out = each.groupBy("ids", "lang", "a", "l", "r", "n", "score").agg(text.alias("phrase"))
    out = out.withColumn("rank", F.row_number().over(by_lang.orderBy(*order, F.col("phrase"))).cast("long")).filter(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same by grams of lists, with 128-bit integers.
SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
cut AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces),
places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM cut),
grams AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM places, (SELECT unnest(range(1, 6)) AS m) WHERE i + m - 1 <= len(ws) GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(ws)) AS n FROM cut GROUP BY 1),
lists AS (SELECT *, string_split(phrase, ' ') AS ids FROM grams WHERE m > 1),
inside AS (SELECT lang, part, max(f) AS most FROM (SELECT lang, f, unnest([array_to_string(ids[1:m - 1], ' '), array_to_string(ids[2:m], ' ')]) AS part FROM lists WHERE m > 2) GROUP BY 1, 2),
stay AS (SELECT s.* FROM lists s LEFT JOIN inside i ON i.lang = s.lang AND i.part = s.phrase WHERE i.most IS NULL OR 100 * i.most < 100 * s.f),
cuts AS (SELECT lang, phrase, f, k, array_to_string(ids[1:k], ' ') AS head, array_to_string(ids[k + 1:m], ' ') AS tail FROM (SELECT *, unnest(range(1, m)) AS k FROM stay)),
scored AS (SELECT c.lang, c.phrase, c.f AS a, h.f AS l, t.f AS r, o.n, c.k, CAST((1000::HUGEINT * c.f * o.n) // (h.f::HUGEINT * t.f) AS BIGINT) AS score
    FROM cuts c JOIN grams h ON h.lang = c.lang AND h.phrase = c.head JOIN grams t ON t.lang = c.lang AND t.phrase = c.tail JOIN totals o ON o.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM best QUALIFY rank <= 2000
"""
