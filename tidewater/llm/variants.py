"""Spelling variants: words one letter apart, found in minimal acyclic automata of words and of reversed words."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Fixed value: what a run of letters is.
RUN = r"[A-Za-zÀ-ÿ]+"
#: Words of groups whose automaton is built together, and words of a group beyond which it is dealt over blocks.
BATCH = 20_000
#: With so few words below a state, each is compared as a whole.
FEW = 3


class Automaton:
    """A minimal acyclic automaton of sorted words in sections, built word by word, which numbers its words in their order.

    edges[s] has, for each letter in ascending order, the next state and how many words of s come before those through
    it; a word's number is the sum of these on its path. Equal tails are one state, also of different sections.
    """

    def __init__(self) -> None:
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.count: list[int] = []
        self._known: dict[tuple, int] = {}
        self._free: list[int] = []

    def _state(self) -> int:
        if self._free:
            return self._free.pop()
        self.edges.append({})
        self.final.append(False)
        self.count.append(0)
        return len(self.edges) - 1

    def _settle(self, path: list[int], word: str, keep: int) -> None:
        """The states of `path` below depth `keep` get no more words: each becomes an equal one that is known, or known itself."""
        for depth in range(len(path) - 1, keep, -1):
            state, parent = path.pop(), path[depth - 1]
            edges = self.edges[state]
            key = (self.final[state], *((c, to) for c, (to, _) in edges.items()))
            found = self._known.get(key)
            if found is None:
                before = int(self.final[state])
                for c, (to, _) in edges.items():
                    edges[c] = (to, before)
                    before += self.count[to]
                self.count[state], self._known[key] = before, state
                found = state
            else:
                self.edges[state], self.final[state] = {}, False
                self._free.append(state)
            self.edges[parent][word[depth - 1]] = (found, 0)

    def section(self, words: list[str]) -> int:
        """Adds a section of sorted distinct words; its first state."""
        root = self._state()
        path, last = [root], ""
        for word in words:
            same = next((i for i, (a, b) in enumerate(zip(last, word, strict=False)) if a != b), min(len(last), len(word)))
            self._settle(path, last, same)
            for c in word[same:]:
                to = self._state()
                self.edges[path[-1]][c] = (to, 0)
                path.append(to)
            self.final[path[-1]] = True
            last = word
        self._settle(path, last, 0)
        before = int(self.final[root])
        for c, (to, _) in self.edges[root].items():
            self.edges[root][c] = (to, before)
            before += self.count[to]
        self.count[root] = before
        return root

    def walk(self, state: int, number: int, text: str) -> tuple[int, int] | None:
        """The state that text leads to, and the sum of numbers on the way."""
        for c in text:
            step = self.edges[state].get(c)
            if step is None:
                return None
            state, number = step[0], number + step[1]
        return state, number

    def one_error(self, state: int, number: int, text: str) -> set[int]:
        """Numbers of the words that go on from a state by text with one letter inserted, deleted or replaced."""
        found = set()

        def ends(state: int, number: int, rest: str) -> None:
            at = self.walk(state, number, rest)
            if at and self.final[at[0]]:
                found.add(at[1])

        for i in range(len(text) + 1):
            for c, (to, before) in self.edges[state].items():
                ends(to, number + before, text[i:])
                if i < len(text) and c != text[i]:
                    ends(to, number + before, text[i + 1 :])
            if i < len(text):
                ends(state, number, text[i + 1 :])
                step = self.edges[state].get(text[i])
                if step is None:
                    break
                state, number = step[0], number + step[1]
        return found


def _common(a: str, b: str) -> int:
    """How many letters two words begin with in common."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def one_apart(a: str, b: str) -> bool:
    """Whether two different words differ by one letter inserted, deleted or replaced."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = _common(a, b)
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def _sections(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, int, list[tuple]]]:
    """Rows, sorted by side, length, block and text, in lists of equal ones: side, length, [(text, n, asked), ...]. From `most` rows on a list ends with its half."""
    key, at, rows = None, None, []
    for batch in batches:
        for side, length, block, half, text, n, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (side, length, block) != key or len(rows) >= most and half != at:
                if rows:
                    yield *key[:2], rows
                key, rows = (side, length, block), []
            at = half
            rows.append((text, n, asked))
    if rows:
        yield *key[:2], rows


def near_rows(held: list[tuple[int, int, list[tuple]]]) -> list[tuple[str, int, str, int]]:
    """word, n, near, near_n for all words that are asked for in some sections, by one automaton of these."""
    machine, out = Automaton(), []
    for side, length, rows in held:
        words = [(t, n) for t, n, _ in rows if n is not None]
        root = machine.section([t for t, _ in words])
        turn = (lambda t: t[::-1]) if side else (lambda t: t)
        half = length - length // 2 if side else length // 2
        for text, _, asked in rows:
            at = machine.walk(root, 0, text[:half]) if asked is not None else None
            if at is None:
                continue
            state, number = at
            below = machine.count[state]
            found = [i for i in range(number, number + below) if one_apart(text, words[i][0])] if below <= FEW else machine.one_error(state, number, text[half:])
            out += [(turn(text), asked, turn(words[i][0]), words[i][1]) for i in found]
    return out


def near_pairs(words: DataFrame, batch: int = BATCH) -> DataFrame:
    """word, n, near, near_n: all pairs of words (word, n; distinct) that are one letter apart, both ways.

    One letter leaves the first or the second half of a word as it is. A word is asked for in the group of its length
    and that half (the second one reversed), and stands in the groups of its own and both neighbouring lengths, so no
    word is compared outside. In the automaton of a group the half is matched exactly and the rest with one error.
    A group of over `batch` words is dealt over blocks, and its questions go to each. Memory is about 300 bytes a
    letter of a batch's words.
    """
    length = F.length("word")
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("text")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("text"))))
    placed = words.select("n", length.alias("_own"), sides.alias("_s")).select("n", "_own", "_s.*")
    placed = placed.select("*", F.explode(F.array(F.col("_own") - 1, F.col("_own"), F.col("_own") + 1)).alias("length"))
    half = F.when(F.col("side") == 1, F.col("length") - F.floor(F.col("length") / 2)).otherwise(F.floor(F.col("length") / 2)).cast("int")
    placed = placed.withColumn("half", F.xxhash64("side", "length", F.substring("text", F.lit(1), half)))
    groups = shared.save(placed.groupBy("half").agg(F.count("*").alias("_size"), F.max(F.col("_own") == F.col("length")).alias("_asked")).filter("_size > 1 AND _asked").select("half", F.ceil(F.col("_size") / batch).cast("int").alias("blocks")), "variant-groups")
    dealt = placed.join(groups, "half").withColumn("asks", F.col("_own") == F.col("length"))
    held = F.struct(F.pmod(F.xxhash64("text"), "blocks").cast("int").alias("block"), F.col("n").alias("n"), F.when(F.col("asks"), F.col("n")).alias("asked"))
    others = F.transform(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.col("asks") & (b != F.pmod(F.xxhash64("text"), "blocks"))), lambda b: F.struct(b.alias("block"), F.lit(None).cast("long").alias("n"), F.col("n").alias("asked")))
    rows = dealt.select("side", "length", "half", "text", F.explode(F.concat(F.array(held), others)).alias("_r")).select("side", "length", "half", "_r.block", "text", "_r.n", "_r.asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())

        def answers(held: list) -> pa.RecordBatch:
            cells = list(zip(*near_rows(held), strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds, strict=True)], names=["word", "n", "near", "near_n"])

        held, size = [], 0
        for section in _sections(batches, batch):
            if held and size + len(section[2]) > batch:
                yield answers(held)
                held, size = [], 0
            held.append(section)
            size += len(section[2])
        if held:
            yield answers(held)

    ordered = rows.repartition("half", "block").sortWithinPartitions("side", "length", "block", "text").select("side", "length", "block", "half", "text", "n", "asked")
    return ordered.mapInArrow(run, "word string, n long, near string, near_n long").distinct()


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 97, shortest: int = 5, least: int = 3) -> DataFrame:
    """word, n: runs of letters, A-Z lower-cased, one letter dropped where modulus divides the crc32 of `key:run`.

    Words of at least `shortest` letters that occur `least` times or more in all texts. A null key is an empty one, a
    null text has no runs; repeated rows count each time.
    """
    low = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("_run")).filter(F.length("_run") >= shortest)
    hashed = runs.withColumn("_h", F.crc32(F.concat_ws(":", "_key", "_run")))
    at = F.pmod("_h", F.length("_run")).cast("int")
    word = F.when(F.col("_h") % modulus == 0, F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.length("_run")))).otherwise(F.col("_run"))
    return hashed.select(word.alias("word")).filter(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def forms(words: DataFrame, ratio: int = 2, batch: int = BATCH) -> DataFrame:
    """word, form, root, n, n_near, form_n of a table of distinct words (word, n).

    form is the near word of largest n (ties: the smallest), if that is `ratio` (over 1) times the word's n at least;
    root follows forms to the last one. As n grows by the ratio with each form, doubling the steps ends after a few
    rounds, each a written table. An empty table gives no rows.
    """
    words = shared.save(words.select("word", "n"), "variant-words")
    best = near_pairs(words, batch).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("_best"))
    strong = -F.col("_best.n") >= ratio * F.col("n")
    linked = best.select("word", "n_near", F.when(strong, F.col("_best.near")).alias("form"), F.when(strong, -F.col("_best.n")).alias("form_n"))
    linked = shared.save(linked, "variant-forms")
    steps = shared.save(linked.filter("form IS NOT NULL").select("word", F.col("form").alias("to")), "variant-steps")
    while True:
        ahead = steps.select(F.col("word").alias("to"), F.col("to").alias("_next"))
        after = shared.save(steps.join(ahead, "to", "left").select("word", F.coalesce("_next", "to").alias("to"), F.col("_next").isNotNull().alias("moved")), "variant-steps")
        shared.drop(steps)
        steps = after
        if not steps.filter("moved").limit(1).count():
            break
        steps = steps.select("word", "to")
        steps.saved_path = after.saved_path
    out = words.join(linked, "word", "left").join(steps.select("word", F.col("to").alias("_root")), "word", "left")
    return out.select("word", "form", F.coalesce("_root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("form_n").cast("long").alias("form_n"))


#: The same with crc32 from its table, and words that are equal without one letter (at one place, or of one of both).
SQL = r"""
WITH RECURSIVE bits AS (SELECT i, CAST(i AS UBIGINT) AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
steps AS MATERIALIZED (SELECT list(c ORDER BY i) AS step FROM bits WHERE k = 8),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS key, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents WHERE text IS NOT NULL),
each AS (SELECT key, run, count(*) AS n, hex(encode(key || ':' || run)) AS hexed FROM runs WHERE length(run) >= 5 GROUP BY 1, 2),
bytes AS (SELECT run, n, list_transform(range(0, length(hexed) // 2), lambda i: CAST('0x' || substr(hexed, CAST(2 * i + 1 AS BIGINT), 2) AS UBIGINT)) AS b FROM each),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::UBIGINT, b), lambda c, x: xor(c >> 8, step[CAST((xor(c, x) & 255) + 1 AS BIGINT)])), 4294967295::UBIGINT) AS h FROM bytes, steps),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed) WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
shorter AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT DISTINCT * FROM (SELECT a.word, b.word AS near, b.n AS near_n FROM shorter a JOIN shorter b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION ALL SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON b.word = a.rest UNION ALL SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON b.word = a.rest)),
best AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near FROM pairs QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1),
linked AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best USING (word)),
roots AS (SELECT word, word AS root FROM linked WHERE form IS NULL UNION ALL SELECT l.word, r.root FROM roots r JOIN linked l ON l.form = r.word)
SELECT word, form, root, n, n_near, form_n FROM linked JOIN roots USING (word)
"""
