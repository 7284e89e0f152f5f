import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tidewater.llm import phrases

LANGS = {"en": "en", "fr": "fr", None: "und"}


def brute(rows, least, covered=100, top=2000):
    """The contract by lists: counts of all grams, cuts, cover and order."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    out = []
    some = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    best = Counter()
    for (lang, w), a in some.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                best[lang, w[i : i + m]] = max(best[lang, w[i : i + m]], a)
    for (lang, w), a in some.items():
        if best[lang, w] and 100 * best[lang, w] >= covered * a:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], n[lang]))
    rank, got = Counter(), []
    for lang, s, a, w, left, right, total in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            got.append((lang, rank[lang], w.decode(), -a, left, right, total, -s))
    return got


def texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "of", "né", "x\x1cy", "𝔸", "new", "york", "city", "a-b", "q", " "]
    gaps = [" ", "  ", "\t", " ", " ", ", ", ". ", "\n", "!", "\x0b", "\r\n"]
    rows = [(rng.choice(list(LANGS)), "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(60)))) for _ in range(n)]
    return rows + [("en", None), (None, ""), ("en", ",;:"), ("fr", "new york city of"), ("fr", "new york city of"), ("fr", "one " * 300)]


@pytest.mark.parametrize(("places", "dense", "gathered"), [(1 << 18, 1 << 20, 1 << 20), (64, 0, 40)])
def test_against_brute_force(spark, monkeypatch, places, dense, gathered):
    """Small shards cut pieces, also the piece of 300 words; phrases go by places or hashes, and are summed a few at a time."""
    monkeypatch.setattr(phrases, "GATHERED", gathered)
    rows = texts(3, 300)
    docs = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], "doc_id long, lang string, text string, ids string, n int").repartition(3)
    for least, covered, top in ((5, 100, 2000), (12, 60, 9)):
        got = [tuple(r) for r in phrases.collocations(docs, least, covered, top, places=places, dense=dense).orderBy("lang", "rank").collect()]
        assert got == brute(rows, least, covered, top)
    assert got


def test_empty(spark):
    for rows in ([], [("en", None), (None, " ,")]):
        assert phrases.collocations(spark.createDataFrame(rows, "lang string, text string")).collect() == []


def test_exact_beyond_64_bits(spark):
    """1000 a n passes 64 bits, and a tie after flooring takes the smallest cut."""
    big = 9 * 10**15
    every = spark.createDataFrame([([0], big), ([1], big // 3), ([2], 7), ([0, 1], 5 * 10**14), ([1, 2], 7), ([0, 1, 2], 3)], "ids array<long>, n long")
    words = spark.createDataFrame([(0, "en", "a"), (1, "en", "b"), (2, "en", "c")], "id long, lang string, word string")
    totals = spark.createDataFrame([("en", 4 * 10**16)], "lang string, total long")
    got = {r.phrase: r for r in phrases.ranked(every, words, totals, 100, 10).collect()}
    assert got["a b"].score == 1000 * 5 * 10**14 * 4 * 10**16 // (big * (big // 3))
    cut = [(1000 * 3 * 4 * 10**16 // (left * right), k) for k, left, right in ((1, big, 7), (2, 5 * 10**14, 7))]
    assert (got["a b c"].score, got["a b c"].l) == (min(cut)[0], big if min(cut)[1] == 1 else 5 * 10**14)
    assert set(got) == {"a b", "b c", "a b c"}


def test_sets_let_all_through_that_they_hold():
    words = np.random.default_rng(1).integers(0, 1 << 40, (500, 3))
    bits = np.zeros(1 << 8, dtype=np.uint64)
    h = phrases._hashes(words) & np.uint64(64 * len(bits) - 1)
    np.bitwise_or.at(bits, (h >> np.uint64(6)).astype(int), np.uint64(1) << (h & np.uint64(63)))
    assert phrases._held(bits, words).all() and phrases._held(bits, words + 1).mean() < 0.2


def test_sql(spark):
    rows = texts(5, 900)
    docs = spark.createDataFrame(rows, "lang string, text string")
    base = duckdb.connect()
    base.execute("CREATE TABLE documents (lang VARCHAR, text VARCHAR)")
    base.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = [tuple(r) for r in phrases.collocations(docs).orderBy("lang", "rank").collect()]
    assert got == sorted(base.execute(phrases.SQL).fetchall()) and got


@pytest.mark.parametrize("roots", [3, 1 << 15])
def test_bitmaps_and_growth_of_one_shard(spark, roots):
    """Whatever roots go together, and wherever texts are sliced, a shard counts the phrases that start in it."""
    rows = texts(8, 40)
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    (want,), (row,) = phrases.bitmaps(docs).collect(), phrases.bitmaps(docs, step=9).collect()
    assert row == want
    cells = [np.arange(len(row.words)), *(np.frombuffer(row[c], dtype=t) for c, t in (("sizes", "<i4"), ("blocks", "<u4"), ("masks", "<u2")))]
    got = Counter()
    for ids, n in phrases.grown(row.own, cells[0], cells[1].astype(np.int64), *cells[2:], (2, 3, 4, 5), {}, roots):
        for w, k in zip(ids.tolist(), n.tolist(), strict=True):
            got[row.langs[w[0]], " ".join(row.words[i] for i in w)] += k
    assert got == {(lang, phrase): a for lang, _, phrase, a, *_ in brute(rows, 1, 101, 10**9)}


def test_words_that_share_a_number(spark, monkeypatch):
    """Numbers that collide are taken anew with another seed."""
    plain, seeds = phrases.bitmaps, []

    def colliding(docs, lang, text, seed, places):
        seeds.append(seed)
        found = plain(docs, lang, text, seed, places)
        return found.withColumn("numbers", phrases.F.transform("numbers", lambda x: x * 0)) if seed == 0 else found

    monkeypatch.setattr(phrases, "bitmaps", colliding)
    rows = texts(9, 60)
    got = [tuple(r) for r in phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), 4).orderBy("lang", "rank").collect()]
    assert got == brute(rows, 4) and seeds == [0, 1]
