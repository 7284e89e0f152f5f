import random
import re
from fractions import Fraction

import numpy as np

from tidewater.llm import jaccard


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(text, n=3):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(texts, percent=90, n=3):
    sets = [grams(t, n) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def made(seed):
    rng = random.Random(seed)
    prose = lambda n: [rng.choice(["Ab", "c", "dé", "f"]) + str(rng.randrange(60)) for _ in range(n)]
    out = [None, "", " \t\n", "one", "One", "two words", "TWO\twords", "two  words x"]
    line = prose(9)
    for n in (4, 9, 12, 30, 31, 80, 200, 400):
        base = prose(n)
        for edits in (0, 0, 1, 1, 2, 3, n // 30, n // 20, n // 60, n // 60, n // 60):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(n)] = "x" + str(rng.randrange(1000))
            if rng.random() < 0.4:
                copy += line[: rng.randrange(9)]
            out.append(" ".join(copy))
        out.append(" ".join(line + prose(n)))
    return out


def check(spark, texts, n=3, percent=90, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = jaccard.jaccard_components(docs, n=n, percent=percent, **more).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(texts, percent, n)


def test_against_brute_force(spark):
    check(spark, made(1) + made(2))


def test_lower_threshold_and_stars_in_blocks(spark):
    check(spark, made(3) + made(4), n=5, percent=80, block=4)


def test_linked_sets_share_a_signature():
    """At every size and both thresholds, however many parts are empty and on whatever level a set stops."""
    rng = np.random.default_rng(7)
    for threshold in (Fraction(9, 10), Fraction(4, 5)):
        for n in [*range(1, 60), 200, 1000]:
            base = rng.choice(2**62, 2 * n, replace=False).astype(np.uint64)
            one = np.sort(base[:n])
            for keep in range(n, 0, -1):
                add = int(n / threshold) - 2 * n + keep + int((n - keep) / threshold)
                other = np.unique(np.concatenate([base[:keep], base[n : n + max(0, min(n, add))]]))
                both = keep / len(np.union1d(one, other))
                if both < threshold or n - keep > 40:
                    break
                if len(np.setxor1d(one, other)):
                    assert np.isin(jaccard.signatures(one, threshold), jaccard.signatures(other, threshold)).any()


def test_ordinary_texts_make_no_hub():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 2**62, n).astype(np.uint64)) for n in rng.integers(20, 400, 400)]
    signed = np.concatenate([np.unique(jaccard.signatures(s, Fraction(4, 5))) for s in sets])
    assert np.unique(signed, return_counts=True)[1].max() <= 2
    words = [bytes(b"ab"[c] for c in bits) for bits in rng.integers(0, 2, (50, 1024))]
    assert len(set(jaccard.word_hashes(b" ".join(words).decode()).tolist())) == 50


def test_trie_alone():
    rng = np.random.default_rng(1)
    base = rng.choice(10**6, 300, replace=False)
    sets = []
    for _ in range(60):
        drop = rng.random(300) < rng.choice([0.01, 0.04, 0.1])
        sets.append(np.unique(np.concatenate([base[~drop], rng.choice(10**6, drop.sum())])).astype(np.uint64))
    sets = list({s.tobytes(): s for s in sets}.values())
    label = jaccard.trie_join(sets, Fraction(9, 10))
    for i in range(len(sets)):
        for j in range(i):
            if 10 * len(np.intersect1d(sets[i], sets[j])) >= 9 * len(np.union1d(sets[i], sets[j])):
                assert label[i] == label[j]
    assert len(np.unique(label)) > 1


def test_repeated_keys_nulls_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(7, text, 1), (7, text, 1), (3, text + " more", 2), (None, text, 3), (9, None, 4)], "doc_id long, text string, root int")
    rows = sorted(map(tuple, jaccard.jaccard_components(docs).collect()), key=str)
    assert rows == sorted([(7, 38, 3), (7, 38, 3), (3, 39, 3), (None, 38, 3), (9, 0, 9)], key=str)
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0
