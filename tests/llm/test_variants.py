import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tidewater.llm import variants


def brute_counts(rows, modulus, shortest, least):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % modulus == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= shortest and k >= least}


def apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute_forms(n, ratio=2):
    near = {w: [v for v in n if apart(w, v)] for w in n}
    form = {}
    for w, all_near in near.items():
        best = min(all_near, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def vocabulary(seed, size):
    """Words with many neighbours: of few letters, periodic ones, and edits of edits of some."""
    rng = random.Random(seed)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 8))) for _ in range(size)} | {"a" * k for k in range(4, 40)} | {"ab" * k for k in range(2, 20)}
    for word in rng.sample(sorted(words), 30):
        for _ in range(4):
            at = rng.randrange(len(word) + 1)
            word = rng.choice([word[:at] + "z" + word[at:], word[:at] + word[at + 1 :], word[:at] + "q" + word[at + 1 :]])
            words.add(word)
    return {w: rng.choice([3, 4, 6, 9, 20, 50]) for w in words if w}


@pytest.mark.parametrize("batch", [7, 20_000])
def test_forms_against_all_pairs(spark, batch):
    """Also with groups dealt over many blocks and automata of few words."""
    n = {w: k for w, k in vocabulary(1, 500).items() if len(w) >= 4}
    words = spark.createDataFrame([(w, k, "x") for w, k in n.items()], "word string, n long, near string").repartition(3)
    assert {tuple(r) for r in variants.forms(words, batch=batch).collect()} == brute_forms(n)


def test_whole_operator(spark):
    rng = random.Random(2)
    n = vocabulary(3, 120)
    some = list(n)
    rows = [(rng.choice([None, i, 9007199254740993, i % 3]), " ".join(rng.choice(some).capitalize() + rng.choice(["", ",", "1", "ß", "×", "Ω"]) for _ in range(rng.randrange(80)))) for i in range(150)]
    rows += [(1, None), (2, ""), (3, "1 2 3"), (4, "É" * 5000), (4, "É" * 5000), (5, "É" * 5000), (6, "É" * 4999 + " "), (6, "É" * 4999), (6, "É" * 4999)] + rows[:20]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, word int")
    want = brute_counts(rows, 5, 5, 3)
    counted = variants.word_counts(docs, modulus=5)
    assert {r.word: r.n for r in counted.collect()} == want
    got = [tuple(r) for r in variants.forms(counted).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_forms(want) and any(r[1] and r[1] != r[2] for r in got)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert variants.forms(variants.word_counts(docs)).collect() == []


def test_automaton_is_minimal_and_numbers_words():
    words = [sorted(set(w)) for w in (["tap", "taps", "top", "tops", "", "zap"], ["a" * i for i in range(9)], sorted(vocabulary(4, 300)))]
    machine = variants.Automaton()
    roots = [machine.section(w) for w in words]
    for root, own in zip(roots, words, strict=True):
        for number, word in enumerate(own):
            assert machine.walk(root, 0, word)[1] == number and machine.final[machine.walk(root, 0, word)[0]]
    rights = defaultdict(set)  # a minimal automaton has a state for each set of endings
    for own in words:
        for word in own:
            for i in range(1, len(word) + 1):
                rights[own[0] == words[0][0], id(own), word[:i]].add(word[i:])
    free = set(machine._free)
    assert len(machine.edges) - len(free) == len({frozenset(x) for x in rights.values()}) + len(words)


def test_one_apart():
    rng = random.Random(5)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))) for _ in range(2))
        assert variants.one_apart(a, b) == (a != b and apart(a, b))
