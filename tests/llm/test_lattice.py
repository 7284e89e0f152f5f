import math
import random
from collections import Counter

import numpy as np
import pytest

from tidewater.llm import lattice

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")


def segmentations(word, pieces):
    if not word:
        yield ()
    for m in range(1, len(word) + 1):
        if word[:m] in pieces:
            for rest in segmentations(word[m:], pieces):
                yield (word[:m], *rest)


def test_sums_over_all_segmentations():
    rng = random.Random(1)
    pieces = [b" ", b"a", b"b", b"ab", b" a", b"aba", b"bb", b" ab"]
    log_p = np.log(np.array([rng.random() for _ in pieces]) / 9)
    own = dict(zip(pieces, log_p, strict=True))
    words = [b" " + "".join(rng.choice("ab") for _ in range(n)).encode() for n in (0, 1, 2, 3, 5, 8, 8, 9)]
    model = lattice.Lattice(pieces, log_p)
    uses = Counter()
    for word, got in zip(words, model.score(words), strict=True):
        each = [(s, math.exp(sum(own[p] for p in s))) for s in segmentations(word, own)]
        total = sum(p for _, p in each)
        assert got == pytest.approx(math.log(total))
        for s, p in each:
            for piece in s:
                uses[piece] += 3 * p / total
    assert model.expected(words, np.full(len(words), 3.0)) == pytest.approx([uses[p] for p in pieces])


def test_words_of_a_lattice_make_a_law():
    """All words sum to 1: START begins each, and ends the one before."""
    import itertools

    pieces = [b" ", b"a", b"b", b"ab", b" a", b"bba", b" ba"]
    p = np.array([0.2, 0.1, 0.1, 0.05, 0.25, 0.05, 0.25])
    words = [b" " + "".join(w).encode() for n in range(13) for w in itertools.product("ab", repeat=n)]
    total = np.exp(lattice.Lattice(pieces, np.log(p)).score(words)).sum()
    assert 0.98 < total <= 1 + 1e-9


def test_long_pieces_count():
    pieces, log_p = lattice.vocabulary(PATH)
    assert b" professional" in pieces and max(map(len, pieces)) > 12
    model = lattice.Lattice(pieces, log_p)
    assert model.score([b" professional"])[0] >= log_p[pieces.index(b" professional")]


def brute_base(texts, held):
    own = [[*lattice.tokens(t), "end"] for t in texts]
    count = Counter(w for words, h in zip(own, held, strict=True) if not h for w in words)
    n, v = sum(count.values()), len(count)
    for words in own:
        yield len(words), sum(count[w] > 0 for w in words), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)


def made():
    """Texts in two languages: mostly words of a vocabulary, some new ones."""
    rng = random.Random(2)
    parts = {"en": ["th", "on", "er", "ing", "ed", "st", "re"], "de": ["ä", "sch", "en", "ung", "keit", "ver"]}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 5)))
    known = {lang: [word(lang) for _ in range(300)] for lang in parts}
    texts = [(None, "en"), ("", "de"), (" \t", None), ("x" * 3000, "en")]
    for i in range(160):
        lang = ["en", "de"][i % 2]
        texts.append((" ".join(rng.choice(known[lang]).title() if rng.random() < 0.98 else word(lang) for _ in range(rng.randrange(1, 200))), lang))
    return texts


def test_base_and_held_out_gain(spark, monkeypatch):
    monkeypatch.setattr(lattice, "FREQUENT", 50)
    texts, langs = zip(*made(), strict=True)
    held = [i % 5 == 1 for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, h, "x", lang) for i, (t, h, lang) in enumerate(zip(texts, held, langs, strict=True))], "doc_id long, text string, held boolean, word string, lang string")
    rows = {r.doc_id: r for r in lattice.score(docs, "held", PATH).collect()}
    for i, (n, known, total, base) in enumerate(brute_base(texts, held)):
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.word) == (n, known, total, "x")
        assert r.base_score == pytest.approx(base)
        assert r.score < 0
    unseen = [i for i, h in enumerate(held) if h and texts[i]]
    assert sum(rows[i].score for i in unseen if i > 3) > sum(rows[i].base_score for i in unseen if i > 3)


def test_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b", False, "en"), (1, "a b", False, "en"), (None, None, None, None)], "doc_id long, text string, held boolean, lang string")
    rows = lattice.score(docs, "held", PATH).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 3, 3]
    assert lattice.score(docs.limit(0), "held", PATH).count() == 0
    assert all(r.n_known == 0 for r in lattice.score(docs.filter("doc_id = 1").selectExpr("doc_id", "text", "lang", "true AS held"), "held", PATH).collect())
