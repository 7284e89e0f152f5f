import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewater.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, docs, window):
    """Pieces cover each document once, sequences have no gap, and each has `window` ids or a power of two."""
    plain = Tokenizer.from_file(PATH)
    sequences, by_key = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) // 4 > 0 and 0 <= r.start <= r.doc_tokens - r.length
        sequences[r.sequence_id].append((r.offset, r.length))
        by_key[r.doc_id].append(r)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == window or at < window and at & (at - 1) == 0
    assert sorted(sequences) == list(range(len(sequences)))
    texts = defaultdict(list)
    for key, text in docs:
        texts[key].append(np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes())
    assert set(by_key) == set(texts)
    for key, want in texts.items():
        if len(want) == 1:
            own = sorted(by_key[key], key=lambda r: r.start)
            assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
            assert b"".join(bytes(r.ids) for r in own) == want[0] and {r.doc_tokens for r in own} == {len(want[0]) // 4}
        else:
            assert sum(r.length for r in by_key[key]) == sum(map(len, want)) // 4
            whole = sorted(bytes(r.ids) for r in by_key[key] if r.length == r.doc_tokens)
            assert all(x in want for x in whole)


@pytest.mark.parametrize("window", [8, 64, 100, 2048])
def test_pieces_sequences_and_ids(spark, window):
    rng = random.Random(window)
    docs = [(i, " ".join(rng.choice(["a", "token", "ñandú", "x1", "."]) for _ in range(rng.choice([1, 3, 7, 30, 60, rng.randrange(300)])))) for i in range(400)]
    docs += [(9007199254740993, "large"), (None, None), (None, None), (None, "b c"), (500, ""), (501, "word " * 9000), (502, "same"), (502, "same")]
    rows = packing.pack(spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, rest int, ids string").repartition(3), PATH, window).collect()
    check(rows, docs, window)


def test_empty_and_one_length(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    docs = [(i, "a b c d") for i in range(70)]
    check(packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), PATH, 32).collect(), docs, 32)


def test_least_squares_against_enumeration():
    """Of small windows: the objective is as small as that of a fine projected descent over each pattern in turn."""
    rng = np.random.default_rng(3)
    for _ in range(5):
        counts = rng.integers(0, 40, 24)
        counts[0] = 0
        patterns = packing.combinations(counts)
        used = np.zeros((len(counts), len(patterns)))
        for p, own in enumerate(patterns):
            for k in own[own > 0]:
                used[k, p] += 1
        x = packing.repeats(patterns, counts, 4000)
        y = np.zeros(len(patterns))
        for _ in range(4000):
            for p in range(len(patterns)):
                y[p] = max(0, y[p] + used[:, p] @ (counts - used @ y) / (used[:, p] @ used[:, p]))
        best = np.square(used @ y - counts).sum()
        assert (x >= 0).all() and np.square(used @ x - counts).sum() <= best + 1e-3 * (1 + best)


def test_plan_uses_whole_counts_and_few_cuts():
    rng = np.random.default_rng(5)
    counts = np.bincount(rng.integers(1, 2048, 400_000), minlength=2048)
    made = packing.plan(counts)
    assert (made["used"] <= counts).all()
    assert made["used"].sum() > 0.97 * counts.sum()
    assert int(made["tail"][-1]) == int(((counts - made["used"]) * np.arange(2048)).sum())
