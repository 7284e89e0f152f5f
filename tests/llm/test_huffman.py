import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import huffman

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=60), st.integers(6, 12))
def test_code_is_prefix_free_and_limited(counts, most):
    lengths = huffman.code_lengths(np.array(counts), most)
    used = lengths[lengths > 0]
    assert (np.array(counts)[lengths == 0] == 0).all() and (used <= most).all()
    assert sum(2.0 ** -used) <= 1


def test_unlimited_code_is_optimal():
    import heapq

    rng = np.random.default_rng(2)
    counts = rng.integers(1, 1000, 200)
    heap, cost = list(map(int, counts)), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        pair = heapq.heappop(heap) + heapq.heappop(heap)
        cost += pair
        heapq.heappush(heap, pair)
    assert (huffman.code_lengths(counts, 16) * counts).sum() == cost


def test_round_trip_of_blocks():
    rng = np.random.default_rng(3)
    for sizes in ([1], [5, 0, 127], [128, 129, 1], [5000, 3, 256, 7], [1] * 300):
        counts = np.array(sizes)
        ids = rng.zipf(1.3, counts.sum()).clip(max=40000).astype(np.int64)
        lengths = huffman.code_lengths(np.bincount(ids), huffman.MOST_BITS)
        codes, table, table_lengths = huffman.canonical(lengths)
        bits, room, marks, lanes = huffman.pack(ids, counts, codes, lengths)
        marks = marks + 8 * np.repeat(np.cumsum(room) - room, lanes)
        assert (huffman.unpack(bits.tobytes(), marks, counts, table, table_lengths) == ids).all()
        assert room.sum() == len(bits) and (lanes == -(-counts // huffman.LANE)).all()


def test_long_codes():
    """Vocabularies beyond 2**16 ids have longer codes."""
    ids = np.random.default_rng(4).permutation(np.repeat(np.arange(90_000), 2))
    lengths = huffman.code_lengths(np.bincount(ids), 18)
    codes, table, table_lengths = huffman.canonical(lengths)
    bits, _, marks, _ = huffman.pack(ids, np.array([len(ids)]), codes, lengths)
    assert lengths.max() in (17, 18) and (huffman.unpack(bits.tobytes(), marks, np.array([len(ids)]), table, table_lengths) == ids).all()


def test_units_against_the_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    encoder, plain = huffman.UnitEncoder(PATH), Tokenizer.from_file(PATH)
    assert encoder.units is not None
    latin = [chr(c) for c in range(1, 0x250)]
    texts = ["".join(latin), "".join(latin[::-1]), "It's I'LL they'Re 'S''t --'s x'd", "İstanbul Σίσυφος ΟΔΟΣ e\u0301", "a<|endoftext|>b", ""]
    texts += ["".join(rng.choice([*latin, "'", "s", "ll", " ", "Σ", "\u0301", "𝔸", "<|startoftext|>"]) for _ in range(40)) for _ in range(300)]
    monkeypatch.setattr(huffman, "CACHED_UNITS", 40)
    for a in range(0, len(texts), 10):
        encoder.encode(texts[a : a + 10])
    ids, counts = encoder.encode(texts)
    for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert own.tolist() == plain.encode(text, add_special_tokens=False).ids, text
    other = huffman.UnitEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.words and other.encode(["Hello  the\nworld", "x"])[0].tolist() == whole.encode("Hello  the\nworld", add_special_tokens=False).ids + whole.encode("x", add_special_tokens=False).ids


def test_files_against_whole_text_encoding(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    pieces = ["The", "ñandú", "it's", " ", "\n", " ", "\x1c", "<|endoftext|>", "12", "...", "𝔸ß", "é", "Σ", "x"]
    texts = [None, "", " ", "\t\n"] + ["".join(rng.choice(pieces) for _ in range(rng.randrange(80))) for _ in range(200)] + ["word " * 30000]
    docs = spark.createDataFrame([(i * 7 % 211, t, 1) for i, t in enumerate(texts)] + [(5, "again", 1), (None, "none", 2)], "doc_id long, text string, start int").repartition(5)
    path = f"file://{tmp_path}/files"
    huffman.write(huffman.tokenize(docs, PATH), path)
    got = huffman.read(spark, path).collect()
    plain = Tokenizer.from_file(PATH)
    want = sorted((-1 if d is None else d, (np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes())) for d, t, _ in docs.collect())
    assert sorted((-1 if r.doc_id is None else r.doc_id, bytes(r.ids)) for r in got) == want
    at, last = 0, -1
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and (-1 if r.doc_id is None else r.doc_id) >= last
        at += len(r.ids) // 4
        last = -1 if r.doc_id is None else r.doc_id
    assert zlib.crc32(b"") == 0


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    huffman.write(huffman.tokenize(docs, PATH), f"file://{tmp_path}/none")
    assert huffman.read(spark, f"file://{tmp_path}/none").count() == 0
