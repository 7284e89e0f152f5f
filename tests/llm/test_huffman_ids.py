"""Keys beyond 2**53 beside nulls, hot keys, and units beyond the cache."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidewater.llm import huffman

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_large_keys_beside_null_and_a_hot_key(spark, tmp_path):
    keys = [9007199254740993, 9007199254740995, None, -9007199254740993, 7] + [None] * 60 + [5] * 60
    docs = spark.createDataFrame([(k, f"text number {i}") for i, k in enumerate(keys)], "doc_id long, text string").repartition(3)
    path = f"file://{tmp_path}/large"
    from tidewater.llm import shared

    kind = huffman.kind_of(PATH)
    huffman.write(shared.save(huffman.tokenize(docs, PATH, kind=kind), "large"), path, kind=kind)
    assert kind == "<u2"
    got = sorted(huffman.read(spark, path).collect(), key=lambda r: r.start)
    order = lambda k: (k is not None, k or 0)
    assert [r.doc_id for r in got] == sorted(keys, key=order)
    plain = Tokenizer.from_file(PATH)
    want = sorted((order(r.doc_id), np.array([*plain.encode(r.text, add_special_tokens=False).ids, 1], dtype="<u4").tobytes()) for r in docs.collect())
    assert sorted((order(r.doc_id), bytes(r.ids)) for r in got) == want
    parts = {r.part for r in spark.read.parquet(f"{path}/blocks").collect()}
    assert len(parts) == 4  # equal keys are dealt over parts


def test_cache_within_a_text(monkeypatch):
    monkeypatch.setattr(huffman, "CACHED_UNITS", 50)
    monkeypatch.setattr(huffman, "PART", 64)
    rng = random.Random(4)
    texts = ["", " ".join("".join(rng.choice("abc é1.Ω") for _ in range(rng.randrange(12))) for _ in range(3000)), "x" * 500, "\n\t"]
    encoder, plain = huffman.UnitEncoder(PATH), Tokenizer.from_file(PATH)
    for _ in range(2):
        ids, counts = encoder.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(encoder.place) < 200


def test_words_beyond_latin_alone():
    plain = Tokenizer.from_file(PATH)
    for text in ["ΟΔΟΣ", "Привет МИР", "İstanbul", "E\u0301COLE — ÉCOLE", "ＡＢＣ", "Ⱥ Å", "<|endoftext|>ABC", "<|ENDOFTEXT|> 1İ Ab", "Ω " + " ".join(f"A{a}B{b}" for a in "CDEFGHIJ" for b in range(1000))]:
        ids, _ = huffman.UnitEncoder(PATH).encode([text])
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_words_are_cut_once(monkeypatch):
    """Not once for each time they occur, which took most of the encoder's seconds."""
    encoder, plain, cut = huffman.UnitEncoder(PATH), Tokenizer.from_file(PATH), []
    whole = encoder.units

    class Spy:
        @staticmethod
        def findall(text):
            found = whole.findall(text)
            cut.extend(found)
            return found

    encoder.units = Spy()
    texts = ["One, two; it's three3 " * 50, "two; ONE, é\n" * 70]
    for _ in range(3):
        ids, counts = encoder.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(cut) <= 20


def test_cache_of_long_words(monkeypatch):
    """A word without white space may be a whole text: the caches are bounded by bytes too."""
    monkeypatch.setattr(huffman, "CACHED_WORDS", 1000)
    monkeypatch.setattr(huffman, "CACHED_UNITS", 1000)
    encoder, plain = huffman.UnitEncoder(PATH), Tokenizer.from_file(PATH)
    for i in range(12):
        texts = [f"{i} " + "字" * 5000 + f"{i} short", "ab." * 3000 + f"{i}"]
        ids, counts = encoder.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert max(known.names.nbytes + known.cells.nbytes for known in (encoder.word, encoder.place)) < 101_000
    assert len(encoder.word) > 0
