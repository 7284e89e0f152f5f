import hashlib
import random
from collections import defaultdict

from tidewater.llm import repeats


def brute(texts, length):
    seen = defaultdict(int)
    for t in texts:
        for s in range(len(t) - length + 1):
            seen[t[s : s + length]] += 1
    for t in texts:
        gone = [False] * len(t)
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone[s : s + length] = [True] * length
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        yield len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()


def made(seed):
    rng = random.Random(seed)
    prose = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [prose(n) for n in (199, 200, 201, 230, 340, 600)]
    out = [None, "", "short", "aaaa" * 120, "ab" * 300, shared[4], shared[4]]
    for _ in range(25):
        out.append("".join(rng.choice([prose(rng.randrange(90)), rng.choice(shared), rng.choice(shared)[rng.randrange(60) :]]) for _ in range(4)))
    long = prose(3000)
    out += [long[:a] + "#" + long[a:] for a in (0, 150, 1500, 2999)]
    return out


def check(spark, texts, length=200, gram=50):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in repeats.remove_repeats(docs, length=length, gram=gram).collect()}
    for i, want in enumerate(brute([(t or "").encode() for t in texts], length)):
        r = rows[i]
        raw = (texts[i] or "").encode()
        assert (len(raw), len(raw) - len(r.kept), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) == want, i


def test_against_brute_force(spark):
    for seed in (1, 2):
        check(spark, made(seed))


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 700)
    check(spark, made(3))


def test_equal_rows_extra_columns_and_empty(spark):
    text = "".join(random.Random(4).choice("xyz ") for _ in range(450))
    docs = spark.createDataFrame([(1, text, "a"), (1, text, "a"), (None, None, None)], "doc_id long, text string, kept_from string").selectExpr("*", "1 AS kept", "2 AS _text", "3 AS core")
    rows = repeats.remove_repeats(docs).collect()
    assert sorted(len(r.kept) for r in rows) == [0, 0, 0] and [r.kept_from for r in rows].count("a") == 2
    assert repeats.remove_repeats(docs.limit(0)).count() == 0
