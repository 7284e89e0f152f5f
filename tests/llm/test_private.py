import random
import re

from tidewater.llm import private

#: The contract's patterns, as Python writes them.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    odd = [int(c) for c in digits[::-1]]
    return (sum(odd[::2]) + sum(sum(divmod(2 * d, 10)) for d in odd[1::2])) % 10 == 0


def stands(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    return [(m.start(), kind, m.end()) for kind, p in BASE.items() for m in re.finditer(p, text or "") if stands(kind, m[0])]


def run(spark, texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.spans for r in private.find_private(docs, **more).collect()}


def test_base_spans(spark):
    rng = random.Random(5)
    texts = [
        None, "", "plain", "a@b.c_x@d.e", "a@b.c-x@d.e.", "x@y a@b. é𝔸 q.w+e@mail-1.example.org", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255 1.2.3.0256", "127.0.0.1 10.0.0.1 0.0.0.0 000.00.0.0255 1.0.0.256",
        "4111 1111 1111 1111 and 4111-1111-1111-1112, 41111111111111114111", "+1 (171) 555-2028 +49.30.1234567, +12", "7" * 5000 + " " + "a" * 5000 + " @ " + "1." * 3000,
    ]
    pieces = ["a", "Zé", "@", ".", "0", "1", "25", "255", "10.0.0.1", "4111111111111111", "+", "-", " ", "  ", "(", ")", "%", "\n", "𝔸", "8.8.8.8", "x@y.z"]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(300)]
    got = run(spark, texts)
    for i, text in enumerate(texts):
        assert sorted((s.start, s.kind, s.end) for s in got[i] if s.base) == sorted(base(text)), text


def test_contexts_find_unseen_identifiers(spark):
    rng = random.Random(6)
    prose = lambda: " ".join(rng.choice("red blue green grey pink".split()) + str(rng.choice(["", ""])) for _ in range(12))
    texts = [f"{prose()} please call me +1 (555) {100 + i}-{2000 + i} today {prose()}" for i in range(30)]
    texts += [f"{prose()} please call me 555-01{i:02d} today {prose()}" for i in range(4)]
    texts += [f"{prose()} version 4.2{i} shipped {prose()}" for i in range(20)]
    got = run(spark, texts)
    new = {i: [texts[i][s.start : s.end] for s in spans if not s.base] for i, spans in got.items()}
    assert {i: v for i, v in new.items() if v} == {30 + i: [f"555-01{i:02d}"] for i in range(4)}


def test_found_identifiers_induce_new_patterns(spark):
    """No seed stands after "dial"; identifiers found after "call" do, and lead to others there."""
    rng = random.Random(7)
    prose = lambda: " ".join(rng.choice("red blue green grey pink".split()) for _ in range(8))
    texts = [f"{prose()} please call me +1 (555) {100 + i}-{2000 + i} today {prose()}" for i in range(60)]
    texts += [f"{prose()} please call me 555-02{i:02d} today {prose()} and then dial up 555-02{i:02d} later {prose()}" for i in range(12)]
    texts += [f"{prose()} and then dial up 555-03{i:02d} later {prose()}" for i in range(3)]
    got = run(spark, texts)
    assert [[texts[i][s.start : s.end] for s in got[i] if not s.base] for i in range(72, 75)] == [[f"555-03{i:02d}"] for i in range(3)]


def test_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a@b.cd", 1), (1, "a@b.cd", 1), (None, None, 2)], "doc_id long, text string, start int")
    rows = private.find_private(docs).collect()
    assert sorted(len(r.spans) for r in rows) == [0, 1, 1]
    assert private.find_private(docs.limit(0)).count() == 0
