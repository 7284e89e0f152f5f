from collections import Counter

import pytest
from test_jaccard import brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tidewater.llm import decontaminate, jaccard, shared  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_one_of_each_group(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join([*base, "x"]), " ".join(base[::-1]), " ".join(base), None, None, "", " ".join([*base[1:], "y"])]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 1), (3, "something else", "en", "s", 1), (None, texts[2], "en", "s", 1)]
    docs = spark.createDataFrame(rows, COLUMNS)
    docs = docs.selectExpr("*", "1 AS _name", "2 AS _uid", "3 AS node", "4 AS _found", "5 AS _one")
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    found = docs.filter("doc_id = 6").selectExpr("doc_id", "xxhash64(text) AS _uid")
    assert decontaminate.without(docs, found).count() == docs.count() - 1
    assert Counter(t for _, t in got if t) == Counter([texts[0], texts[2], "something else"])
    assert [t for _, t in got if not t].count(None) == 2 and (6, "") in got
    assert jaccard.one_of_each(docs.limit(0)).count() == 0


def test_stages_on_small_tables(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = shared.documents(spark, sf_dir)
    before = {r.doc_id: r for r in docs.collect()}
    kept = [before]
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.save(stage(spark, docs, sf_dir), "test")
        rows = docs.collect()
        assert all(before[r.doc_id].text == r.text and before[r.doc_id].source == r.source for r in rows), name
        if name != "mixing sources to target weights" and name != "sharding":
            assert len({r.doc_id for r in rows}) == len(rows)
        if name == "n-gram Jaccard join":
            texts = [r.text for r in rows]
            assert all(root == i for i, (n, root) in brute(texts, 80, 5).items() if n)
        kept.append(Counter(r.doc_id for r in rows))
    assert set(kept[1]) > set(kept[2]) >= set(kept[3]) >= set(kept[4]) and max(kept[4].values()) <= 3 and kept[5] == kept[4]
    assert docs.columns == [*COLUMNS.replace(" long", "").replace(" string", "").split(", "), "shard", "slot"]
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(40)) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s])) for s in counts)
