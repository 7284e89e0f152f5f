import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tidewater.llm import quality, shared

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_counts_against_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "one", "a b c", "a b c a b c", "a a a a", "x\n\nx\n \nx", "#*$%&|<> ü€𝔸 #", "w " * 30_000]
    texts += ["".join(rng.choice(["a", "b", "é𝔸", "#", " ", "  ", "\n", "a b c ", "\x1c", "\x0b"]) for _ in range(rng.randrange(120))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, _words string, _bits int")
    rows = quality.describe(docs)
    assert rows.columns == [*docs.columns, *quality.COUNTS]
    for r in rows.collect():
        assert tuple(r[c] for c in quality.COUNTS) == brute(r.text), r.text[:50]


def fast_mcd(x, share, rng, starts=100):
    """Plain concentration steps from many random subsets of 6 rows: the least determinant found, floors as in the operator."""
    n, best = len(x), math.inf
    scale = share / quality.chi2_cdf(quality.chi2_quantile(share, quality.D), quality.D + 2)
    h = round(share * n)

    def moments(own):
        cov = scale * np.cov(own.T, bias=True)
        np.fill_diagonal(cov, np.maximum(np.diag(cov), np.square(quality.FLOORS)))
        return own.mean(axis=0), cov

    for _ in range(starts):
        mean, cov = moments(x[rng.choice(n, 6, replace=False)])
        cov += 1e-6 * np.eye(quality.D)
        for _ in range(20):
            d = x - mean
            mean, cov = moments(x[np.argsort((d @ np.linalg.inv(cov) * d).sum(axis=1), kind="stable")[:h]])
        best = min(best, np.linalg.slogdet(cov)[1])
    return best


def test_estimate_against_many_random_starts(spark):
    rng = np.random.default_rng(2)
    rows, groups = [], {}
    for name, center in (("a", 0.0), ("b", 5.0)):
        mix = rng.normal(0, 1, (5, 5)) * np.array(quality.FLOORS)[:, None] * 1.5
        good = center + rng.normal(0, 1, (400, 5)) @ mix.T
        bad = center + 25 * np.array(quality.FLOORS) + rng.normal(0, 0.1, (60, 5))
        groups[name] = np.concatenate([good, bad])
        rows += [(name, *map(float, x)) for x in groups[name]]
    table = spark.createDataFrame(rows, "_group string, " + ", ".join(f"_x{i} double" for i in range(5)))
    found = {r._group: r for r in quality.estimates(table, 0.75, 10).collect()}
    for name, x in groups.items():
        r = found[name]
        lower = np.array([[r[f"_l{i}{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
        assert 2 * np.log(np.diag(lower)).sum() <= fast_mcd(x, 0.75, rng) + 0.05
        z = np.linalg.solve(lower, (x - [r[f"_m{i}"] for i in range(5)]).T)
        far = (z**2).sum(axis=0) > quality.chi2_quantile(0.99, 5)
        assert far[400:].all() and far[:400].mean() < 0.05


def test_chi_square():
    assert abs(quality.chi2_quantile(0.99, 5) - 15.0863) < 1e-3 and abs(quality.chi2_cdf(4.35146, 5) - 0.5) < 1e-5


def test_judge_small_groups_nulls_clashing_names_and_empty(spark):
    rng = random.Random(3)
    prose = lambda: " ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) + str(rng.randrange(50)) for _ in range(rng.randrange(80, 200)))
    rows = [(i, prose(), None if i % 2 else "en", f"s{i % 40}", "x") for i in range(200)]
    rows += [(900, " ".join(f"#$%{i}" for i in range(300)) + " " + prose(), "en", "s1", "x"), (901, "short", "en", "s1", "x"), (902, "same again now " * 60, None, None, "x"), (903, None, None, None, "x"), (1, rows[1][1], "en", "s1", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _group string")
    described = shared.save(quality.describe(docs), "test")
    out = quality.judge(described.withColumn("kept", F.lit("old")))
    assert out.columns == [*docs.columns, *quality.COUNTS, "base_failed", "kept", "distance"]
    every = out.collect()
    got = {r.doc_id: r for r in every}
    assert len(every) == len(rows)
    assert not got[900].kept and not got[900].base_failed and got[901].base_failed and got[902].base_failed and got[903].base_failed
    assert sum(got[i].kept for i in range(200)) > 190
    few = quality.judge(described.filter("doc_id < 20 OR doc_id = 900")).filter("NOT base_failed").collect()
    assert few and all(r.kept and r.distance is None for r in few)
    assert quality.judge(described.limit(0)).count() == 0
