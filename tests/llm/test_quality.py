import random

import numpy as np

from cohortlens.llm import quality as Q


def prose(rng, n):
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(n)]
    return ". ".join(" ".join(words[k : k + 9]).capitalize() for k in range(0, n, 9)) + "."


def junk(rng, n):
    words = prose(rng, n).split()
    kind = rng.randint(0, 3)
    if kind == 0:
        return " ".join(w + rng.choice(["***", "###", "$$$"]) for w in words)
    if kind == 1:
        return " ".join(w.upper() + "!!" for w in words)
    if kind == 2:
        return " | ".join(words)
    return " ".join(w for w in words[: n // 8] for _ in range(8))


def test_estimate_trusts_a_lone_rejection():
    good = Q.estimate({"20000000": 10, "00000011": 500, "00000000": 9, "02200200": 20})
    assert good["20000000"] < 0.3 < good["00000011"]
    assert good["00000000"] == 0.5 and Q.estimate({}) == {}


def test_held_out_accuracy(spark):
    rng = random.Random(4)
    rows = [(i, junk(rng, rng.randint(20, 200)) if i % 6 == 0 else prose(rng, rng.randint(3, 300)), "x") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    weights = Q.fit(df.where("doc_id < 600"))
    got = {r.doc_id: r.score >= Q.THRESHOLD for r in Q.score(df.where("doc_id >= 600"), weights).collect()}
    assert np.mean([got[i] == (i % 6 != 0) for i in got]) > 0.98 and len(got) == 300
    kept = Q.keep_good(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} >= {i for i in range(900) if i % 6}


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "one"), (2, "")], "doc_id long, text string")
    assert Q.keep_good(df).count() == 4
    assert Q.keep_good(df.limit(0)).count() == 0
    assert {r.score for r in Q.score(df, np.zeros(1 << Q.BITS)).collect()} == {0.5}


def test_votes_on_a_long_text():
    assert Q.votes(b"a b " * 300_000)[2] == "2" and Q.votes(b"") == "0" * Q.LABELLERS


def test_estimate_against_single_documents():
    """Expectation-maximisation document by document, in plain loops."""
    rng = random.Random(2)
    patterns = ["".join(rng.choice("0012") for _ in range(Q.LABELLERS)) for _ in range(25)]
    counts = {p: rng.randint(1, 30) for p in patterns}
    docs = [p for p, n in counts.items() for _ in range(n)]
    accuracy = [0.9] * Q.LABELLERS
    for _ in range(40):
        good = []
        for d in docs:
            keep = reject = 1.0
            for a, vote in zip(accuracy, d, strict=True):
                if vote == "1":
                    keep, reject = keep * a, reject * (1 - a)
                elif vote == "2":
                    keep, reject = keep * (1 - a), reject * a
            good.append(keep / (keep + reject))
        for j in range(Q.LABELLERS):
            right = sum(g if d[j] == "1" else 1 - g for g, d in zip(good, docs, strict=True) if d[j] != "0")
            voted = sum(d[j] != "0" for d in docs)
            accuracy[j] = min(0.995, max(0.55, (right + 9) / (voted + 10)))
    got = Q.estimate(counts, rounds=40)
    for d, g in zip(docs, good, strict=True):
        assert abs(got[d] - (0.5 if set(d) == {"0"} else g)) < 1e-6


def test_fit_does_not_depend_on_the_partitioning(spark):
    rng = random.Random(7)
    rows = [(i, junk(rng, 60) if i % 4 == 0 else prose(rng, 80)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = Q.fit(df.repartition(1), 100), Q.fit(df.repartition(7), 100)
    assert np.array_equal(one, many) and one.any()
