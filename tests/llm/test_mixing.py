from collections import Counter, defaultdict

import pytest

from cohortlens.llm.mixing import exponent, mix_sources, tokens


def rows_of():
    rows = [(i, "w " * (5 + i % 7), "big", 1) for i in range(3000)]
    rows += [(10_000 + i, "w " * 9, "small", 1) for i in range(150)]
    rows += [(20_000 + i, "w " * 4, None, 1) for i in range(40)]
    return rows + [(None, None, "big", 1), (30_000, "", "empty", 1), (5, "w w w", "big", 1), (5, "w w w", "big", 1)]


def test_repetition_limit(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, block int")
    got = mix_sources(df.repartition(5), repetition_limit=2.0).collect()
    size, drawn = Counter(), Counter()
    for _, text, source, _ in rows:
        size[source] += len((text or "").split())
    for r in got:
        drawn[r.source] += r.n_tokens
    ratio = {s: drawn[s] / size[s] for s in size if size[s]}
    assert ratio["big"] == 1 and max(ratio.values()) == pytest.approx(2, abs=0.05)
    assert {(r["row"]["doc_id"], r["row"]["text"]) for r in got} == {(d, t) for d, t, *_ in rows}
    assert sum(r.epoch == 0 for r in got) == len(rows)
    weights = {r.source: r.weight for r in got}
    assert sum(weights.values()) == pytest.approx(1)
    assert max(ratio[s] / (weights[s] / size[s]) for s in ratio) == pytest.approx(
        min(ratio[s] / (weights[s] / size[s]) for s in ratio), rel=0.05
    )


def test_budget_cuts_inside_blocks(spark):
    rows = [r for r in rows_of() if r[0] is not None and r[0] < 3000]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, block int")
    got = mix_sources(df, repetition_limit=1.0, budget=5_000).collect()
    assert 5_000 <= sum(r.n_tokens for r in got) < 5_012
    order = defaultdict(list)
    for r in got:
        order[r.block_order].append(r)
    assert len(order) > 1 and mix_sources(df.limit(0)).count() == 0


def test_exponent_meets_entropy(spark):
    import math

    sizes = [900.0, 90.0, 9.0, 1.0]
    df = spark.createDataFrame([(str(s), int(s)) for s in sizes], "source string, tokens long")
    a = exponent(df, None, 0.6)
    w = [(s / 1000) ** a for s in sizes]
    w = [x / sum(w) for x in w]
    assert -sum(x * math.log(x) for x in w) / math.log(4) == pytest.approx(0.6, abs=1e-6)
    assert exponent(df, 900.0 ** 0.5, None) == pytest.approx(0.5, abs=1e-6)
    with pytest.raises(ValueError):
        mix_sources(df, None, None)


def test_tokens(strings):
    from pyspark.sql import functions as F

    got = strings([None, "", "  ", "a", " a\tb\n\nc "]).orderBy("i").select(tokens(F.col("s"))).collect()
    assert [r[0] for r in got] == [0, 0, 0, 1, 3]


def test_last_epoch_against_brute_force(spark, monkeypatch):
    """Blocks in their order until the budget is met, in the last one document by document."""
    from cohortlens.llm import mixing

    monkeypatch.setattr(mixing, "BLOCK_ROWS", 4)
    monkeypatch.setattr(mixing, "PART_BITS", 3)
    rows = [r for r in rows_of() if r[2] in ("big", "small") and r[0] is not None]
    rows = rows[:900] + rows[-250:]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, block int").dropDuplicates(["doc_id"])
    every = mix_sources(df, repetition_limit=1.0, budget=10**6).collect()  # whole epochs
    some = mix_sources(df, repetition_limit=1.0, budget=2_500).collect()
    assert {r.epoch for r in some} == {0}
    by_source = defaultdict(list)
    for r in every:
        if r.epoch == 0:
            by_source[r.source].append(r)
    total = sum(r.n_tokens for own in by_source.values() for r in own)
    want = set()
    for source, own in by_source.items():
        budget = round(2_500 * sum(r.n_tokens for r in own) / total)
        spent = 0
        for r in sorted(own, key=lambda r: (r.block_order, r.block, r.doc_order)):
            if spent < budget:
                want.add((source, r["row"]["doc_id"]))
            spent += r.n_tokens
    assert {(r.source, r["row"]["doc_id"]) for r in some} == want
