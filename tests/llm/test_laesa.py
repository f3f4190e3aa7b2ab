import hashlib
import math
import random

import numpy as np
import pytest

from cohortlens.llm.laesa import assign, away, cluster, exact, farthest, whole, with_inertia

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance string, id string"


def brute(rows, dims=64, k=8, rounds=10):
    kept = []
    for vec_id, x in rows:
        if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x):
            kept.append((vec_id, [math.floor(1024 * float(np.float32(v))) for v in x]))
    named = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in named[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = [[] for _ in centres]
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centres = [[sum(col) // len(g) for col in zip(*g, strict=True)] if g else c for g, c in zip(groups, centres, strict=True)]
    return [(i, *nearest(v)[::-1]) for i, v in kept], centres


def check(spark, rows):
    df = spark.createDataFrame([(i, x, 1, "a", "b", "c") for i, x in rows], SCHEMA).repartition(3)
    found, centres = cluster(df)
    want, want_centres = brute(rows)
    got = [(r.id, r.cluster, r.distance) for r in found.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert centres == want_centres
    out = with_inertia(found, centres).collect()
    assert {r.inertia for r in out} == {sum(d for _, _, d in want)}
    for r in out:
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, want_centres[r.cluster])).encode()).hexdigest()


def vectors(rng, n, groups=5):
    heads = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(groups)]
    return [[h + rng.gauss(0, 0.2) for h in rng.choice(heads)] for _ in range(n)]


def test_matches_brute_force(spark):
    rng = random.Random(1)
    rows = list(enumerate(vectors(rng, 300)))
    rows += [(7, rows[3][1]), (7, rows[3][1]), (None, rows[5][1])]
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [None] + [0.0] * 63), (904, [math.nan] * 64), (905, [math.inf] + [0.0] * 63)]
    rows += [(1000 + i, [0.5] * 64) for i in range(100)]  # ties between equal vectors
    check(spark, rows)


@pytest.mark.parametrize("scale", [1e5, 1e6])
def test_large_components_are_exact(spark, scale):
    rng = random.Random(2)
    rows = [(i, [scale * rng.choice([-1, 1, 0.5, 0]) if j < 2 else 0.25 for j in range(64)]) for i in range(40)]
    check(spark, rows)


def test_few_and_no_vectors(spark):
    rng = random.Random(3)
    check(spark, list(enumerate(vectors(rng, 3))))
    check(spark, [(5, [1.0] * 64)] * 12)
    empty = spark.createDataFrame([], SCHEMA)
    found, centres = cluster(empty)
    assert found.count() == 0 and centres == [] and with_inertia(found, centres).count() == 0


def test_bounds_lose_no_centroid_and_save_distances():
    rng = np.random.default_rng(4)
    heads = rng.integers(-2000, 2000, (8, 64))
    v = whole((heads[rng.integers(0, 8, 4000)] + rng.integers(-200, 200, (4000, 64))).astype(float))
    centres = v[:8].copy()
    centres[5] = centres[2]  # a tie on every vector
    pivots = farthest(v[:500], 12)
    own, reach = (np.stack([away(x, p) for p in pivots], axis=1) for x in (v, centres))
    got, best, used = assign(v, own, centres, reach)
    full = np.stack([exact(v, c) for c in centres], axis=1)
    assert (got == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()
    assert used.mean() < 5
