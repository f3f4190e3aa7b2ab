import numpy as np
from pyspark.sql import functions as F

from cohortlens.llm import ann
from cohortlens.llm.ann import fit_tree, nearest


def brute(rows, k):
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v) and len(v) == 8]
    ids, x = np.array([g[0] for g in good]), np.stack([g[1] for g in good])
    out = {}
    for i, v in good:
        if i % 20 == 0:
            s = (x * v).sum(axis=1)
            keep = ids != i
            order = np.lexsort((ids[keep], -s[keep]))[:k]
            out[i] = list(zip(ids[keep][order].tolist(), s[keep][order].tolist(), strict=True))
    return out


def test_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + 0.3 * rng.normal(size=8)).tolist()) for i in range(2500)]
    rows += [(3000 + i, centres[0].tolist()) for i in range(900)]
    rows += [(20_000, None), (20_020, [0.0] * 8), (20_040, [float("nan")] * 8), (20_060, [1.0]), (None, centres[1].tolist())]
    rows += [(20_080, [None] + [1.0] * 7), (20_100, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("leaf", F.lit(1))
    got = {}
    for r in nearest(df.repartition(4), F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(rows, 20)
    assert got.keys() == want.keys()
    hits = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    for q, own in got.items():
        assert own == sorted(own, key=lambda p: (-p[1], p[0])) and len(own) == 20 and q not in dict(own)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, [1.0, 2.0])], "vec_id long, embedding array<float>")
    got = nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [
        (0, 1, 20, 5.0), (0, 2, 1, 4.0), (20, 1, 0, 5.0), (20, 2, 1, 4.0),
    ]
    assert nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_tree_covers_all_leaves():
    x = np.random.default_rng(1).normal(size=(500, 4))
    tree = fit_tree(x, 20)
    assert set(tree.descend(x)) <= set(range(len(tree.leaf_of)))
    assert sorted(tree.visits(x[0], 10_000)) == list(range(len(tree.leaf_of)))


def test_queries_in_small_leaves_get_k_rows(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 8)) * 50
    x = np.concatenate([centres[i % 60] + rng.normal(size=(1, 8)) * 0.01 for i in range(600)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(df, F.col("vec_id") < 60, k=20, target=0.05).groupBy("query_id").count().collect()
    assert len(got) == 60 and all(r["count"] == 20 for r in got)


def test_blocks_of_queries_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(9, 8)) * 5
    rows = [(i, (centres[0 if i % 3 else i % 9] + rng.normal(size=8)).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)

    def found(block):
        monkeypatch.setattr(ann, "BLOCK_QUERIES", block)
        return sorted(map(tuple, nearest(df, F.col("vec_id") % 4 == 0, k=5).collect()))

    assert found(7) == found(8192) and len(found(8192)) == 5 * 225
