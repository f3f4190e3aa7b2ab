import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from cohortlens.operators.exact import Measure, measure

X = "x"
BOTH = {"s": Measure("exact_sum", X), "a": Measure("exact_avg", X), "n": Measure("count"), "m": Measure("max", X)}


def sums(spark, groups, parts=3):
    rows = [(k, x) for k, xs in groups.items() for x in xs]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, x double").repartition(parts)
    return {r.k: r for r in measure(df, ["k"], BOTH).collect()}


def test_sums_are_exact_and_rounded_once(spark):
    rng = random.Random(2)
    groups = {
        "fine": [0.004] * 1000,
        "large": [1e17, 1.0, -1e17],
        "cancel": [1e300, 1.0, -1e300, 1e-300],
        "between": [2.0**53, 1.0, 2.0**-60],  # just above a tie
        "tie": [2.0**53, 1.0],
        "tie up": [2.0**53 + 2, 1.0],
        "near cancel": [2.0**69, -(2.0**69) + 2.0**20, -(2.0**20), 2.0**-70],
        "negative": [-0.1] * 7 + [-1e10],
        "subnormal": [5e-324, 1e-310, -3e-320] * 5,
        "largest": [1.7976931348623157e308, -1e308, 5.0],
        "zero": [0.0, -0.0, 0.0],
    }
    for i in range(60):
        spread = rng.choice([1, 30, 200, 900])
        groups[f"r{i}"] = [rng.uniform(-1, 1) * 2.0 ** rng.randint(-spread, spread) for _ in range(rng.randint(1, 40))]
    got = sums(spark, groups)
    for k, xs in groups.items():
        assert got[k].s == math.fsum(xs), k
        assert got[k].s == float(sum(map(Fraction, xs))), k
        assert (got[k].a, got[k].n, got[k].m) == (math.fsum(xs) / len(xs), len(xs), max(xs)), k


def test_special_values(spark):
    inf, nan = math.inf, math.nan
    groups = {"n": [1.0, nan], "p": [1.0, inf], "m": [-inf, 2.0], "both": [inf, -inf], "null": [None, None], "some": [None, 2.5], "over": [1.5e308, 1.5e308]}
    got = sums(spark, groups)
    assert math.isnan(got["n"].s) and math.isnan(got["both"].s)
    assert (got["p"].s, got["m"].s, got["over"].s) == (inf, -inf, inf)
    assert got["null"].s is None and got["null"].a is None and got["null"].n == 2
    assert (got["some"].s, got["some"].a, got["some"].n) == (2.5, 2.5, 2)


def test_order_does_not_matter(spark):
    rng = random.Random(3)
    xs = [rng.uniform(-1, 1) * 10.0 ** rng.randint(-20, 20) for _ in range(2000)]
    assert {sums(spark, {"k": rng.sample(xs, len(xs))}, p)["k"].s for p in (1, 2, 7)} == {math.fsum(xs)}


def test_whole_table_and_several_inputs(spark):
    df = spark.createDataFrame([(0.1, 1, True), (0.2, None, False), (None, 4, None)], "x double, i int, f boolean")
    figures = {
        "s": Measure("exact_sum", X), "twice": Measure("exact_avg", F.col("x") * 2), "i": Measure("sum", F.col("i")),
        "j": Measure("avg", F.col("i")), "n": Measure("count"),
    }
    row = measure(df, [], figures).first()
    assert (row.s, row.twice, row.i, row.j, row.n) == (math.fsum([0.1, 0.2]), math.fsum([0.2, 0.4]) / 2, 5, 2.5, 3)
    empty = measure(df.limit(0), [], figures).first()
    assert tuple(empty) == (None, None, None, None, 0)
    assert measure(df.limit(0), ["i"], {"s": Measure("exact_sum", X)}).count() == 0


def test_bad_measures():
    with pytest.raises(ValueError):
        Measure("median", X)
    with pytest.raises(ValueError):
        Measure("exact_sum")
