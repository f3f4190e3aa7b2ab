import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from cohortlens.operators import regression as M
from cohortlens.presets.discharge import COST_MODEL

KEY = ["permanent_facility_id"]


@pytest.fixture(scope="module")
def parts(df):
    return M.split(M.training_frame(df, COST_MODEL), KEY)


@pytest.fixture(scope="module")
def model(parts):
    return M.fit(parts[0], COST_MODEL)


def test_usable_rows(spark):
    spec = M.RegressionSpec("y", ("x",), ("c",))
    data = [(1.0, 1, "a"), (0.0, 1, "a"), (None, 1, "a"), (1.0, None, "a"), (1.0, 1, "Unknown"),
            (1.0, 1, None)]
    df = spark.createDataFrame(data, "y double, x int, c string")
    assert M.training_frame(df, spec).count() == 1


@pytest.mark.parametrize("method", ["xxhash64", "md5"])
def test_sample_and_split_do_not_depend_on_the_partitioning(df, method):
    def keys(frame):
        return sorted(r[0] for r in frame.select(*KEY).collect())

    def draw(n):
        frame = M.training_frame(df.repartition(n), COST_MODEL, 200, KEY, method=method)
        return [keys(frame), *map(keys, M.split(frame, KEY, method=method))]

    sample, train, test = draw(1)
    assert draw(7) == [sample, train, test]
    assert 140 < len(sample) < 260
    assert sorted(train + test) == sample
    assert 0.65 < len(train) / len(sample) < 0.92


def test_sample_keeps_everything_below_the_cap(df):
    assert M.training_frame(df, COST_MODEL, 10_000, KEY).count() == 600


def test_train_and_predict(df, parts, model):
    train, test = parts
    metrics = M.evaluate(model.transform(test), COST_MODEL.label).first()
    assert metrics.n_rows == test.count()
    assert metrics.rmse > 0
    scored = model.transform(test)
    for name, digits in (("rmse", 2), ("mae", 2), ("r2", 4)):
        theirs = RegressionEvaluator(labelCol=COST_MODEL.label, metricName=name).evaluate(scored)
        assert metrics[name] == pytest.approx(theirs, abs=0.6 * 10**-digits)
    assert M.model_summary(model, COST_MODEL).count() > 1


def test_coefficients_agree_with_ridge_in_closed_form(parts, model):
    """Ridge on standardised features: the penalty is regParam * n / std(y) per feature."""
    train, _ = parts
    names = M.feature_names(model, COST_MODEL)
    frame = model.transform(train).select("features", COST_MODEL.label).collect()
    x = np.array([r.features.toArray() for r in frame])
    y = np.array([r[1] for r in frame])
    sx, sy = x.std(axis=0, ddof=1), y.std(ddof=1)
    z, t = (x - x.mean(axis=0)) / sx, (y - y.mean()) / sy
    n = len(y)
    penalty = COST_MODEL.reg_param / sy * n
    beta = np.linalg.solve(z.T @ z + penalty * np.eye(len(names)), z.T @ t) * sy / sx
    got = {r.feature: r.coefficient for r in M.model_summary(model, COST_MODEL, 0, False).collect()}
    for name, b in zip(names, beta):
        assert got[name] == pytest.approx(b, rel=1e-3, abs=1e-2)


def test_category_index_follows_frequency_then_value(spark):
    df = spark.createDataFrame([(v,) for v in "cbbaacc"], "v string")
    assert [tuple(r) for r in M.category_index(df, "v").collect()] == [("c", 0), ("a", 1), ("b", 2)]


def test_predict_fills_missing_and_unseen(spark, df, model):
    odd = df.limit(1).select(
        F.lit(None).cast("int").alias("length_of_stay"),
        F.lit(None).cast("int").alias("apr_severity_of_illness_code"),
        F.lit(None).cast("string").alias("age_group"),
        F.lit("Somewhere").alias("type_of_admission"),
        "payment_typology_1", "apr_medical_surgical_description",
    )
    out = M.predict(model, odd, COST_MODEL).first()
    assert out.prediction is not None
    assert out.length_of_stay == 1 and out.age_group == "Unknown"


def test_one_hot(parts):
    spec = M.RegressionSpec("total_charges", ("length_of_stay",), ("age_group",), "onehot")
    model = M.fit(parts[0], spec)
    names = M.feature_names(model, spec)
    assert len(names) == len(model.stages[-1].coefficients) == 6
    with pytest.raises(ValueError):
        M.RegressionSpec("y", ("x",), encoding="none")


def test_category_index_numbers_every_value(spark):
    values = ["b", "a", "b", None, "c", "a", "d"] + [f"v{i:03d}" for i in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "x string").repartition(5)
    rows = {r["x"]: r["category_index"] for r in M.category_index(df, "x").collect()}
    assert [rows["a"], rows["b"], rows["c"], rows["d"]] == [0, 1, 2, 3]
    assert sorted(rows.values()) == list(range(304))
    assert rows["v000"] == 4 and rows["v299"] == 303
    assert M.category_index(df.limit(0), "x").collect() == []


def test_the_cap_leaves_the_test_part_whole(df):
    train, test = M.split(M.training_frame(df, COST_MODEL), KEY)
    few = M.training_frame(train, COST_MODEL, 50, KEY)
    model = M.fit(few, COST_MODEL)
    scored = M.evaluate(model.transform(test), COST_MODEL.label).first()
    assert scored.n_rows == test.count() > few.count() / 2
    assert not few.is_cached


def test_fit_by_table_gives_the_line_of_fit(df, parts, model):
    train, test = parts
    mine = M.fit_by_table(train, COST_MODEL)
    a = {r.feature: r.coefficient for r in M.model_summary(mine, COST_MODEL, 0, False).collect()}
    b = {r.feature: r.coefficient for r in M.model_summary(model, COST_MODEL, 0, False).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-6, abs=1e-6) for k in a)
    key = KEY[0]
    odd = test.withColumn("age_group", F.when(F.crc32(key) % 3 == 0, None).when(F.crc32(key) % 3 == 1, "new").otherwise(F.col("age_group")))
    mine, theirs = ({r[key]: r.prediction for r in M.predict(m, odd, COST_MODEL).collect()} for m in (mine, model))
    assert len(mine) == odd.count() and mine.keys() == theirs.keys()
    assert all(mine[k] == pytest.approx(theirs[k], rel=1e-6) for k in mine)


def test_fit_by_table_with_all_values_different(spark):
    spec = M.RegressionSpec("y", ("x",), ("c",), reg_param=0.0)
    rows = [(3.0 * i + 2 * (i % 7) + 1, i % 7, f"v{i:05d}") for i in range(3000)]
    model = M.fit_by_table(spark.createDataFrame(rows, "y double, x int, c string").repartition(4), spec)
    got = {r.feature: r.coefficient for r in M.model_summary(model, spec).collect()}
    assert got == pytest.approx({"(intercept)": 1.0, "x": 2.0, "c_idx": 3.0}, abs=1e-3)
    new = spark.createDataFrame([(0.0, 1, "unseen"), (0.0, 1, None), (0.0, 0, "v00002")], "y double, x int, c string")
    assert sorted(round(r.prediction, 2) for r in M.predict(model, new, spec).collect()) == [7.0, 9003.0, 9003.0]
    with pytest.raises(ValueError):
        M.fit_by_table(new, M.RegressionSpec("y", ("x",), ("c",), "onehot"))
