"""Linear regression with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.functions.hashing import unit_hash
from cohortlens.sources.scratch import scratch_path

INTERCEPT = "(intercept)"


@dataclass(frozen=True)
class RegressionSpec:
    """Label, features and solver settings."""

    label: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = ()
    encoding: str = "index"
    max_iter: int = 20
    reg_param: float = 0.01
    unknown: str = "Unknown"
    missing_number: float = 1

    def __post_init__(self) -> None:
        if self.encoding not in ("index", "onehot"):
            raise ValueError(f"unknown encoding: {self.encoding!r}")
        if not self.numeric + self.categorical:
            raise ValueError("need at least one feature")

    def usable(self) -> Column:
        """positive label, all numbers present, all categories known."""
        tests = [F.col(self.label) > 0]
        tests += [F.col(c).isNotNull() for c in self.numeric]
        tests += [F.col(c) != self.unknown for c in self.categorical]
        return reduce(and_, tests)


def training_frame(
    df: DataFrame,
    spec: RegressionSpec,
    cap: int | None = None,
    key: Sequence[str] | None = None,
    salt: str = "sample-42",
    method: str = "xxhash64",
) -> DataFrame:
    """Usable rows, thinned to about ``cap`` of them when there are more.

    A row stays when the hash of its key falls below cap/rows, so the choice depends on
    neither the partitioning nor the order, and no task ever holds the sample. The row
    count is a scalar subquery; ``key`` defaults to all columns.
    """
    rows = df.filter(spec.usable())
    if cap is None:
        return rows
    n_rows = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    keep = unit_hash(key or df.columns, salt, method) * n_rows < cap
    return rows.filter(keep)


def split(
    df: DataFrame,
    key: Sequence[str],
    train_ratio: float = 0.8,
    salt: str = "split-42",
    method: str = "xxhash64",
) -> tuple[DataFrame, DataFrame]:
    """M2: train and test part by the hash of the key; the same rows on every run."""
    if not 0 < train_ratio < 1:
        raise ValueError(f"train_ratio must be in (0, 1), got {train_ratio}")
    u = unit_hash(key, salt, method)
    return df.filter(u < train_ratio), df.filter(u >= train_ratio)


def category_index(df: DataFrame, column: str) -> DataFrame:
    """M3 as a table: values by falling frequency, ties by value, numbered from 0.

    The numbers a fitted ``StringIndexer`` would give, for any number of distinct values: the
    sorted counts are stored, so that a repeated task cannot deal them anew, and each part
    starts where the parts before it end. Only the sizes of the parts meet in one task. Nulls
    have no number; more than 2^31 values are an error.
    """
    values = df.select(F.col(f"`{column}`").cast("string").alias("value")).dropna()
    counts = values.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    path = scratch_path(df.sparkSession, "category-index")
    ranked = counts.sort(F.desc("n"), "value").select(
        "value", F.monotonically_increasing_id().alias("at")
    )
    ranked.write.parquet(path)

    # The upper bits of the id are the number of the part, the lower 33 the row in it.
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    stored = df.sparkSession.read.schema(ranked.schema).parquet(path)
    stored = stored.select("value", part.alias("part"), row.alias("row"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stored.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    starts = sizes.select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"))
    return stored.join(starts, "part").select(
        F.col("value").alias(column),
        (F.col("start") + F.col("row")).cast("int").alias("category_index"),
    )


def fit(train: DataFrame, spec: RegressionSpec) -> PipelineModel:
    """M3-M5: index the categories, assemble the features, fit the line.

    The columns used are kept while the stages of the fit read them, then released.
    """
    indexed = [f"{c}_idx" for c in spec.categorical]
    stages = []
    if indexed:
        # Values not seen in training share one extra index.
        stages.append(
            StringIndexer(
                inputCols=list(spec.categorical), outputCols=indexed, handleInvalid="keep"
            )
        )
    if indexed and spec.encoding == "onehot":
        encoded = [f"{c}_vec" for c in spec.categorical]
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=encoded))
        indexed = encoded
    stages += [
        VectorAssembler(inputCols=[*spec.numeric, *indexed], outputCol="features"),
        LinearRegression(
            labelCol=spec.label, maxIter=spec.max_iter, regParam=spec.reg_param
        ),
    ]
    kept = train.select(*spec.numeric, *spec.categorical, spec.label).persist()
    try:
        return Pipeline(stages=stages).fit(kept)
    finally:
        kept.unpersist()


@dataclass(frozen=True)
class TableModel:
    """A fitted line with its category numbers as stored tables, not as lists on the driver."""

    spec: RegressionSpec
    line: LinearRegressionModel
    numbers: dict[str, DataFrame]
    sizes: dict[str, int]

    @property
    def stages(self) -> list[LinearRegressionModel]:
        return [self.line]

    def transform(self, df: DataFrame) -> DataFrame:
        return self.line.transform(_with_numbers(df, self.spec, self.numbers, self.sizes))


def _with_numbers(
    df: DataFrame, spec: RegressionSpec, numbers: dict[str, DataFrame], sizes: dict[str, int]
) -> DataFrame:
    """Category numbers by a join per column; nulls and unseen values share the next number."""
    for c in spec.categorical:
        values = numbers[c].select(F.col(c).alias("_value"), F.col("category_index").alias("_number"))
        found = F.coalesce(F.col("_number"), F.lit(sizes[c])).cast("double")
        df = df.join(values, F.col(c).cast("string") == F.col("_value"), "left")
        df = df.withColumn(f"{c}_idx", found).drop("_value", "_number")
    inputs = [*spec.numeric, *[f"{c}_idx" for c in spec.categorical]]
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(df)


def fit_by_table(train: DataFrame, spec: RegressionSpec) -> TableModel:
    """M3-M5 for categories of any number of values: the line that ``fit`` gives.

    Each category's numbers (``category_index``) are a stored table that is joined in here and
    when predicting, so no list of labels reaches the driver or a task. Spark picks the join by
    the table's size. One-hot columns need a coefficient per value: use ``fit`` for them.
    """
    if spec.encoding != "index":
        raise ValueError("fit_by_table numbers categories; one-hot columns need fit")
    numbers, sizes = {}, {}
    for c in spec.categorical:
        path = scratch_path(train.sparkSession, "category-numbers")
        made = category_index(train, c)
        made.write.parquet(path)
        numbers[c] = train.sparkSession.read.schema(made.schema).parquet(path)
        sizes[c] = numbers[c].count()
    rows = train.select(*spec.numeric, *spec.categorical, spec.label)
    kept = _with_numbers(rows, spec, numbers, sizes).select("features", spec.label).persist()
    try:
        solver = LinearRegression(
            labelCol=spec.label, maxIter=spec.max_iter, regParam=spec.reg_param
        )
        return TableModel(spec, solver.fit(kept), numbers, sizes)
    finally:
        kept.unpersist()


def evaluate(predictions: DataFrame, label: str, rounded: bool = True) -> DataFrame:
    """M6: RMSE, MAE and R2 in one row from one pass."""
    error = F.col(label) - F.col("prediction")
    squares = F.sum(error * error)
    spread = F.var_pop(label) * F.count(label)
    figures = {
        "rmse": (F.sqrt(F.avg(error * error)), 2),
        "mae": (F.avg(F.abs(error)), 2),
        "r2": (1 - squares / F.nullif(spread, F.lit(0.0)), 4),
    }
    return predictions.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[(F.round(c, d) if rounded else c).alias(k) for k, (c, d) in figures.items()],
    )


def model_summary(
    model: PipelineModel | TableModel, spec: RegressionSpec, smallest: float = 1e-6, rounded: bool = True
) -> DataFrame:
    """M7: intercept and non-negligible coefficients as rows (feature, coefficient)."""
    line = model.stages[-1]
    names = feature_names(model, spec)
    rows = [(INTERCEPT, float(line.intercept))]
    rows += [(n, float(c)) for n, c in zip(names, line.coefficients) if abs(c) > smallest]
    table = SparkSession.active().createDataFrame(rows, "feature string, coefficient double")
    if not rounded:
        return table
    digits = F.when(F.col("feature") == INTERCEPT, F.round("coefficient", 2))
    return table.withColumn("coefficient", digits.otherwise(F.round("coefficient", 4)))


def feature_names(model: PipelineModel | TableModel, spec: RegressionSpec) -> list[str]:
    """The names of the coefficients, one per vector slot."""
    if spec.encoding == "index" or not spec.categorical:
        return [*spec.numeric, *[f"{c}_idx" for c in spec.categorical]]
    # The encoder drops the last index, which is the one kept for unseen values.
    labels = model.stages[0].labelsArray
    slots = [f"{c}={v}" for c, vs in zip(spec.categorical, labels) for v in vs]
    return [*spec.numeric, *slots]


def fill_features(df: DataFrame, spec: RegressionSpec) -> DataFrame:
    """Missing numbers and categories get the spec's stand-ins."""
    numbers = {
        c: F.coalesce(F.col(c), F.lit(spec.missing_number).cast(df.schema[c].dataType))
        for c in spec.numeric
    }
    texts = {c: F.coalesce(F.col(c), F.lit(spec.unknown)) for c in spec.categorical}
    return df.withColumns(numbers | texts)


def predict(model: PipelineModel | TableModel, df: DataFrame, spec: RegressionSpec) -> DataFrame:
    """M8: the table with a ``prediction`` column, rows with missing features included."""
    scored = model.transform(fill_features(df, spec))
    return scored.select(*df.columns, "prediction")
