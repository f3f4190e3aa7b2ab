"""Grouped aggregates, one-scan indicators, distributions and shares."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.numbers import finite
from cohortlens.model import Filter, Metric, SemanticModel, SortKey
from cohortlens.operators.exact import Measure, measure
from cohortlens.operators.filters import apply_filters


def normalise_result(df: DataFrame, metrics: Iterable[Metric]) -> DataFrame:
    """NaN and infinities to null, fractional metrics to their decimals."""
    decimals = {m.key: m.decimals for m in metrics}
    fractional = {"double", "float"}

    def clean(name: str, type_name: str) -> Column:
        if type_name not in fractional:
            return F.col(name)
        value = finite(F.col(name))
        return (F.round(value, decimals[name]) if name in decimals else value).alias(name)

    return df.select(*[clean(n, t) for n, t in df.dtypes])


def aggregate(
    df: DataFrame,
    model: SemanticModel,
    dimensions: Sequence[str],
    metrics: Sequence[str],
    filters: Iterable[Filter] = (),
    sort: Sequence[SortKey] = (),
    limit: int | None = None,
    normalise: bool = True,
) -> DataFrame:
    """A1 with O1-O3: filter, group, measure, sort, keep the first ``limit`` groups.

    Without ``sort`` the first metric decides, largest first. The group keys always follow
    as tie-breaker, so a limited result does not change from run to run.
    """
    dims = model.pick_dimensions(dimensions)
    measures = model.pick_metrics(metrics)
    if limit is not None and limit < 1:
        raise ValueError(f"limit must be positive, got {limit}")
    order = sort_columns(model, dims, measures, sort)
    rows, keys = apply_filters(df, model, filters), [d.column for d in dims]
    if any(m.exact for m in measures):
        groups = measure(rows, keys, {m.key: m.measure() for m in measures})
    else:
        groups = rows.groupBy(*keys).agg(*[m.expr() for m in measures])
    groups = groups.orderBy(*order)
    top = groups if limit is None else groups.limit(limit)
    return normalise_result(top, measures) if normalise else top


def sort_columns(model, dims, measures, sort: Sequence[SortKey]) -> list[Column]:
    """O1/O2 as order expressions; a field that is not in the output is refused."""
    outputs = [d.column for d in dims] + [m.key for m in measures]
    order = []
    for s in sort or [SortKey(measures[0].key)]:
        dim = model.dimension(s.field)
        name = s.field if s.field in outputs or dim is None else dim.column
        if name not in outputs:
            raise ValueError(f"cannot sort by {s.field!r}: not in the output")
        if s.order not in ("asc", "desc"):
            raise ValueError(f"bad sort order: {s.order!r}")
        order.append((name, s.order))
    taken = {name for name, _ in order}
    order += [(d.column, "asc") for d in dims if d.column not in taken]
    return [F.desc(n) if o == "desc" else F.asc(n) for n, o in order]


def rate_pct(condition: Column) -> Column:
    """A4: share of rows that meet the condition, in percent; null counts as no."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0)) * 100


def indicators(df: DataFrame, **expressions: Column | Measure) -> DataFrame:
    """A3: one row of figures over the whole table, from one scan."""
    return _measured(df, [], expressions)


def _measured(df: DataFrame, keys: Sequence[str], figures: dict[str, Column | Measure]) -> DataFrame:
    """Aggregates as columns, or as measures where exact ones are among them."""
    if all(isinstance(f, Measure) for f in figures.values()):
        return measure(df, keys, figures)
    return df.groupBy(*keys).agg(*[f.alias(name) for name, f in figures.items()])


# Tasks that share the distinct values of one field.
VALUE_BUCKETS = 64
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def value_counts(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """How often each value of each field occurs, as (field, value, n_rows), in one scan."""
    long = df.select(*[F.col(f).cast("string").alias(f) for f in fields]).unpivot(
        [], list(fields), "field", "value"
    )
    return long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n_rows"))


def value_distribution(df: DataFrame, fields: Sequence[str], n: int = 10) -> DataFrame:
    """A5/Q2: the ``n`` most frequent values of each field, in one scan.

    The rows are unpivoted to (field, value), counted with map-side combine and ranked.
    """
    return top_values(value_counts(df, fields), n)


def top_values(counts: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent values of each field from (field, value, n_rows).

    The values of a field never meet in one task: up to the optimizer's threshold the rank filter
    becomes a group limit below the second shuffle; beyond it they are ranked in buckets by hash
    first, and only the ``n`` best of each bucket go on. Both give the same rows.
    """
    order = [F.desc("n_rows"), F.asc("value")]
    if n > int(counts.sparkSession.conf.get(GROUP_LIMIT)):
        bucket = F.pmod(F.xxhash64("value"), F.lit(VALUE_BUCKETS))
        inside = Window.partitionBy("field", bucket).orderBy(*order)
        counts = counts.withColumn("position", F.row_number().over(inside))
        counts = counts.filter(F.col("position") <= n)
    by_rank = Window.partitionBy("field").orderBy(*order)
    ranked = counts.withColumn("position", F.row_number().over(by_rank))
    return ranked.filter(F.col("position") <= n)


def top_groups(
    df: DataFrame, keys: Sequence[str], n: int, count_name: str = "n_rows", **measures: Column | Measure
) -> DataFrame:
    """The ``n`` largest groups with further measures; the keys break ties."""
    exact = any(isinstance(m, Measure) for m in measures.values())
    size = Measure("count") if exact else F.count(F.lit(1))
    sized = _measured(df, keys, {count_name: size, **measures})
    return sized.orderBy(F.desc(count_name), *[F.asc(k) for k in keys]).limit(n)


def group_share(df: DataFrame, *keys: str, decimals: int | None = 4) -> DataFrame:
    """Group sizes and their share of all rows.

    The total is a scalar subquery over the group counts, not a window or a join.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    total = counts.agg(F.sum("n_rows").alias("total")).scalar()
    share = F.col("n_rows") / total
    return counts.withColumn("ratio", share if decimals is None else F.round(share, decimals))
