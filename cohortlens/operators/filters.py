"""Filters from (field, op, value) specs."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.model import EQUALITY_OPS, LIST_OPS, RANGE_OPS, Filter, SemanticModel


def _literal(value: object, value_type: str, op: str) -> Column:
    """A literal of the column's own type, so the comparison reaches the Parquet scan."""
    if isinstance(value, bool) or value is None:
        raise ValueError(f"bad filter value: {value!r}")
    if value_type == "string":
        if not isinstance(value, str):
            raise ValueError(f"text column compared with {value!r}")
        return F.lit(value)
    try:
        number = float(value)
    except (TypeError, ValueError):
        raise ValueError(f"numeric column compared with {value!r}") from None
    if value_type == "integer" and number.is_integer():
        return F.lit(int(value) if isinstance(value, int) else int(number))
    if value_type == "integer" and op in EQUALITY_OPS:
        raise ValueError(f"integer column compared with {value!r}")
    return F.lit(number)


def predicate(f: Filter, model: SemanticModel) -> Column:
    """One condition. As in SQL, ``ne`` and ``not_in`` also drop rows with a null."""
    column, value_type = model.filter_target(f.field)
    allowed = EQUALITY_OPS if value_type == "string" else EQUALITY_OPS | RANGE_OPS
    if f.op not in allowed:
        raise ValueError(f"{f.field!r} ({value_type}) does not take {f.op!r}")
    c = F.col(column)
    if f.op in LIST_OPS:
        if isinstance(f.values, str) or not f.values:
            raise ValueError(f"{f.op!r} needs a non-empty list of values")
        if f.op == "between" and len(f.values) != 2:
            raise ValueError("'between' needs exactly two values")
        values = [_literal(v, value_type, f.op) for v in f.values]
        if f.op == "between":
            return c.between(*values)
        return c.isin(*values) if f.op == "in" else ~c.isin(*values)
    v = _literal(f.value, value_type, f.op)
    return {
        "eq": c == v, "ne": c != v, "gte": c >= v, "gt": c > v, "lte": c <= v, "lt": c < v,
    }[f.op]


def apply_filters(df: DataFrame, model: SemanticModel, filters: Iterable[Filter]) -> DataFrame:
    """all conditions must hold."""
    conditions = [predicate(f, model) for f in filters]
    return df.filter(reduce(and_, conditions)) if conditions else df


def known(df: DataFrame, *columns: str, unknown: str = "Unknown") -> DataFrame:
    """drop rows where any of the columns is null or the ``unknown`` marker.

    The null tests are spelled out. Joins add them above the filter, and only a filter that
    has them already stays the same in every branch, so that one scan can serve them all.
    """
    tests = [F.col(c).isNotNull() & (F.col(c) != unknown) for c in columns]
    return df.filter(reduce(and_, tests))
