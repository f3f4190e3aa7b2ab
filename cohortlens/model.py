"""The semantic layer: what may be grouped, measured, filtered and sorted.

A ``SemanticModel`` is a whitelist passed to ``aggregate``. All checks run before any plan
is built and raise ``ValueError``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlens.operators.exact import Measure

EQUALITY_OPS = frozenset({"eq", "ne", "in", "not_in"})
RANGE_OPS = frozenset({"gte", "gt", "lte", "lt", "between"})
LIST_OPS = frozenset({"in", "not_in", "between"})
VALUE_TYPES = frozenset({"string", "integer", "double"})
AGGREGATES = frozenset({"count", "avg", "sum", "max"})


@dataclass(frozen=True)
class Dimension:
    """A column one may group and filter by; ``key`` is the name used in requests."""

    key: str
    column: str = ""
    value_type: str = "string"
    label: str = ""

    def __post_init__(self) -> None:
        if self.value_type not in VALUE_TYPES:
            raise ValueError(f"unknown value type: {self.value_type!r}")
        object.__setattr__(self, "column", self.column or self.key)
        object.__setattr__(self, "label", self.label or self.key.replace("_", " "))


@dataclass(frozen=True)
class Metric:
    """A named aggregate. ``exact`` asks for sums that drop no digit of a double."""

    key: str
    agg: str
    column: str | None = None
    decimals: int = 2
    unit: str = ""
    exact: bool = False

    def __post_init__(self) -> None:
        if self.agg not in AGGREGATES:
            raise ValueError(f"unknown aggregate: {self.agg!r}")
        if self.agg != "count" and not self.column:
            raise ValueError(f"metric {self.key!r} needs a column")

    def expr(self) -> Column:
        """A1a-A1d as Spark's own aggregate."""
        if self.exact and self.agg in ("sum", "avg"):
            raise ValueError(f"metric {self.key!r} is exact: use measure()")
        if self.agg == "count":
            return F.count(F.lit(1)).alias(self.key)
        return {"sum": F.sum, "avg": F.avg, "max": F.max}[self.agg](self.column).alias(self.key)

    def measure(self) -> Measure:
        """A1a-A1d where some metric of the request is exact."""
        kind = f"exact_{self.agg}" if self.exact and self.agg in ("sum", "avg") else self.agg
        return Measure(kind, None if self.agg == "count" else F.col(self.column))


@dataclass(frozen=True)
class Filter:
    """``field op value``; the list operators take ``values`` instead."""

    field: str
    op: str
    value: object = None
    values: Sequence[object] | None = None


@dataclass(frozen=True)
class SortKey:
    field: str
    order: str = "desc"


@dataclass(frozen=True)
class SemanticModel:
    dimensions: tuple[Dimension, ...]
    metrics: tuple[Metric, ...]
    # Numeric columns that may be filtered on without being dimensions: (name, value type).
    filter_columns: tuple[tuple[str, str], ...] = field(default=())
    max_dimensions: int = 5

    @cached_property
    def _dimension_index(self) -> dict[str, Dimension]:
        by_column = {d.column: d for d in self.dimensions}
        return by_column | {d.key: d for d in self.dimensions}

    def dimension(self, name: str) -> Dimension | None:
        """Find a dimension by key or by column."""
        return self._dimension_index.get(name)

    def metric(self, key: str) -> Metric | None:
        return next((m for m in self.metrics if m.key == key), None)

    def pick_dimensions(self, names: Iterable[str]) -> list[Dimension]:
        names = list(names)
        if not 1 <= len(names) <= self.max_dimensions:
            raise ValueError(f"need 1 to {self.max_dimensions} dimensions, got {len(names)}")
        return _pick("dimension", names, self.dimension)

    def pick_metrics(self, keys: Iterable[str]) -> list[Metric]:
        keys = list(keys)
        if not keys:
            raise ValueError("need at least one metric")
        return _pick("metric", keys, self.metric)

    def filter_target(self, name: str) -> tuple[str, str]:
        """Column and value type of a field that may be filtered on."""
        dim = self.dimension(name)
        if dim is not None:
            return dim.column, dim.value_type
        value_type = dict(self.filter_columns).get(name)
        if value_type is None:
            raise ValueError(f"field may not be filtered on: {name!r}")
        return name, value_type


def _pick(kind, names, find):
    found = {n: find(n) for n in names}
    bad = [n for n, spec in found.items() if spec is None]
    if bad:
        raise ValueError(f"unknown {kind}: {bad}")
    return list(dict.fromkeys(found.values()))
