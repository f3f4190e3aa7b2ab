"""Score, contribution and level columns from declarative rules (K1-K3)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MapRule:
    """Points by value; a value that is not listed scores nothing."""

    factor: str
    field: str
    points_by_value: Mapping[str, int]

    def points(self) -> Column:
        return reduce(
            lambda chain, item: chain.when(F.col(self.field) == item[0], item[1]),
            self.points_by_value.items(),
            F,
        ).otherwise(0)


@dataclass(frozen=True)
class ThresholdRule:
    """Points when the number is at least ``at_least``."""

    factor: str
    field: str
    at_least: float
    award: int

    def points(self) -> Column:
        return F.when(F.col(self.field) >= self.at_least, self.award).otherwise(0)


@dataclass(frozen=True)
class ExcludeRule:
    """Points when the value is none of ``allowed``; null scores only on request."""

    factor: str
    field: str
    allowed: tuple[str, ...]
    award: int
    null_counts_as_other: bool = False

    def points(self) -> Column:
        hit = ~F.col(self.field).isin(*self.allowed)
        if self.null_counts_as_other:
            hit = F.coalesce(hit, F.lit(True))
        return F.when(hit, self.award).otherwise(0)


Rule = MapRule | ThresholdRule | ExcludeRule


def score(rules: Sequence[Rule]) -> Column:
    """K1: total points of a row."""
    return reduce(add, [r.points() for r in rules]).cast("int")


def contributions(rules: Sequence[Rule]) -> Column:
    """K2: one (factor, field, value, points) entry per rule, in rule order."""
    return F.array(
        *[
            F.struct(
                F.lit(r.factor).alias("factor"),
                F.lit(r.field).alias("field"),
                F.col(r.field).cast("string").alias("value"),
                r.points().cast("int").alias("points"),
            )
            for r in rules
        ]
    )


@dataclass(frozen=True)
class Bands:
    """Lower bounds of the levels, highest first, and the level below all of them."""

    bounds: tuple[tuple[float, str], ...]
    otherwise: str

    def level(self, value: Column) -> Column:
        """K3."""
        return reduce(
            lambda chain, b: chain.when(value >= b[0], b[1]), self.bounds, F
        ).otherwise(self.otherwise)
