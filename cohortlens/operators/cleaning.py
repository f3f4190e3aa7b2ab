"""Cleaning of whole tables by column group."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.numbers import numeric_literal, to_money, whole_literal
from cohortlens.functions.text import (
    PLACEHOLDERS,
    READER_MISSING,
    UNKNOWN,
    clean_text,
    map_values,
    normalise_name,
    restrict_domain,
)


@dataclass(frozen=True)
class CleaningSpec:
    """Which rule cleans which column (by its normalised name)."""

    text: tuple[str, ...] = ()
    code: tuple[str, ...] = ()
    category: tuple[str, ...] = ()
    ints: tuple[str, ...] = ()
    int_types: Mapping[str, str] = field(default_factory=dict)  # default: bigint
    money: tuple[str, ...] = ()
    maps: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    domains: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    unknown: str = UNKNOWN
    placeholders: tuple[str, ...] = PLACEHOLDERS + READER_MISSING

    @property
    def marked(self) -> tuple[str, ...]:
        """Columns whose missing values carry the ``unknown`` marker and are profiled."""
        return self.text + self.code + self.category

    @property
    def nullable(self) -> tuple[str, ...]:
        return self.ints + self.money

    def rule(self, name: str) -> Column:
        """A special column: maps and domains come before any group; others pass through."""
        c = _col(name)
        if name in self.maps:
            return map_values(c, self.maps[name], self.unknown)
        if name in self.domains:
            return restrict_domain(c, self.domains[name], self.unknown)
        return c


def normalise_columns(df: DataFrame) -> DataFrame:
    """snake_case names; two columns that would get the same name are an error."""
    names = [normalise_name(c) for c in df.columns]
    twice = [n for n, k in Counter(names).items() if k > 1]
    if twice:
        raise ValueError(f"column names collide after normalisation: {twice}")
    return df.toDF(*names)


# Columns cleaned as one array. An array is computed as a whole, so a reader of one column
# pays for its few neighbours and not for the group.
_TOGETHER = 4


def clean_table(
    df: DataFrame, spec: CleaningSpec, columns: Sequence[str] | None = None
) -> DataFrame:
    """Clean the columns that are present, or only ``columns`` (normalised names).

    One expression per column would give a generated method far beyond the size that the
    JVM compiles, and the whole scan would run in its interpreter. So the columns of a group
    pass through array expressions, a few columns each, however many a group has. Arrays that
    no reader asks for are pruned, with the columns behind them.
    """
    named = normalise_columns(df)
    if columns is not None:
        named = named.select(*columns)
    special = set(spec.maps) | set(spec.domains)
    place: dict[str, Column] = {}
    arrays: dict[str, Column] = {}
    steps = {
        "text": (spec.marked, lambda c: clean_text(c, spec.unknown, spec.placeholders)),
        "ints": (spec.ints, numeric_literal),
        "money": (spec.money, to_money),
    }
    for group, (members, rule) in steps.items():
        present = [c for c in named.columns if c in members and c not in special]
        for k in range(0, len(present), _TOGETHER):
            some = present[k : k + _TOGETHER]
            name = f"__{group}_{k}"
            arrays[name] = F.transform(F.array(*[_col(c) for c in some]), rule)
            place |= {c: F.col(name)[i] for i, c in enumerate(some)}
    grouped = named.withColumns(arrays)
    flat = grouped.select(*[place.get(c, spec.rule(c)).alias(c) for c in named.columns])
    # Integers take a second step, so that each string is searched once.
    whole = {
        c: whole_literal(_col(c), spec.int_types.get(c, "bigint"))
        for c in spec.ints
        if c in flat.columns and c not in special
    }
    return flat.withColumns(whole)


def _col(name: str) -> Column:
    return F.col(f"`{name}`")
