"""Numbers in generated text against numbers in its source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.labels import let
from cohortlens.functions.text import WHITESPACE
from cohortlens.presets import fixed_values as fv

# A number stands apart from letters, digits and underscores on both sides. Thousands
# groups may carry decimals, and a number does not start after a digit and a point.
NUMBER = (
    r"(?<![A-Za-z0-9_])(?<!\d\.)(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+\.\d+|\d+)"
    rf"{WHITESPACE}*(?:{'|'.join(fv.UNITS)})?(?![A-Za-z0-9_])"
)


NEAR_ZERO = 1e-9
SLACK = 1e-12  # widens an interval by more than the rounding of its ends
FEW = 32  # so many source numbers are tried one after the other


def numbers_in_text(text: Column) -> Column:
    """The numbers as doubles in text order, units applied; years and codes left out."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), 0)

    # One step per array pass, so that each match is parsed once: a lambda has no shared
    # sub-expressions. A match holds nothing but the number, blanks and the unit.
    def parse(match: Column) -> Column:
        factor = reduce(
            lambda chain, unit: chain.when(F.contains(match, F.lit(unit[0])), unit[1]),
            fv.MULTIPLIERS.items(),
            F,
        ).otherwise(1.0)
        digits = F.regexp_replace(match, r"[^0-9.]", "").try_cast("double")
        return F.struct(
            (digits * factor).alias("value"),
            F.contains(match, F.lit(".")).alias("has_point"),
        )

    def counts(n: Column) -> Column:
        year = n["value"].between(fv.FIRST_YEAR, fv.LAST_YEAR) & ~n["has_point"]
        return ~year & (n["value"] < fv.CODE_LIKE_FROM)

    return F.transform(F.filter(F.transform(found, parse), counts), lambda n: n["value"])


def source_numbers(value: Column, data_type: T.DataType) -> Column:
    """Every number in a nested value, with the size of each non-empty container.

    Driven by the type: booleans and strings give nothing, a struct gives its number of
    fields and a list or map its length, since texts often state "n groups".
    """
    leaves = _leaves(value, data_type)
    return F.array().cast("array<double>") if leaves is None else F.array_compact(leaves)


def _leaves(value: Column, data_type: T.DataType) -> Column | None:
    empty = F.array().cast("array<double>")
    if isinstance(data_type, T.NumericType):
        return F.array(value.cast("double"))
    if isinstance(data_type, T.StructType):
        parts = [_leaves(value.getField(f.name), f.dataType) for f in data_type]
        size = F.array(F.lit(float(len(data_type))))
        known = [p for p in parts if p is not None]
        return F.when(value.isNotNull(), F.concat(size, *known)).otherwise(empty)
    if isinstance(data_type, T.MapType):
        return _leaves(F.map_values(value), T.ArrayType(data_type.valueType))
    if isinstance(data_type, T.ArrayType):
        size = F.array(F.size(value).cast("double"))
        if _leaves(F.lit(None), data_type.elementType) is None:
            inner = empty
        else:
            inner = F.flatten(
                F.transform(value, lambda x: _leaves(x, data_type.elementType))
            )
        return F.when(F.size(value) > 0, F.concat(size, inner)).otherwise(empty)
    return None


def numbers_match(a: Column, b: Column, tolerance: float = 0.02) -> Column:
    """Equal; or one is about 0 and they differ by less than 0.5; or close enough."""
    size_a, size_b, gap = F.abs(a), F.abs(b), F.abs(a - b)
    near_zero = F.least(size_a, size_b) < NEAR_ZERO
    return (a == b) | F.when(near_zero, gap < 0.5).otherwise(
        gap / F.greatest(size_a, size_b) <= tolerance
    )


def _rank(ordered: Column, value: Column, with_equal: bool) -> Column:
    """How many numbers of a sorted array lie below ``value`` (or equal it), by bisection."""
    steps = F.transform(
        F.sequence(F.ceil(F.log2(F.size(ordered) + 1)).cast("int"), F.lit(0), F.lit(-1)),
        lambda k: F.call_function("shiftleft", F.lit(1), k),
    )

    def step(at: Column, width: Column) -> Column:
        last = F.get(ordered, at + width - 1)
        below = last <= value if with_equal else last < value
        return F.when(F.coalesce(below, F.lit(False)), at + width).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def _match_between(ordered: Column, low: Column, high: Column, n: Column, tolerance: float) -> Column:
    """Whether one of the numbers from ``low`` to ``high`` matches ``n``."""
    ends = {"a": _rank(ordered, low, False), "b": _rank(ordered, high, True)}
    return let(
        ends,
        lambda e: F.exists(
            F.slice(ordered, e["a"] + 1, F.greatest(e["b"] - e["a"], F.lit(0))),
            lambda s: numbers_match(n, s, tolerance),
        ),
    )


def unmatched_numbers(numbers: Column, source: Column, tolerance: float = 0.02) -> Column:
    """The numbers of the text that have no counterpart in the source.

    The source is sorted once per row. Only numbers around ``n`` and around 0 can match ``n``, so
    two bisections find the few that are compared; a short source is gone through instead, with
    the same result. Nulls on either side say nothing; a null source leaves no number open.
    """
    if not 0 <= tolerance < 1:
        raise ValueError(f"tolerance must be in [0, 1), got {tolerance}")

    def found(ordered: Column, n: Column) -> Column:
        size = F.abs(n)
        near, far = size * (1 - tolerance) * (1 - SLACK), size / (1 - tolerance) * (1 + SLACK)
        about_zero = size < NEAR_ZERO
        low = F.when(about_zero, n - 0.6).when(n < 0, -far).otherwise(near)
        high = F.when(about_zero, n + 0.6).when(n < 0, -near).otherwise(far)
        zero = F.lit(NEAR_ZERO)
        return _match_between(ordered, low, high, n, tolerance) | (
            (size < 0.6) & _match_between(ordered, -zero, zero, n, tolerance)
        )

    def open_numbers(x: Column) -> Column:
        ordered = x["ordered"]
        one_by_one = F.filter(
            numbers, lambda n: ~F.exists(ordered, lambda s: numbers_match(n, s, tolerance))
        )
        searched = F.filter(numbers, lambda n: n.isNotNull() & ~found(ordered, n))
        return F.when(F.size(ordered) > FEW, searched).otherwise(one_by_one)

    return let({"ordered": F.sort_array(F.array_distinct(F.array_compact(source)))}, open_numbers)
