"""Number parsing and result normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlens.functions.text import READER_MISSING, WHITESPACE

# What counts as a numeric literal. The guard is needed because Spark's own
# string-to-double cast also takes "1d", "NaN" and "Infinity".
NUMERIC_LITERAL = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def numeric_literal(c: Column) -> Column:
    """Drop outer white space and commas; anything but a numeric literal is empty."""
    bare = F.regexp_replace(c, f"^{WHITESPACE}+|{WHITESPACE}+$|,", "")
    return F.regexp_extract(bare, NUMERIC_LITERAL, 0)


def parse_number(c: Column) -> Column:
    """A numeric literal as double; anything else is null."""
    return numeric_literal(c).try_cast("double")


def whole_literal(literal: Column, type_name: str = "bigint") -> Column:
    """A numeric literal as integer; fractions and values out of range are null.

    Plain digits are read as they are, to the last one; an exponent takes the way through
    double.
    """
    number = literal.try_cast("double")
    digits = F.regexp_extract(literal, r"^([+-]?\d+)\.?0*$", 1)
    return F.when(digits != "", digits.try_cast(type_name)).when(
        number % 1 == 0, number.try_cast(type_name)
    )


def to_int(c: Column, type_name: str = "int") -> Column:
    """C7 in one expression. Over many rows use ``whole_literal`` on a column that already
    holds ``numeric_literal``: one expression searches the string several times.
    """
    return whole_literal(numeric_literal(c), type_name)


def to_money(c: Column) -> Column:
    """Delete everything but digits, point and minus, then parse.

    So ``(12.30)`` reads as 12.30, ``1e5`` as 15 and ``1-2`` as null.
    """
    value = F.regexp_replace(c, r"[^0-9.\-]", "").try_cast("double")
    return F.when(~c.isin(*READER_MISSING), value)


def finite(c: Column) -> Column:
    """C10, first half: NaN and infinities to null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
