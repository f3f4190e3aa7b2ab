"""Sums and means of doubles that drop no digit and do not depend on the order.

A finite double is a whole number of at most 53 bits times a power of two. Each value is counted in
a band of ``BAND`` bits of that power, and inside the band its whole number is split into ``LIMBS``
signed limbs of ``BITS`` bits, which add up as 64-bit integers in any order: up to 2**40 values
per group before an addition would overflow, which Spark reports as an error. Rows are grouped by
the keys and the bands of their values with map-side combine; ordinary amounts (4e-6 to 1.7e13,
and zero) share one band, so this group count is that of the keys. The bands of a group then
meet in one row, carries are settled, and the total is rounded to a double once, to nearest.

Defined results: nulls do not count; no value gives null; any NaN, or infinities of both signs,
give NaN; one infinity gives itself; a total beyond the doubles is infinite.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 23
LIMBS = 6
BAND = 3 * BITS
UNIT = 72  # band 0 counts in units of 2**-UNIT
ORDINARY = (2.0**-18, 2.0**44)  # absolute values that lie in band 0 whole
KINDS = frozenset({"count", "max", "sum", "avg", "exact_sum", "exact_avg"})
CARRY = 3  # places above the highest limb, for what 64-bit sums carry


@dataclass(frozen=True)
class Measure:
    """``sum`` and ``avg`` are Spark's own, for whole numbers and flags; ``count`` counts rows."""

    kind: str
    value: Column | str | None = None  # a column or its name

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown measure: {self.kind!r}")
        if self.kind != "count" and self.value is None:
            raise ValueError(f"{self.kind} needs a value")

    def column(self) -> Column:
        return F.col(self.value) if isinstance(self.value, str) else self.value


def _power(k: Column) -> tuple[Column, Column]:
    """2**k as two factors, as either end of the doubles is within reach of one only."""
    half = F.floor(k / 2)
    return F.pow(F.lit(2.0), half), F.pow(F.lit(2.0), k - half)


def _band(x: Column) -> Column:
    """The band of a finite value; log2 may be off by its rounding, which the limbs allow for."""
    size = F.abs(x)
    low, high = ORDINARY
    other = F.floor((F.floor(F.log2(size)) - 53 + UNIT) / BAND)
    return F.when((size == 0) | size.between(low, high), 0).otherwise(other).cast("int")


def _whole(x: Column, band: Column) -> Column:
    """The value in units of its band: a whole number, exact."""
    one, two = _power(UNIT - BAND * band)
    return F.when(band == 0, x * 2.0**UNIT).otherwise(x * one * two)


def _limb(y: Column, k: int) -> Column:
    """Rounding at both ends makes limbs signed; their sum is ``y``."""
    upper = F.rint(y / 2.0 ** (BITS * (k + 1))) * 2.0**BITS
    own = F.rint(y / 2.0 ** (BITS * k))
    return (own if k == LIMBS - 1 else own - upper).cast("long")


def _settled(digits: Column) -> Column:
    """Digits of 0 to 2**BITS - 1, least first; only the last may be negative."""
    base = 1 << BITS
    empty = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<long>").alias("done"))

    def step(state: Column, digit: Column) -> Column:
        total = state["carry"] + digit
        rest = F.pmod(total, F.lit(base).cast("long"))
        carry = F.shiftright(total - rest, BITS)
        return F.struct(carry.alias("carry"), F.concat(state["done"], F.array(rest)).alias("done"))

    return F.aggregate(digits, empty, step)


def _total(df: DataFrame, name: str) -> DataFrame:
    """Column ``name`` from its limbs per band: array of (band, limbs)."""
    bands, low, digits, at, done = (f"_{name}_{c}" for c in ("bands", "low", "digits", "at", "done"))
    long = F.lit(0).cast("long")
    high = F.aggregate(bands, F.lit(-100), lambda a, e: F.greatest(a, e["band"]))
    df = df.withColumn(low, F.aggregate(bands, F.lit(100), lambda a, e: F.least(a, e["band"])))
    place = F.sequence(F.lit(0), (high - F.col(low)) * 3 + (LIMBS - 1 + CARRY))

    def digit(p: Column) -> Column:
        def add(a: Column, e: Column) -> Column:
            return a + F.coalesce(F.get(e["limbs"], p - 3 * (e["band"] - F.col(low))), long)

        return F.aggregate(bands, long, add)

    df = df.withColumn(digits, F.when(F.size(bands) > 0, F.transform(place, digit)))
    df = df.withColumn(done, _settled(F.col(digits)))
    negative = F.col(done)["carry"] < 0
    positive = F.when(negative, _settled(F.transform(digits, lambda d: -d))).otherwise(F.col(done))
    df = df.withColumn("_sign", F.when(negative, -1.0).otherwise(1.0)).withColumn(done, positive["done"])
    # The highest digit that is not zero; below the four highest only "some bit" matters.
    top = F.aggregate(
        F.transform(done, lambda d, i: F.when(d != 0, i).otherwise(-1)), F.lit(-1), lambda a, i: F.greatest(a, i)
    )
    df = df.withColumn(at, top)

    def d(k: int) -> Column:
        return F.coalesce(F.get(done, F.col(at) - k), long)

    rest = F.exists(F.slice(F.col(done), 1, F.greatest(F.col(at) - 3, F.lit(0))), lambda x: x != 0)
    upper = (d(0) * (1 << BITS) + d(1)).cast("double") * 2.0 ** (2 * BITS + 1)
    lower = ((d(2) * (1 << BITS) + d(3)) * 2 + rest.cast("long")).cast("double")
    one, two = _power((F.col(at) - 3) * BITS - 1 + BAND * F.col(low) - UNIT)
    value = F.when(F.col(at) < 0, 0.0).otherwise(F.col("_sign") * (upper + lower) * one * two)
    special = F.col(f"_{name}_special")
    value = F.when(F.col(f"_{name}_n") == 0, None).when(F.isnan(special) | (special != 0), special).otherwise(value)
    return df.withColumn(name, value).drop(bands, low, digits, at, done, "_sign", f"_{name}_special")


def measure(df: DataFrame, keys: Sequence[str], measures: Mapping[str, Measure]) -> DataFrame:
    """One row per group (one row without keys) with the measures, in one scan and two groupings.

    The second grouping sees one row per group and band of each exact input.
    """
    # Each distinct value is split once, however many measures it has.
    inputs: dict[str, str] = {}
    columns: dict[str, Column] = {}
    origin: dict[str, str] = {}
    for name, m in measures.items():
        if m.kind.startswith("exact"):
            x = inputs.setdefault(str(m.column()), f"_x{len(inputs)}")
            origin[name], columns[x] = x, m.column().cast("double")
    plain = {n: m for n, m in measures.items() if n not in origin}
    base = df.select(
        *keys,
        *[c.alias(x) for x, c in columns.items()],
        *[m.column().alias(f"_p_{n}") for n, m in plain.items() if m.value is not None],
    )
    names = list(columns)

    def finite(x: str) -> Column:
        c = F.col(x)
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)

    base = base.withColumns({f"{x}_band": F.coalesce(_band(finite(x)), F.lit(0)) for x in names})
    base = base.withColumns({f"{x}_y": _whole(finite(x), F.col(f"{x}_band")) for x in names})
    parts = []
    for x in names:
        parts += [F.coalesce(F.sum(_limb(F.col(f"{x}_y"), k)), F.lit(0).cast("long")).alias(f"{x}_{k}") for k in range(LIMBS)]
        odd = F.isnan(x) | (F.abs(x) == float("inf"))
        parts += [F.count(x).alias(f"{x}_n"), F.sum(F.when(odd, F.col(x)).otherwise(0.0)).alias(f"{x}_special")]
    for n, m in plain.items():
        c = F.col(f"_p_{n}")
        if m.kind == "count":
            parts.append(F.count(F.lit(1)).alias(n))
        elif m.kind == "max":
            parts.append(F.max(c).alias(n))
        else:
            parts += [F.sum(c).alias(n), F.count(c).alias(f"_n_{n}")]
    if not parts:
        raise ValueError("need at least one measure")
    by_band = base.groupBy(*keys, *[f"{x}_band" for x in names]).agg(*parts)

    merged = []
    for x in names:
        limbs = F.array(*[F.col(f"{x}_{k}") for k in range(LIMBS)])
        merged += [
            F.collect_list(F.struct(F.col(f"{x}_band").alias("band"), limbs.alias("limbs"))).alias(f"_{x}_bands"),
            F.coalesce(F.sum(f"{x}_n"), F.lit(0).cast("long")).alias(f"_{x}_n"),
            F.sum(f"{x}_special").alias(f"_{x}_special"),
        ]
    for n, m in plain.items():
        if m.kind == "max":
            merged.append(F.max(n).alias(n))
        elif m.kind == "count":
            merged.append(F.coalesce(F.sum(n), F.lit(0).cast("long")).alias(n))
        else:
            merged += [F.sum(n).alias(n), F.sum(f"_n_{n}").alias(f"_n_{n}")]
    out = by_band.groupBy(*keys).agg(*merged)
    for x in names:
        out = _total(out, x)

    def final(n: str, m: Measure) -> Column:
        if n in origin:
            x = origin[n]
            value = F.col(x) if m.kind == "exact_sum" else F.col(x) / F.nullif(F.col(f"_{x}_n"), F.lit(0))
        else:
            value = F.col(n) / F.nullif(F.col(f"_n_{n}"), F.lit(0)) if m.kind == "avg" else F.col(n)
        return value.alias(n)

    return out.select(*keys, *[final(n, m) for n, m in measures.items()])
