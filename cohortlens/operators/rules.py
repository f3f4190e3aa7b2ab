"""Association rules between two columns."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.filters import known


MAX_FREQUENT = 100_000  # values of a column that pruning may broadcast


def pair_counts(df: DataFrame, a: str, b: str, unknown: str = "Unknown") -> DataFrame:
    """How often each pair of known values occurs."""
    base = known(df, a, b, unknown=unknown).select(a, b)
    return base.groupBy(a, b).agg(F.count(F.lit(1)).alias("n_ab"))


def frequent_values(
    base: DataFrame, column: str, count: str, total: Column, min_support: float
) -> DataFrame:
    """The values of ``column`` that fill at least ``min_support`` of ``total`` rows, counted."""
    counts = base.groupBy(column).agg(F.count(F.lit(1)).alias(count))
    return counts.filter(F.col(count) / total >= min_support)


def association_rules(
    df: DataFrame,
    antecedent: str,
    consequent: str,
    min_support: float = 0.005,
    top_n: int | None = 20,
    unknown: str = "Unknown",
    rounded: bool = True,
    fields: Collection[str] | None = None,
    prune: bool = False,
) -> DataFrame:
    """Rules A -> B with support, confidence and lift, strongest support first.

    ``fields`` are the columns that rules may be asked for; others are refused.

    Everything derives from the pair counts, so the base table is scanned once. The support
    filter needs only the total and runs before the joins: at most 1/min_support pairs pass
    it. The counts per value are aggregates with
    map-side combine, so a value that fills a third of the rows is no burden to one task.

    ``prune`` is for columns of very many values: the values are counted first, two more scans of
    a column each, and only rows whose two values both reach the support enter the pair count.
    The rules are the same. The values that reach it are at most 1/min_support a column, so they
    are broadcast up to ``MAX_FREQUENT``; a lower support is not pruned.
    """
    if antecedent == consequent:
        raise ValueError("antecedent and consequent must differ")
    refused = [c for c in (antecedent, consequent) if fields is not None and c not in fields]
    if refused:
        raise ValueError(f"no rules over {refused}; allowed: {sorted(fields)}")
    if not 0 < min_support <= 1:
        raise ValueError(f"min_support must be in (0, 1], got {min_support}")
    if prune and min_support * MAX_FREQUENT >= 1:
        base = known(df, antecedent, consequent, unknown=unknown).select(antecedent, consequent)
        total = base.agg(F.count(F.lit(1)).alias("n")).scalar()
        n_a = frequent_values(base, antecedent, "n_a", total, min_support)
        n_b = frequent_values(base, consequent, "n_b", total, min_support)
        both = base.join(F.broadcast(n_a.select(antecedent)), antecedent, "left_semi")
        both = both.join(F.broadcast(n_b.select(consequent)), consequent, "left_semi")
        pairs = pair_counts(both, antecedent, consequent, unknown)
    else:
        pairs = pair_counts(df, antecedent, consequent, unknown)
        n_a = pairs.groupBy(antecedent).agg(F.sum("n_ab").alias("n_a"))
        n_b = pairs.groupBy(consequent).agg(F.sum("n_ab").alias("n_b"))
        total = pairs.agg(F.sum("n_ab").alias("n")).scalar()

    frequent = pairs.withColumn("n", total).withColumn("support", F.col("n_ab") / F.col("n"))
    frequent = frequent.filter(F.col("support") >= min_support)
    # At most 1/min_support rows: adaptive execution sees that and picks the join.
    with_b = n_b.join(n_a.join(frequent, antecedent), consequent)

    confidence = F.col("n_ab") / F.col("n_a")
    lift = confidence / (F.col("n_b") / F.col("n"))

    def shown(c, digits):
        return F.round(c, digits) if rounded else c

    rules = with_b.select(
        antecedent,
        consequent,
        shown(F.col("support"), 6).alias("support"),
        shown(confidence, 4).alias("confidence"),
        shown(lift, 3).alias("lift"),
        "n_ab",
    )
    if top_n is None:
        return rules
    order = [F.desc("support"), F.desc("lift"), F.asc(antecedent), F.asc(consequent)]
    return rules.orderBy(*order).limit(top_n)
