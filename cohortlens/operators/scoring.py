"""Rule-based scores over a whole table (K1-K6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.scoring import Bands, Rule, contributions, score
from cohortlens.operators.aggregate import group_share, top_groups


def score_rows(
    df: DataFrame,
    rules: Sequence[Rule],
    bands: Bands,
    explain: bool = False,
    score_name: str = "risk_score",
    level_name: str = "risk_level",
) -> DataFrame:
    """K1, K3 and on request K2: a projection, no shuffle."""
    scored = df.withColumn(score_name, score(rules))
    scored = scored.withColumn(level_name, bands.level(F.col(score_name)))
    return scored.withColumn("contributions", contributions(rules)) if explain else scored


def level_distribution(scored: DataFrame, level: str = "risk_level") -> DataFrame:
    """K4: rows and share per level."""
    return group_share(scored, level)


def score_profile(
    scored: DataFrame,
    keys: Sequence[str],
    n: int = 50,
    score_name: str = "risk_score",
    decimals: int = 1,
) -> DataFrame:
    """K5: group size and mean score, highest mean (after rounding) first."""
    groups = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.avg(score_name), decimals).alias("avg_score"),
    )
    return groups.orderBy(F.desc("avg_score"), *[F.asc(k) for k in keys]).limit(n)


def largest_groups_at_level(
    scored: DataFrame,
    keys: Sequence[str],
    at: str = "High",
    n: int = 10,
    level: str = "risk_level",
) -> DataFrame:
    """K6: where the rows of one level are."""
    return top_groups(scored.filter(F.col(level) == at), keys, n)
