"""Composed reports over the discharge table: overview and risk profile."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators import aggregate as A
from cohortlens.operators import scoring as S
from cohortlens.operators.exact import Measure
from cohortlens.presets import discharge
from cohortlens.presets import fixed_values as fv


@dataclass(frozen=True)
class Overview:
    figures: DataFrame
    distributions: DataFrame
    top_diseases: DataFrame


def overview_figures(df: DataFrame, rounded: bool = True) -> DataFrame:
    """The eight figures of the overview in one row."""
    charges, costs = F.col("total_charges"), F.col("total_costs")
    emergency = F.col("emergency_department_indicator") == "Y"
    figures = A.indicators(
        df,
        discharge_count=Measure("count"),
        avg_length_of_stay=Measure("avg", F.col("length_of_stay")),
        avg_total_charges=Measure("exact_avg", charges),
        avg_total_costs=Measure("exact_avg", costs),
        sum_total_charges=Measure("exact_sum", charges),
        sum_total_costs=Measure("exact_sum", costs),
        avg_severity_of_illness=Measure("avg", F.col("apr_severity_of_illness_code")),
        emergency_rate_pct=Measure("avg", F.when(emergency, 100).otherwise(0)),
    )
    if not rounded:
        return figures
    count, *rest = figures.columns
    return figures.select(count, *[F.round(c, 2).alias(c) for c in rest])


def top_diseases(df: DataFrame, n: int = 10, rounded: bool = True) -> DataFrame:
    """The most frequent diseases with their mean charges."""
    mean = Measure("exact_avg", F.col("total_charges"))
    top = A.top_groups(df, ["ccsr_diagnosis_description"], n, "discharge_count", avg_total_charges=mean)
    return top.withColumn("avg_total_charges", F.round("avg_total_charges", 2)) if rounded else top


def overview(df: DataFrame, n: int = 10) -> Overview:
    """Figures, value distributions and top diseases: three scans of few columns each."""
    return Overview(
        overview_figures(df),
        A.value_distribution(df, fv.OVERVIEW_FIELDS, n),
        top_diseases(df, n),
    )


@dataclass(frozen=True)
class RiskProfile:
    levels: DataFrame
    by_age_and_admission: DataFrame
    high_risk_age_groups: DataFrame


def risk_profile(df: DataFrame) -> RiskProfile:
    """Level shares, mean score by age and admission, and where the high risks are."""
    scored = S.score_rows(df, discharge.RISK_RULES, discharge.RISK_BANDS)
    return RiskProfile(
        S.level_distribution(scored),
        S.score_profile(scored, ["age_group", "type_of_admission"]),
        S.largest_groups_at_level(scored, ["age_group"]),
    )
