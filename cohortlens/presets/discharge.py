"""Specs for the 33-column hospital discharge table."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from cohortlens.functions.scoring import Bands, ExcludeRule, MapRule, ThresholdRule
from cohortlens.functions.text import normalise_name
from cohortlens.model import Dimension, Metric, SemanticModel
from cohortlens.operators.cleaning import CleaningSpec
from cohortlens.operators.regression import RegressionSpec
from cohortlens.presets import fixed_values as fv

CLEANING = CleaningSpec(
    text=fv.TEXT_COLUMNS,
    code=fv.CODE_COLUMNS,
    category=fv.PAYMENT_COLUMNS,
    ints=fv.INT_COLUMNS,
    int_types={c: "int" for c in fv.INT_COLUMNS},
    money=fv.MONEY_COLUMNS,
    maps={"gender": fv.GENDER_MAP},
    domains={"emergency_department_indicator": fv.YES_NO},
)


def _type(name: str):
    if name in fv.INT_COLUMNS:
        return IntegerType()
    return DoubleType() if name in fv.MONEY_COLUMNS else StringType()


COLUMNS = tuple(normalise_name(c) for c in fv.RAW_COLUMNS)
SCHEMA = StructType([StructField(c, _type(c), True) for c in COLUMNS])

# The ten columns that are no dimensions: identifiers and measures.
_NOT_GROUPED = {
    "operating_certificate_number", "permanent_facility_id", "ccsr_procedure_code",
    "apr_drg_code", "apr_mdc_code", "length_of_stay", "apr_severity_of_illness_code",
    "birth_weight", "total_charges", "total_costs",
}

MODEL = SemanticModel(
    dimensions=tuple(
        Dimension(c, value_type="integer" if c in fv.INT_COLUMNS else "string")
        for c in COLUMNS
        if c not in _NOT_GROUPED
    ),
    metrics=tuple(
        Metric(key, agg, column, decimals, unit, column in fv.MONEY_COLUMNS)
        for key, agg, column, decimals, unit in fv.METRICS
    ),
    filter_columns=(
        ("length_of_stay", "integer"),
        ("total_charges", "double"),
        ("total_costs", "double"),
        ("birth_weight", "integer"),
        ("apr_severity_of_illness_code", "integer"),
    ),
)

RISK_RULES = (
    MapRule("advanced age", "age_group", fv.AGE_POINTS),
    MapRule("emergency admission", "type_of_admission", fv.ADMISSION_POINTS),
    MapRule("severe illness", "apr_severity_of_illness_description", fv.SEVERITY_POINTS),
    MapRule("high mortality risk", "apr_risk_of_mortality", fv.MORTALITY_POINTS),
    ThresholdRule("long stay", "length_of_stay", fv.LONG_STAY_DAYS, fv.LONG_STAY_POINTS),
    ExcludeRule(
        "not discharged home", "patient_disposition", fv.HOME_DISPOSITIONS, fv.NOT_HOME_POINTS
    ),
)
RISK_BANDS = Bands(((fv.HIGH_FROM, "High"), (fv.MEDIUM_FROM, "Medium")), "Low")

COST_MODEL = RegressionSpec(
    label="total_charges",
    numeric=("length_of_stay", "apr_severity_of_illness_code"),
    categorical=(
        "age_group", "type_of_admission", "payment_typology_1",
        "apr_medical_surgical_description",
    ),
)
