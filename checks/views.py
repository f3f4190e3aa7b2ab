"""Inputs of the registered queries, derived from the whole shipped tables.

A view is a list of column expressions in the SQL that Spark and the checking engine share,
so both sides start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens import Dimension, Metric, SemanticModel
from cohortlens.functions.text import normalise_name
from cohortlens.presets import discharge

NBSP = chr(0xA0)
WIDE_BLANK = chr(0x3000)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(
    spark: SparkSession, sf_dir: str, name: str, columns: dict[str, str], where: str = "true"
) -> DataFrame:
    rows = table(spark, sf_dir, name).filter(where)
    return rows.select(*[F.expr(spark_sql(e)).alias(c) for c, e in columns.items()])


def derive_sql(name: str, columns: dict[str, str]) -> str:
    parts = [f'{duck_sql(e)} AS "{c}"' for c, e in columns.items()]
    return f"SELECT {', '.join(parts)} FROM {name}"


# How each dialect writes the price with thousands separators.
MONEY = "MONEY(l_extendedprice)"


def spark_sql(expression: str) -> str:
    return expression.replace(MONEY, "format_number(l_extendedprice, 2)")


def duck_sql(expression: str) -> str:
    return expression.replace(MONEY, "format('{:,.2f}', l_extendedprice)")


_LEVEL = (
    "CASE WHEN {c} < {a} THEN 'Minor' WHEN {c} < {b} THEN 'Moderate' "
    "WHEN {c} < {d} THEN 'Major' WHEN {c} < {e} THEN 'Extreme' ELSE 'Unknown' END"
)

# The discharge table as a view of lineitem: 33 columns by their normalised names.
DISCHARGES = {
    "hospital_service_area": "concat('Area ', l_returnflag)",
    "hospital_county": "concat('County ', CAST(month(l_shipdate) AS STRING))",
    "operating_certificate_number": "concat('0', CAST(l_suppkey AS STRING))",
    "permanent_facility_id": "concat('00', CAST(l_suppkey AS STRING))",
    "facility_name": "concat('Facility ', CAST(l_suppkey AS STRING))",
    "age_group": (
        "CASE WHEN l_quantity <= 10 THEN '0 to 17' WHEN l_quantity <= 20 THEN '18 to 29' "
        "WHEN l_quantity <= 30 THEN '30 to 49' WHEN l_quantity <= 40 THEN '50 to 69' "
        "ELSE '70 or Older' END"
    ),
    "zip_code_3_digits": "CASE WHEN l_tax < 0.01 THEN 'OOS' ELSE '104' END",
    "gender": (
        "CASE WHEN l_linenumber = 7 THEN 'Unknown' WHEN l_linestatus = 'O' THEN 'Male' "
        "ELSE 'Female' END"
    ),
    "race": "CASE WHEN l_tax < 0.045 THEN 'White' ELSE 'Other Race' END",
    "ethnicity": "CASE WHEN l_discount < 0.055 THEN 'Not Span/Hispanic' ELSE 'Unknown' END",
    "length_of_stay": "CAST(l_quantity AS INT)",
    "type_of_admission": (
        "CASE l_linenumber WHEN 1 THEN 'Emergency' WHEN 2 THEN 'Emergency' "
        "WHEN 3 THEN 'Elective' WHEN 4 THEN 'Urgent' WHEN 5 THEN 'Newborn' "
        "WHEN 6 THEN 'Trauma' ELSE 'Not Available' END"
    ),
    "patient_disposition": (
        "CASE l_returnflag WHEN 'A' THEN 'Home or Self Care' WHEN 'N' THEN 'Expired' END"
    ),
    "discharge_year": "CAST(year(l_shipdate) AS INT)",
    "ccsr_diagnosis_code": "concat('DX', CAST(l_linenumber AS STRING), l_linestatus)",
    "ccsr_diagnosis_description": (
        "concat('Disease ', CAST(l_linenumber AS STRING), l_linestatus)"
    ),
    "ccsr_procedure_code": "concat('PX', CAST(CAST(round(l_discount * 100) AS INT) AS STRING))",
    "ccsr_procedure_description": (
        "CASE WHEN l_discount < 0.005 THEN 'Unknown' ELSE "
        "concat('Procedure ', CAST(CAST(round(l_discount * 100) AS INT) AS STRING)) END"
    ),
    "apr_drg_code": "concat('0', CAST(l_linenumber AS STRING))",
    "apr_drg_description": "concat('DRG ', CAST(l_linenumber AS STRING))",
    "apr_mdc_code": "concat('0', l_linestatus)",
    "apr_mdc_description": "concat('MDC ', l_linestatus)",
    "apr_severity_of_illness_code": (
        "CASE WHEN l_tax < 0.015 THEN 1 WHEN l_tax < 0.035 THEN 2 WHEN l_tax < 0.055 THEN 3 "
        "WHEN l_tax < 0.075 THEN 4 END"
    ),
    "apr_severity_of_illness_description": _LEVEL.format(
        c="l_tax", a=0.015, b=0.035, d=0.055, e=0.075
    ),
    "apr_risk_of_mortality": _LEVEL.format(
        c="l_discount", a=0.025, b=0.055, d=0.085, e=0.095
    ),
    "apr_medical_surgical_description": (
        "CASE WHEN l_linestatus = 'O' THEN 'Medical' ELSE 'Surgical' END"
    ),
    "payment_typology_1": (
        "CASE WHEN l_returnflag = 'A' THEN 'Medicare' WHEN l_returnflag = 'N' THEN 'Medicaid' "
        "WHEN l_tax < 0.035 THEN 'Private Health Insurance' ELSE 'Self-Pay' END"
    ),
    "payment_typology_2": "CASE WHEN l_tax < 0.025 THEN 'Medicaid' ELSE 'Unknown' END",
    "payment_typology_3": "'Unknown'",
    "birth_weight": "CASE WHEN l_linenumber = 5 THEN CAST(2000 + l_quantity * 30 AS INT) END",
    "emergency_department_indicator": (
        "CASE WHEN l_linenumber <= 2 THEN 'Y' WHEN l_linenumber <= 6 THEN 'N' END"
    ),
    "total_charges": "l_extendedprice",
    "total_costs": "CAST(floor(l_extendedprice * 0.4) AS DOUBLE)",
}
ROW_KEY = {
    "order_key": "l_orderkey", "line": "l_linenumber", "part_key": "l_partkey",
    "supp_key": "l_suppkey",
}
KEY = tuple(ROW_KEY)

DISCHARGES_SQL = derive_sql("lineitem", ROW_KEY | DISCHARGES)
WITH_D = f"WITH d AS ({DISCHARGES_SQL})"


def discharges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, "lineitem", ROW_KEY | DISCHARGES)


def _dirty(clean: str) -> str:
    """Padding, odd blanks, placeholders and nulls around a clean value."""
    return (
        f"CASE WHEN l_linenumber = 1 THEN concat('  ', {clean}, '{NBSP}') "
        f"WHEN l_linenumber = 2 THEN replace({clean}, ' ', '{WIDE_BLANK} {NBSP}') "
        "WHEN l_linenumber = 3 AND l_returnflag = 'R' THEN '' "
        "WHEN l_linenumber = 4 AND l_returnflag = 'R' THEN 'NaN' "
        "WHEN l_linenumber = 5 AND l_returnflag = 'R' THEN NULL "
        "WHEN l_linenumber = 6 AND l_returnflag = 'R' THEN ' n/a ' "
        f"ELSE {clean} END"
    )


def _dirty_int(clean: str) -> str:
    return (
        f"CASE WHEN l_linenumber = 1 THEN concat(' 0', CAST({clean} AS STRING), ' ') "
        f"WHEN l_linenumber = 2 THEN concat(CAST({clean} AS STRING), '.0') "
        f"WHEN l_linenumber = 3 THEN concat('1,', CAST({clean} AS STRING)) "
        f"WHEN l_linenumber = 4 AND l_returnflag = 'R' THEN concat(CAST({clean} AS STRING), '.5') "
        "WHEN l_linenumber = 5 AND l_returnflag = 'R' THEN '1d' "
        "WHEN l_linenumber = 6 AND l_returnflag = 'R' THEN 'inf' "
        "WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN NULL "
        f"ELSE CAST({clean} AS STRING) END"
    )


_DIRTY_MONEY = (
    f"CASE WHEN l_linenumber = 1 THEN concat('$', {MONEY}) "
    f"WHEN l_linenumber = 2 THEN concat('(', {MONEY}, ')') "
    f"WHEN l_linenumber = 3 THEN concat('-', {MONEY}, ' USD') "
    "WHEN l_linenumber = 4 AND l_returnflag = 'R' THEN '1-2' "
    "WHEN l_linenumber = 5 AND l_returnflag = 'R' THEN 'USD' "
    "WHEN l_linenumber = 6 AND l_returnflag = 'R' THEN '1e5' "
    "WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN NULL "
    f"ELSE {MONEY} END"
)
_DIRTY_GENDER = (
    "CASE WHEN l_linenumber = 1 THEN ' m ' WHEN l_linenumber = 2 THEN 'FEMALE' "
    f"WHEN l_linenumber = 3 THEN '{NBSP}F' WHEN l_linenumber = 4 THEN 'u' "
    "WHEN l_linenumber = 5 THEN 'x' WHEN l_linenumber = 6 THEN NULL ELSE 'Male' END"
)
_DIRTY_FLAG = (
    "CASE WHEN l_linenumber = 1 THEN ' y ' WHEN l_linenumber = 2 THEN 'N' "
    f"WHEN l_linenumber = 3 THEN 'n{WIDE_BLANK}' WHEN l_linenumber = 4 THEN 'yes' "
    "WHEN l_linenumber = 5 THEN '' WHEN l_linenumber = 6 THEN NULL ELSE 'Y' END"
)


def _raw(column: str) -> str:
    if column == "gender":
        return _DIRTY_GENDER
    if column == "emergency_department_indicator":
        return _DIRTY_FLAG
    if column in discharge.CLEANING.ints:
        return _dirty_int("CAST(l_quantity AS INT)")
    if column in discharge.CLEANING.money:
        return _DIRTY_MONEY
    return _dirty(DISCHARGES[column])


# The same table before cleaning: raw names, all strings, with the usual dirt.
RAW_DISCHARGES = {
    raw: _raw(normalise_name(raw)) for raw in discharge.fv.RAW_COLUMNS
}
RAW_SQL = derive_sql("lineitem", RAW_DISCHARGES)


def raw_discharges(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    return derive(spark, sf_dir, "lineitem", RAW_DISCHARGES, where)


# The star schema as one flat table.
SALES_MODEL = SemanticModel(
    dimensions=(
        Dimension("return_flag", "l_returnflag"),
        Dimension("line_status", "l_linestatus"),
        Dimension("order_status", "o_orderstatus"),
        Dimension("priority", "o_orderpriority"),
        Dimension("segment", "c_mktsegment"),
        Dimension("nation", "n_name"),
        Dimension("region", "r_name"),
        Dimension("brand", "p_brand"),
        Dimension("part_type", "p_type"),
        Dimension("part_size", "p_size", "integer"),
    ),
    metrics=(
        Metric("line_count", "count", decimals=0),
        Metric("avg_quantity", "avg", "l_quantity", 1),
        Metric("max_quantity", "max", "l_quantity", 0),
        Metric("avg_price", "avg", "l_extendedprice", exact=True),
        Metric("sum_price", "sum", "l_extendedprice", exact=True),
    ),
    filter_columns=(("l_quantity", "double"), ("l_extendedprice", "double")),
)
_JOINS = (
    ("orders", "l_orderkey", "o_orderkey"),
    ("customer", "o_custkey", "c_custkey"),
    ("nation", "c_nationkey", "n_nationkey"),
    ("region", "n_regionkey", "r_regionkey"),
    ("part", "l_partkey", "p_partkey"),
)


def sales(spark: SparkSession, sf_dir: str, *tables: str) -> DataFrame:
    """lineitem with the named tables joined on; how to join is left to the optimizer."""
    flat = table(spark, sf_dir, "lineitem")
    for name, left, right in _JOINS:
        if name in tables:
            other = table(spark, sf_dir, name)
            flat = flat.join(other, flat[left] == other[right])
    return flat


def sales_sql(*tables: str) -> str:
    joins = [f"JOIN {n} ON {a} = {b}" for n, a, b in _JOINS if n in tables]
    return " ".join(["FROM lineitem", *joins])


# Short questions built from orders.
QUESTIONS = {
    "o_orderkey": "o_orderkey",
    "question": (
        "concat(CAST(year(o_orderdate) AS STRING), '年', CASE o_orderpriority "
        "WHEN '1-URGENT' THEN '急诊入院' WHEN '2-HIGH' THEN '老年人和儿童' "
        "WHEN '3-MEDIUM' THEN 'Medicare 男性' WHEN '4-NOT SPECIFIED' THEN '外科 critical' "
        "ELSE '新生儿的平均费用和人数' END, CASE o_orderstatus WHEN 'F' THEN ' 前 12 ' "
        "WHEN 'O' THEN ' top5 ' ELSE ' 30 天' END)"
    ),
}
QUESTIONS_SQL = derive_sql("orders", QUESTIONS)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, "orders", QUESTIONS)


def values_sql(rows: list[tuple]) -> str:
    def one(v) -> str:
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

    return ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows)
