"""F11, R1-R4, J1, J2 and K1-K6."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from checks.views import KEY, WITH_D, discharges, sales, sales_sql, table
from cohortlens.operators import rules as R
from cohortlens.operators import scoring as S
from cohortlens.operators.filters import known
from cohortlens.plans import reports
from cohortlens.presets import discharge
from cohortlens.presets import fixed_values as fv

A, B = "ccsr_diagnosis_description", "ccsr_procedure_description"


def rules_sql(a: str, b: str, source: str, min_support: float, tail: str = "") -> str:
    """Rules from counts taken separately over the base rows."""
    return f"""
    base AS (SELECT {a}, {b} FROM {source} WHERE {a} <> 'Unknown' AND {b} <> 'Unknown'),
    p AS (SELECT {a}, {b}, COUNT(*) AS n_ab FROM base GROUP BY 1, 2),
    ca AS (SELECT {a}, COUNT(*) AS n_a FROM base GROUP BY 1),
    cb AS (SELECT {b}, COUNT(*) AS n_b FROM base GROUP BY 1),
    t AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n FROM base)
    SELECT {a}, {b}, n_ab / n AS support, CAST(n_ab AS DOUBLE) / n_a AS confidence,
        (CAST(n_ab AS DOUBLE) / n_a) / (n_b / n) AS lift, n_ab
    FROM p JOIN ca USING ({a}) JOIN cb USING ({b}), t WHERE n_ab / n >= {min_support} {tail}"""


@check(
    "known_rows",
    f"""{WITH_D} SELECT order_key, line, part_key, supp_key, {B}, patient_disposition FROM d
        WHERE {B} <> 'Unknown' AND patient_disposition <> 'Unknown'""",
)
def known_rows(spark, sf_dir):
    kept = known(discharges(spark, sf_dir), B, "patient_disposition")
    return kept.select(*KEY, B, "patient_disposition")


@check(
    "assoc_pairs",
    f"""{WITH_D} SELECT {A}, {B}, COUNT(*) AS n_ab FROM d
        WHERE {A} <> 'Unknown' AND {B} <> 'Unknown' GROUP BY 1, 2""",
)
def assoc_pairs(spark, sf_dir):
    return R.pair_counts(discharges(spark, sf_dir), A, B)


@check(
    "assoc_rules",
    f"{WITH_D}, "
    + rules_sql(A, B, "d", 0.005, f"ORDER BY support DESC, lift DESC, {A}, {B} LIMIT 20"),
)
def assoc_rules(spark, sf_dir):
    return R.association_rules(discharges(spark, sf_dir), A, B, rounded=False, fields=fv.RULE_FIELDS)


@check(
    "assoc_rules_all",
    "WITH s AS (SELECT p_type, CASE WHEN o_orderpriority = '5-LOW' THEN 'Unknown' "
    f"ELSE o_orderpriority END AS priority {sales_sql('orders', 'part')}), "
    + rules_sql("p_type", "priority", "s", 1e-6),
)
def assoc_rules_all(spark, sf_dir):
    priority = F.when(F.col("o_orderpriority") == "5-LOW", "Unknown").otherwise(
        F.col("o_orderpriority")
    )
    flat = sales(spark, sf_dir, "orders", "part").withColumn("priority", priority)
    return R.association_rules(
        flat, "p_type", "priority", min_support=1e-6, top_n=None, rounded=False
    )


_BUYER = (
    "CASE WHEN o_custkey % 2 = 0 THEN concat('group ', CAST(o_custkey % 7 AS STRING)) "
    "ELSE concat('customer ', CAST(o_custkey AS STRING)) END"
)


@check(
    "assoc_rules_pruned",
    f"WITH s AS (SELECT {_BUYER} AS buyer, o_orderpriority FROM orders), "
    + rules_sql("buyer", "o_orderpriority", "s", 1e-3),
)
def assoc_rules_pruned(spark, sf_dir):
    """Half of the rows have a buyer too rare for a rule."""
    orders = table(spark, sf_dir, "orders").select(F.expr(_BUYER).alias("buyer"), "o_orderpriority")
    return R.association_rules(
        orders, "buyer", "o_orderpriority", 1e-3, top_n=None, rounded=False, prune=True
    )


POINTS = {
    "advanced age": ("age_group", "CASE age_group WHEN '70 or Older' THEN 25 "
                     "WHEN '50 to 69' THEN 10 ELSE 0 END"),
    "emergency admission": ("type_of_admission", "CASE type_of_admission WHEN 'Emergency' "
                            "THEN 20 ELSE 0 END"),
    "severe illness": ("apr_severity_of_illness_description",
                       "CASE apr_severity_of_illness_description WHEN 'Extreme' THEN 25 "
                       "WHEN 'Major' THEN 15 WHEN 'Moderate' THEN 5 ELSE 0 END"),
    "high mortality risk": ("apr_risk_of_mortality", "CASE apr_risk_of_mortality "
                            "WHEN 'Extreme' THEN 15 WHEN 'Major' THEN 10 ELSE 0 END"),
    "long stay": ("length_of_stay", "CASE WHEN length_of_stay >= 10 THEN 10 ELSE 0 END"),
    "not discharged home": ("patient_disposition", "CASE WHEN patient_disposition "
                            "NOT IN ('Home or Self Care') THEN 5 ELSE 0 END"),
}
SCORE = " + ".join(sql for _, sql in POINTS.values())
LEVEL = (
    "CASE WHEN risk_score >= 60 THEN 'High' WHEN risk_score >= 30 THEN 'Medium' "
    "ELSE 'Low' END"
)
WITH_SCORE = (
    f"{WITH_D}, r0 AS (SELECT *, CAST({SCORE} AS INT) AS risk_score FROM d), "
    f"r AS (SELECT *, {LEVEL} AS risk_level FROM r0)"
)


def scored(spark, sf_dir, explain=False):
    return S.score_rows(
        discharges(spark, sf_dir), discharge.RISK_RULES, discharge.RISK_BANDS, explain
    )


@check(
    "risk_score",
    f"{WITH_SCORE} SELECT order_key, line, part_key, supp_key, risk_score, risk_level FROM r",
)
def risk_score(spark, sf_dir):
    return scored(spark, sf_dir).select(*KEY, "risk_score", "risk_level")


@check(
    "risk_contrib",
    f"{WITH_D} "
    + " UNION ALL ".join(
        f"SELECT order_key, line, part_key, supp_key, '{factor}' AS factor, "
        f"'{field}' AS field, CAST({field} AS VARCHAR) AS value, CAST({sql} AS INT) AS points "
        "FROM d"
        for factor, (field, sql) in POINTS.items()
    ),
)
def risk_contrib(spark, sf_dir):
    return scored(spark, sf_dir, explain=True).select(*KEY, F.inline("contributions"))


@check(
    "risk_levels",
    f"""{WITH_SCORE} SELECT risk_level, COUNT(*) AS n_rows,
        ROUND(CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER (), 4) AS ratio
        FROM r GROUP BY 1""",
)
def risk_levels(spark, sf_dir):
    return reports.risk_profile(discharges(spark, sf_dir)).levels


@check(
    "risk_profile",
    f"""{WITH_SCORE} SELECT age_group, type_of_admission, COUNT(*) AS n_rows,
        ROUND(AVG(risk_score), 1) AS avg_score FROM r GROUP BY 1, 2
        ORDER BY avg_score DESC, age_group, type_of_admission LIMIT 50""",
)
def risk_profile(spark, sf_dir):
    return reports.risk_profile(discharges(spark, sf_dir)).by_age_and_admission


@check(
    "risk_high_groups",
    f"""{WITH_SCORE} SELECT age_group, COUNT(*) AS n_rows FROM r WHERE risk_level = 'High'
        GROUP BY 1 ORDER BY n_rows DESC, age_group LIMIT 10""",
)
def risk_high_groups(spark, sf_dir):
    return reports.risk_profile(discharges(spark, sf_dir)).high_risk_age_groups
