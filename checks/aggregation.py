"""A1-A7, C10, F1-F10, O1-O3 over the discharge view and the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from checks.views import SALES_MODEL, WITH_D, discharges, sales, sales_sql, table
from cohortlens import Filter, Metric, SortKey
from cohortlens.operators import aggregate as A
from cohortlens.operators.exact import Measure, measure
from cohortlens.plans import reports
from cohortlens.presets import discharge
from cohortlens.presets import fixed_values as fv

MODEL = discharge.MODEL


def exact(c: str) -> str:
    return f"CAST(SUM(CAST({c} AS DECIMAL(18,2))) AS DOUBLE)"


def mean(c: str) -> str:
    return f"{exact(c)} / NULLIF(COUNT({c}), 0)"


@check(
    "revenue_by_region",
    f"""SELECT r_name, o_orderpriority, {exact('l_extendedprice')} AS sum_price,
        COUNT(*) AS line_count
        {sales_sql('orders', 'customer', 'nation', 'region')} GROUP BY 1, 2""",
)
def revenue_by_region(spark, sf_dir):
    flat = sales(spark, sf_dir, "orders", "customer", "nation", "region")
    return A.aggregate(flat, SALES_MODEL, ["region", "priority"], ["sum_price", "line_count"])


@check(
    "agg_one_dim",
    f"{WITH_D} SELECT age_group, COUNT(*) AS discharge_count FROM d GROUP BY 1",
)
def agg_one_dim(spark, sf_dir):
    return A.aggregate(discharges(spark, sf_dir), MODEL, ["age_group"], ["discharge_count"])


@check(
    "agg_two_dims",
    f"""{WITH_D} SELECT age_group, gender, {mean('total_charges')} AS avg_total_charges
        FROM d GROUP BY 1, 2""",
)
def agg_two_dims(spark, sf_dir):
    return A.aggregate(
        discharges(spark, sf_dir), MODEL, ["age_group", "gender"], ["avg_total_charges"],
        sort=[SortKey("age_group", "asc"), SortKey("gender", "asc")], normalise=False,
    )


@check(
    "agg_all_metrics",
    f"""{WITH_D} SELECT hospital_county, type_of_admission, gender, discharge_year,
        payment_typology_1,
        COUNT(*) AS discharge_count, AVG(length_of_stay) AS avg_length_of_stay,
        MAX(length_of_stay) AS max_length_of_stay,
        {mean('total_charges')} AS avg_total_charges,
        {exact('total_charges')} AS sum_total_charges,
        {mean('total_costs')} AS avg_total_costs, {exact('total_costs')} AS sum_total_costs,
        AVG(birth_weight) AS avg_birth_weight,
        AVG(apr_severity_of_illness_code) AS avg_severity_of_illness
        FROM d GROUP BY 1, 2, 3, 4, 5""",
)
def agg_all_metrics(spark, sf_dir):
    return A.aggregate(
        discharges(spark, sf_dir), MODEL,
        ["hospital_county", "type_of_admission", "gender", "discharge_year",
         "payment_typology_1"],
        [m.key for m in MODEL.metrics], normalise=False,
    )


@check(
    "agg_rounded",
    f"""{WITH_D} SELECT hospital_county, ROUND(AVG(length_of_stay), 1) AS avg_length_of_stay,
        ROUND({mean('total_charges')}, 2) AS avg_total_charges FROM d GROUP BY 1""",
)
def agg_rounded(spark, sf_dir):
    return A.aggregate(
        discharges(spark, sf_dir), MODEL, ["hospital_county"],
        ["avg_length_of_stay", "avg_total_charges"],
    )


@check(
    "agg_star_dims",
    f"""SELECT p_brand, p_type, c_mktsegment, COUNT(*) AS line_count,
        MAX(l_quantity) AS max_quantity, {exact('l_extendedprice')} AS sum_price
        {sales_sql('orders', 'customer', 'part')} WHERE p_size >= 10
        GROUP BY 1, 2, 3""",
)
def agg_star_dims(spark, sf_dir):
    flat = sales(spark, sf_dir, "orders", "customer", "part")
    return A.aggregate(
        flat, SALES_MODEL, ["brand", "part_type", "segment"],
        ["line_count", "max_quantity", "sum_price"], [Filter("part_size", "gte", 10)],
    )


FILTERS = {
    "filter_eq": ([Filter("gender", "eq", "Male")], "gender = 'Male'"),
    "filter_ne": (
        [Filter("patient_disposition", "ne", "Expired")], "patient_disposition <> 'Expired'",
    ),
    "filter_in": (
        [Filter("type_of_admission", "in", values=["Emergency", "Trauma"])],
        "type_of_admission IN ('Emergency', 'Trauma')",
    ),
    "filter_not_in": (
        [Filter("patient_disposition", "not_in", values=["Expired", "Other"])],
        "patient_disposition NOT IN ('Expired', 'Other')",
    ),
    "filter_gte": ([Filter("discharge_year", "gte", 1998)], "discharge_year >= 1998"),
    "filter_gt": ([Filter("length_of_stay", "gt", 24.5)], "length_of_stay > 24.5"),
    "filter_lte": ([Filter("birth_weight", "lte", 2900)], "birth_weight <= 2900"),
    "filter_lt": ([Filter("total_costs", "lt", 9000)], "total_costs < 9000"),
    "filter_between": (
        [Filter("total_charges", "between", values=[20000, 30000])],
        "total_charges BETWEEN 20000 AND 30000",
    ),
    "filter_and": (
        [
            Filter("gender", "eq", "Female"),
            Filter("apr_severity_of_illness_code", "in", values=[1, 4]),
            Filter("total_charges", "gt", 15000.5),
            Filter("hospital_county", "ne", "County 3"),
        ],
        "gender = 'Female' AND apr_severity_of_illness_code IN (1, 4) "
        "AND total_charges > 15000.5 AND hospital_county <> 'County 3'",
    ),
}


def _filter_check(name, filters, condition):
    @check(
        name,
        f"""{WITH_D} SELECT age_group, COUNT(*) AS discharge_count,
            {exact('total_charges')} AS sum_total_charges
            FROM d WHERE {condition} GROUP BY 1""",
    )
    def query(spark, sf_dir):
        return A.aggregate(
            discharges(spark, sf_dir), MODEL, ["age_group"],
            ["discharge_count", "sum_total_charges"], filters,
        )


for _name, (_filters, _condition) in FILTERS.items():
    _filter_check(_name, _filters, _condition)


@check(
    "topk_sorted",
    f"""SELECT p_brand, {exact('l_extendedprice')} AS sum_price, COUNT(*) AS line_count
        {sales_sql('part')} GROUP BY 1 ORDER BY sum_price DESC, p_brand ASC LIMIT 10""",
)
def topk_sorted(spark, sf_dir):
    return A.aggregate(
        sales(spark, sf_dir, "part"), SALES_MODEL, ["brand"], ["sum_price", "line_count"],
        sort=[SortKey("sum_price"), SortKey("brand", "asc")], limit=10,
    )


@check(
    "topk_default",
    f"""{WITH_D} SELECT facility_name, gender, COUNT(*) AS discharge_count FROM d GROUP BY 1, 2
        ORDER BY discharge_count DESC, facility_name ASC, gender ASC LIMIT 25""",
)
def topk_default(spark, sf_dir):
    return A.aggregate(
        discharges(spark, sf_dir), MODEL, ["facility_name", "gender"], ["discharge_count"],
        limit=25,
    )


@check(
    "result_normalise",
    """SELECT event_id, CASE WHEN event_type IN ('error', 'click') THEN NULL
           ELSE ROUND(value / 7, 3) END AS ratio,
           CASE WHEN event_type = 'view' THEN NULL ELSE value END AS amount FROM events""",
)
def result_normalise(spark, sf_dir):
    ratio = (
        "CASE event_type WHEN 'error' THEN double('NaN') WHEN 'click' THEN double('-Infinity') "
        "ELSE value / 7 END AS ratio"
    )
    amount = "CASE WHEN event_type = 'view' THEN double('Infinity') ELSE value END AS amount"
    raw = table(spark, sf_dir, "events").selectExpr("event_id", ratio, amount)
    return A.normalise_result(raw, [Metric("ratio", "avg", "value", 3)])


@check(
    "kpi_overview",
    f"""{WITH_D} SELECT COUNT(*) AS discharge_count,
        AVG(length_of_stay) AS avg_length_of_stay, {mean('total_charges')} AS avg_total_charges,
        {mean('total_costs')} AS avg_total_costs, {exact('total_charges')} AS sum_total_charges,
        {exact('total_costs')} AS sum_total_costs,
        AVG(apr_severity_of_illness_code) AS avg_severity_of_illness,
        AVG(CASE WHEN emergency_department_indicator = 'Y' THEN 1.0e0 ELSE 0.0e0 END) * 100
            AS emergency_rate_pct FROM d""",
)
def kpi_overview(spark, sf_dir):
    return reports.overview_figures(discharges(spark, sf_dir), rounded=False)


@check(
    "conditional_rate",
    """SELECT AVG(CASE WHEN l_returnflag = 'R' THEN 1.0e0 ELSE 0.0e0 END) * 100 AS returned_pct,
       AVG(CASE WHEN l_quantity >= 30 AND l_linestatus = 'O' THEN 1.0e0 ELSE 0.0e0 END) * 100
       AS large_open_pct FROM lineitem""",
)
def conditional_rate(spark, sf_dir):
    large_open = (F.col("l_quantity") >= 30) & (F.col("l_linestatus") == "O")
    return A.indicators(
        table(spark, sf_dir, "lineitem"),
        returned_pct=A.rate_pct(F.col("l_returnflag") == "R"),
        large_open_pct=A.rate_pct(large_open),
    )


def distribution_sql(fields, n, source="d") -> str:
    """The first ``n`` values of each field by count, then value; null sorts first."""
    parts = [
        f"""SELECT '{f}' AS field, CAST({f} AS VARCHAR) AS value, COUNT(*) AS n_rows,
            row_number() OVER (ORDER BY COUNT(*) DESC, CAST({f} AS VARCHAR) ASC NULLS FIRST)
            AS position FROM {source} GROUP BY {f}"""
        for f in fields
    ]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE position <= {n}"


@check("distribution_topn", f"{WITH_D} {distribution_sql(fv.OVERVIEW_FIELDS, 10)}")
def distribution_topn(spark, sf_dir):
    return A.value_distribution(discharges(spark, sf_dir), fv.OVERVIEW_FIELDS, 10)


@check(
    "distribution_topn_large",
    """WITH v AS (SELECT 'o_custkey' AS field, CAST(o_custkey AS VARCHAR) AS value FROM orders
        UNION ALL SELECT 'o_orderdate', CAST(CAST(o_orderdate AS DATE) AS VARCHAR) FROM orders),
        c AS (SELECT field, value, COUNT(*) AS n_rows FROM v GROUP BY 1, 2)
        SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY field ORDER BY n_rows DESC, value) AS INTEGER)
        AS position FROM c QUALIFY position <= 1500""",
)
def distribution_topn_large(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    days = orders.select("o_custkey", F.to_date("o_orderdate").alias("o_orderdate"))
    return A.value_distribution(days, ["o_custkey", "o_orderdate"], 1_500)


@check(
    "top_groups",
    f"""{WITH_D} SELECT ccsr_diagnosis_description, COUNT(*) AS discharge_count,
        {mean('total_charges')} AS avg_total_charges FROM d GROUP BY 1
        ORDER BY discharge_count DESC, ccsr_diagnosis_description ASC LIMIT 10""",
)
def top_groups(spark, sf_dir):
    return reports.top_diseases(discharges(spark, sf_dir), 10, rounded=False)


@check(
    "group_share",
    """SELECT l_returnflag, l_linestatus, COUNT(*) AS n_rows,
       CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER () AS ratio FROM lineitem GROUP BY 1, 2""",
)
def group_share(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return A.group_share(lines, "l_returnflag", "l_linestatus", decimals=None)


@check(
    "sum_fine_amounts",
    """SELECT l_returnflag, l_linestatus,
        CAST(SUM(l_partkey % 1000 * 4) AS DOUBLE) / 10000 AS sum_fine,
        CAST(SUM(l_partkey % 1000 * 4) AS DOUBLE) / 10000 / COUNT(l_partkey) AS avg_fine,
        MAX(l_quantity) AS max_quantity, COUNT(*) AS n
        FROM lineitem GROUP BY 1, 2""",
)
def sum_fine_amounts(spark, sf_dir):
    """Amounts with four decimals, most of them below a cent."""
    fine = (F.col("l_partkey") % 1000 * 4).cast("double") / 10000
    return measure(
        table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"],
        {
            "sum_fine": Measure("exact_sum", fine), "avg_fine": Measure("exact_avg", fine),
            "max_quantity": Measure("max", F.col("l_quantity")), "n": Measure("count"),
        },
    )


@check(
    "sum_wide_range",
    """WITH cents AS (
          SELECT l_returnflag, l_linenumber, CAST(round(l_extendedprice * 100) AS HUGEINT) AS c FROM lineitem
        ), parts AS (
          SELECT l_returnflag,
            SUM(CASE WHEN l_linenumber = 1 THEN c WHEN l_linenumber = 2 THEN -c ELSE 0 END) AS huge,
            SUM(CASE WHEN l_linenumber = 3 THEN c ELSE 0 END) AS large,
            SUM(CASE WHEN l_linenumber > 3 THEN c ELSE 0 END) AS small
          FROM cents GROUP BY 1
        )
        SELECT l_returnflag, CAST(huge * 1208925819614629174706176 + large * 1099511627776 + small AS DOUBLE)
          / 1099511627776 AS total FROM parts""",
)
def sum_wide_range(spark, sf_dir):
    """Values 2**80 apart, of both signs: a sum of doubles would lose the small ones."""
    line, cents = F.col("l_linenumber"), F.round(F.col("l_extendedprice") * 100).cast("double")
    wide = (
        F.when(line == 1, cents * 2.0**40).when(line == 2, cents * -(2.0**40))
        .when(line == 3, cents).otherwise(cents * 2.0**-40)
    )
    return measure(table(spark, sf_dir, "lineitem"), ["l_returnflag"], {"total": Measure("exact_sum", wide)})
