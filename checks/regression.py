"""F12 and M1-M8."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from checks.views import KEY, WITH_D, discharges, table
from cohortlens.operators import regression as M
from cohortlens.presets.discharge import COST_MODEL

USABLE = " AND ".join(
    ["total_charges > 0"]
    + [f"{c} IS NOT NULL" for c in COST_MODEL.numeric]
    + [f"{c} <> 'Unknown'" for c in COST_MODEL.categorical]
)
KEY_SQL = ", ".join(KEY)


def unit_sql(salt: str, key=KEY) -> str:
    joined = ", ".join([f"'{salt}'"] + [f"CAST({k} AS VARCHAR)" for k in key])
    digits = f"substr(md5(concat_ws('|', {joined})), 1, 13)"
    return f"(CAST(CAST('0x' || {digits} AS BIGINT) AS DOUBLE) / {float(1 << 52)!r})"


@check("train_frame", f"{WITH_D} SELECT {KEY_SQL}, total_charges FROM d WHERE {USABLE}")
def train_frame(spark, sf_dir):
    rows = M.training_frame(discharges(spark, sf_dir), COST_MODEL)
    return rows.select(*KEY, "total_charges")


CAP = 5000


@check(
    "train_sample",
    f"""{WITH_D}, u AS (SELECT * FROM d WHERE {USABLE})
        SELECT {KEY_SQL} FROM u
        WHERE {unit_sql('sample-42')} * (SELECT COUNT(*) FROM u) < {CAP}""",
)
def train_sample(spark, sf_dir):
    d = discharges(spark, sf_dir)
    return M.training_frame(d, COST_MODEL, CAP, KEY, method="md5").select(*KEY)


@check(
    "split_counts",
    f"""{WITH_D} SELECT CASE WHEN {unit_sql('split-42')} < 0.8 THEN 'train' ELSE 'test' END
        AS part, COUNT(*) AS n_rows, SUM(length_of_stay) AS total_days FROM d GROUP BY 1""",
)
def split_counts(spark, sf_dir):
    train, test = M.split(discharges(spark, sf_dir), KEY, method="md5")
    parts = train.withColumn("part", F.lit("train")).unionByName(
        test.withColumn("part", F.lit("test"))
    )
    return parts.groupBy("part").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("length_of_stay").alias("total_days")
    )


@check(
    "category_index",
    """SELECT p_type, CAST(row_number() OVER (ORDER BY COUNT(*) DESC, p_type) - 1 AS INTEGER)
       AS category_index FROM part GROUP BY p_type""",
)
def category_index(spark, sf_dir):
    return M.category_index(table(spark, sf_dir, "part"), "p_type")


@check(
    "category_index_distinct",
    """SELECT c_name, CAST(row_number() OVER (ORDER BY COUNT(*) DESC, c_name) - 1 AS INTEGER)
       AS category_index FROM customer GROUP BY c_name""",
)
def category_index_distinct(spark, sf_dir):
    return M.category_index(table(spark, sf_dir, "customer"), "c_name")


CUSTOMERS = M.RegressionSpec("c_acctbal", (), ("c_name",), reg_param=0.0)
_NUMBERED = """WITH k AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 0),
    n AS (SELECT c_name, row_number() OVER (ORDER BY COUNT(*) DESC, c_name) - 1 AS i
        FROM k GROUP BY c_name),
    m AS (SELECT regr_slope(c_acctbal, i) AS a, regr_intercept(c_acctbal, i) AS b
        FROM k JOIN n USING (c_name))"""


def customer_fit(spark, sf_dir):
    """A category whose values are all different."""
    rows = M.training_frame(table(spark, sf_dir, "customer"), CUSTOMERS)
    return M.fit_by_table(rows, CUSTOMERS)


@check(
    "distinct_category_line",
    f"""{_NUMBERED} SELECT '(intercept)' AS feature, ROUND(b, 2) AS coefficient FROM m
        UNION ALL SELECT 'c_name_idx', ROUND(a, 4) FROM m""",
)
def distinct_category_line(spark, sf_dir):
    return M.model_summary(customer_fit(spark, sf_dir), CUSTOMERS, smallest=-1)


@check(
    "distinct_category_predictions",
    f"""{_NUMBERED} SELECT c_custkey, ROUND(a * COALESCE(i, (SELECT COUNT(*) FROM n)) + b, 2)
        AS prediction FROM customer LEFT JOIN n USING (c_name), m""",
)
def distinct_category_predictions(spark, sf_dir):
    """Customers without a positive balance have names that training has not seen."""
    customers = table(spark, sf_dir, "customer")
    scored = M.predict(customer_fit(spark, sf_dir), customers, CUSTOMERS)
    return scored.select("c_custkey", F.round("prediction", 2).alias("prediction"))


# A line with known ends: the target follows the quantity, the discount is the noise.
LINE = M.RegressionSpec("target", ("quantity",), reg_param=0.0)
LINE_COLUMNS = {
    "order_key": "l_orderkey",
    "line": "l_linenumber",
    "part_key": "l_partkey",
    "supp_key": "l_suppkey",
    "quantity": "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END",
    "target": "3 * l_quantity + 2 + 100 * l_discount",
}
LINE_SQL = ", ".join(f"{e} AS {c}" for c, e in LINE_COLUMNS.items())
WITH_LINE = f"""WITH x AS (SELECT {LINE_SQL} FROM lineitem),
    k AS (SELECT * FROM x WHERE target > 0 AND quantity IS NOT NULL),
    train AS (SELECT * FROM k WHERE {unit_sql('split-42')} < 0.8),
    test AS (SELECT * FROM k WHERE {unit_sql('split-42')} >= 0.8),
    m AS (SELECT regr_slope(target, quantity) AS a, regr_intercept(target, quantity) AS b
          FROM train)"""


def line_rows(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(*[F.expr(e).alias(c) for c, e in LINE_COLUMNS.items()])


def line_fit(spark, sf_dir):
    rows = M.training_frame(line_rows(spark, sf_dir), LINE)
    train, test = M.split(rows, KEY, method="md5")
    return M.fit(train, LINE), test


@check(
    "ols_coefficients",
    f"""{WITH_LINE} SELECT '(intercept)' AS feature, ROUND(b, 2) AS coefficient FROM m
        UNION ALL SELECT 'quantity', ROUND(a, 4) FROM m""",
)
def ols_coefficients(spark, sf_dir):
    model, _ = line_fit(spark, sf_dir)
    return M.model_summary(model, LINE)


@check(
    "model_metrics",
    f"""{WITH_LINE}, e AS (SELECT target, target - (a * quantity + b) AS e FROM test, m)
        SELECT COUNT(*) AS n_rows, ROUND(SQRT(AVG(e * e)), 2) AS rmse,
        ROUND(AVG(ABS(e)), 2) AS mae,
        ROUND(1 - SUM(e * e) / (VAR_POP(target) * COUNT(*)), 4) AS r2 FROM e""",
)
def model_metrics(spark, sf_dir):
    model, test = line_fit(spark, sf_dir)
    return M.evaluate(model.transform(test), "target")


@check(
    "batch_predict",
    f"""{WITH_LINE} SELECT {KEY_SQL}, ROUND(a * COALESCE(quantity, 1) + b, 3) AS prediction
        FROM x, m""",
)
def batch_predict(spark, sf_dir):
    model, _ = line_fit(spark, sf_dir)
    scored = M.predict(model, line_rows(spark, sf_dir), LINE)
    return scored.select(*KEY, F.round("prediction", 3).alias("prediction"))


# A number and an indexed category, in closed form by Cramer's rule.
PLANE = M.RegressionSpec("target", ("quantity",), ("flag",), reg_param=0.0)
PLANE_COLUMNS = LINE_COLUMNS | {
    "flag": "CASE WHEN l_linenumber = 6 THEN 'Unknown' ELSE l_returnflag END",
    "target": """3 * l_quantity + 2 + 100 * l_discount
        + CASE l_returnflag WHEN 'N' THEN 40 WHEN 'A' THEN 7 ELSE 19 END""",
}
PLANE_SQL = ", ".join(f"{e} AS {c}" for c, e in PLANE_COLUMNS.items())
WITH_PLANE = f"""WITH x AS (SELECT {PLANE_SQL} FROM lineitem),
    k AS (SELECT * FROM x WHERE target > 0 AND quantity IS NOT NULL AND flag <> 'Unknown'),
    f AS (SELECT flag, row_number() OVER (ORDER BY COUNT(*) DESC, flag) - 1 AS i FROM k
          WHERE {unit_sql('split-42')} < 0.8 GROUP BY flag),
    j AS (SELECT k.*, i FROM k JOIN f USING (flag)),
    train AS (SELECT * FROM j WHERE {unit_sql('split-42')} < 0.8),
    test AS (SELECT * FROM j WHERE {unit_sql('split-42')} >= 0.8),
    c AS (SELECT var_pop(quantity) AS qq, var_pop(i) AS ii, covar_pop(quantity, i) AS qi,
          covar_pop(quantity, target) AS qt, covar_pop(i, target) AS it,
          AVG(quantity) AS q, AVG(i) AS i0, AVG(target) AS t FROM train),
    s AS (SELECT (qt * ii - it * qi) / (qq * ii - qi * qi) AS a,
          (it * qq - qt * qi) / (qq * ii - qi * qi) AS b, q, i0, t FROM c),
    m AS (SELECT a, b, t - a * q - b * i0 AS c FROM s)"""


def plane_fit(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.select(*[F.expr(e).alias(c) for c, e in PLANE_COLUMNS.items()])
    train, test = M.split(M.training_frame(rows, PLANE), KEY, method="md5")
    return M.fit(train, PLANE), test


@check(
    "two_feature_coefficients",
    f"""{WITH_PLANE} SELECT '(intercept)' AS feature, ROUND(c, 2) AS coefficient FROM m
        UNION ALL SELECT 'quantity', ROUND(a, 4) FROM m
        UNION ALL SELECT 'flag_idx', ROUND(b, 4) FROM m""",
)
def two_feature_coefficients(spark, sf_dir):
    model, _ = plane_fit(spark, sf_dir)
    return M.model_summary(model, PLANE)


@check(
    "two_feature_metrics",
    f"""{WITH_PLANE}, e AS (SELECT target, target - (a * quantity + b * i + c) AS e FROM test, m)
        SELECT COUNT(*) AS n_rows, ROUND(SQRT(AVG(e * e)), 2) AS rmse,
        ROUND(AVG(ABS(e)), 2) AS mae,
        ROUND(1 - SUM(e * e) / (VAR_POP(target) * COUNT(*)), 4) AS r2 FROM e""",
)
def two_feature_metrics(spark, sf_dir):
    model, test = plane_fit(spark, sf_dir)
    return M.evaluate(model.transform(test), "target")


FIT_ROWS = 100_000
FEATURES = [*COST_MODEL.numeric, *(f"{c}_idx" for c in COST_MODEL.categorical)]
SLOTS = range(len(FEATURES))


def coded_sql(source: str) -> str:
    """The rows of ``source`` with category numbers; values not seen in training share one more."""
    numbers = ", ".join(
        f"COALESCE({c}_map.i, (SELECT COUNT(*) FROM {c}_map)) AS {c}_idx"
        for c in COST_MODEL.categorical
    )
    joins = " ".join(
        f"LEFT JOIN {c}_map ON {c}_map.v = {source}.{c}" for c in COST_MODEL.categorical
    )
    return f"SELECT {source}.*, {numbers} FROM {source} {joins}"


def ridge_sql(source: str) -> str:
    """CTEs that end in ``solved``: slopes x_0, x_1, ... and ``intercept`` from one aggregate.

    On standardised features and label the penalty is reg_param over the label's deviation; in
    the features' own units it scales their variances. The system is solved by elimination.
    """
    y = COST_MODEL.label
    cells = [
        f"covar_pop({FEATURES[i]}, {FEATURES[j]})"
        + (f" * (1 + {COST_MODEL.reg_param} / stddev_pop({y}))" if i == j else "")
        + f" AS a_{i}_{j}"
        for i in SLOTS for j in SLOTS
    ]
    cells += [f"covar_pop({FEATURES[i]}, {y}) AS b_{i}" for i in SLOTS]
    cells += [f"AVG({FEATURES[i]}) AS mean_{i}" for i in SLOTS] + [f"AVG({y}) AS mean_y"]
    steps = [f"g0 AS (SELECT {', '.join(cells)} FROM {source})"]
    for k in SLOTS:
        below = [i for i in SLOTS if i > k]
        changed = [
            f"a_{i}_{j} - a_{i}_{k} * a_{k}_{j} / a_{k}_{k} AS a_{i}_{j}" for i in below for j in below
        ]
        changed += [f"b_{i} - a_{i}_{k} * b_{k} / a_{k}_{k} AS b_{i}" for i in below]
        replaced = f" REPLACE ({', '.join(changed)})" if changed else ""
        steps.append(f"g{k + 1} AS (SELECT *{replaced} FROM g{k})")
    last = f"g{len(FEATURES)}"
    for k in reversed(SLOTS):
        known = "".join(f" - a_{k}_{j} * x_{j}" for j in SLOTS if j > k)
        steps.append(f"s{k} AS (SELECT *, (b_{k}{known}) / a_{k}_{k} AS x_{k} FROM {last})")
        last = f"s{k}"
    level = "".join(f" - x_{i} * mean_{i}" for i in SLOTS)
    steps.append(f"solved AS (SELECT *, mean_y{level} AS intercept FROM {last})")
    return ", ".join(steps)


MAPS = ", ".join(
    f"{c}_map AS (SELECT {c} AS v, row_number() OVER (ORDER BY COUNT(*) DESC, {c}) - 1 AS i "
    f"FROM train GROUP BY {c})"
    for c in COST_MODEL.categorical
)
WITH_COST = f"""{WITH_D}, u AS (SELECT * FROM d WHERE {USABLE}),
    part AS (SELECT * FROM u WHERE {unit_sql('split-42')} < 0.8),
    test AS (SELECT * FROM u WHERE {unit_sql('split-42')} >= 0.8),
    train AS (SELECT * FROM part
              WHERE {unit_sql('sample-42')} * (SELECT COUNT(*) FROM part) < {FIT_ROWS}),
    {MAPS}, coded AS ({coded_sql('train')}), {ridge_sql('coded')}"""
PREDICTED = "intercept" + "".join(f" + x_{i} * {f}" for i, f in enumerate(FEATURES))


def cost_model(spark, sf_dir):
    """Fitted on about ``FIT_ROWS`` rows of the training part; the whole test part is left."""
    usable = M.training_frame(discharges(spark, sf_dir), COST_MODEL)
    train, test = M.split(usable, KEY, method="md5")
    sample = M.training_frame(train, COST_MODEL, FIT_ROWS, KEY, method="md5")
    return M.fit(sample, COST_MODEL), test


@check(
    "cost_model_summary",
    f"""{WITH_COST} SELECT '(intercept)' AS feature, ROUND(intercept, 2) AS coefficient FROM solved """
    + " ".join(
        f"UNION ALL SELECT '{f}', ROUND(x_{i}, 4) FROM solved WHERE ABS(x_{i}) > 1e-6"
        for i, f in enumerate(FEATURES)
    ),
)
def cost_model_summary(spark, sf_dir):
    model, _ = cost_model(spark, sf_dir)
    return M.model_summary(model, COST_MODEL)


@check(
    "cost_model_metrics",
    f"""{WITH_COST}, seen AS ({coded_sql('test')}),
        e AS (SELECT {COST_MODEL.label} AS y, {COST_MODEL.label} - ({PREDICTED}) AS e FROM seen, solved)
        SELECT COUNT(*) AS n_rows, ROUND(SQRT(AVG(e * e)), 2) AS rmse,
        ROUND(AVG(ABS(e)), 2) AS mae,
        ROUND(1 - SUM(e * e) / (VAR_POP(y) * COUNT(*)), 4) AS r2 FROM e""",
)
def cost_model_metrics(spark, sf_dir):
    model, test = cost_model(spark, sf_dir)
    return M.evaluate(model.transform(test), COST_MODEL.label)


FILLED = ", ".join(
    [f"COALESCE({c}, {COST_MODEL.missing_number}) AS {c}" for c in COST_MODEL.numeric]
    + [f"COALESCE({c}, '{COST_MODEL.unknown}') AS {c}" for c in COST_MODEL.categorical]
)


@check(
    "cost_predictions",
    f"""{WITH_COST}, filled AS (SELECT {KEY_SQL}, {FILLED} FROM d), every AS ({coded_sql('filled')})
        SELECT {KEY_SQL}, ROUND({PREDICTED}, 2) AS prediction FROM every, solved""",
)
def cost_predictions(spark, sf_dir):
    model, _ = cost_model(spark, sf_dir)
    scored = M.predict(model, discharges(spark, sf_dir), COST_MODEL)
    return scored.select(*KEY, F.round("prediction", 2).alias("prediction"))
