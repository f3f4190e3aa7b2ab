"""C1-C9, D1, Q1-Q5 and S1-S6."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from checks.aggregation import distribution_sql
from checks.registry import check
from checks.views import (
    DISCHARGES,
    KEY,
    RAW_DISCHARGES,
    RAW_SQL,
    ROW_KEY,
    WITH_D,
    derive,
    derive_sql,
    discharges,
    raw_discharges,
    table,
)
from cohortlens.functions import numbers as N
from cohortlens.functions import text as X
from cohortlens.operators import cleaning as C
from cohortlens.operators import quality as Q
from cohortlens.plans.clean_job import clean_and_report
from cohortlens.plans.deliveries import delivery_report, stored_copies
from cohortlens.presets import discharge
from cohortlens.presets import fixed_values as fv
from cohortlens.sources import tables as T
from cohortlens.sources.scratch import scratch_path
from cohortlens.streaming.incremental import clean_deliveries

SPEC = discharge.CLEANING
WIDE = tuple(DISCHARGES)

# The white space class and the placeholders in the checking engine's spelling.
_WS = (
    r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
    r"\x{205f}\x{3000}]"
)
_MISSING = ", ".join(f"'{p.lower()}'" for p in X.PLACEHOLDERS + X.READER_MISSING)
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def text_sql(c: str) -> str:
    s = f"trim(regexp_replace({c}, '{_WS}+', ' ', 'g'))"
    return f"CASE WHEN {c} IS NULL OR lower({s}) IN ({_MISSING}) THEN 'Unknown' ELSE {s} END"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def int_sql(c: str) -> str:
    s = f"replace({strip_sql(c)}, ',', '')"
    x = f"TRY_CAST({s} AS DOUBLE)"
    return (
        f"CASE WHEN regexp_matches({s}, '{_NUMBER}') AND {x} = round({x}) "
        f"THEN TRY_CAST({x} AS INTEGER) END"
    )


def money_sql(c: str) -> str:
    return f"TRY_CAST(regexp_replace({c}, '[^0-9.\\-]', '', 'g') AS DOUBLE)"


def map_sql(c: str) -> str:
    key = f"lower({strip_sql(c)})"
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.GENDER_MAP.items())
    return f"CASE {key} {cases} ELSE 'Unknown' END"


def flag_sql(c: str) -> str:
    key = f"upper({strip_sql(c)})"
    return f"CASE WHEN {key} IN ('Y', 'N') THEN {key} ELSE 'Unknown' END"


def rule_sql(raw: str) -> str:
    name = X.normalise_name(raw)
    quoted = f'"{raw}"'
    if name in SPEC.maps:
        return map_sql(quoted)
    if name in SPEC.domains:
        return flag_sql(quoted)
    if name in SPEC.ints:
        return int_sql(quoted)
    return money_sql(quoted) if name in SPEC.money else text_sql(quoted)


CLEAN_COLUMNS = ", ".join(
    f"{rule_sql(r)} AS {X.normalise_name(r)}" for r in RAW_DISCHARGES
)


def dirty(spark, sf_dir, *raw_names):
    """The row key and some raw columns."""
    columns = ROW_KEY | {r: RAW_DISCHARGES[r] for r in raw_names}
    return derive(spark, sf_dir, "lineitem", columns)


def _column_check(name, raws, build, sql):
    outputs = {X.normalise_name(r): r for r in raws}
    inner = derive_sql("lineitem", ROW_KEY | {r: RAW_DISCHARGES[r] for r in raws})
    columns = ", ".join(f"""{sql(f'"{r}"')} AS {n}""" for n, r in outputs.items())

    @check(name, f"SELECT {', '.join(KEY)}, {columns} FROM ({inner})")
    def query(spark, sf_dir):
        built = [build(F.col(f"`{r}`")).alias(n) for n, r in outputs.items()]
        return dirty(spark, sf_dir, *raws).select(*KEY, *built)


_column_check("clean_text", ["Hospital County", "Age Group"], X.clean_text, text_sql)
_column_check("clean_code", ["APR DRG Code", "Zip Code - 3 digits"], X.clean_text, text_sql)
_column_check(
    "clean_category", ["Payment Typology 1", "Payment Typology 2"], X.clean_text, text_sql
)
_column_check("map_values", ["Gender"], lambda c: X.map_values(c, fv.GENDER_MAP), map_sql)
_column_check(
    "restrict_domain", ["Emergency Department Indicator"],
    lambda c: X.restrict_domain(c, fv.YES_NO), flag_sql,
)
_column_check("to_int", ["Length of Stay", "Birth Weight"], N.to_int, int_sql)


@check(
    "to_int_wide",
    """SELECT o_orderkey, TRY_CAST(CAST(o_orderkey AS VARCHAR) || '0000000001' AS BIGINT) AS wide,
       CAST(NULL AS BIGINT) AS fraction FROM orders""",
)
def to_int_wide(spark, sf_dir):
    """Keys times 10**10 and one, as strings with commas and blanks, to the last digit."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey").cast("string")
    return orders.select(
        "o_orderkey",
        N.to_int(F.concat(F.lit(" "), key, F.lit("0,000,000,001 ")), "bigint").alias("wide"),
        N.to_int(F.concat(key, F.lit(".5")), "bigint").alias("fraction"),
    )


_column_check("to_money", ["Total Charges"], N.to_money, money_sql)


@check("clean_table", f"SELECT {CLEAN_COLUMNS} FROM ({RAW_SQL})")
def clean_table(spark, sf_dir):
    return C.clean_table(raw_discharges(spark, sf_dir), SPEC)


@check("clean_table_one_column", f"SELECT {rule_sql('Race')} AS race FROM ({RAW_SQL})")
def clean_table_one_column(spark, sf_dir):
    return C.clean_table(raw_discharges(spark, sf_dir), SPEC).select("race")


@check(
    "rename_columns",
    "SELECT o_orderkey AS order_key_id, o_custkey AS customer_number, "
    "o_totalprice AS total_price_usd FROM orders",
)
def rename_columns(spark, sf_dir):
    messy = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias(" Order-Key / ID"),
        F.col("o_custkey").alias("Customer  Number"),
        F.col("o_totalprice").alias("Total Price (USD)"),
    )
    return C.normalise_columns(messy)


@check(
    "dedup_exact",
    """SELECT DISTINCT c_nationkey, c_mktsegment, o_orderpriority, o_orderstatus FROM orders
       JOIN customer ON o_custkey = c_custkey""",
)
def dedup_exact(spark, sf_dir):
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return Q.drop_copies(
        joined.select("c_nationkey", "c_mktsegment", "o_orderpriority", "o_orderstatus")
    )


@check("dedup_wide", f"{WITH_D} SELECT {', '.join([*KEY, *WIDE])} FROM d")
def dedup_wide(spark, sf_dir):
    """Rows of 37 columns; the first two lines of every order come twice."""
    rows = discharges(spark, sf_dir).select(*KEY, *WIDE)
    return Q.drop_copies_of_wide_rows(rows.unionByName(rows.filter("line <= 2")))


@check("dedup_documents", "SELECT text, COUNT(*) AS n_copies FROM documents GROUP BY text")
def dedup_documents(spark, sf_dir):
    return Q.count_copies(table(spark, sf_dir, "documents").select("text"))


WITH_CLEAN = (
    f"WITH raw AS ({RAW_SQL}), cleaned AS (SELECT {CLEAN_COLUMNS} FROM raw), "
    "g AS (SELECT *, COUNT(*) AS n_copies FROM cleaned GROUP BY ALL)"
)


def missing_sql(source: str) -> str:
    parts = [
        f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} = 'Unknown') AS missing "
        f"FROM {source}"
        for c in SPEC.marked
    ] + [
        f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS missing "
        f"FROM {source}"
        for c in SPEC.nullable
    ]
    return " UNION ALL ".join(parts)


@check("missing_profile", f"{WITH_CLEAN} {missing_sql('cleaned')}")
def missing_profile(spark, sf_dir):
    cleaned = C.clean_table(raw_discharges(spark, sf_dir), SPEC)
    return Q.missing_profile(cleaned, SPEC.marked, SPEC.nullable)


@check("value_profile", f"{WITH_CLEAN} {distribution_sql(fv.REPORT_FIELDS, 20, 'cleaned')}")
def value_profile(spark, sf_dir):
    cleaned = C.clean_table(raw_discharges(spark, sf_dir), SPEC, fv.REPORT_FIELDS)
    return Q.value_distribution(cleaned, fv.REPORT_FIELDS, 20)


_COUNTS = """SELECT CAST(SUM(n_copies) AS BIGINT) AS raw_rows, COUNT(*) AS clean_rows,
    CAST(SUM(n_copies) AS BIGINT) - COUNT(*) AS duplicate_rows_removed FROM """


@check(
    "row_accounting",
    f"{_COUNTS} (SELECT text, lang, COUNT(*) AS n_copies FROM documents GROUP BY 1, 2)",
)
def row_accounting(spark, sf_dir):
    copies = Q.count_copies(table(spark, sf_dir, "documents").select("text", "lang"))
    return Q.row_accounting(copies)


def report_sql(groups: str) -> str:
    return f"""
    SELECT 'rows' AS section, name, CAST(NULL AS VARCHAR) AS value, n_rows FROM
        (UNPIVOT ({_COUNTS} {groups}) ON * INTO NAME name VALUE n_rows)
    UNION ALL SELECT 'missing', column_name, NULL, missing FROM ({missing_sql(groups)})
    UNION ALL SELECT 'distribution', field, value, n_rows
        FROM ({distribution_sql(fv.REPORT_FIELDS, 20, groups)})"""


@check("quality_report", f"{WITH_CLEAN} {report_sql('g')}")
def quality_report(spark, sf_dir):
    path = scratch_path(spark, "counted")
    T.write_table(Q.count_copies(C.clean_table(raw_discharges(spark, sf_dir), SPEC)), path)
    stored = spark.read.parquet(path)
    return Q.quality_report(stored, SPEC.marked, SPEC.nullable, fv.REPORT_FIELDS)


# Raw files take a seventh of the disk compressed. They are then not split, hence many.
PACKED = {"compression": "gzip", "rows_per_file": 250_000}

# Returned lines twice, so that the files hold copies of rows.
_TWICE = f"SELECT * FROM ({RAW_SQL}) UNION ALL SELECT * FROM ({RAW_SQL} WHERE l_returnflag = 'R')"
WITH_TWICE = (
    f"WITH raw AS ({_TWICE}), cleaned AS (SELECT {CLEAN_COLUMNS} FROM raw), "
    "g AS (SELECT *, COUNT(*) AS n_copies FROM cleaned GROUP BY ALL)"
)


@check("clean_and_report", f"{WITH_TWICE} {report_sql('g')}")
def clean_and_report_query(spark, sf_dir):
    raw = raw_discharges(spark, sf_dir)
    returned = raw_discharges(spark, sf_dir, where="l_returnflag = 'R'")
    source, target = scratch_path(spark, "raw"), scratch_path(spark, "clean")
    T.write_table(raw.unionByName(returned), source, "csv", **PACKED)
    return clean_and_report(spark, source, target, SPEC, fv.REPORT_FIELDS).report


def three_deliveries(spark, sf_dir):
    """A batch run, then two deliveries of files: new rows and rows that were there before."""
    returned = raw_discharges(spark, sf_dir, where="l_returnflag = 'R'")
    accepted = raw_discharges(spark, sf_dir, where="l_returnflag = 'A'")
    rest = raw_discharges(spark, sf_dir, where="l_returnflag = 'N'")
    first, later, target = (scratch_path(spark, name) for name in ("first", "later", "table"))
    T.write_table(returned, first, "csv", **PACKED)
    clean_and_report(spark, first, target, SPEC, fv.REPORT_FIELDS)
    for step, delivery in enumerate((accepted.unionByName(returned), rest)):
        T.write_table(delivery, f"{later}/{step}", "csv", **PACKED)
        clean_deliveries(
            spark, later, target, SPEC, fv.RAW_COLUMNS, fv.REPORT_FIELDS
        ).awaitTermination()
    return target


@check("stream_dedup", f"{WITH_TWICE} SELECT * FROM g")
def stream_dedup(spark, sf_dir):
    return stored_copies(spark, three_deliveries(spark, sf_dir))


@check("report_over_deliveries", f"{WITH_TWICE} {report_sql('g')}")
def report_over_deliveries(spark, sf_dir):
    return delivery_report(spark, three_deliveries(spark, sf_dir))


ORDER_SCHEMA = StructType(
    [
        StructField("o_orderkey", LongType()),
        StructField("o_orderpriority", StringType()),
        StructField("o_totalprice", DoubleType()),
        StructField("o_custkey", LongType()),
    ]
)


@check(
    "csv_roundtrip",
    "SELECT o_orderkey, o_orderpriority, o_totalprice, o_custkey FROM orders",
)
def csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "orders")
    shuffled = table(spark, sf_dir, "orders").select(
        "o_totalprice", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderkey"
    )
    T.write_table(shuffled, path, "csv")
    return T.read_typed(spark, path, ORDER_SCHEMA)


@check("csv_nested_folders", "SELECT o_orderkey, o_orderpriority FROM orders")
def csv_nested_folders(spark, sf_dir):
    root = scratch_path(spark, "nested")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    open_orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'")
    others = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'O'")
    T.write_table(open_orders.select(*orders.columns), f"{root}/open", "csv")
    T.write_table(others.select(*orders.columns), f"{root}/rest/of/them", "csv")
    read = T.read_raw_csv(spark, root, recursive=True)
    return T.conform(read, orders.schema)


@check(
    "csv_mixed_headers",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority,
       CASE WHEN o_orderstatus = 'P' THEN o_orderstatus END AS o_orderstatus FROM orders""",
)
def csv_mixed_headers(spark, sf_dir):
    """Files with the columns in another order, and with one more column."""
    root = scratch_path(spark, "mixed")
    orders = table(spark, sf_dir, "orders")
    layouts = {
        "O": ["o_orderkey", "o_orderpriority"],
        "F": ["o_orderpriority", "o_orderkey"],
        "P": ["o_orderstatus", "o_orderkey", "o_orderpriority"],
    }
    for status, columns in layouts.items():
        part = orders.filter(F.col("o_orderstatus") == status).select(*columns)
        T.write_table(part, f"{root}/{status}/of them", "csv")
    return T.read_raw_csv(spark, root, recursive=True, mixed_headers=True)


@check(
    "csv_quoted_breaks",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
       CASE WHEN o_orderstatus = 'F' AND o_orderkey % 7 = 0
         THEN concat('one', chr(10), '"two", ', o_orderpriority) ELSE o_orderpriority END AS note FROM orders""",
)
def csv_quoted_breaks(spark, sf_dir):
    """Notes with line breaks and quotes in some of the files."""
    root = scratch_path(spark, "breaks")
    note = F.when(
        (F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 7 == 0),
        F.concat(F.lit('one\n"two", '), "o_orderpriority"),
    ).otherwise(F.col("o_orderpriority"))
    orders = table(spark, sf_dir, "orders").withColumn("note", note)
    for name, part in (("f", "o_orderstatus = 'F'"), ("rest", "o_orderstatus <> 'F'")):
        T.write_table(orders.where(part).select("o_orderkey", "note"), f"{root}/{name}", "csv")
    return T.read_raw_csv(spark, root, recursive=True, quoted_breaks=True)


@check(
    "csv_bad_records",
    """SELECT COUNT(*) AS raw_records, COUNT(*) FILTER (o_orderkey % 10 IN (0, 1)) AS bad_records FROM orders""",
)
def csv_bad_records(spark, sf_dir):
    """Records with a field too many or too few are counted, not lost."""
    root = scratch_path(spark, "ragged")
    key = F.col("o_orderkey")
    line = F.when(key % 10 == 0, F.concat_ws(",", key, "o_orderpriority", F.lit("more"))).when(
        key % 10 == 1, key.cast("string")
    ).otherwise(F.concat_ws(",", key, "o_orderpriority"))
    lines = table(spark, sf_dir, "orders").select(line.alias("o_orderkey,o_orderpriority"))
    lines.write.option("header", True).option("sep", "|").csv(root)
    return T.record_accounting(T.read_raw_csv(spark, root, bad_records="_bad"), "_bad")


@check(
    "table_sink",
    f"{WITH_D} SELECT order_key, line, part_key, supp_key, age_group, birth_weight FROM d",
)
def table_sink(spark, sf_dir):
    path = scratch_path(spark, "discharges")
    columns = [*KEY, "age_group", "birth_weight"]
    T.write_table(discharges(spark, sf_dir).select(*columns), path)
    T.write_table(discharges(spark, sf_dir).select(*columns), path)
    return spark.read.parquet(path)


@check("report_json_roundtrip", f"{WITH_CLEAN} {report_sql('g')}")
def report_json_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "report")
    report = quality_report(spark, sf_dir)
    T.write_report(report, path)
    return spark.read.schema(report.schema).json(path)


@check("materialised_table", f"{WITH_D} SELECT gender, COUNT(*) AS n_rows FROM d GROUP BY 1")
def materialised_table(spark, sf_dir):
    kept = T.materialise(discharges(spark, sf_dir).select("gender"))
    return kept.groupBy("gender").agg(F.count(F.lit(1)).alias("n_rows"))
