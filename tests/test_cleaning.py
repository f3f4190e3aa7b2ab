import re

import pytest
from conftest import plan_of
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cohortlens.functions import numbers as N
from cohortlens.functions import text as X
from cohortlens.operators import cleaning as C
from cohortlens.operators import quality as Q
from cohortlens.plans.clean_job import clean_and_report
from cohortlens.presets import discharge
from cohortlens.presets import fixed_values as fv
from cohortlens.session import for_wide_rows
from cohortlens.sources import tables as T
from cohortlens.sources.scratch import scratch_path
from cohortlens.streaming.incremental import append_clean_files

NBSP, WIDE, LINE_SEP, FS = chr(0xA0), chr(0x3000), chr(0x2028), chr(0x1C)


def apply(strings, values, build):
    out = strings(values).select("i", build(F.col("s")).alias("v")).collect()
    return [r.v for r in sorted(out)]


TEXT = {
    " Male ": "Male", f"a{NBSP} b": "a b", f"a{WIDE}b": "a b", f"a{FS}\t\nb": "a b",
    f"{LINE_SEP}x{NBSP}": "x", "": "Unknown", "   ": "Unknown", "NaN": "Unknown",
    "n/a": "Unknown", " N/A ": "Unknown", "<NA>": "Unknown", "None": "Unknown",
    "NULL": "Unknown", "na": "Unknown", "#N/A": "Unknown", None: "Unknown",
    "Not Available": "Not Available", "045": "045", "OOS": "OOS", "nana": "nana",
    "a  b": "a b", "a b": "a b", "é  è": "é è", "NaN x": "NaN x", "中文": "中文", "-": "-",
}


def test_clean_text(strings):
    assert apply(strings, list(TEXT), X.clean_text) == list(TEXT.values())


def test_clean_text_agrees_with_python_white_space(strings):
    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    assert len(blanks) > 20
    values = [f"{b}a{b}{b}b{b}" for b in blanks]
    assert apply(strings, values, X.clean_text) == ["a b"] * len(values)
    assert apply(strings, values, X.strip_space) == [v.strip() for v in values]


def test_clean_text_own_marker(strings):
    build = lambda c: X.clean_text(c, unknown="$?", placeholders=("", "-"))
    assert apply(strings, ["-", " - ", None, "NaN", ""], build) == ["$?", "$?", "$?", "NaN", "$?"]


def test_map_values(strings):
    values = [" m ", "FEMALE", "u", "x", None, f"{NBSP}F", ""]
    expected = ["Male", "Female", "Unknown", "Unknown", "Unknown", "Female", "Unknown"]
    assert apply(strings, values, lambda c: X.map_values(c, fv.GENDER_MAP)) == expected


def test_restrict_domain(strings):
    values = [" y ", "N", "yes", None, ""]
    expected = ["Y", "N", "Unknown", "Unknown", "Unknown"]
    assert apply(strings, values, lambda c: X.restrict_domain(c, fv.YES_NO)) == expected


INTS = {
    "03200": 3200, "1,234": 1234, "5.0": 5, "5.5": None, "x": None, "1d": None, "NaN": None,
    "inf": None, None: None, " 7 ": 7, "-3": -3, "+4": 4, "1e3": 1000, "1e-1": None,
    "99999999999": None, "": None, ".": None, f"{NBSP}8": 8,
}
MONEY = {
    "320,922.43": 320922.43, "$1,234.50": 1234.5, "(12.30)": 12.3, "1e5": 15.0, "1-2": None,
    "USD": None, None: None, "-5": -5.0, "": None, "1.#IND": None, "1.2.3": None,
}


def test_to_int(strings):
    assert apply(strings, list(INTS), N.to_int) == list(INTS.values())


def test_to_money(strings):
    assert apply(strings, list(MONEY), N.to_money) == list(MONEY.values())


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("Zip Code - 3 digits", "zip_code_3_digits"), ("Cost (USD)", "cost_usd"),
        ("Total  Charges", "total_charges"), ("a/b", "a_b"), ("APR MDC Code", "apr_mdc_code"),
    ],
)
def test_normalise_name(raw, expected):
    assert X.normalise_name(raw) == expected


def test_name_collision(spark):
    with pytest.raises(ValueError, match="collide"):
        C.normalise_columns(spark.createDataFrame([(1, 2)], ["A b", "a-B"]))


def raw_frame(spark):
    """The full raw table with the dirt of all column groups, cycling through the cases."""
    texts, ints, money = list(TEXT), list(INTS), list(MONEY)
    genders, flags = ["m", " F", None, "x"], ["y", "N ", "", None]
    data, expected = [], []
    for k in range(60):
        raw, clean = {}, {}
        for j, column in enumerate(fv.RAW_COLUMNS):
            name = X.normalise_name(column)
            if name == "gender":
                v = genders[k % 4]
                c = {"m": "Male", " F": "Female"}.get(v, "Unknown")
            elif name == "emergency_department_indicator":
                v = flags[k % 4]
                c = {"y": "Y", "N ": "N"}.get(v, "Unknown")
            elif name in fv.INT_COLUMNS:
                v = ints[(k + j) % len(ints)]
                c = INTS[v]
            elif name in fv.MONEY_COLUMNS:
                v = money[(k + j) % len(money)]
                c = MONEY[v]
            else:
                v = texts[(k + j) % len(texts)]
                c = TEXT[v]
            raw[column], clean[name] = v, c
        data.append(tuple(raw.values()))
        expected.append(clean)
    schema = ", ".join(f"`{c}` string" for c in fv.RAW_COLUMNS)
    return spark.createDataFrame(data, schema), expected


def bag(dicts):
    return sorted(repr(sorted(d.items())) for d in dicts)


def test_clean_table(spark):
    raw, expected = raw_frame(spark)
    clean = C.clean_table(raw, discharge.CLEANING)
    assert clean.columns == list(discharge.COLUMNS)
    assert dict(clean.dtypes) == {f.name: f.dataType.simpleString() for f in discharge.SCHEMA}
    assert bag(r.asDict() for r in clean.collect()) == bag(expected)


def test_clean_table_tolerates_other_columns(spark):
    raw = spark.createDataFrame([(" a ", "m", " x ")], ["Race", "Gender", "Extra Column"])
    (row,) = C.clean_table(raw, discharge.CLEANING).collect()
    assert row.asDict() == {"race": "a", "gender": "Male", "extra_column": " x "}
    (row,) = C.clean_table(raw, discharge.CLEANING, ["race"]).collect()
    assert row.asDict() == {"race": "a"}


def test_drop_copies_treats_nulls_as_equal(spark):
    data = [("a", None), ("b", 1), ("a", None), ("c", 2), ("b", 1), ("a", 1)]
    df = spark.createDataFrame(data, "s string, n int").repartition(3)
    assert sorted(map(str, Q.drop_copies(df).collect())) == sorted(
        map(str, spark.createDataFrame([("a", None), ("b", 1), ("c", 2), ("a", 1)], df.schema).collect())
    )
    counted = Q.count_copies(df)
    assert Q.row_accounting(counted).first() == (6, 4, 2)
    assert Q.row_accounting(counted.limit(0)).first() == (0, 0, 0)


def test_one_row_that_fills_the_table(spark):
    df = spark.range(0, 20_000, 1, 8).selectExpr("if(id < 15000, 0, id) AS k")
    counted = Q.count_copies(df)
    assert Q.row_accounting(counted).first() == (20_000, 5_001, 14_999)
    assert counted.agg(F.max("n_copies")).first()[0] == 15_000


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_typed_load_is_by_name(spark, fmt, df):
    path = scratch_path(spark, "typed")
    T.write_table(df.select(*reversed(df.columns)), path, fmt)
    back = T.read_typed(spark, path, discharge.SCHEMA, fmt)
    assert back.schema == discharge.SCHEMA
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_typed_load_needs_all_columns(spark, df):
    path = scratch_path(spark, "short")
    T.write_table(df.drop("gender"), path, "csv")
    with pytest.raises(ValueError, match="gender"):
        T.read_typed(spark, path, discharge.SCHEMA)


def test_csv_keeps_odd_strings(spark):
    path = scratch_path(spark, "odd")
    data = [('say "hi"', " x "), ("a,b", "c"), (None, "end\\"), (f"{NBSP}n", "é")]
    df = spark.createDataFrame(data, "a string, b string")
    T.write_table(df, path, "csv")
    assert sorted(map(str, T.read_raw_csv(spark, path).collect())) == sorted(
        map(str, df.collect())
    )


def test_clean_and_report(spark):
    raw, expected = raw_frame(spark)
    source, target = scratch_path(spark, "in"), scratch_path(spark, "out")
    report_path = scratch_path(spark, "report")
    T.write_table(raw.union(raw.limit(10)), source, "csv")
    result = clean_and_report(
        spark, source, target, discharge.CLEANING, fv.REPORT_FIELDS, report_path,
        multi_line=True,
    )
    distinct = sorted(set(bag(expected)))
    assert bag(r.asDict() for r in result.clean.collect()) == distinct
    report = {(r.section, r.name, r.value): r.n_rows for r in result.report.collect()}
    assert report["rows", "raw_rows", None] == 70
    assert report["rows", "clean_rows", None] == len(distinct)
    assert report["rows", "duplicate_rows_removed", None] == 70 - len(distinct)
    kept = [r.asDict() for r in result.clean.collect()]
    for name in discharge.CLEANING.marked:
        assert report["missing", name, None] == sum(r[name] == "Unknown" for r in kept)
    for name in discharge.CLEANING.nullable:
        assert report["missing", name, None] == sum(r[name] is None for r in kept)
    for value in ("Male", "Female", "Unknown"):
        n = sum(r["gender"] == value for r in kept)
        assert report["distribution", "gender", value] == n
    stored = spark.read.json(report_path)
    assert stored.count() == len(report)


def test_new_files_are_appended_once(spark):
    raw, expected = raw_frame(spark)
    source, target = scratch_path(spark, "drop"), scratch_path(spark, "table")
    checkpoint = scratch_path(spark, "progress")

    def run():
        query = append_clean_files(
            spark, source, target, checkpoint, discharge.CLEANING, fv.RAW_COLUMNS,
            multi_line=True,
        )
        assert query.awaitTermination(120)

    T.write_table(raw, f"{source}/first", "csv")
    run()
    run()
    assert bag(r.asDict() for r in spark.read.parquet(target).collect()) == bag(expected)
    T.write_table(raw.limit(5), f"{source}/second", "csv")
    run()
    assert spark.read.parquet(target).count() == 65


@pytest.mark.parametrize("others", [0, 2, 3, 24])
def test_maps_win_at_every_width(spark, others):
    names = ["gender", "flag", *(f"t{i}" for i in range(others))]
    spec = C.CleaningSpec(
        text=tuple(names), maps={"gender": {"m": "Male"}}, domains={"flag": ("Y", "N")}
    )
    df = spark.createDataFrame([("m", "y", *["a  b"] * others)], names)
    assert tuple(C.clean_table(df, spec).head()) == ("Male", "Y", *["a b"] * others)


def test_one_column_reads_its_neighbours_only(spark, tmp_path):
    names = [f"t{i}" for i in range(25)]
    path = str(tmp_path / "wide")
    spark.createDataFrame([tuple("x" for _ in names)], names).write.parquet(path)
    cleaned = C.clean_table(spark.read.parquet(path), C.CleaningSpec(text=tuple(names)))
    read = plan_of(cleaned.select("t9")).split("ReadSchema: ")[1].split(">")[0]
    assert "t9:" in read and read.count(":string") <= 4


def test_wide_integers(spark):
    spec = C.CleaningSpec(ints=("a", "b"), int_types={"b": "int"})
    df = spark.createDataFrame([("3,000,000,000", "3000000000"), ("9007199254740993", "7.0")], "a string, b string")
    got = [tuple(r) for r in C.clean_table(df, spec).collect()]
    assert got == [(3_000_000_000, None), (9_007_199_254_740_993, 7)]


def test_a_foreign_header_is_an_error(spark, tmp_path):
    for name, text in (("a", "k,v\n1,2\n"), ("b", "v,k\n3,4\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    with pytest.raises(Exception, match="header"):
        T.read_raw_csv(spark, str(tmp_path)).collect()


def test_mixed_headers_are_matched_by_name(spark, tmp_path):
    files = {"a": "k,v\n1,2\n", "b c": "v,k\r\n3,4\r\n", "d": 'k,v,w\n5,"6,6",7\n', "e": "k,v\n"}
    for name, text in files.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.csv").write_text(text, newline="")
    (tmp_path / "a" / "notes.txt").write_text("k\nx\n")
    read = T.read_raw_csv(spark, str(tmp_path), recursive=True, mixed_headers=True)
    rows = sorted((r["k"], r["v"], r["w"]) for r in read.collect())
    assert rows == [("1", "2", None), ("4", "3", None), ("5", "6,6", "7")]


def test_quoted_breaks_and_bad_records(spark, tmp_path):
    files = {
        "a.csv": 'k,v\n1,"x\ny"\n2,"say ""no"""\n3,\n', "b.csv": "k,v\n4,plain\n5\n6,a,b\n", "sub c/d.csv": 'k,v\r\n7,"p, q"\r\n',
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    read = T.read_raw_csv(spark, str(tmp_path), recursive=True, quoted_breaks=True, bad_records="bad")
    got = sorted(tuple(r) for r in read.select("k", "v", F.trim("bad")).na.fill("-").collect())
    assert got == [
        ("1", "x\ny", "-"), ("2", 'say "no"', "-"), ("3", "-", "-"), ("4", "plain", "-"), ("5", "-", "5"),
        ("6", "a", "6,a,b"), ("7", "p, q", "-"),
    ]
    assert T.record_accounting(read, "bad").first() == (7, 2)
    one = T.read_raw_csv(spark, str(tmp_path / "b.csv"), quoted_breaks=True)
    assert one.count() == 3 and one.columns == ["k", "v"]
    with pytest.raises(ValueError):
        T.read_raw_csv(spark, str(tmp_path / "b.csv"), bad_records="v")


@pytest.mark.parametrize("max_hashes", [0, 1_000_000])
def test_wide_rows_lose_their_copies(spark, max_hashes):
    rows = [(i % 40, None if i % 3 else "a", float("nan") if i % 5 else -0.0) for i in range(200)]
    rows += [(1000 + i, "x", 1.0) for i in range(50)] + [(7, "hot", 0.0)] * 300 + [(7, "hot", -0.0)]
    df = spark.createDataFrame(rows, "`a.b` int, s string, x double").repartition(5)
    got = Q.drop_copies_of_wide_rows(df, max_hashes)
    assert got.columns == df.columns
    key = lambda r: (r[0], r[1] or "", str(abs(r[2])))
    assert sorted(map(key, got.collect())) == sorted(map(key, df.dropDuplicates().collect()))
    assert Q.drop_copies_of_wide_rows(df.limit(0), max_hashes).collect() == []


def test_rows_that_share_a_hash_both_stay(spark):
    """The row hash skips nulls: these rows have one hash and differ."""
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", None)], "s string, t string")
    assert df.select(F.xxhash64("s", "t")).distinct().count() == 1
    assert sorted(map(str, Q.drop_copies_of_wide_rows(df).collect())) == ["Row(s='a', t=None)", "Row(s=None, t='a')"]


def test_wide_rows_beyond_the_limit_of_hashes(spark):
    """Many repeated rows: those that occur once still go past the shuffle of whole rows."""
    rows = [(i % 700, f"n{i % 700}", None if i % 3 else float(i % 700)) for i in range(900)] + [(None, None, None)] * 3
    df = spark.createDataFrame(rows, "a int, b string, c double").repartition(3, "a")
    found = Q.drop_copies_of_wide_rows(df, max_hashes=0)
    assert "Union" in plan_of(found)
    assert bag_of(found) == bag_of(df.distinct())
    aggregates = spark.createDataFrame([(i, f"n{i}", None) for i in range(50)], df.schema)
    assert bag_of(Q.drop_copies_of_wide_rows(aggregates, max_hashes=-1)) == bag_of(aggregates)


def bag_of(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_packed_texts_count_like_plain_columns(spark):
    texts = [None, "", "a", "\x01", "\x02", "a\x01", "a\x02b", " "]
    rows = [(a, b, n, x) for a in texts for b in texts for n, x in ((1, 0.0), (1, -0.0), (None, float("nan")))]
    df = spark.createDataFrame(rows * 2, "`a.b` string, b string, n int, x double").repartition(3)
    counted = Q.count_copies(df)
    assert counted.columns == [*df.columns, Q.COPIES]
    plain = df.groupBy("`a.b`", "b", "n", "x").agg(F.count(F.lit(1)).alias(Q.COPIES))
    assert sorted(map(str, counted.collect())) == sorted(map(str, plain.collect()))
    back = Q.unpack_texts(Q.pack_texts(df).withColumn("more", F.lit(1)), df.schema)
    assert back.columns == [*df.columns, "more"]
    assert sorted(map(str, back.drop("more").collect())) == sorted(map(str, df.collect()))


def test_the_texts_of_wide_rows_are_shuffled_as_one(df):
    texts = [f.name for f in df.schema if f.dataType == StringType()]
    shuffles = re.findall(r"hashpartitioning\((.*?), \d+\)", plan_of(Q.count_copies(df)))
    assert len(shuffles) == 1 and len(texts) > 20
    assert len(shuffles[0].split(", ")) <= len(df.columns) - len(texts) + 8  # normalised doubles take more words


@pytest.mark.parametrize("raw_files", [True, False])
def test_settings_of_a_job_over_wide_rows_are_put_back(spark, raw_files):
    names = ["spark.sql.codegen.hugeMethodLimit", "spark.sql.files.maxPartitionBytes"]
    before = [spark.conf.get(n) for n in names]
    try:
        for method, split, then in (("65535", "128MB", ["8000", "32m"]), ("100", "1000", ["100", "1000"])):
            now = [method, split]
            for n, v in zip(names, now, strict=True):
                spark.conf.set(n, v)
            with pytest.raises(KeyError), for_wide_rows(spark, raw_files):
                assert [spark.conf.get(n) for n in names] == (then if raw_files else [then[0], split])
                raise KeyError
            assert [spark.conf.get(n) for n in names] == now
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
