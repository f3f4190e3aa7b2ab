import math
from collections import Counter

import pytest
from conftest import AGES, plan_of
from pyspark.sql import functions as F

from cohortlens import Dimension, Filter, Metric, SemanticModel, SortKey
from cohortlens.operators import aggregate as A
from cohortlens.operators.exact import measure
from cohortlens.operators.filters import apply_filters, known
from cohortlens.plans import reports
from cohortlens.presets.discharge import MODEL


def test_model_has_23_dimensions_and_9_metrics():
    assert len(MODEL.dimensions) == 23
    assert len(MODEL.metrics) == 9


def test_count_by_age(df):
    out = A.aggregate(df, MODEL, ["age_group"], ["discharge_count"]).collect()
    assert [(r.age_group, r.discharge_count) for r in out] == [(a, 120) for a in AGES]


def test_exact_averages(df):
    out = A.aggregate(
        df, MODEL, ["age_group", "gender"], ["avg_total_charges"],
        sort=[SortKey("age_group", "asc"), SortKey("gender", "asc")],
    ).collect()
    assert [(r.age_group, r.gender) for r in out] == [
        (a, g) for a in AGES for g in ("Female", "Male")
    ]
    # Row i charges 1000 + 10 i. Age k and gender pick one residue of i modulo 10.
    for r in out:
        k = AGES.index(r.age_group)
        residue = next(x for x in (k, k + 5) if (x % 2 == 1) == (r.gender == "Female"))
        assert r.avg_total_charges == 3950 + 10 * residue
    by_age = A.aggregate(df, MODEL, ["age_group"], ["avg_total_charges"]).collect()
    assert {r.age_group: r.avg_total_charges for r in by_age} == {
        a: 3975 + 10 * k for k, a in enumerate(AGES)
    }


def test_all_metrics(df, rows):
    out = A.aggregate(df, MODEL, ["hospital_county"], [m.key for m in MODEL.metrics]).collect()
    for r in out:
        own = [x for x in rows if x["hospital_county"] == r.hospital_county]
        weights = [x["birth_weight"] for x in own if x["birth_weight"] is not None]
        assert r.discharge_count == len(own)
        assert r.max_length_of_stay == max(x["length_of_stay"] for x in own)
        assert r.sum_total_charges == sum(x["total_charges"] for x in own)
        assert r.sum_total_costs == sum(x["total_costs"] for x in own)
        assert r.avg_birth_weight == pytest.approx(sum(weights) / len(weights), abs=0.5)


FILTERS = [
    (Filter("gender", "eq", "Male"), lambda r: r["gender"] == "Male"),
    (Filter("gender", "ne", "Male"), lambda r: r["gender"] != "Male"),
    (Filter("age_group", "in", values=AGES[:2]), lambda r: r["age_group"] in AGES[:2]),
    (Filter("age_group", "not_in", values=AGES[:2]), lambda r: r["age_group"] not in AGES[:2]),
    (Filter("length_of_stay", "gte", 10), lambda r: r["length_of_stay"] >= 10),
    (Filter("length_of_stay", "gt", 10), lambda r: r["length_of_stay"] > 10),
    (Filter("length_of_stay", "lte", "9.5"), lambda r: r["length_of_stay"] <= 9.5),
    (Filter("total_costs", "lt", 900), lambda r: r["total_costs"] < 900),
    (Filter("total_charges", "between", values=[2000, 3000]),
     lambda r: 2000 <= r["total_charges"] <= 3000),
    (Filter("discharge_year", "eq", "2021"), lambda r: True),
    (Filter("discharge_year", "lt", 2021), lambda r: False),
    (Filter("birth_weight", "ne", 3001),
     lambda r: r["birth_weight"] is not None and r["birth_weight"] != 3001),
]


@pytest.mark.parametrize("f, holds", FILTERS, ids=lambda x: getattr(x, "op", ""))
def test_filters(df, rows, f, holds):
    assert apply_filters(df, MODEL, [f]).count() == sum(map(holds, rows))


def test_between_keeps_101_rows(df):
    f = Filter("total_charges", "between", values=[2000, 3000])
    out = A.aggregate(df, MODEL, ["age_group"], ["discharge_count"], [f]).collect()
    assert sum(r.discharge_count for r in out) == 101


@pytest.mark.parametrize(
    "f",
    [
        Filter("nonsense", "eq", 1), Filter("gender", "gte", "M"), Filter("gender", "eq", 5),
        Filter("gender", "in", values=[]), Filter("gender", "in", values="Male"),
        Filter("total_charges", "between", values=[1]), Filter("total_charges", "eq", "abc"),
        Filter("length_of_stay", "eq", 1.5), Filter("length_of_stay", "eq"),
        Filter("total_charges", "like", 3), Filter("total_charges", "eq", True),
        Filter("facility_name", "between", values=["a", "b"]),
    ],
    ids=str,
)
def test_bad_filters(df, f):
    with pytest.raises(ValueError):
        apply_filters(df, MODEL, [f])


@pytest.mark.parametrize(
    "request_",
    [
        dict(dimensions=["nope"], metrics=["discharge_count"]),
        dict(dimensions=["gender"], metrics=["nope"]),
        dict(dimensions=[], metrics=["discharge_count"]),
        dict(dimensions=["gender"], metrics=[]),
        dict(dimensions=list(AGES) + ["x"], metrics=["discharge_count"]),
        dict(dimensions=["gender"], metrics=["discharge_count"], limit=0),
        dict(dimensions=["gender"], metrics=["discharge_count"], sort=[SortKey("race")]),
        dict(dimensions=["gender"], metrics=["discharge_count"], sort=[SortKey("gender", "up")]),
    ],
    ids=str,
)
def test_bad_requests(df, request_):
    with pytest.raises(ValueError):
        A.aggregate(df, MODEL, **request_)


def test_sort_and_limit(df):
    out = A.aggregate(
        df, MODEL, ["hospital_county"], ["discharge_count", "avg_total_costs"],
        sort=[SortKey("avg_total_costs", "desc")], limit=2,
    ).collect()
    assert [r.hospital_county for r in out] == ["Queens", "Kings"]


def test_limit_ties_go_to_the_smaller_key(df):
    out = A.aggregate(df, MODEL, ["facility_name"], ["discharge_count"], limit=3)
    assert [r.facility_name for r in out.collect()] == ["FACILITY_0", "FACILITY_1", "FACILITY_2"]
    assert "TakeOrderedAndProject" in plan_of(out)


def test_dimension_key_and_column():
    model = SemanticModel((Dimension("place", "town"),), (Metric("n", "count"),))
    assert model.dimension("place") is model.dimension("town")


def test_result_normalise(spark):
    data = [(1, float("nan"), 2.345), (2, float("inf"), None), (3, 1.0, -float("inf"))]
    raw = spark.createDataFrame(data, "k int, a double, b double")
    out = A.normalise_result(raw, [Metric("b", "avg", "x", 1)]).orderBy("k").collect()
    assert [tuple(r) for r in out] == [(1, None, 2.3), (2, None, None), (3, 1.0, None)]


def test_overview(df, rows):
    o = reports.overview(df, 3)
    figures = o.figures.first()
    assert figures.discharge_count == 600
    assert figures.avg_length_of_stay == 10.5
    assert figures.avg_total_charges == 3995.0
    assert figures.sum_total_costs == sum(r["total_costs"] for r in rows)
    assert figures.emergency_rate_pct == 50.0
    for field in ("age_group", "ccsr_diagnosis_description"):
        counted = Counter(r[field] for r in rows)
        best = sorted(counted.items(), key=lambda kv: (-kv[1], kv[0]))[:3]
        got = o.distributions.filter(F.col("field") == field).orderBy("position").collect()
        assert [(r.value, r.n_rows) for r in got] == best
    assert [r.ccsr_diagnosis_description for r in o.top_diseases.collect()] == [
        "DISEASE_0", "DISEASE_1", "DISEASE_2",
    ]


def test_distribution_limits_groups_below_the_shuffle(df):
    plan = plan_of(A.value_distribution(df, ["gender", "race"], 5))
    assert plan.count("WindowGroupLimit") == 2


def test_conditional_rate_counts_null_as_no(spark):
    df = spark.createDataFrame([("Y",), (None,), ("N",), ("Y",)], "f string")
    assert A.indicators(df, rate=A.rate_pct(F.col("f") == "Y")).first().rate == 50.0


def test_group_share(df):
    out = {r.hospital_county: r.ratio for r in A.group_share(df, "hospital_county").collect()}
    assert out == {"Bronx": 0.3333, "Kings": 0.3333, "Queens": 0.3333}
    assert A.group_share(df.limit(0), "gender").collect() == []
    plan = plan_of(A.group_share(df, "gender"))
    assert "Window" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_known(spark):
    df = spark.createDataFrame([("a", "b"), ("Unknown", "b"), (None, "b"), ("a", None)], "x string, y string")
    assert [tuple(r) for r in known(df, "x", "y").collect()] == [("a", "b")]


def test_money_sums_do_not_depend_on_order(spark):
    values = [0.1, 0.2, 0.3, 1e9, -1e9, 0.05] * 50
    df = spark.createDataFrame([(v,) for v in values], "total_charges double")
    m = MODEL.metric("sum_total_charges")
    sums = {measure(df.repartition(n), [], {"s": m.measure()}).first().s for n in (1, 2, 5, 7)}
    assert sums == {math.fsum(values)}
    with pytest.raises(ValueError):
        m.expr()


def test_filters_reach_the_scan(spark, df, tmp_path):
    df.write.parquet(str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    out = A.aggregate(
        stored, MODEL, ["age_group"], ["sum_total_charges"],
        [Filter("length_of_stay", "gt", 4.5), Filter("gender", "eq", "Male")],
    )
    plan = plan_of(out)
    assert "EqualTo(gender,Male)" in plan and "length_of_stay" in plan.split("PushedFilters")[1]
    schema = plan.split("ReadSchema")[1].split("\n")[0]
    assert "facility_name" not in schema and "total_costs" not in schema
