import re
from collections import Counter

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from cohortlens.functions.scoring import ExcludeRule
from cohortlens.operators import rules as R
from cohortlens.operators import scoring as S
from cohortlens.plans import reports
from cohortlens.presets import discharge
from cohortlens.presets import fixed_values as fv

DIAGNOSIS, PROCEDURE = "ccsr_diagnosis_description", "ccsr_procedure_description"


def brute_rules(pairs):
    pairs = [(a, b) for a, b in pairs if a not in (None, "Unknown") and b not in (None, "Unknown")]
    n, n_ab = len(pairs), Counter(pairs)
    n_a, n_b = Counter(a for a, _ in pairs), Counter(b for _, b in pairs)
    return {
        (a, b): (k / n, k / n_a[a], (k / n_a[a]) / (n_b[b] / n), k)
        for (a, b), k in n_ab.items()
    }


def test_perfect_rule(df):
    out = R.association_rules(df, DIAGNOSIS, PROCEDURE, min_support=0.05, top_n=30)
    found = {(r[DIAGNOSIS], r[PROCEDURE]): r for r in out.collect()}
    rule = found["DISEASE_3", "PROC_2"]
    assert rule.confidence == 1.0
    assert rule.support == pytest.approx(100 / 600, abs=1e-6)
    assert rule.lift > 1


@pytest.mark.parametrize("min_support", [1e-6, 0.01, 0.05])
def test_rules_agree_with_brute_force(spark, min_support):
    # One antecedent and one pair each hold more than a third of all rows.
    pairs = [("hot", "x")] * 400 + [("hot", f"y{i % 40}") for i in range(100)]
    pairs += [(f"a{i % 30}", f"y{i % 7}") for i in range(300)]
    pairs += [("Unknown", "x"), (None, "x"), ("hot", "Unknown"), ("hot", None)] * 9
    df = spark.createDataFrame(pairs, "a string, b string").repartition(6)
    expected = {k: v for k, v in brute_rules(pairs).items() if v[0] >= min_support}
    out = R.association_rules(df, "a", "b", min_support, top_n=None, rounded=False).collect()
    got = {(r.a, r.b): (r.support, r.confidence, r.lift, r.n_ab) for r in out}
    assert got.keys() == expected.keys()
    for k, v in expected.items():
        assert got[k] == pytest.approx(v)


@pytest.mark.parametrize("min_support", [1e-6, 0.01, 0.05])
def test_pruning_keeps_the_rules(spark, min_support):
    pairs = [("hot", "x")] * 400 + [(f"rare{i}", f"y{i % 40}") for i in range(300)]
    pairs += [(f"a{i % 10}", f"y{i % 5}") for i in range(200)] + [("Unknown", "x"), (None, "x")] * 9
    df = spark.createDataFrame(pairs, "a string, b string").repartition(6)

    def rules(prune):
        return sorted(map(tuple, R.association_rules(df, "a", "b", min_support, None, rounded=False, prune=prune).collect()))

    assert rules(True) == rules(False) != []
    few = R.association_rules(df, "a", "b", 0.05, None, prune=True)
    few.collect()
    counted = [m for m in re.findall(r"BroadcastHashJoin.*LeftSemi", plan_of(few))]
    assert counted and "NestedLoop" not in plan_of(few)
    assert R.association_rules(df.limit(0), "a", "b", 0.05, None, prune=True).collect() == []


def test_top_rules_are_ordered_with_ties_by_name(spark):
    df = spark.createDataFrame([(a, b) for a in "cab" for b in "zxy"] * 2, "a string, b string")
    out = R.association_rules(df, "a", "b", top_n=4).collect()
    assert [(r.a, r.b) for r in out] == [("a", "x"), ("a", "y"), ("a", "z"), ("b", "x")]


@pytest.mark.parametrize("derived", [False, True])
def test_rules_scan_the_base_once(spark, df, derived):
    path = f"{spark.conf.get('spark.checkpoint.dir')}/rules-{derived}"
    df.write.parquet(path)
    base = spark.read.parquet(path)
    if derived:
        base = base.withColumn(DIAGNOSIS, F.concat(F.lit("d "), "age_group", "gender"))
    out = R.association_rules(base, DIAGNOSIS, PROCEDURE)
    out.collect()
    final = plan_of(out).split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final
    assert "NestedLoop" not in final and "Cartesian" not in final and "Window" not in final


@pytest.mark.parametrize("bad", [dict(min_support=0), dict(min_support=2), dict(consequent=DIAGNOSIS)])
def test_bad_rule_arguments(df, bad):
    with pytest.raises(ValueError):
        R.association_rules(df, **({"antecedent": DIAGNOSIS, "consequent": PROCEDURE} | bad))


def points(r):
    """The score by hand."""
    return (
        {"70 or Older": 25, "50 to 69": 10}.get(r["age_group"], 0)
        + (20 if r["type_of_admission"] == "Emergency" else 0)
        + {"Extreme": 25, "Major": 15, "Moderate": 5}.get(
            r["apr_severity_of_illness_description"], 0)
        + {"Extreme": 15, "Major": 10}.get(r["apr_risk_of_mortality"], 0)
        + (10 if r["length_of_stay"] >= 10 else 0)
        + (5 if r["patient_disposition"] != "Home or Self Care" else 0)
    )


def level(p):
    return "High" if p >= 60 else "Medium" if p >= 30 else "Low"


FIELDS = (
    "age_group string, type_of_admission string, apr_severity_of_illness_description string, "
    "apr_risk_of_mortality string, length_of_stay int, patient_disposition string"
)


def test_all_rules_hit(spark):
    row = ("70 or Older", "Emergency", "Extreme", "Extreme", 15, "Expired")
    nulls = (None,) * 6
    edge = ("0 to 17", "Urgent", "Minor", "Minor", 10, "Home or Self Care")
    df = spark.createDataFrame([row, nulls, edge], FIELDS)
    scored = S.score_rows(df, discharge.RISK_RULES, discharge.RISK_BANDS, explain=True).collect()
    assert [(r.risk_score, r.risk_level) for r in scored] == [(100, "High"), (0, "Low"), (10, "Low")]
    first = scored[0].contributions
    assert [c.points for c in first] == [25, 20, 25, 15, 10, 5]
    assert first[4].value == "15" and first[4].field == "length_of_stay"


def test_null_may_count_as_other(spark):
    df = spark.createDataFrame([(None,), ("home",), ("x",)], "d string")
    rule = ExcludeRule("f", "d", ("home",), 5, null_counts_as_other=True)
    assert [r[0] for r in df.select(rule.points()).collect()] == [5, 0, 5]


def test_risk_profile(df, rows):
    profile = reports.risk_profile(df)
    levels = Counter(level(points(r)) for r in rows)
    got = {r.risk_level: (r.n_rows, r.ratio) for r in profile.levels.collect()}
    assert set(got) == {"Low", "Medium", "High"}
    assert got == {k: (n, round(n / 600, 4)) for k, n in levels.items()}
    groups = {}
    for r in rows:
        groups.setdefault((r["age_group"], r["type_of_admission"]), []).append(points(r))
    out = profile.by_age_and_admission.collect()
    assert {(r.age_group, r.type_of_admission): r.n_rows for r in out} == {
        k: len(v) for k, v in groups.items()
    }
    means = [r.avg_score for r in out]
    assert means == sorted(means, reverse=True)
    high = Counter(r["age_group"] for r in rows if level(points(r)) == "High")
    assert {r.age_group: r.n_rows for r in profile.high_risk_age_groups.collect()} == high


def test_scoring_is_a_projection(spark):
    df = spark.range(4).selectExpr(*[f"CAST(NULL AS {f.split()[1]}) AS {f.split()[0]}" for f in FIELDS.split(", ")])
    plan = plan_of(S.score_rows(df, discharge.RISK_RULES, discharge.RISK_BANDS, explain=True))
    assert "Exchange" not in plan and "Python" not in plan


def test_scores_over_whole_table(df, rows):
    scored = S.score_rows(df, discharge.RISK_RULES, discharge.RISK_BANDS)
    assert scored.agg(F.sum("risk_score")).first()[0] == sum(map(points, rows))


def test_rules_only_over_allowed_fields(spark, df):
    with pytest.raises(ValueError):
        R.association_rules(df, "gender", "age_group", fields=fv.RULE_FIELDS)
    rules = R.association_rules(df, "type_of_admission", "age_group", fields=fv.RULE_FIELDS)
    assert rules.count() > 0
