import math
import random
import re

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from cohortlens.functions import grounding as G
from cohortlens.functions import labels as L
from cohortlens.operators import labelling as X
from cohortlens.operators.grounding import ground
from cohortlens.presets import fixed_values as fv
from cohortlens.presets.intents import label_intents
from queries_labelled import TEST, TRAIN, VALID


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, t string")


def one(spark, texts, build, match="substring"):
    df = frame(spark, texts).withColumn("low", L.searchable(F.col("t"), match))
    return [r.v for r in df.select("i", build(F.col("low")).alias("v")).orderBy("i").collect()]


def test_score_and_hits(spark):
    texts = ["Payment by MEDICARE", "按年龄段和年龄", "nothing here", ""]
    rows = X.lexicon_scores(frame(spark, texts), ["i"], "t", fv.DIMENSION_WORDS).collect()
    got = {(r.i, r.label): (r.score, r.hits) for r in rows}
    assert got[0, "payment_typology_1"] == (2.0, ["payment", "medicare"])
    assert got[1, "age_group"] == (1.25, ["年龄", "年龄段"])
    assert not [k for k in got if k[0] == 3]


def test_lexicon_is_one_projection(spark):
    rows = X.lexicon_scores(frame(spark, ["a"]), ["i"], "t", fv.DIMENSION_WORDS)
    plan = plan_of(rows)
    assert "Join" not in plan and "Exchange" not in plan and "Python" not in plan


def test_token_match(spark):
    texts = ["he was wounded", "the ED, at 18-29", "急诊ed急诊", "red_ed"]
    hit = lambda m: one(spark, texts, lambda c: L.any_word(c, ["ed"], m), m)
    assert hit("substring") == [True, True, True, True]
    assert hit("token") == [False, True, True, False]
    assert one(spark, texts, lambda c: L.any_word(c, ["18-29"], "token"), "token")[1]
    assert one(spark, texts, lambda c: L.any_word(c, ["急诊"], "token"), "token")[2]


def test_unknown_match_mode(spark):
    with pytest.raises(ValueError):
        L.searchable(F.lit("x"), "fuzzy")


def test_big_lexicons(spark):
    words = [f"w{i:04d}" for i in range(2_500)]
    score = one(spark, ["w0001 w2499", "none", None], lambda c: L.hit_score(c, words))
    assert score == [2.0, 0.0, 0.0]
    both = one(spark, ["w0001 w2499"], lambda c: L.mentions(c, {"a": words, "b": ["w0001"]}))
    assert both == [["a", "b"]]
    best = one(spark, ["w0001 w2499"], lambda c: L.best_synonym(c, {"d": {w: [w] for w in words}}))
    assert (best[0]["dimension"], best[0]["value"]) == ("d", "w0001")


def test_lexicon_table_of_any_size(spark):
    rows = [("a", f"w{i}") for i in range(10_000)] + [("b", "W7"), ("b", "cat"), ("b", "cat")]
    lexicon = spark.createDataFrame(rows, "label string, word string")
    texts = [(1, "w7, W9999 w7; concat"), (2, None), (3, ""), (4, "Cat")]
    df = spark.createDataFrame(texts, "id int, text string")
    found = X.lexicon_scores_by_join(df, ["id"], "text", lexicon)
    got = sorted((r["id"], r["label"], r["score"], r["hits"]) for r in found.collect())
    assert got == [(1, "a", 1.5, ["w7", "w9999"]), (1, "b", 0.5, ["W7"]), (4, "b", 0.75, ["cat"])]


def test_words_are_searched_in_compiled_code(spark, capsys):
    df = spark.createDataFrame([(1, "x")], "id int, text string")
    X.with_mentions(df, "text", m={"a": ["x", "y"]}).filter("size(m) > 0").explain()
    plan = capsys.readouterr().out
    assert "lambdafunction" not in plan and plan.count("Contains(") == 2


SYNONYMS = {
    "老年人": ("age_group", "70 or Older"),
    "急诊入院": ("type_of_admission", "Emergency"),
    "男性": ("gender", "Male"),
    "极重患者": ("apr_severity_of_illness_description", "Extreme"),
    "medicare": ("payment_typology_1", "Medicare"),
    "你好": (None, None),
}


def test_best_synonym(spark):
    rows = X.with_best_synonym(frame(spark, list(SYNONYMS)), "t", fv.VALUE_WORDS).collect()
    assert {r.t: (r.dimension, r.value) for r in rows} == SYNONYMS


def test_normalise_values(spark):
    data = [
        ("age_group", "老年人", "70 or Older"), ("gender", " 男 ", "Male"),
        ("age_group", "70 or Older", "70 or Older"), ("race", "Asian", "Asian"),
        ("gender", None, None),
    ]
    df = spark.createDataFrame(data, "d string, raw string, expected string")
    out = X.normalise_values(df, "d", "raw", fv.VALUE_WORDS).collect()
    assert len(out) == len(data)
    assert all(r.value == r.expected for r in out)


MENTIONS = {
    "按年龄段和性别分组的人次": {"age_group", "gender"},
    "2021年每个县的住院人次": {"hospital_county"},
    "按疾病类型和年龄组看人次": {"ccsr_diagnosis_description", "age_group"},
}


def test_mentions(spark):
    rows = X.with_mentions(
        frame(spark, list(MENTIONS)), "t", dims=fv.DIMENSION_WORDS, metrics=fv.METRIC_WORDS
    ).collect()
    for r in rows:
        assert MENTIONS[r.t] <= set(r.dims) and r.metrics == ["discharge_count"]


def test_filters(spark):
    texts = ["2021年各医院的平均费用", "老年人和儿童", "1850年"]
    rows = X.with_filters(
        frame(spark, texts), "t", fv.VALUE_WORDS, "discharge_year", fv.YEAR_PATTERN
    ).orderBy("i").collect()
    found = [{f.field: (f.op, f["values"]) for f in r.filters} for r in rows]
    assert found[0] == {"discharge_year": ("eq", ["2021"])}
    assert found[1] == {"age_group": ("in", ["0 to 17", "70 or Older"])}
    assert found[2] == {}


def test_slots(spark):
    texts = ["住院5天", "top 12", "前3", "none"]
    rows = X.with_slots(frame(spark, texts), "t", days=fv.DAYS_PATTERN, n=fv.TOP_N_PATTERN)
    assert [(r.days, r.n) for r in rows.orderBy("i").collect()] == [
        (5, None), (None, 12), (None, 3), (None, None),
    ]


def test_intent_accuracy(spark):
    sets = {"train": TRAIN, "valid": VALID, "test": TEST}
    rows = [(name, q, intent) for name, samples in sets.items() for q, intent in samples]
    df = spark.createDataFrame(rows, "part string, question string, expected string")
    labelled = label_intents(df, "question")
    for name, samples in sets.items():
        part = labelled.filter(F.col("part") == name)
        result = X.label_accuracy(part, "expected", "intent").first()
        wrong = X.wrong_labels(part, "expected", "intent").count()
        assert result.total == len(samples)
        assert result.correct + wrong == result.total
        assert result.accuracy >= 0.9


INTENTS = [
    ("整体情况", "statistics_overview", 1.5),
    ("费用预测", "cost_prediction", 1.0),
    ("再入院风险", "readmission_risk", 1.0),
    ("算法清单", "metadata_query", 1.0),
    ("有什么算法可用", "metadata_query", 1.0),
    ("肺炎常见的操作", "association_analysis", 0.78),
    ("今天天气", "unsupported", 0.95),
    ("", "unsupported", 0.0),
    (None, "unsupported", 0.0),
    ("   ", "unsupported", 0.0),
    ("xyz", "unsupported", 0.4),
    # One dimension without grouping words stays below the threshold.
    ("种族", "unsupported", 0.25),
    ("预测花钱的费用", "cost_prediction", 0.85),
    ("住院费用预估", "cost_prediction", 0.85),
    ("按死亡风险分组的人次", "aggregation_query", 0.75),
    # Overview words together with grouping and a dimension raise the score to the floor.
    ("按种族分组看整体", "aggregation_query", 0.85),
    # Without a grouped count the overview itself scores higher.
    ("按种族看整体", "statistics_overview", 0.9),
    # The later rule wins: readmission before cost, disease and treatment before both.
    ("预测再入院费用", "readmission_risk", 1.0),
    ("预测手术治疗肺炎的费用", "association_analysis", 0.78),
    ("按肺炎手术统计", "aggregation_query", 0.6),
]


def test_intents(spark):
    labelled = label_intents(frame(spark, [t for t, _, _ in INTENTS]), "t")
    got = [(r.t, r.intent, r.confidence) for r in labelled.orderBy("i").collect()]
    assert got == INTENTS
    plan = plan_of(labelled)
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan


def test_threshold_is_an_argument(spark):
    row = label_intents(frame(spark, ["种族"]), "t", min_confidence=0.2).first()
    assert (row.intent, row.confidence) == ("aggregation_query", 0.25)


NUMBERS = {
    "平台共收录 1000 例": [1000.0], "1,234.56": [1234.56], "1,000,000": [1e6],
    "3.5万元": [35000.0], "1.2 亿": [1.2e8], "12.5%": [12.5], "2021年": [], "1999": [],
    "2020.5": [2020.5], "9999999999": [], "abc12 x3y": [], "id_7": [], "5天10例": [5.0, 10.0],
    "1.2.3": [1.2], "a,5,6": [5.0, 6.0], "": [], "no": [], "20万": [200000.0],
    "0.2万": [2000.0], "152.143.123.131": [152.143], "12345,678": [12345.0, 678.0], "v 7.": [7.0],
    "Done.9999 patients": [9999.0], "1.2.3": [1.2], "1,234.56": [1234.56],
}


def test_numbers_in_text(spark):
    df = frame(spark, list(NUMBERS))
    out = df.select("i", G.numbers_in_text(F.col("t")).alias("v")).orderBy("i").collect()
    assert {t: r.v for t, r in zip(NUMBERS, out)} == NUMBERS


def test_numbers_agree_with_a_scan_by_hand(spark):
    """Whole documents against a plain scan for digits in Python."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = docs.select("text", G.numbers_in_text(F.col("text")).alias("v")).collect()
    whole = re.compile(r"(?<![A-Za-z0-9_])(?<!\d\.)(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)")
    for r in out:
        expected = []
        for m in whole.finditer(r.text):
            number, end = m.group(0), m.end()
            if re.match(r"[A-Za-z0-9_]", r.text[end : end + 1]):
                cut = number.split(".")[0]
                if "." not in number or r.text[m.start() + len(cut)] != ".":
                    continue
                number = cut
            value = float(number.replace(",", ""))
            year = 1900 <= value <= 2099 and "." not in number
            if not year and value < 1e9:
                expected.append(value)
        assert r.v == expected


def test_source_numbers(spark):
    schema = (
        "s struct<a:int,b:boolean,c:array<double>,d:string,e:map<string,bigint>,"
        "f:array<struct<x:decimal(5,2),y:string>>,g:array<string>>"
    )
    data = [
        ((3, True, [1.5, None], "12", {"k": 9}, [(None, "4")], ["p", "q"]),),
        ((None, None, [], None, {}, None, []),),
        (None,),
    ]
    df = spark.createDataFrame(data, schema)
    ns = G.source_numbers(F.col("s"), df.schema["s"].dataType)
    first, second, third = [r.v for r in df.select(ns.alias("v")).collect()]
    # The struct has 7 fields; then a; c and its size; e and its size; f, its struct; g's size.
    assert first == [7.0, 3.0, 2.0, 1.5, 1.0, 9.0, 1.0, 2.0, 2.0]
    assert second == [7.0]
    assert third == []


MATCHES = [
    (5.0, 5.0, True), (0.0, 1e-10, True), (0.0, 0.4, True), (0.0, 0.5, False),
    (100.0, 102.0, True), (100.0, 102.1, False), (-5.0, 5.0, False), (1e-10, 0.3, True),
]


def test_numbers_match(spark):
    df = spark.createDataFrame(MATCHES, "a double, b double, same boolean")
    assert df.filter(G.numbers_match(F.col("a"), F.col("b")) != F.col("same")).count() == 0


def test_grounding(spark):
    data = [
        ((1000, 5000), "平台共收录 1000 例住院记录，平均费用 5000 元。"),
        ((1000, 1), "平台共收录 9999 例住院记录。"),
        ((1000, 1), "no numbers"),
    ]
    df = spark.createDataFrame(data, "source struct<total:int,avg:int>, text string")
    out = ground(df, "text", "source").collect()
    assert [(r.passed, r.unmatched) for r in out] == [(True, []), (False, [9999.0]), (True, [])]
    with pytest.raises(ValueError):
        ground(df, "text", "source", tolerance=1.5)


def test_long_sources_are_searched_with_the_same_result(spark):
    """Bisection against every pair, at the ends of the tolerance and around zero."""

    def match(a, b, tolerance):
        if math.isnan(a) or math.isnan(b):
            return math.isnan(a) and math.isnan(b)
        if a == b:
            return True
        if min(abs(a), abs(b)) < 1e-9:
            return abs(a - b) < 0.5
        return not math.isinf(max(abs(a), abs(b))) and abs(a - b) / max(abs(a), abs(b)) <= tolerance

    rng = random.Random(5)
    ends = [100.0, 98.0, 102.0, 100 / 0.98, 100 * 0.98, 1e-10, -1e-10, 0.0, -0.0, 0.3, 0.49, 0.5, -0.5, 1e300]
    ends += [float("inf"), float("-inf"), 1e-9, -100.0, -98.0, 5e-324]
    rows = []
    for i in range(60):
        source = [rng.uniform(-3, 3) * 10 ** rng.randint(-2, 4) for _ in range(rng.choice([0, 5, 40, 300]))]
        numbers = [s * rng.choice([0.98, 1.02, 1 / 0.98, 0.9799, 1.05]) for s in source[:20]] + ends
        source += rng.sample(ends, rng.randint(0, 6)) + source[:3]
        rows.append((i, numbers, source))
    rows.append((60, ends, [1000.0 + k for k in range(100)] + [float("nan")]))
    rows.append((61, [float("nan"), 1.0], [1000.0 + k for k in range(100)] + [float("nan")]))
    df = spark.createDataFrame(rows, "i int, ns array<double>, src array<double>")
    for tolerance in (0.0, 0.02, 0.3):
        out = df.select("i", G.unmatched_numbers(F.col("ns"), F.col("src"), tolerance).alias("left"))
        got = {r.i: r.left for r in out.collect()}
        for i, numbers, source in rows:
            want = [n for n in numbers if not any(match(n, s, tolerance) for s in source)]
            assert str(got[i]) == str(want), i


def test_nulls_among_numbers_and_sources(spark):
    long = [float(k) for k in range(1, 60)]
    rows = [(0, [None, 500.0, 5.0], [None, *long]), (1, [None, 500.0], [None, 1.0]), (2, [1.0], None), (3, None, long)]
    df = spark.createDataFrame(rows, "i int, ns array<double>, src array<double>")
    out = df.select("i", G.unmatched_numbers(F.col("ns"), F.col("src")).alias("left"))
    got = {r.i: r.left for r in out.collect()}
    assert got[0] == [500.0] and got[1] == [500.0] and not got[2] and got[3] is None


def test_label_accuracy_of_nothing(spark):
    df = spark.createDataFrame([], "a string, b string")
    assert tuple(X.label_accuracy(df, "a", "b").first()) == (0, 0, 0.0)


def test_two_years_become_one_filter(spark):
    df = frame(spark, ["2020年和2021年", "2021年", "none"])
    found = X.with_filters(df, "t", {}, "discharge_year", fv.YEAR_PATTERN).orderBy("i").collect()
    assert [[(f.op, f["values"]) for f in r.filters] for r in found] == [
        [("in", ["2020", "2021"])], [("eq", ["2021"])], [],
    ]


TABLE_WORDS = [
    ("a", "red"), ("a", "Red Ring"), ("a", "small red ring"), ("b", "c++"), ("b", "  "), ("b", ""), ("b", None),
    ("c", "住院"), ("c", "住"), ("c", "é t"), ("d", "ing"), ("d", "red"), ("a", "red"), ("e", "x"), ("e", "ring  small"),
    ("e", "zzzz"), ("f", "a" * 50), ("f", "!!"),
]
TABLE_TEXTS = [
    "A small RED ring", "reddish ringing", "red, ring. Small", "c++ and C", "住院费用 red", "住 院", "café terrace", "",
    None, "a" * 60, "small red  ring small red ring", "x!! y", "red-ring", "x",
]


@pytest.mark.parametrize("match", ["token", "substring"])
def test_lexicon_tables_agree_with_compiled_words(spark, match):
    """Phrases, other scripts and parts of words: the table gives what the compiled tests give."""
    texts = [(i, t) for i, t in enumerate(TABLE_TEXTS)] + [(None, "red ring")]
    df = spark.createDataFrame(texts, "k int, text string")
    lexicon = spark.createDataFrame(TABLE_WORDS, "label string, word string")
    spec = {}
    for label, word in TABLE_WORDS:
        alone = match == "token" and (word or "").isascii()
        if word and (not alone or re.sub(L.NOT_WORD, " ", word.lower()).strip()) and word not in spec.setdefault(label, []):
            spec[label].append(word)
    spec = {k: v for k, v in spec.items() if v}
    want = {
        (r.k, r.label): (r.score, sorted(r.hits))
        for r in X.lexicon_scores(df, ["k"], "text", spec, match).collect()
    }
    got = {(r.k, r.label): (r.score, r.hits) for r in X.lexicon_scores_by_join(df, ["k"], "text", lexicon, match).collect()}
    assert got == want and len(got) > 10
    plan = plan_of(X.word_hits_by_join(df, ["k"], "text", lexicon, match))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "zzzz" not in plan.replace("LocalTableScan", "")
    empty = lexicon.limit(0)
    assert X.word_hits_by_join(df, ["k"], "text", empty, match).count() == 0
    assert X.word_hits_by_join(df.limit(0), ["k"], "text", lexicon, match).count() == 0


def test_best_synonym_and_mentions_of_a_table(spark):
    values = {"d": {"v1": ["ring", "red"], "v2": ["small"]}, "e": {"w": ["住院", "住"], "u": ["RED"]}}
    rows = [(d, v, w) for d, by in values.items() for v, ws in by.items() for w in ws]
    table = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "dimension string, value string, word string, place int")
    df = spark.createDataFrame(list(enumerate(TABLE_TEXTS)), "k int, text string")
    want = {r.k: (r.dimension, r.value) for r in X.with_best_synonym(df, "text", values).collect()}
    got = {r.k: (r.dimension, r.value) for r in X.best_synonym_by_join(df, ["k"], "text", table).collect()}
    assert got == want
    lexicon = table.selectExpr("value AS label", "word")
    found = {r.k: r.mentions for r in X.mentions_by_join(df, ["k"], "text", lexicon).collect()}
    flat = {v: ws for by in values.values() for v, ws in by.items()}
    compiled = {r.k: sorted(r.m) for r in X.with_mentions(df, "text", m=flat).collect() if r.m}
    assert found == compiled
    filters = {(r.k, r.field): (r.op, r["values"]) for r in X.filters_by_join(df, ["k"], "text", table.withColumnRenamed("dimension", "field")).collect()}
    plain = {(r.k, f.field): (f.op, sorted(f["values"])) for r in X.with_filters(df, "text", values).collect() for f in r.filters}
    assert filters == plain


def test_values_that_share_a_word_meet_texts_once(spark, monkeypatch):
    """However many values have one word, only the first of them is compared with texts."""
    rows = [("d", f"v{i:04d}", "ring", 5000 - i) for i in range(3000)] + [("d", "early", "bolt", 7), ("e", "same", "RING", 1)]
    table = spark.createDataFrame([*rows, ("d", "none", None, 0)], "dimension string, value string, word string, place int")
    df = spark.createDataFrame([(1, "a ring"), (2, "bolt or ring"), (None, "bolt"), (4, "")], "k int, text string")
    met = []
    join = X.word_hits_by_join
    monkeypatch.setattr(X, "word_hits_by_join", lambda d, k, t, words, m: met.append(words.count()) or join(d, k, t, words, m))
    got = {r.k: (r.dimension, r.value) for r in X.best_synonym_by_join(df, ["k"], "text", table).collect()}
    assert got == {1: ("e", "same"), 2: ("e", "same"), None: ("d", "early"), 4: (None, None)}
    assert met == [3]
