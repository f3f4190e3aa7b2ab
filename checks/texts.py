"""X1-X8 and N1-N4."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from checks.views import QUESTIONS_SQL, derive, derive_sql, questions, table, values_sql
from cohortlens.functions import grounding as G
from cohortlens.functions import labels as L
from cohortlens.operators import labelling as X
from cohortlens.operators.grounding import ground
from cohortlens.presets import fixed_values as fv
from cohortlens.presets.intents import label_intents

_WORD_ROWS = [
    (label, word, min(1.0, len(word) / 4))
    for label, words in fv.DIMENSION_WORDS.items()
    for word in words
]


def words_sql(rows) -> str:
    numbered = [(i, *row) for i, row in enumerate(rows)]
    return values_sql(numbered)


@check(
    "lexicon_score",
    f"""WITH w(seq, label, word, weight) AS (VALUES {words_sql(_WORD_ROWS)})
        SELECT doc_id, label, SUM(CAST(weight AS DOUBLE)) AS score,
        string_agg(word, ',' ORDER BY seq) AS hits
        FROM documents JOIN w ON contains(lower(text), lower(word)) GROUP BY doc_id, label""",
)
def lexicon_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = X.lexicon_scores(docs, ["doc_id"], "text", fv.DIMENSION_WORDS)
    return rows.withColumn("hits", F.array_join("hits", ","))


@check(
    "lexicon_large",
    r"""WITH w AS (SELECT DISTINCT CAST(c_custkey % 7 AS VARCHAR) AS label,
          CAST(c_custkey AS VARCHAR) AS word FROM customer
        UNION SELECT DISTINCT 'part', unnest(string_split(p_name, ' ')) FROM part),
        t AS (SELECT DISTINCT doc_id,
          unnest(regexp_split_to_array(lower(text), '[^a-z0-9_+]+')) AS token FROM documents)
        SELECT doc_id, label, SUM(LEAST(1.0::DOUBLE, length(word) / 4)) AS score,
        string_agg(word, ',' ORDER BY word) AS hits
        FROM t JOIN w ON token = lower(word) AND word <> '' GROUP BY doc_id, label""",
)
def lexicon_large(spark, sf_dir):
    """Every customer number and every word of the part names as a lexicon."""
    numbers = table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") % 7).cast("string").alias("label"),
        F.col("c_custkey").cast("string").alias("word"),
    )
    names = table(spark, sf_dir, "part").select(
        F.lit("part").alias("label"), F.explode(F.split("p_name", " ")).alias("word")
    )
    docs = table(spark, sf_dir, "documents")
    rows = X.lexicon_scores_by_join(docs, ["doc_id"], "text", numbers.union(names))
    return rows.withColumn("hits", F.array_join("hits", ","))


# The heads of the benchmark's passages, two and three words long, and the part names.
_PHRASES = r"""phrases AS (
    SELECT DISTINCT CAST(item_id % 5 AS VARCHAR) AS label, array_to_string(string_split(text, ' ')[1:n], ' ') AS word
    FROM benchmark, (VALUES (2), (3)) AS sizes(n)
    UNION SELECT DISTINCT 'part', p_name FROM part
)"""


def phrase_table(spark, sf_dir):
    heads = table(spark, sf_dir, "benchmark").withColumn("n", F.explode(F.array(F.lit(2), F.lit(3))))
    words = F.array_join(F.slice(F.split("text", " "), F.lit(1), F.col("n")), " ")
    heads = heads.select((F.col("item_id") % 5).cast("string").alias("label"), words.alias("word"))
    return heads.union(table(spark, sf_dir, "part").select(F.lit("part"), "p_name"))


@check(
    "lexicon_phrases",
    f"""WITH {_PHRASES}, d AS (
          SELECT doc_id, lower(text) AS low,
            concat(' ', regexp_replace(lower(text), '[^a-z0-9_+]+', ' ', 'g'), ' ') AS padded FROM documents
        ), w AS (
          SELECT label, word, regexp_matches(word, '[^\x00-\x7f]') AS anywhere, lower(word) AS low,
            concat(' ', trim(regexp_replace(lower(word), '[^a-z0-9_+]+', ' ', 'g')), ' ') AS alone
          FROM phrases WHERE word <> ''
        )
        SELECT doc_id, label, SUM(LEAST(1.0::DOUBLE, length(word) / 4)) AS score,
          string_agg(word, ',' ORDER BY word) AS hits
        FROM d JOIN w ON CASE WHEN anywhere THEN contains(d.low, w.low) ELSE contains(padded, alone) END
        GROUP BY doc_id, label""",
)
def lexicon_phrases(spark, sf_dir):
    """Phrases of two and three words as a lexicon table; those with accents match anywhere."""
    docs = table(spark, sf_dir, "documents")
    rows = X.lexicon_scores_by_join(docs, ["doc_id"], "text", phrase_table(spark, sf_dir))
    return rows.withColumn("hits", F.array_join("hits", ","))


_TOKEN_ROWS = [
    ("articles", "the", 0.75), ("articles", "les", 0.75), ("articles", "der", 0.75),
    ("links", "and", 0.75), ("links", "und", 0.75), ("links", "et", 0.5),
    ("license", "copyright", 1.0), ("license", "all rights reserved", 1.0),
]
TOKENS: dict[str, list[str]] = {}
for _label, _word, _ in _TOKEN_ROWS:
    TOKENS.setdefault(_label, []).append(_word)


@check(
    "lexicon_tokens",
    f"""WITH w(seq, label, word, weight) AS (VALUES {words_sql(_TOKEN_ROWS)}),
        t AS (SELECT doc_id, concat(' ', regexp_replace(lower(text), '[^a-z0-9_+]+', ' ', 'g'),
              ' ') AS padded FROM documents)
        SELECT doc_id, label, SUM(CAST(weight AS DOUBLE)) AS score,
        string_agg(word, ',' ORDER BY seq) AS hits
        FROM t JOIN w ON contains(padded, concat(' ', word, ' ')) GROUP BY doc_id, label""",
)
def lexicon_tokens(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = X.lexicon_scores(docs, ["doc_id"], "text", TOKENS, match="token")
    return rows.withColumn("hits", F.array_join("hits", ","))


_VALUE_ROWS = [
    (dim, value, word)
    for dim, by in fv.VALUE_WORDS.items()
    for value, words in by.items()
    for word in words
]
_VALUES = f"w(seq, dim, val, word) AS (VALUES {words_sql(_VALUE_ROWS)})"


@check(
    "best_synonym",
    f"""WITH {_VALUES},
        h AS (SELECT conv_id, turn, dim, val, row_number() OVER (PARTITION BY conv_id, turn
              ORDER BY length(word) DESC, seq) AS r
              FROM conversations JOIN w ON contains(lower(text), lower(word)))
        SELECT c.conv_id, c.turn, h.dim AS dimension, h.val AS value FROM conversations c
        LEFT JOIN h ON h.conv_id = c.conv_id AND h.turn = c.turn AND h.r = 1""",
)
def best_synonym(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    named = X.with_best_synonym(turns, "text", fv.VALUE_WORDS)
    return named.select("conv_id", "turn", "dimension", "value")


def synonym_table(spark):
    rows = [(place, *row) for place, row in enumerate(_VALUE_ROWS)]
    return spark.createDataFrame(rows, "place int, dimension string, value string, word string")


@check(
    "best_synonym_table",
    f"""WITH {_VALUES}, v AS (
          SELECT seq AS place, dim, val, word FROM w
          UNION ALL SELECT 1000000 + p_partkey, 'part', p_name, string_split(p_name, ' ')[1] FROM part
        ), h AS (SELECT conv_id, turn, dim, val, row_number() OVER (PARTITION BY conv_id, turn
              ORDER BY length(word) DESC, place) AS r
              FROM conversations JOIN v ON contains(lower(text), lower(word)))
        SELECT c.conv_id, c.turn, h.dim AS dimension, h.val AS value FROM conversations c
        LEFT JOIN h ON h.conv_id = c.conv_id AND h.turn = c.turn AND h.r = 1""",
)
def best_synonym_table(spark, sf_dir):
    """The value words and the first words of the part names as one synonym table."""
    parts = table(spark, sf_dir, "part").select(
        (F.col("p_partkey") + 1_000_000).cast("int"), F.lit("part"), "p_name", F.split("p_name", " ")[0]
    )
    turns = table(spark, sf_dir, "conversations")
    return X.best_synonym_by_join(turns, ["conv_id", "turn"], "text", synonym_table(spark).union(parts))


@check(
    "filters_table",
    f"""WITH {_VALUES}, h AS (
          SELECT DISTINCT conv_id, turn, dim, val FROM conversations JOIN w ON contains(lower(text), lower(word)))
        SELECT conv_id, turn, dim AS field, CASE WHEN COUNT(*) > 1 THEN 'in' ELSE 'eq' END AS op,
          string_agg(val, '|' ORDER BY val) AS values FROM h GROUP BY 1, 2, 3""",
)
def filters_table(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    values = synonym_table(spark).withColumnRenamed("dimension", "field")
    found = X.filters_by_join(turns, ["conv_id", "turn"], "text", values)
    return found.withColumn("values", F.array_join("values", "|"))


# Raw values under a dimension: some known synonyms, some canonical values, some unknown.
RAW_VALUES = {
    "o_orderkey": "o_orderkey",
    "dimension": (
        "CASE o_orderstatus WHEN 'F' THEN 'gender' WHEN 'O' THEN 'age_group' ELSE 'race' END"
    ),
    "raw": (
        "CASE o_orderpriority WHEN '1-URGENT' THEN ' m ' WHEN '2-HIGH' THEN '老年' "
        "WHEN '3-MEDIUM' THEN '70 or Older' WHEN '4-NOT SPECIFIED' THEN 'Male' END"
    ),
}


@check(
    "normalise_values",
    f"""WITH {_VALUES}, r AS ({derive_sql('orders', RAW_VALUES)}),
        k AS (SELECT dim, val, word FROM w UNION SELECT dim, val, val FROM w)
        SELECT o_orderkey, dimension, raw, COALESCE(k.val, trim(raw)) AS value FROM r
        LEFT JOIN k ON k.dim = r.dimension AND k.word = trim(r.raw)""",
)
def normalise_values(spark, sf_dir):
    rows = derive(spark, sf_dir, "orders", RAW_VALUES)
    return X.normalise_values(rows, "dimension", "raw", fv.VALUE_WORDS)


_METRIC_ROWS = [(label, word) for label, words in fv.METRIC_WORDS.items() for word in words]
_DIM_ROWS = [(label, word) for label, word, _ in _WORD_ROWS]


def _mention_sql(source: str, key: str, text: str, rows, name: str) -> str:
    return f"""(SELECT {key}, string_agg(label, ',' ORDER BY seq) AS {name} FROM
        (SELECT {key}, label, MIN(seq) AS seq FROM {source} JOIN
         (VALUES {words_sql(rows)}) w(seq, label, word) ON contains(lower({text}), lower(word))
         GROUP BY {key}, label) GROUP BY {key})"""


@check(
    "mentions",
    f"""WITH q AS ({QUESTIONS_SQL})
        SELECT q.o_orderkey, COALESCE(dims, '') AS dims, COALESCE(metrics, '') AS metrics
        FROM q LEFT JOIN {_mention_sql('q', 'o_orderkey', 'question', _DIM_ROWS, 'dims')} d
        USING (o_orderkey)
        LEFT JOIN {_mention_sql('q', 'o_orderkey', 'question', _METRIC_ROWS, 'metrics')} m
        USING (o_orderkey)""",
)
def mentions(spark, sf_dir):
    found = X.with_mentions(
        questions(spark, sf_dir), "question", dims=fv.DIMENSION_WORDS, metrics=fv.METRIC_WORDS
    )
    return found.select(
        "o_orderkey",
        F.array_join("dims", ",").alias("dims"),
        F.array_join("metrics", ",").alias("metrics"),
    )


@check(
    "mentions_in_conversations",
    f"""SELECT c.conv_id, c.turn, COALESCE(dims, '') AS dims FROM conversations c
        LEFT JOIN {_mention_sql('conversations', 'conv_id, turn', 'text', _DIM_ROWS, 'dims')}
        USING (conv_id, turn)""",
)
def mentions_in_conversations(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    found = X.with_mentions(turns, "text", dims=fv.DIMENSION_WORDS)
    return found.select("conv_id", "turn", F.array_join("dims", ",").alias("dims"))


@check(
    "filters_found",
    f"""WITH {_VALUES}, q AS ({QUESTIONS_SQL}),
        v AS (SELECT o_orderkey, dim, val, MIN(seq) AS seq FROM q
              JOIN w ON contains(lower(question), lower(word)) GROUP BY 1, 2, 3)
        SELECT o_orderkey, dim AS field, CASE WHEN COUNT(*) > 1 THEN 'in' ELSE 'eq' END AS op,
        string_agg(val, ',' ORDER BY seq) AS vals FROM v GROUP BY 1, 2
        UNION ALL SELECT o_orderkey, 'discharge_year', 'eq',
        regexp_extract(question, '({fv.YEAR_PATTERN})', 1) FROM q
        WHERE regexp_matches(question, '{fv.YEAR_PATTERN}')""",
)
def filters_found(spark, sf_dir):
    found = X.with_filters(
        questions(spark, sf_dir), "question", fv.VALUE_WORDS, "discharge_year", fv.YEAR_PATTERN
    )
    rows = found.select("o_orderkey", F.inline("filters"))
    return rows.select("o_orderkey", "field", "op", F.array_join("values", ",").alias("vals"))


@check(
    "slots",
    f"""WITH q AS ({QUESTIONS_SQL}) SELECT o_orderkey,
        TRY_CAST(regexp_extract(question, '{fv.DAYS_PATTERN}', 1) AS INTEGER) AS days,
        TRY_CAST(regexp_extract(question, '{fv.TOP_N_PATTERN}', 1) AS INTEGER) AS top_n
        FROM q""",
)
def slots(spark, sf_dir):
    found = X.with_slots(
        questions(spark, sf_dir), "question", days=fv.DAYS_PATTERN, top_n=fv.TOP_N_PATTERN
    )
    return found.select("o_orderkey", "days", "top_n")


# One question per order, by priority and status, with the label a reader would give it.
ASKED = {
    ("1-URGENT", "F"): ("按年龄段统计住院人次", "aggregation_query"),
    ("2-HIGH", "F"): ("整体情况", "statistics_overview"),
    ("3-MEDIUM", "F"): ("疾病和操作的关联", "association_analysis"),
    ("4-NOT SPECIFIED", "F"): ("预测住院费用", "cost_prediction"),
    ("5-LOW", "F"): ("再入院风险评分", "readmission_risk"),
    ("1-URGENT", "O"): ("有哪些维度", "metadata_query"),
    ("2-HIGH", "O"): ("今天天气如何", "unsupported"),
    ("3-MEDIUM", "O"): ("各县的住院总费用", "aggregation_query"),
    ("4-NOT SPECIFIED", "O"): ("预估住院花费", "cost_prediction"),
    ("5-LOW", "O"): ("不同疾病经常伴随的操作", "association_analysis"),
    ("1-URGENT", "P"): ("2021年按县和性别分组的人次", "aggregation_query"),
    ("2-HIGH", "P"): ("系统能做什么分析", "metadata_query"),
    ("3-MEDIUM", "P"): ("肺炎患者常见的操作", "association_analysis"),
    ("4-NOT SPECIFIED", "P"): ("平台概要", "statistics_overview"),
    ("5-LOW", "P"): ("帮我订机票", "unsupported"),
}


def _asked(which: int) -> str:
    cases = " ".join(
        f"WHEN o_orderpriority = '{p}' AND o_orderstatus = '{s}' THEN '{pair[which]}'"
        for (p, s), pair in ASKED.items()
    )
    return f"CASE {cases} END"


ASKED_VIEW = {"o_orderkey": "o_orderkey", "question": _asked(0), "expected": _asked(1)}


@check("intent_label", f"SELECT o_orderkey, {_asked(1)} AS intent FROM orders")
def intent_label(spark, sf_dir):
    asked = derive(spark, sf_dir, "orders", ASKED_VIEW)
    return label_intents(asked, "question").select("o_orderkey", "intent")


# The whole decision table over free text has no short SQL form; tests hold golden labels.
@check("intent_of_conversations")
def intent_of_conversations(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return label_intents(turns, "text").select("conv_id", "turn", "intent", "confidence")


_GUESS = "CASE WHEN n_chars >= 500 THEN 1 ELSE 0 END"


def guesses(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return labels.join(docs, "doc_id").withColumn("guess", F.expr(_GUESS))


@check(
    "label_accuracy",
    f"""SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE quality = {_GUESS}) AS correct,
        ROUND(CAST(COUNT(*) FILTER (WHERE quality = {_GUESS}) AS DOUBLE) / COUNT(*), 4)
        AS accuracy FROM labels JOIN documents USING (doc_id)""",
)
def label_accuracy(spark, sf_dir):
    return X.label_accuracy(guesses(spark, sf_dir), "quality", "guess")


@check(
    "wrong_labels",
    f"""SELECT doc_id, quality, {_GUESS} AS guess FROM labels JOIN documents USING (doc_id)
        WHERE quality <> {_GUESS}""",
)
def wrong_labels(spark, sf_dir):
    wrong = X.wrong_labels(guesses(spark, sf_dir), "quality", "guess")
    return wrong.select("doc_id", "quality", "guess")


# Numbers stand between other characters. Without look-behind: cut the text into runs of
# word characters, points and commas, then take numbers at the start of a run, after a comma, or after a
# point that has no digit before it.
_DIGITS = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+\.\d+|\d+"


def numbers_sql(text: str) -> str:
    runs = f"regexp_extract_all({text}, '[A-Za-z0-9_.,]+')"
    inside = f"regexp_extract_all(r, '(?:^|,|(?:^|[^0-9])\\.)({_DIGITS})(?:[^A-Za-z0-9_]|$)', 1)"
    found = f"flatten(list_transform({runs}, lambda r: {inside}))"
    value = "CAST(replace(n, ',', '') AS DOUBLE)"
    year = f"({value} BETWEEN 1900 AND 2099 AND NOT contains(n, '.'))"
    kept = f"list_filter({found}, lambda n: NOT {year} AND {value} < 1e9)"
    return f"list_transform({kept}, lambda n: {value})"


@check(
    "numbers_in_text",
    f"""WITH n AS (SELECT doc_id, {numbers_sql('text')} AS ns FROM documents)
        SELECT doc_id, CAST(unnest(generate_series(1, len(ns))) AS INTEGER) - 1 AS pos,
        unnest(ns) AS number FROM n""",
)
def numbers_in_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", G.numbers_in_text(F.col("text")).alias("ns"))
    return found.select("doc_id", F.posexplode("ns").alias("pos", "number"))


# Reports on orders, with the numbers they speak about; closed orders get a wrong total.
REPORTS = {
    "o_orderkey": "o_orderkey",
    "report": (
        "concat('Order of customer ', CAST(o_custkey AS STRING), ': total ', "
        "CAST(CASE o_orderstatus WHEN 'F' THEN o_totalprice * 2 ELSE round(o_totalprice) END "
        "AS STRING), ' in 2021, 3 items.')"
    ),
    "custkey": "o_custkey",
    "total": "o_totalprice",
}
SOURCE = (
    "named_struct('custkey', custkey, 'total', total, 'rush', true, 'note', '7 days', "
    "'items', array(1, 2, 3))"
)


def reports_with_source(spark, sf_dir):
    rows = derive(spark, sf_dir, "orders", REPORTS)
    return rows.withColumn("source", F.expr(SOURCE))


_SOURCE_SQL = (
    "[5.0e0, CAST(o_custkey AS DOUBLE), o_totalprice, 3.0e0, 1.0e0, 2.0e0, 3.0e0]"
)


@check(
    "source_numbers",
    f"""WITH n AS (SELECT o_orderkey, {_SOURCE_SQL} AS ns FROM orders)
        SELECT o_orderkey, unnest(ns) AS number FROM n""",
)
def source_numbers(spark, sf_dir):
    rows = reports_with_source(spark, sf_dir)
    ns = G.source_numbers(F.col("source"), rows.schema["source"].dataType)
    # The array gets its own projection: Spark 4.1 prunes the wrong columns when it pulls
    # struct fields out of an expression that stands directly inside explode.
    found = rows.select("o_orderkey", ns.alias("ns"))
    return found.select("o_orderkey", F.explode("ns").alias("number"))


def match_sql(a: str, b: str) -> str:
    return (
        f"({a} = {b} OR CASE WHEN least(abs({a}), abs({b})) < 1e-9 THEN abs({a} - {b}) < 0.5 "
        f"ELSE abs({a} - {b}) / greatest(abs({a}), abs({b})) <= 0.02 END)"
    )


@check(
    "number_match",
    f"""WITH p AS (SELECT event_id, value AS a,
        CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) AS b FROM events)
        SELECT event_id, {match_sql('a', 'b')} AS matches FROM p""",
)
def number_match(spark, sf_dir):
    b = F.regexp_extract("props", r"(\d+)", 1).cast("double")
    matches = G.numbers_match(F.col("value"), b).alias("matches")
    return table(spark, sf_dir, "events").select("event_id", matches)


@check(
    "grounding",
    f"""WITH s AS (SELECT o_orderkey, {_SOURCE_SQL} AS src, CASE o_orderstatus WHEN 'F'
            THEN o_totalprice * 2 ELSE round(o_totalprice) END AS stated, o_custkey
            FROM orders),
        n AS (SELECT o_orderkey, src, list_filter([CAST(o_custkey AS DOUBLE), stated, 3.0e0],
            lambda x: x < 1e9 AND NOT (x BETWEEN 1900 AND 2099 AND x = o_custkey)) AS ns FROM s),
        u AS (SELECT o_orderkey, src, ns, list_filter(ns, lambda x: len(list_filter(src,
            lambda y: {match_sql('x', 'y')})) = 0) AS bad FROM n)
        SELECT o_orderkey, len(bad) = 0 AS passed, CAST(len(ns) AS INTEGER) AS n_numbers,
        CAST(len(bad) AS INTEGER) AS n_unmatched FROM u""",
)
def grounding(spark, sf_dir):
    judged = ground(reports_with_source(spark, sf_dir), "report", "source")
    return judged.select(
        "o_orderkey", "passed", F.size("text_numbers").alias("n_numbers"),
        F.size("unmatched").alias("n_unmatched"),
    )


@check(
    "grounding_long_source",
    f"""WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS src
            FROM embeddings WHERE len(embedding) > 0),
        n AS (SELECT vec_id, src, list_transform(src, lambda x: x * 1.03e0 + 0.001e0) AS ns FROM s)
        SELECT vec_id, CAST(len(list_filter(ns, lambda x: len(list_filter(src,
            lambda y: {match_sql('x', 'y')})) = 0)) AS INTEGER) AS n_unmatched FROM n""",
)
def grounding_long_source(spark, sf_dir):
    """Sources long enough for the search by bisection: the components of a vector."""
    rows = table(spark, sf_dir, "embeddings").filter(F.size("embedding") > 0)
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("src"))
    rows = rows.select("*", F.transform("src", lambda x: x * 1.03 + 0.001).alias("ns"))
    left = G.unmatched_numbers(F.col("ns"), F.col("src"))
    return rows.select("vec_id", F.size(left).alias("n_unmatched"))
