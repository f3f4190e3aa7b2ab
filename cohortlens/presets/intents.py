"""Intent labels for questions about the discharge table.

``label_intents`` turns the decision table of the domain into three steps: signals (lexicon
scores and pattern flags), candidate scores, and the choice. Every row is handled on its own;
there is no join and no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import labels as L
from cohortlens.presets import fixed_values as fv


def _cap(c: Column, top: float = 1.0) -> Column:
    return F.least(c, F.lit(top))


def _signals(text: Column, low: L.Prepared, match: str) -> dict[str, Column]:
    """What occurs in a text: scores per lexicon, counts of names, pattern flags."""
    lexicons = {"metadata": fv.METADATA_WORDS, "overview": fv.OVERVIEW_WORDS}
    lexicons |= fv.ANALYSIS_WORDS
    scores = {f"s_{k}": L.hit_score(low, ws, match) for k, ws in lexicons.items()}
    counts = {
        k: F.size(L.mentions(low, lexicon, match))
        for k, lexicon in [("dims", fv.DIMENSION_WORDS), ("metrics", fv.METRIC_WORDS)]
    }
    patterns = {
        "grouped_count": fv.GROUPED_COUNT_PATTERN,
        "grouping": fv.GROUPING_PATTERN,
        "plain_grouping": fv.PLAIN_GROUPING_PATTERN,
        "disease": fv.DISEASE_PATTERN,
        "treatment": fv.TREATMENT_PATTERN,
    }
    flags = {k: F.regexp_like(text, F.lit(p)) for k, p in patterns.items()}
    words = {
        "off_topic": fv.OFF_TOPIC_WORDS,
        "verb": fv.PREDICT_VERBS,
        "cost": fv.COST_NOUNS,
        "readmission": fv.READMISSION_NOUNS,
        "counting": [fv.COUNTING_WORD],
    }
    flags |= {k: L.any_word(low, ws, match) for k, ws in words.items()}
    return scores | counts | flags | {"is_empty": text == ""}


def _candidates(x: Mapping[str, Column]) -> dict[str, Column]:
    """Score per intent, null where the intent has no signal; in order of preference."""
    s = {k: x[f"s_{k}"] for k in ("metadata", "overview", *fv.ANALYSIS_WORDS)}
    dims, metrics = x["dims"], x["metrics"]
    grouping, grouped_count, verb = x["grouping"], x["grouped_count"], x["verb"]

    from_overview = F.when(
        (s["overview"] > 0) & ~grouped_count, _cap(s["overview"] + fv.BONUS_OVERVIEW)
    ).when(
        (s["overview"] > 0) & x["counting"] & (dims == 0),
        _cap(s["overview"] + fv.BONUS_COUNTING),
    )
    from_statistics = F.when(
        (s["statistics"] > 0) & (dims == 0) & (metrics > 0), s["statistics"] + fv.BONUS_COUNTING
    ).when((s["statistics"] > 0) & ~grouped_count, s["statistics"])

    prediction = F.when(
        (s["cost_prediction"] > 0) & verb, _cap(s["cost_prediction"] + fv.BONUS_PREDICTION)
    ).when(verb & x["cost"], fv.VERB_AND_NOUN)

    named = _cap(dims * fv.PER_DIMENSION, fv.DIMENSIONS_CAP)
    measured = _cap(metrics * fv.PER_METRIC, fv.METRICS_CAP) + fv.GROUPING_BONUS
    summed = named + F.when(grouping, measured).otherwise(0.0)
    floor = F.when((dims > 0) & (s["overview"] > 0) & grouping, fv.GROUPED_OVERVIEW_FLOOR)
    aggregation = F.when((dims > 0) | grouping, _cap(F.greatest(summed, floor)))

    return {
        "metadata_query": F.when(
            s["metadata"] > 0, _cap(s["metadata"] + fv.BONUS_METADATA)
        ),
        "statistics_overview": F.greatest(from_overview, from_statistics),
        "association_analysis": F.when(
            s["association"] > 0, _cap(s["association"] + fv.BONUS_ASSOCIATION)
        ),
        "cost_prediction": prediction,
        "readmission_risk": F.when(
            s["readmission_risk"] > 0, _cap(s["readmission_risk"] + fv.BONUS_READMISSION)
        ),
        "aggregation_query": aggregation,
    }


def _answer(intent: str, confidence: Column | float) -> Column:
    level = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return F.struct(F.lit(intent).alias("intent"), level.cast("double").alias("confidence"))


def _choice(x: Mapping[str, Column], points: Mapping[str, Column], min_confidence: float) -> Column:
    """The candidate that wins, after the overrides, as (intent, confidence)."""
    top = F.greatest(*points.values())
    # The highest score wins; on a tie the candidate that comes first.
    leads = {k: points[k] == top for k in fv.INTENTS}
    by_score = reduce(
        lambda chain, k: chain.when(leads[k], _answer(k, points[k])), fv.INTENTS, F
    )
    before = [leads[k] for k in fv.INTENTS[: fv.INTENTS.index("association_analysis")]]
    leads_association = F.coalesce(leads["association_analysis"], F.lit(False)) & ~reduce(
        lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in before]
    )

    asked_cost = x["verb"] & x["cost"]
    returns = x["readmission"]
    treated = x["disease"] & x["treatment"] & ~(x["plain_grouping"] & x["grouping"])
    # The disease rule looks at what the earlier rules chose and leaves associations alone.
    already = ~returns & ~asked_cost & leads_association
    readmission = F.coalesce(points["readmission_risk"], F.lit(fv.READMISSION_ALONE))
    association = F.greatest(points["association_analysis"], F.lit(fv.DISEASE_AND_TREATMENT))
    chosen = (
        F.when(treated & ~already, _answer("association_analysis", association))
        .when(returns, _answer("readmission_risk", readmission))
        .when(asked_cost, _answer("cost_prediction", points["cost_prediction"]))
        .otherwise(by_score)
    )

    def accepted(best: Column) -> Column:
        low = best["best"]["confidence"] < min_confidence
        unsure = _answer(fv.UNSUPPORTED, best["best"]["confidence"])
        return F.when(low, unsure).otherwise(best["best"])

    return (
        F.when(x["is_empty"], _answer(fv.UNSUPPORTED, fv.CONFIDENCE_EMPTY))
        .when(x["off_topic"], _answer(fv.UNSUPPORTED, fv.CONFIDENCE_OFF_TOPIC))
        .when(top.isNull(), _answer(fv.UNSUPPORTED, fv.CONFIDENCE_NO_SIGNAL))
        .otherwise(L.let({"best": chosen}, accepted))
    )


def label_intents(
    df: DataFrame,
    text: str,
    min_confidence: float = fv.MIN_CONFIDENCE,
    match: str = "substring",
) -> DataFrame:
    """Columns ``intent`` and ``confidence`` for every row of a text column."""

    tidy = df.select("*", L.normalise_query(F.col(text)).alias("_search_text"))
    parts = L.search_parts(F.col("_search_text"), match)
    ready = tidy.select("*", *[c.alias(f"_search_{k}") for k, c in parts.items()])
    prepared = {k: F.col(f"_search_{k}") for k in parts}
    signals = _signals(F.col("_search_text"), prepared, match)
    searched = L.once(ready, {f"_signal_{k}": c for k, c in signals.items()})
    x = {k: F.col(f"_signal_{k}") for k in signals}
    answer = L.let(
        _candidates(x), lambda p: _choice(x, {k: p[k] for k in fv.INTENTS}, min_confidence)
    )
    return searched.withColumn("_answer", answer).select(
        *df.columns,
        F.col("_answer.intent").alias("intent"),
        F.round("_answer.confidence", 4).alias("confidence"),
    )
