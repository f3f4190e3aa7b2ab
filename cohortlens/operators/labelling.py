"""Lexicon labels for a text column."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import labels as L
from cohortlens.sources.scratch import scratch_path


def lexicon_scores(
    df: DataFrame,
    keep: Sequence[str],
    text: str,
    lexicon: Mapping[str, Sequence[str]],
    match: str = "substring",
) -> DataFrame:
    """Rows (*keep, label, score, hits) for every label with a hit.

    Rows come out of an inline array of the row itself, so nothing is shuffled.
    """
    found = _search(df, text, match, lambda t: {"found": L.words_found(t, lexicon, match)})
    return found.select(*keep, F.inline(L.scored(F.col("_search_found"))))


def word_hits_by_join(
    df: DataFrame, key: Sequence[str], text: str, lexicon: DataFrame, match: str = "token"
) -> DataFrame:
    """Rows (*key, columns of ``lexicon``) for every entry whose ``word`` occurs in the text.

    The lexicon is a table of any size, with words, phrases and any script; the rules are those of
    ``lexicon_scores`` with the same ``match``. Entries that must stand alone are compared with the
    text's runs of as many words, one equality join. Entries that may occur anywhere meet the text
    by their rarest run of up to ``GRAM`` characters, and what meets is searched for in the text. No
    text is compared with an entry that shares no such run. ``key`` identifies a row; empty words
    match nothing; each entry counts once per text. What entries are looked up by is stored in the
    scratch folder: its size is known then, and a small lexicon is sent to the texts before their
    runs are shuffled.
    """
    if match not in ("substring", "token"):
        raise ValueError(f"unknown match mode: {match!r}")
    entries = lexicon.where("word IS NOT NULL").distinct().withColumn("_low", F.lower("word"))
    alone = F.lit(match == "token") & ~F.rlike("word", F.lit(r"[^\x00-\x7f]"))
    # Read three times below; dealt out, because a compressed file has few splits.
    texts = _stored(df.select(*key, F.lower(text).alias("_text")).repartition(*key), "texts")
    columns = [*key, *lexicon.columns]
    phrases = entries.where(alone).withColumn("_phrase", _run_of_words("_low"))
    phrases = _stored(phrases.where("_phrase <> ''"), "phrases")
    return (
        _phrase_hits(texts, phrases).select(columns)
        .union(_gram_hits(texts, key, entries.where(~alone & (F.col("_low") != ""))).select(columns))
    )


GRAM = 3  # characters by which an entry is looked up


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _run_of_words(low: str) -> Column:
    return F.trim(F.regexp_replace(low, L.NOT_WORD, " "))


def _phrase_hits(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """Texts cut into runs of each number of words that a phrase has."""
    sized = phrases.withColumn("_size", F.size(F.split("_phrase", " ")))
    # Few rows: one per number of words.
    sizes = sorted(r["_size"] for r in sized.select("_size").distinct().collect())
    words = F.split(_run_of_words("_text"), " ")

    def runs(n: int) -> Column:
        starts = F.when(F.size("_words") >= n, F.sequence(F.lit(0), F.size("_words") - n))
        one = F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(F.col("_words"), i + k) for k in range(n)]))
        return F.array_distinct(F.col("_words") if n == 1 else one)

    every = F.concat(*[F.coalesce(runs(n), F.array().cast("array<string>")) for n in sizes]) if sizes else F.array().cast("array<string>")
    cut = texts.withColumn("_words", words).withColumn("_phrase", F.explode(every)).drop("_text", "_words")
    return cut.join(sized, "_phrase")


def _grams(low: str, sizes: Sequence[int]) -> tuple[Column, Column]:
    """The characters, and from a column ``_chars`` of them all runs of the given sizes, each once."""
    chars = F.split(low, "")

    def runs(n: int) -> Column:
        starts = F.when(F.length(low) >= n, F.sequence(F.lit(0), F.length(low) - n))
        return F.transform(starts, lambda i: F.concat(*[F.get(F.col("_chars"), i + k) for k in range(n)]))

    none = F.array().cast("array<string>")
    return chars, F.array_distinct(F.concat(*[F.coalesce(runs(n), none) for n in sizes]))


def _text_grams(low: str, sizes: Sequence[int]) -> Column:
    """All runs of the given sizes, each once; compiled, where ``_grams`` is interpreted per character.

    Around characters beyond the first plane there are a few runs more, which no entry has.
    """
    runs = [F.regexp_extract_all(low, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in sizes]
    return F.array_distinct(F.concat(*runs))


def _gram_hits(texts: DataFrame, key: Sequence[str], entries: DataFrame) -> DataFrame:
    chars, grams = _grams("_low", range(1, GRAM + 1))
    own = entries.withColumn("_chars", chars).withColumn("_gram", F.explode(grams)).drop("_chars")
    # An entry's grams are of one size: GRAM, or its own length.
    own = _stored(own.where(F.length("_gram") == F.least(F.lit(GRAM), F.length("_low"))), "grams")
    # At most GRAM rows; texts are cut into runs of these sizes only.
    sizes = sorted(r.n for r in own.select(F.length("_gram").alias("n")).distinct().collect()) or [GRAM]
    seen = texts.select(*key, F.explode(_text_grams("_text", sizes)).alias("_gram"))
    needed = own.select("_gram").distinct()
    # Read twice below, and much less than all runs.
    seen = _stored(seen.join(needed, "_gram", "left_semi"), "seen")
    # A gram that no text has rules its entry out; of the others the rarest finds it.
    common = seen.groupBy("_gram").agg(F.count("*").alias("_n"))
    rest = [c for c in own.columns if c != "_gram"]
    ranked = own.join(common, "_gram", "left").groupBy(*rest).agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("g"))).alias("_best")
    )
    found = ranked.where("_best.n > 0").withColumn("_gram", F.col("_best.g")).drop("_best")
    met = seen.join(_stored(found, "rarest"), "_gram").drop("_gram")
    named = texts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], "_text")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]
    return met.join(named, same).where(F.contains("_text", "_low"))


def lexicon_scores_by_join(
    df: DataFrame, key: Sequence[str], text: str, lexicon: DataFrame, match: str = "token"
) -> DataFrame:
    """X1 for a lexicon table (label, word) of any size: rows (*key, label, score, hits).

    See ``word_hits_by_join``; hits are in alphabetical order, texts without a hit give no row.
    """
    weight = F.least(F.lit(1.0), F.length("word") / 4)
    hits = word_hits_by_join(df, key, text, lexicon.select("label", "word"), match)
    return hits.groupBy(*key, "label").agg(
        F.sum(weight).alias("score"), F.sort_array(F.collect_list("word")).alias("hits")
    )


def best_synonym_by_join(
    df: DataFrame, key: Sequence[str], text: str, values: DataFrame, match: str = "substring"
) -> DataFrame:
    """X2 for a table (dimension, value, word, place) of any size: one row per text, with
    ``dimension`` and ``value`` of the longest word that occurs, the least ``place`` on a tie;
    null where no word occurs."""
    named = F.struct("dimension", "value", "word")
    ranked = F.struct((-F.length("word")).alias("n"), F.col("place"), named.alias("v"))
    # Of the entries with one word a text that has it can only take the first: texts meet words, however
    # many values share one.
    words = values.where("word IS NOT NULL").groupBy("word").agg(F.min(ranked).alias("_first"))
    hits = word_hits_by_join(df, key, text, words, match)
    best = hits.groupBy(*key).agg(F.min("_first").alias("_b"))
    best = best.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], "_b.v.dimension", "_b.v.value")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]
    return df.join(best, same, "left").select(*key, "dimension", "value")


def mentions_by_join(
    df: DataFrame, key: Sequence[str], text: str, lexicon: DataFrame, match: str = "substring"
) -> DataFrame:
    """X4 for a table (label, word): rows (*key, mentions), labels sorted; texts with one only."""
    hits = word_hits_by_join(df, key, text, lexicon.select("label", "word"), match)
    return hits.groupBy(*key).agg(F.sort_array(F.collect_set("label")).alias("mentions"))


def filters_by_join(
    df: DataFrame, key: Sequence[str], text: str, values: DataFrame, match: str = "substring"
) -> DataFrame:
    """X5 for a table (field, value, word): rows (*key, field, op, values), values sorted."""
    hits = word_hits_by_join(df, key, text, values.select("field", "value", "word"), match)
    found = hits.groupBy(*key, "field").agg(F.sort_array(F.collect_set("value")).alias("values"))
    return found.select(*key, "field", F.when(F.size("values") > 1, "in").otherwise("eq").alias("op"), "values")


def _search(
    df: DataFrame,
    text: str,
    match: str,
    tests: Callable[[Mapping[str, Column]], Mapping[str, Column]],
) -> DataFrame:
    """``df`` with the tests as columns ``_search_*``; the text is prepared once for all."""
    parts = L.search_parts(F.col(text), match)
    prepared = {k: F.col(f"_search_{k}") for k in parts}
    ready = df.select("*", *[c.alias(f"_search_{k}") for k, c in parts.items()])
    named = {f"_search_{k}": c for k, c in tests(prepared).items()}
    return L.once(ready, named).drop(*[f"_search_{k}" for k in parts])


def with_best_synonym(
    df: DataFrame, text: str, values: L.Values, match: str = "substring"
) -> DataFrame:
    """Columns ``dimension`` and ``value``; null where no word occurs."""
    best = _search(df, text, match, lambda t: {"best": L.best_synonym(t, values, match)})
    return best.withColumns(
        {"dimension": F.col("_search_best.dimension"), "value": F.col("_search_best.value")}
    ).drop("_search_best")


def normalise_values(df: DataFrame, dimension: str, raw: str, values: L.Values) -> DataFrame:
    """Column ``value``, the canonical form of ``raw`` under the row's dimension.

    Values outside the table pass through stripped. The join strategy is left to the optimizer,
    which sees the size of the synonym table.
    """
    rows, seen = [], set()
    for dim, by in values.items():
        for value, words in by.items():
            for word in (value, *words):
                if (dim, word) not in seen:
                    seen.add((dim, word))
                    rows.append((dim, word, value))
    table = df.sparkSession.createDataFrame(rows, "_dim string, _word string, _value string")
    keyed = df.withColumn("_key", L.value_key(F.col(raw)))
    hit = (F.col(dimension) == F.col("_dim")) & (F.col("_key") == F.col("_word"))
    joined = keyed.join(table, hit, "left")
    return joined.select(*df.columns, F.coalesce("_value", "_key").alias("value"))


def with_mentions(
    df: DataFrame, text: str, match: str = "substring", **lexicons: Mapping[str, Sequence[str]]
) -> DataFrame:
    """One array column of labels per lexicon."""

    def tests(t: Mapping[str, Column]) -> dict[str, Column]:
        return {f"in_{k}": L.mentions(t, lexicon, match) for k, lexicon in lexicons.items()}

    found = _search(df, text, match, tests)
    named = found.withColumns({k: F.col(f"_search_in_{k}") for k in lexicons})
    return named.drop(*[f"_search_in_{k}" for k in lexicons])


def with_filters(
    df: DataFrame,
    text: str,
    values: L.Values,
    year_field: str | None = None,
    year_pattern: str = "",
    match: str = "substring",
) -> DataFrame:
    """Column ``filters``."""

    found = _search(df, text, match, lambda t: {"found": L.values_found(t, values, match)})
    filters = L.as_filters(F.col(text), F.col("_search_found"), year_field, year_pattern)
    return found.withColumn("filters", filters).drop("_search_found")


def with_slots(df: DataFrame, text: str, **patterns: str) -> DataFrame:
    """One integer column per pattern."""
    return df.withColumns({name: L.slot(F.col(text), p) for name, p in patterns.items()})


def label_accuracy(labelled: DataFrame, expected: str, actual: str) -> DataFrame:
    """Total, correct and accuracy in one row; a null label is wrong."""
    right = F.count_if(F.col(expected).eqNullSafe(F.col(actual)))
    total = F.count(F.lit(1))
    accuracy = F.coalesce(F.round(right / F.nullif(total, F.lit(0)), 4), F.lit(0.0))
    return labelled.agg(
        total.alias("total"), right.alias("correct"), accuracy.alias("accuracy")
    )


def wrong_labels(labelled: DataFrame, expected: str, actual: str) -> DataFrame:
    """The rows whose label is not the expected one."""
    return labelled.filter(~F.col(expected).eqNullSafe(F.col(actual)))

