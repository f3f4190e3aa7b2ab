"""Keyword tests on a text column.

A lexicon is a small spec, so each word becomes one compiled substring search over the row:
no join, no shuffle. For a lexicon of thousands of words use ``lexicon_scores_by_join``.

``match="substring"`` finds a word anywhere, as in "ed" in "need". ``match="token"`` wants
words in Latin letters or digits to stand alone; words in other scripts, which are not
separated by blanks, still match anywhere.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.text import collapse_space, strip_space


def once(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """``df`` with ``values`` as further columns, each computed once per row.

    As plain columns, a filter on a result would be pushed below it and the expression
    computed again for the filter. Filters stay above the array of one row used here.
    """
    packed = df.select("*", F.struct(*[c.alias(k) for k, c in values.items()]).alias("_once"))
    return packed.select("*", F.inline(F.array("_once"))).drop("_once")


def let(values: Mapping[str, Column], body: Callable[[Column], Column]) -> Column:
    """``body`` over a struct of ``values``, each computed once per row.

    With a chain of projections instead, a filter on the result would be pushed below them
    and every mention of a value replaced by its whole expression, step after step.
    """
    bound = F.array(F.struct(*[c.alias(k) for k, c in values.items()]))
    return F.element_at(F.transform(bound, body), 1)


NOT_WORD = r"[^a-z0-9_+]+"


# East Asian characters and what lies beyond them. A word with such a character cannot occur
# in a text without any, and one look at the text tells.
_WIDE = "[\\u2e80-\\uffff]"


def search_parts(text: Column, match: str = "substring") -> dict[str, Column]:
    """The text as the word tests search it (low) and whether it has wide characters (wide)."""
    if match not in ("substring", "token"):
        raise ValueError(f"unknown match mode: {match!r}")
    low = F.lower(text)
    wide = F.rlike(text, F.lit(_WIDE))
    if match == "token":
        # The text as it is, then its Latin words with single blanks around each of them.
        words = F.regexp_replace(low, NOT_WORD, " ")
        low = F.concat(low, F.lit("\n "), words, F.lit(" "))
    return {"low": low, "wide": wide}


def searchable(text: Column, match: str = "substring") -> Column:
    """``search_parts`` as a struct. Compute it once per row, with ``let``."""
    return F.struct(*[c.alias(k) for k, c in search_parts(text, match).items()])


def word_weight(word: str) -> float:
    """Longer words say more: a quarter per character, at most 1."""
    return min(1.0, len(word) / 4)


def _needle(word: str, match: str) -> str:
    """What ``searchable`` text contains when the word occurs in it."""
    word = word.lower()
    if match == "token" and word.isascii():
        return f" {re.sub(NOT_WORD, ' ', word).strip()} "
    return word


# What the word tests take: columns ``low`` and ``wide``, apart or in a struct.
Prepared = Column | Mapping[str, Column]


def _occurs(prepared: Prepared, word: str, match: str) -> Column:
    if not word:
        raise ValueError("an empty word would occur in every text")
    found = F.contains(prepared["low"], F.lit(_needle(word, match)))
    return prepared["wide"] & found if re.search(_WIDE, word) else found


def _balanced(op: Callable[[Column, Column], Column], columns: list[Column]) -> Column:
    """The columns joined by ``op`` as a tree of low depth, in their order."""
    while len(columns) > 1:
        pairs = [columns[i : i + 2] for i in range(0, len(columns), 2)]
        columns = [reduce(op, pair) for pair in pairs]
    return columns[0]


def _those(pairs: list[tuple[str, Column]]) -> Column:
    """The names whose test holds, in order."""
    if not all(name for name, _ in pairs):
        raise ValueError("names must not be empty")
    # An empty name marks the others; removing it stays in compiled code.
    marked = [F.when(test, F.lit(name)).otherwise("") for name, test in pairs]
    return F.array_remove(F.array(*marked), "") if marked else F.array().cast("array<string>")


# Beyond so many words the generated code is too large to compile; the same tests then run
# over a literal table of the words.
COMPILED_WORDS = 500


def _named(
    prepared: Prepared, entries: list[tuple[str, Sequence[str]]], match: str, total: int
) -> Column:
    """The names of which a word occurs, in order; ``total`` words are tested side by side."""
    if total <= COMPILED_WORDS:
        return _those([(name, _any(prepared, ws, match)) for name, ws in entries])
    rows = [
        {"name": name, "words": [{"n": _needle(w, match), "w": bool(re.search(_WIDE, w))} for w in ws]}
        for name, ws in entries
    ]
    schema = "array<struct<name: string, words: array<struct<n: string, w: boolean>>>>"

    def occurs(word: Column) -> Column:
        return (prepared["wide"] | ~word["w"]) & F.contains(prepared["low"], word["n"])

    table = F.from_json(F.lit(json.dumps(rows)), schema)
    found = F.filter(table, lambda e: F.exists(e["words"], occurs))
    return F.transform(found, lambda e: e["name"])


def _any(prepared: Prepared, words: Sequence[str], match: str) -> Column:
    tests = [_occurs(prepared, w, match) for w in words]
    return _balanced(lambda a, b: a | b, tests or [F.lit(False)])


def any_word(prepared: Prepared, words: Sequence[str], match: str = "substring") -> Column:
    if len(words) <= COMPILED_WORDS:
        return _any(prepared, words, match)
    return F.size(_named(prepared, [("any", words)], match, len(words))) > 0


def hit_score(prepared: Prepared, words: Sequence[str], match: str = "substring") -> Column:
    """Summed weight of the words that occur."""
    by_weight: dict[float, list[str]] = {}
    for w in words:
        by_weight.setdefault(word_weight(w), []).append(w)
    # Flat arrays of the words of one weight; a sum over all words would nest too deeply.
    sums = [
        F.size(_named(prepared, [(w, [w]) for w in ws], match, len(words))) * weight
        for weight, ws in by_weight.items()
    ]
    return reduce(lambda a, b: a + b, sums, F.lit(0.0))


def words_found(
    prepared: Prepared, lexicon: Mapping[str, Sequence[str]], match: str = "substring"
) -> Column:
    """(label, hits) for every label, hits in lexicon order."""
    total = sum(map(len, lexicon.values()))
    entries = [
        F.struct(
            F.lit(label).alias("label"),
            _named(prepared, [(w, [w]) for w in words], match, total).alias("hits"),
        )
        for label, words in lexicon.items()
    ]
    return F.array(*entries)


def scored(found: Column) -> Column:
    """(label, score, hits) for the labels that occur, from ``words_found``."""

    def weighed(entry: Column) -> Column:
        total = F.aggregate(
            entry["hits"], F.lit(0.0), lambda t, w: t + F.least(F.lit(1.0), F.length(w) / 4)
        )
        return F.struct(entry["label"].alias("label"), total.alias("score"), entry["hits"].alias("hits"))

    return F.transform(F.filter(found, lambda e: F.size(e["hits"]) > 0), weighed)


def lexicon_hits(
    prepared: Prepared, lexicon: Mapping[str, Sequence[str]], match: str = "substring"
) -> Column:
    """(label, score, hits) for the labels that occur; hits in lexicon order."""
    return scored(words_found(prepared, lexicon, match))


def mentions(
    prepared: Prepared, lexicon: Mapping[str, Sequence[str]], match: str = "substring"
) -> Column:
    """The labels of which at least one word occurs, in lexicon order."""
    return _named(prepared, list(lexicon.items()), match, sum(map(len, lexicon.values())))


Values = Mapping[str, Mapping[str, Sequence[str]]]


def best_synonym(prepared: Prepared, values: Values, match: str = "substring") -> Column:
    """(dimension, value) of the longest word that occurs; the earlier one wins a tie."""
    entries = [
        (dim, value, word) for dim, by in values.items() for value, ws in by.items() for word in ws
    ]
    entries.sort(key=lambda e: len(e[2]), reverse=True)
    if len(entries) > COMPILED_WORDS:
        named = [(json.dumps({"dimension": d, "value": v}), [w]) for d, v, w in entries]
        first = F.get(_named(prepared, named, match, len(entries)), F.lit(0))
        return F.from_json(first, "struct<dimension: string, value: string>")
    chain = F.when(F.lit(False), F.lit(None).cast("struct<dimension: string, value: string>"))
    for dim, value, word in entries:
        named = F.struct(F.lit(dim).alias("dimension"), F.lit(value).alias("value"))
        chain = chain.when(_occurs(prepared, word, match), named)
    return chain


def values_found(prepared: Prepared, values: Values, match: str = "substring") -> Column:
    """(field, values) for every field."""
    total = sum(len(ws) for by in values.values() for ws in by.values())
    entries = [
        F.struct(
            F.lit(dim).alias("field"),
            _named(prepared, list(by.items()), match, total).alias("values"),
        )
        for dim, by in values.items()
    ]
    return F.array(*entries)


def as_filters(
    text: Column, found: Column, year_field: str | None = None, year_pattern: str = ""
) -> Column:
    """Filters (field, op, values) from ``values_found`` and the years in the text.

    Several values of one field become one ``in`` filter; as separate ``eq`` filters they
    would exclude each other.
    """
    if year_field:
        years = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({year_pattern})"), F.lit(1)))
        years = F.coalesce(years, F.array().cast("array<string>"))
        in_year = F.struct(F.lit(year_field).alias("field"), years.alias("values"))
        found = F.concat(found, F.array(in_year))

    def shown(entry: Column) -> Column:
        op = F.when(F.size(entry["values"]) > 1, "in").otherwise("eq")
        return F.struct(entry["field"].alias("field"), op.alias("op"), entry["values"].alias("values"))

    return F.transform(F.filter(found, lambda e: F.size(e["values"]) > 0), shown)


def filters_found(
    text: Column,
    prepared: Prepared,
    values: Values,
    year_field: str | None = None,
    year_pattern: str = "",
    match: str = "substring",
) -> Column:
    """Filters (field, op, values) that the text asks for."""
    return as_filters(text, values_found(prepared, values, match), year_field, year_pattern)


def slot(text: Column, pattern: str) -> Column:
    """The first group of the first match as an integer, else null."""
    return F.regexp_extract(text, pattern, 1).try_cast("int")


def normalise_query(text: Column) -> Column:
    """Single blanks, trimmed; null reads as empty."""
    return collapse_space(F.coalesce(text, F.lit("")))


def value_key(raw: Column) -> Column:
    """A raw value as it is compared with the synonym table."""
    return strip_space(raw)
