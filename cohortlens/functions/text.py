"""String cleaning as column expressions.

The builders keep each regular expression to one evaluation per value, and nothing here
starts a Python worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "Unknown"

# The Unicode white space class, as Python's \s and str.strip see it.
WHITESPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# Strings that stand for "no value", compared without regard to case.
PLACEHOLDERS = ("", "nan", "none", "null", "na", "n/a", "<na>")

# Further strings that a CSV reader of the pandas family takes as missing.
READER_MISSING = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "1.#IND", "1.#QNAN",
)


def collapse_space(c: Column) -> Column:
    """Runs of white space (NBSP, U+3000 and the like included) to one blank; trimmed."""
    return F.trim(F.regexp_replace(c, WHITESPACE + "+", " "))


def strip_space(c: Column) -> Column:
    """Remove white space at both ends; ``F.trim`` alone knows only the ASCII blank."""
    return F.regexp_replace(c, f"^{WHITESPACE}+|{WHITESPACE}+$", "")


# Printable ASCII words with single blanks between them: nothing to collapse or trim.
_TIDY = r"^[!-~]++(?: [!-~]++)*+\z"


def clean_text(
    c: Column,
    unknown: str = UNKNOWN,
    placeholders: Iterable[str] = PLACEHOLDERS + READER_MISSING,
) -> Column:
    """Collapse white space; null and placeholder strings become ``unknown``.

    Codes use the same rule: they stay strings, so leading zeros survive. Most values are
    tidy already and pay for one cheap test only; the rest take two regular expressions.
    """
    words = [p.lower() for p in placeholders if p]
    # An empty value matches the pattern too, hence the "?" after the group.
    missing = rf"^(?i:{'|'.join(re.escape(w) for w in words)})?\z"
    marked = F.regexp_replace(collapse_space(c), missing, unknown.replace("$", r"\$"))
    tidy = F.when(F.lower(c).isin(words), unknown).otherwise(c)
    return F.when(F.rlike(c, F.lit(_TIDY)), tidy).otherwise(
        F.coalesce(marked, F.lit(unknown))
    )


def _lookup(key: Column, mapping: Mapping[str, str], default: str) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def map_values(c: Column, mapping: Mapping[str, str], default: str = UNKNOWN) -> Column:
    """Look up the stripped lower-case value; anything not listed becomes ``default``."""
    return _lookup(F.lower(strip_space(c)), mapping, default)


def restrict_domain(c: Column, domain: Iterable[str], default: str = UNKNOWN) -> Column:
    """Keep the stripped upper-case value when it is listed, else ``default``."""
    return _lookup(F.upper(strip_space(c)), {v: v for v in domain}, default)


def normalise_name(name: str) -> str:
    """C1 for one name: separators and white space to single underscores, lower case."""
    return "_".join(re.sub(r"[-/()]", " ", str(name)).split()).lower()
