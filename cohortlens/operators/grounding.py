"""Grounding verdicts for a table of generated texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.grounding import numbers_in_text, source_numbers, unmatched_numbers


def ground(df: DataFrame, text: str, source: str, tolerance: float = 0.02) -> DataFrame:
    """Add source_numbers, text_numbers, unmatched and passed; a projection, no shuffle.

    ``source`` names a struct, list, map or number column that the text reports on.
    """
    read = df.withColumns(
        {
            "source_numbers": source_numbers(F.col(source), df.schema[source].dataType),
            "text_numbers": numbers_in_text(F.col(text)),
        }
    )
    open_numbers = unmatched_numbers(F.col("text_numbers"), F.col("source_numbers"), tolerance)
    judged = read.withColumn("unmatched", open_numbers)
    return judged.withColumn("passed", F.size("unmatched") == 0)
