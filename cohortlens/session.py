"""Session settings that suit these jobs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# A generated method beyond 8,000 bytes is never compiled by the JVM. With this limit Spark
# splits very wide projections into small functions instead of fusing them.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
}


# Cleaning a row takes far longer than reading it, and a row grows when it is parsed.
RAW_SPLIT = "32m"


@contextmanager
def for_wide_rows(spark: SparkSession, raw_files: bool = False) -> Iterator[None]:
    """The limit above while a library function runs a job over wide rows, lower ones kept.

    With ``raw_files`` the splits of files are at most ``RAW_SPLIT`` too: of compressed files as many
    go into one task as have that size, so a task would get many times the rows.
    """
    limits = {"spark.sql.codegen.hugeMethodLimit": SETTINGS["spark.sql.codegen.hugeMethodLimit"]}
    if raw_files:
        limits["spark.sql.files.maxPartitionBytes"] = RAW_SPLIT
    before = {name: spark.conf.get(name) for name in limits}
    lower = {k: v for k, v in limits.items() if _size(v) < _size(before[k])}
    for name, value in lower.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name in lower:
            spark.conf.set(name, before[name])


def _size(text: str) -> int:
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)b?", text.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def with_settings(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder
