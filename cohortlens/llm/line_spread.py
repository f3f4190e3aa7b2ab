"""Line dedup by distinct-site spread: boilerplate is what many sites share.

Each line's sites go into a HyperLogLog sketch per line hash; sketches merge by aggregation, so
a line that fills a third of the table arrives once per task. Lines whose estimate is clear of
the threshold are decided by it; the lines near it get an exact distinct count. Removal joins
line hashes, never texts, and gives each document the positions to drop.

A line counts by its text without surrounding spaces. Lines of fewer than ``min_words`` words
recur by chance and always stay.

Defined results: a null text stays null and an empty one empty; rows without a site add none to
a line's spread, but lose boilerplate like any other; null and repeated ids and repeated rows are
kept as they are; a document may end up empty; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import stored

MIN_SITES = 10
MIN_WORDS = 3
LG_K = 12  # sketches of 4,096 registers: a standard error of 1.04 / 64
BAND = 4 * 1.04 / 64  # lines within four standard errors of the threshold count exactly


def _bare(line: Column) -> Column:
    return F.trim(line)


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_table(rows: DataFrame, min_words: int) -> DataFrame:
    """(h1, h2, site, doc, pos) of every line long enough; ``rows`` has doc, text and site."""
    long_enough = " +".join(["[^ ]+"] * min_words)
    return (
        rows.select("doc", "site", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
        .select("doc", "site", "pos", _bare(F.col("line")).alias("line"))
        .where(F.col("line").rlike(long_enough))
        .select(
            F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), F.col("line")).alias("h2"),
            "site", "doc", "pos",
        )
    )


def widespread(lines: DataFrame, min_sites: int) -> DataFrame:
    """(h1, h2) of the lines found on at least ``min_sites`` sites."""
    sketches = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    spread = stored(
        sketches.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites")).where(
            F.col("sites") >= min_sites / (1 + BAND) - 1
        ),
        "spread",
    )
    clear = F.col("sites") > min_sites * (1 + BAND) + 1
    exact = (
        lines.join(spread.where(~clear).select("h1", "h2"), ["h1", "h2"], "left_semi")
        .groupBy("h1", "h2").agg(F.countDistinct("site").alias("sites"))
        .where(F.col("sites") >= min_sites)
    )
    return spread.where(clear).select("h1", "h2").union(exact.select("h1", "h2"))


def remove_boilerplate(
    df: DataFrame,
    min_sites: int = MIN_SITES,
    min_words: int = MIN_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
) -> DataFrame:
    """The rows of ``df`` as (row, text, n_lines, n_removed): ``row`` holds all its columns."""
    rows = df.select(
        F.struct("*").alias("row"),
        F.col(text_col).alias("text"),
        F.col(site_col).alias("site"),
        # Rows equal in id and text lose the same lines.
        F.struct(
            F.xxhash64(F.col(id_col), F.col(text_col)).alias("a"),
            F.xxhash64(F.lit(7), F.col(id_col), F.col(text_col)).alias("b"),
        ).alias("doc"),
    )
    lines = line_table(rows.select("doc", "text", "site"), min_words)
    found = stored(widespread(lines, min_sites), "boilerplate")
    hits = (
        lines.join(found, ["h1", "h2"], "left_semi")
        .groupBy("doc").agg(F.collect_set("pos").alias("gone"))
    )
    joined = rows.join(hits, "doc", "left")
    kept = F.filter(_lines(F.col("text")), lambda _, i: ~F.array_contains("gone", i))
    return joined.select(
        "row",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.size(_lines(F.coalesce("text", F.lit("")))).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


ORACLE = rf"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
b AS (
  SELECT trim(line) AS bare FROM l
  WHERE regexp_matches(trim(line), '{" +".join(["[^ ]+"] * MIN_WORDS)}')
  GROUP BY 1 HAVING count(DISTINCT source) >= {MIN_SITES}),
m AS (SELECT l.*, b.bare IS NOT NULL AS gone FROM l LEFT JOIN b ON trim(l.line) = b.bare)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_md5
FROM m GROUP BY doc_id
"""
