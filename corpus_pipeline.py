"""The corpus pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import stored
from cohortlens.llm.line_spread import remove_boilerplate
from cohortlens.llm.mixing import mix_sources
from cohortlens.llm.packing import pack
from cohortlens.llm.quality import keep_good
from cohortlens.llm.queries import word_vocabulary
from cohortlens.llm.simhash import near_duplicates


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sites share go; ``n_chars`` follows the text."""
    cleaned = remove_boilerplate(docs)
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(row.alias("row")).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component (three-word shingles, three bits) one row stays.

    Rows are told apart by a hash of all their columns, so null and repeated ids do no harm. The
    row with the smallest id stays (a null id comes last, the least hash decides between equal
    ids), and of rows equal in every column one.
    """
    # The hash skips nulls, so which columns are null goes into it as well.
    row = [*docs.columns, *[F.isnull(c) for c in docs.columns]]
    hashed = docs.withColumn("_key", F.xxhash64(*row))
    found = near_duplicates(hashed, id_col="_key").select(F.col("doc_id").alias("_key"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_key"))).alias("first")
    named = found.distinct().join(hashed.select("_key", "doc_id").distinct(), "_key")
    kept = named.groupBy("component_id").agg(first).select(F.col("first._key").alias("_key"))
    stay = hashed.join(kept, "_key", "left_semi").withColumn("_again", F.xxhash64(F.lit(1), *row))
    return stay.dropDuplicates(["_key", "_again"]).select(docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; small sources again, up to the repetition limit."""
    return mix_sources(docs).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of 2048, with their ids."""
    return pack(docs, word_vocabulary())


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", source_mixing),
    ("packing", packing),
]

# Classifier, fingerprints and tokens have no SQL; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not STAGES[-1][1]:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
