"""Shared folder, tables and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's setting.

    Only a local session without the setting, as in tests, gets a folder of its own.
    """
    folder = spark.conf.get(SETTING, None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set(SETTING, folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str) -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (may be null or repeated) and the text; extra columns never get in the way."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))


def row_key() -> Column:
    """With the id, tells rows apart; rows equal in both get equal results anyway."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (node, root) per node of an edge.

    ``root`` is the smallest node reachable. Large-star and small-star steps alternate until
    nothing changes; links are never collected, and each round is a written table.
    """
    spark = edges.sparkSession
    ends = stored(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    mark = None
    for _ in range(max_rounds):
        both = ends.union(ends.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low"))
        low = low.select("a", F.least("a", "low").alias("low"))
        large = (
            both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        ).distinct()
        large = stored(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(
            F.explode(
                F.array(F.struct(F.col("b").alias("a"), "low"), F.struct("a", "low"))
            ).alias("e")
        )
        small = small.select("e.a", F.col("e.low").alias("b")).where("a <> b").distinct()
        ends = stored(small, "small-star")
        now = ends.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).head()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = ends.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return ends.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
