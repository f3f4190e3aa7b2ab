"""Registered queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import line_spread, rules

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.simhash import hexadecimal, near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", hexadecimal("fp").alias("fingerprint"), "component_id"
    )


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.packing import pack

    # The ids go through packing; of them the result shows the digest.
    return pack(table(spark, sf_dir, "documents"), word_vocabulary()).drop("ids")


@query
def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op7_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_spread.remove_boilerplate(table(spark, sf_dir, "documents"))
    return found.select(
        "row.doc_id", "n_lines", "n_removed",
        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"),
    )


ORACLES["op7_line_spread"] = line_spread.ORACLE


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.quality import THRESHOLD, fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs)).select(
        "doc_id", "score", (F.col("score") >= THRESHOLD).alias("kept")
    )


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).select(
        "row.doc_id", "source", "n_tokens", "weight", "repetitions",
        "epoch", "block", "block_order", "doc_order",
    )


@query
def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.minhash import compare_with_edits, likeness, packed

    return compare_with_edits(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        packed("signature").alias("fingerprint"),
        packed("edited_signature").alias("edited_fingerprint"),
        likeness("signature", "edited_signature").alias("near_edited"),
        likeness("signature", "next_signature").alias("near_next"),
    )


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.warc import read_archives, write_archives

    path = write_archives(table(spark, sf_dir, "pages"))
    return read_archives(spark, path, keep_payload=False)


@query
def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.pii import KINDS, find_personal_data, listed

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    found = find_personal_data(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )


@query
def op11_laesa(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.laesa import cluster, with_inertia

    assigned, centroids = cluster(table(spark, sf_dir, "embeddings"))
    return with_inertia(assigned.withColumnRenamed("id", "vec_id"), centroids)


@query
def op12_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score",
        "base_failed", "kept",
    )


ORACLES["op12_rules"] = rules.ORACLE


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from cohortlens.llm.alignment import align

    paths = (str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    found = align(table(spark, sf_dir, "documents"), *paths)
    text = F.col("groups")
    digest = F.when(text == "", "").otherwise(F.sha2(text.cast("binary"), 256))
    docs = found.documents.select(
        "row", "doc_id", "n_a", "n_b", "n_groups", F.size("links").cast("long").alias("n_links"), digest.alias("groups_sha256")
    )
    zero = F.lit(0).cast("long")
    return docs.join(found.scores, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"),
        "groups_sha256",
    )
