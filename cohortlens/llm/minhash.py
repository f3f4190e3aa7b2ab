"""Document fingerprints: one-permutation MinHash in column expressions.

Every shingle of ``SIZE`` words is hashed once. The leading bits of the hash name one of ``BINS``
bins, and a bin keeps its least hash. An empty bin tries bins of its own random sequence until one is
occupied and takes that value: optimal densification, each empty bin choosing anew and
uniformly. ``BITS`` low bits of every bin are stored, and the likeness of two
fingerprints, the share of equal bins, is corrected for bins that agree by chance.

Defined results: null text counts as empty; fewer than ``SIZE`` words are one shingle, none give
the empty fingerprint, which is like itself (1) and unlike any other (0). For the next document,
rows come in the order of doc_id, null first, equal ids by a hash of their text; repeated rows
follow each other; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.llm.common import documents, row_key, stored

SIZE = 5
BINS = 128  # two bitmaps of 64 bins
BITS = 8
RANGE_ROWS = 2_000  # documents in a range of ids, on average
MAX_RANGES = 32_768  # bounds the list of range ends that the driver holds
MAX_HOT = 1_000  # ids that can have a share of their own of the rows
SUBRANGES = 256  # ranges that such an id is divided into

_WHITE = "\t\n\x0b\x0c\r"


def _words(text: Column) -> Column:
    bare = F.trim(F.translate(F.lower(text), _WHITE, " " * len(_WHITE)))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " +"))


def _bin(h: Column) -> Column:
    """0 to BINS - 1, ascending with the signed hash."""
    return F.shiftright(h, 57) + 64


def probes(n: int = 8) -> list[list[int]]:
    """For every bin the bins it tries when it is empty: independent and uniform."""
    return [[hashlib.sha256(b"%d:%d" % (j, k)).digest()[0] % BINS for j in range(BINS)] for k in range(n)]


def with_signature(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``, an array of BINS stored values, or none for a text without words."""
    long = lambda n: F.lit(n).cast("long")
    shifted = lambda n, by: F.call_function("shiftleft", long(n), by)
    keep = [F.col(c) for c in df.columns]
    step = df.select(*keep, F.transform(_words(F.col(text)), lambda w: F.xxhash64(w)).alias("_w"))
    w = F.col("_w")
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(w) - SIZE),
        lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(SIZE))),
    )
    none = F.array().cast("array<bigint>")
    few = F.when(F.size(w) == 0, none).otherwise(F.array(F.xxhash64(w)))
    step = step.select(
        *keep, F.sort_array(F.when(F.size(w) <= SIZE, few).otherwise(hashes)).alias("_s")
    )
    s = F.col("_s")
    least = F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1))))
    step = step.select(*keep, least.alias("_m"))
    m = F.col("_m")

    def bitmap(half: int) -> Column:
        """Occupied bins of one half; shifts of longs use the low six bits of the bin."""
        return F.aggregate(
            m,
            long(0),
            lambda a, x: F.when(
                F.shiftright(_bin(x), 6) == half, a.bitwiseOR(shifted(1, _bin(x).cast("int")))
            ).otherwise(a),
        )

    step = step.select(*keep, "_m", bitmap(0).alias("_low"), bitmap(1).alias("_high"))
    step = step.select(
        *keep, "_m", F.array("_low", "_high").alias("_b"), F.array(F.lit(0), F.bit_count("_low")).alias("_n")
    )

    def held(j: Column) -> Column:
        """The least hash of an occupied bin: the n-th of all, n occupied bins being below."""
        half = F.shiftright(j, 6)
        bits = F.get(F.col("_b"), half)
        rank = F.get(F.col("_n"), half) + F.bit_count(bits.bitwiseAND(F.bitwise_not(shifted(-1, j))))
        occupied = F.call_function("shiftrightunsigned", bits, j).bitwiseAND(long(1)) == 1
        return F.when(occupied, F.get(m, rank))

    bins = F.sequence(F.lit(0), F.lit(BINS - 1))
    step = step.select(*keep, "_m", F.transform(bins, held).alias("_d"))
    tried = [F.array(*map(F.lit, own)) for own in probes()]

    def value(x: Column, j: Column) -> Column:
        # Few texts come past the probes, and those have few occupied bins.
        nearest = F.array_min(
            F.transform(m, lambda y: F.struct(F.xxhash64(j, _bin(y)).alias("o"), y.alias("y")))
        ).getField("y")
        found = F.coalesce(x, *(F.get(F.col("_d"), F.get(p, j)) for p in tried), nearest)
        return F.xxhash64(found, j).bitwiseAND(long((1 << BITS) - 1)).cast("int")

    signature = F.when(F.size("_m") == 0, F.array().cast("array<int>")).otherwise(
        F.transform("_d", value)
    )
    return step.select(*keep, signature.alias(name))


def packed(signature: str) -> Column:
    """The stored bits as hexadecimal digits."""
    return F.array_join(F.transform(signature, lambda v: F.lpad(F.lower(F.hex(v)), 2, "0")), "")


def likeness(a: str, b: str) -> Column:
    chance = 2.0**-BITS
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / BINS
    estimate = F.greatest(F.lit(0.0), (equal - chance) / (1 - chance))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0)
        .when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
        .otherwise(estimate)
    )


def _range_of(column: str, ends: list[int]) -> Column:
    """How many range ends lie below the id, by bisection; -1 for null ids."""
    place = F.lit(0)
    if ends:
        list_of_ends = F.lit(np.array(ends, np.int64))
        steps = [1 << k for k in range(len(ends).bit_length() - 1, -1, -1)]
        place = F.aggregate(
            F.array(*map(F.lit, steps)),
            F.lit(0),
            lambda at, step: F.when(F.get(list_of_ends, at + step - 1) < F.col(column), at + step).otherwise(at),
        )
    return F.when(F.col(column).isNull(), -1).otherwise(place)


def _with_range(docs: DataFrame) -> DataFrame:
    """Adds ``range``, a number that ascends with (doc_id, key) and divides the rows evenly.

    Ranges end at quantiles of the ids. An id of very many rows (null, too) is a range of its own,
    divided once more by the leading bits of the key.
    """
    count = docs.select("doc_id").count()
    ranges = min(MAX_RANGES, -(-count // RANGE_ROWS))
    shares = [i / ranges for i in range(1, ranges)]
    ends = set()
    if shares:
        ends |= set(docs.agg(F.percentile_approx("doc_id", shares, 10 * ranges + 1000)).head()[0] or [])
    many = docs.groupBy("doc_id").count().where(F.col("count") > max(10 * RANGE_ROWS, count // MAX_HOT))
    hot = {r["doc_id"] for r in many.select("doc_id").collect()}  # at most MAX_HOT
    known = hot - {None}
    ends |= known | {i - 1 for i in known if i > -(1 << 63)}
    order = sorted(ends)
    own = sorted([bisect.bisect_left(order, i) for i in known] + [-1] * (None in hot))
    place = _range_of("doc_id", order).cast("long")
    ranged = docs.withColumn("range", place * SUBRANGES)
    if not own:
        return ranged
    part = F.shiftright("key", 64 - SUBRANGES.bit_length() + 1) + SUBRANGES // 2
    own_range = F.col("range").isin([i * SUBRANGES for i in own])
    return ranged.withColumn("range", F.col("range") + F.when(own_range, part).otherwise(0))


def with_next(docs: DataFrame) -> DataFrame:
    """Adds ``next_text`` and ``next_signature`` of the next document, after the last the first.

    Ids fall into ranges of about equal size; the next document is the next row of the range, and
    for the last row of a range the first of the next one. ``docs`` has doc_id, text, key and
    signature.
    """
    ranged = _with_range(docs)

    # One row per range: at most MAX_RANGES + (2 + SUBRANGES) * MAX_HOT, so one window may hold them.
    firsts = stored(
        ranged.groupBy("range").agg(F.min(F.struct("doc_id", "key")).alias("f")), "range-starts"
    )
    around = W.orderBy("range")
    first_of_all = F.first("f").over(around.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    after = firsts.select("range", F.coalesce(F.lead("f").over(around), first_of_all).alias("f"))
    tails = after.select(F.col("range").alias("tail"), F.col("f.doc_id").alias("i"), F.col("f.key").alias("k"))
    starts = docs.select("doc_id", "key", "text").join(
        F.broadcast(tails), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k"))
    )
    starts = stored(starts.dropDuplicates(["tail"]).select("tail", "text"), "starts")
    starts = with_signature(starts, "text", "tail_signature").withColumnRenamed("text", "tail_text")
    order = W.partitionBy("range").orderBy("doc_id", "key")
    follow = ranged.select(
        "*", F.lead("text").over(order).alias("next"), F.lead("signature").over(order).alias("next_sig")
    )
    return follow.join(starts, F.col("range") == F.col("tail"), "left").select(
        "doc_id",
        "text",
        "signature",
        F.coalesce("next", "tail_text").alias("next_text"),
        F.coalesce("next_sig", "tail_signature").alias("next_signature"),
    )


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) for every row of ``df``."""
    signed = with_signature(documents(df, id_col, text_col), "text", "signature")
    return signed.select("doc_id", packed("signature").alias("fingerprint"))


def compare_with_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document against its edited text and against the next document.

    Edited: the last quarter of the code points gives way to the first as many of the next
    document. Columns: doc_id, text, edited, signature, edited_signature, next_signature.
    """
    docs = documents(df, id_col, text_col).withColumn("key", row_key())
    docs = with_signature(docs, "text", "signature")
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(
        F.col("text").substr(F.lit(1), n - quarter), F.col("next_text").substr(F.lit(1), quarter)
    )
    both = with_next(docs).select("doc_id", "text", edited.alias("edited"), "signature", "next_signature")
    return with_signature(both, "edited", "edited_signature")
