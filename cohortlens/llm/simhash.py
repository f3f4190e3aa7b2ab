"""SimHash near-duplicates: a Gray-order hierarchical index over fingerprints.

Fingerprints of whole texts are reduced to distinct values first, so a group of equal
fingerprints is one value however many documents share it. Values that differ in at most three
bits agree in at least one of four blocks of bits; a block and its bits are the top nodes of the
index. A bucket beyond ``max_bucket`` is divided again by the bits that are left, up to four
levels, after which at most 2**20 values can share a bucket. Inside a bucket the values are
sorted by their rank in Gray order, neighbours form nodes, and a node keeps the bits that all
its members share. Two nodes whose shared bits differ in more than three places cannot hold a
link, and the whole pair of groups is dropped; what is left goes down one level.

Only links that join two groups leave a task (a spanning forest), so a dense group never emits
all its pairs.

Defined results: null text counts as empty; empty texts have fingerprint zero and are linked
like any other; rows with a null id get a fingerprint and the component of their text, but never
name a component; repeated rows are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import components, documents, stored

U = np.uint64
SEED = 42
FAN = 8  # children of a node of the index
LANES = U(0x0101010101010101)


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    words = text.lower().split()  # bytes: only A-Z change, only ASCII white space divides
    if not words:
        return np.empty(0, U)
    if len(words) <= size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), U)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, counted in byte lanes."""
    n = len(hashes)
    if n == 0:
        return 0
    padded = np.zeros(-(-n // 255) * 255, U)
    padded[:n] = hashes
    padded = padded.reshape(-1, 255)
    counts = np.empty((8, 8), np.int64)  # [byte, bit in byte]
    for bit in range(8):
        lanes = ((padded >> U(bit)) & LANES).sum(axis=1, dtype=U)
        counts[:, bit] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    bits = (counts.reshape(-1) * 2 > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(U)[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; ``fp`` is a signed long with the fingerprint's bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            fps = np.fromiter((majority(shingle_hashes(t.as_py(), size)) for t in texts), U)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"]
            )

    return docs.mapInArrow(run, "doc_id long, fp long")


def gray_rank(values: np.ndarray) -> np.ndarray:
    for shift in (1, 2, 4, 8, 16, 32):
        values = values ^ (values >> U(shift))
    return values


def _join(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the groups of i[k] and j[k]; ``parent`` points straight at each group's least."""
    while len(i):
        a, b = parent[i], parent[j]
        differ = a != b
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def forest(bucket: np.ndarray, fps: np.ndarray, bits: int, chunk: int = 20_000) -> np.ndarray:
    """Edges (value, least value of its group) that span all links inside the buckets."""
    order = np.lexsort((gray_rank(fps), bucket))
    bucket, fps = bucket[order], fps[order]
    values, item = np.unique(fps, return_inverse=True)
    parent = np.arange(len(values))

    # Level 0 holds the values; a node above covers up to FAN neighbours of one bucket.
    levels = [(bucket, fps, fps, None)]
    while len(np.unique(bucket)) < len(bucket):
        first = np.r_[True, bucket[1:] != bucket[:-1]]
        run = np.flatnonzero(first)
        place = np.arange(len(bucket)) - np.repeat(run, np.diff(np.r_[run, len(bucket)]))
        starts = np.flatnonzero(place % FAN == 0)
        _, all_set, any_set, _ = levels[-1]
        bucket = bucket[starts]
        levels.append(
            (
                bucket,
                np.bitwise_and.reduceat(all_set, starts),
                np.bitwise_or.reduceat(any_set, starts),
                np.r_[starts, len(place)],
            )
        )
    top = len(levels) - 1
    roots = np.arange(len(levels[top][0]))
    work = [(top, roots[k : k + chunk], roots[k : k + chunk]) for k in range(0, len(roots), chunk)]
    while work:
        level, x, y = work.pop()
        if level == 0:
            _join(parent, item[x], item[y])
            continue
        child = levels[level][3]
        nx, ny = child[x + 1] - child[x], child[y + 1] - child[y]
        pair = np.repeat(np.arange(len(x)), nx * ny)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(nx * ny) - nx * ny, nx * ny)
        i, j = child[x][pair] + k // ny[pair], child[y][pair] + k % ny[pair]
        level -= 1
        keep = i < j if level == 0 else i <= j
        i, j = i[keep], j[keep]
        _, all_set, any_set, _ = levels[level]
        shared = ~(all_set[i] ^ any_set[i]) & ~(all_set[j] ^ any_set[j])
        near = np.bitwise_count((all_set[i] ^ all_set[j]) & shared) <= bits
        i, j = i[near], j[near]
        work += [(level, i[k : k + chunk], j[k : k + chunk]) for k in range(0, len(i), chunk)]
    moved = parent != np.arange(len(parent))
    return np.stack([values[moved], values[parent[moved]]])


def links(values: DataFrame, bits: int = 3, max_bucket: int = 50_000) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints ``fp`` at ``bits`` or fewer bits."""

    def divided(df: DataFrame, width: int) -> DataFrame:
        """Each row once for every block of its remaining ``width`` bits, without that block."""
        blocks, at = [], 0
        for b in range(bits + 1):
            size = width // (bits + 1) + (b < width % (bits + 1))
            low = F.col("rest").bitwiseAND(F.lit((1 << at) - 1))
            high = F.shiftrightunsigned("rest", at + size) if at + size < 64 else F.lit(0)
            key = F.shiftrightunsigned("rest", at).bitwiseAND(F.lit((1 << size) - 1))
            blocks.append(
                F.struct(
                    F.xxhash64(F.col("bucket"), F.lit(b), key).alias("bucket"),
                    low.bitwiseOR(F.shiftleft(high.cast("long"), at)).alias("rest"),
                )
            )
            at += size
        return df.select("fp", F.explode(F.array(*blocks)).alias("n")).select(
            "fp", "n.bucket", "n.rest"
        )

    rest = values.select("fp", F.lit(0).cast("long").alias("bucket"), F.col("fp").alias("rest"))
    width, small = 64, None
    while True:
        rest = divided(rest, width)
        width -= width // (bits + 1)
        if width <= 20:
            break
        full = rest.groupBy("bucket").count().where(F.col("count") > max_bucket).select("bucket")
        full = stored(full, "full-buckets")
        if full.isEmpty():
            break
        part = rest.join(full, "bucket", "left_anti").select("fp", "bucket", "rest")
        small = part if small is None else small.union(part)
        rest = rest.join(full, "bucket", "left_semi").select("fp", "bucket", "rest")
    rows = rest if small is None else small.union(rest)
    shards = max(1, values.count() * (bits + 1) // 60_000)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = forest(pdf["bucket"].to_numpy(), pdf["fp"].to_numpy().view(U), bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return (
        rows.select("fp", "bucket", F.pmod("bucket", F.lit(shards)).alias("shard"))
        .groupBy("shard")
        .applyInPandas(run, "a long, b long")
    )


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, bits: int = 3
) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``df``."""
    fps = stored(fingerprints(documents(df, id_col, text_col), size), "fingerprints")
    values = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "values")
    found = components(links(values.select("fp"), bits))
    roots = values.join(found, values.fp == found.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stored(roots.join(least, "root").select("fp", "component_id"), "classes")
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(column: str) -> Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")
