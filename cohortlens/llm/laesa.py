"""Centroid clustering over a LAESA pivot table.

Vectors become integers once, and their distances to a few fixed pivots are stored beside them:
the pivot table. A round measures the centroids against the pivots; for every vector the
largest difference of the two pivot distances is a lower bound of its distance to a centroid
(triangle inequality). The centroid with the least bound gets its exact integer distance first,
and only centroids whose bound does not exceed that distance get theirs. Bounds are floating and
are lowered by more than their rounding error, so no nearest centroid and no tie is ever lost.

A round is one pass over the stored table. Tasks return componentwise sums per centroid, which
Spark adds up exactly; the driver holds ``k`` centroids and the pivots, whatever the table's size.

Defined results: vectors that are null, of another length, or hold null or non-finite components
take no part; rows with a null id are clustered but never start a centroid; repeated rows count
as often as they occur; with fewer than ``k`` usable vectors there are fewer centroids; an
empty table gives an empty result. Components too large for 64-bit arithmetic are computed with
Python's integers; a squared distance beyond 64 bits is an error, as the result cannot hold it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import stored

PIVOTS = 12
PIVOT_SAMPLE = 1024  # rows, by the order of a hash, from which pivots are chosen
SLACK = 1e-9  # bounds are lowered by this share of the distances they come from
SAFE = 1 << 25  # components up to here: squared distances of 1024 of them fit 64 bits

TABLE = "id long, vector array<decimal(38,0)>, pivots array<double>"


def whole(values: np.ndarray) -> np.ndarray:
    """Integers of whole doubles: 64-bit where that is exact, else Python's own."""
    if values.size == 0 or np.abs(values).max() <= SAFE:
        return values.astype(np.int64)
    return np.array([int(v) for v in values.ravel()], object).reshape(values.shape)


def exact(vectors: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of each vector to its own or the one ``centre``."""
    if object in (vectors.dtype, centre.dtype):
        vectors, centre = vectors.astype(object), centre.astype(object)
    gap = vectors - centre
    return (gap * gap).sum(axis=1)


def away(vectors: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Distances as doubles, correct to a few units in the last place."""
    gap = (vectors - centre).astype(np.float64)
    return np.sqrt((gap * gap).sum(axis=1))


def rows_of(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix; whole numbers stay exact."""
    flat = column.flatten()
    if pa.types.is_decimal(flat.type):
        return np.array([int(v) for v in flat.to_pylist()], object).reshape(-1, width)
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width)


def assign(
    vectors: np.ndarray, pivots: np.ndarray, centres: np.ndarray, reach: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (smaller number on ties), exact squared distance, exact distances used.

    ``pivots`` are the stored distances of the vectors, ``reach`` those of the centroids.
    """
    n, k = len(vectors), len(centres)
    bound = np.zeros((n, k))
    for p in range(reach.shape[1]):
        own, other = pivots[:, p, None], reach[None, :, p]
        np.maximum(bound, np.abs(own - other) - SLACK * (own + other), out=bound)
    nearest = bound.argmin(axis=1)
    best = exact(vectors, centres[nearest])
    # The same slack keeps a centroid whose distance ties with the best so far.
    limit = np.sqrt(best.astype(np.float64)) * (1 + SLACK)
    used = np.ones(n, np.int32)
    first = nearest.copy()
    for c in range(k):
        at = np.flatnonzero((bound[:, c] <= limit) & (first != c))
        used[at] += 1
        found = exact(vectors[at], centres[c])
        better = (found < best[at]) | ((found == best[at]) & (c < nearest[at]))
        nearest[at[better]] = c
        best[at[better]] = found[better]
    return nearest, best, used


def usable(df: DataFrame, dims: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) of the vectors that take part."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return df.where((F.size(vector_col) == dims) & finite).select(
        F.col(id_col).cast("long").alias("id"), x.alias("x")
    )


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    return whole(np.floor(scale * x))


def farthest(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots far from each other: each next one has the largest sum of distances so far."""
    if not len(sample):
        return sample
    chosen = [0]
    total = away(sample, sample[0])
    while len(chosen) < min(count, len(sample)):
        rest = total.copy()
        rest[chosen] = -1
        chosen.append(int(rest.argmax()))
        total += away(sample, sample[chosen[-1]])
    return sample[chosen]


def _measure(
    batches: Iterator[pa.RecordBatch], dims: int, scale: int, pivots: np.ndarray, wide: bool
) -> Iterator[pa.RecordBatch]:
    kind = pa.decimal128(38, 0) if wide else pa.int64()
    for batch in batches:
        vectors = integers(rows_of(batch.column("x"), dims), scale)
        far = np.stack([away(vectors, p) for p in pivots], axis=1)
        ends = np.arange(0, (len(vectors) + 1) * dims, dims, dtype=np.int32)
        marks = np.arange(0, (len(vectors) + 1) * len(pivots), len(pivots), dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(_decimals(vectors, wide), kind)),
                pa.ListArray.from_arrays(pa.array(marks), pa.array(far.ravel())),
            ],
            ["id", "vector", "pivots"],
        )


def _decimals(vectors: np.ndarray, wide: bool) -> object:
    from decimal import Decimal

    return [Decimal(int(v)) for v in vectors.ravel()] if wide else vectors.ravel()


def _look(batch: pa.RecordBatch, centres: np.ndarray, reach: np.ndarray) -> tuple:
    vectors = rows_of(batch.column("vector"), centres.shape[1])
    return vectors, *assign(vectors, rows_of(batch.column("pivots"), reach.shape[1]), centres, reach)


def _sums(
    batches: Iterator[pa.RecordBatch], centres: np.ndarray, reach: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """Per centroid, the count (as component -1) and the sums of the components, of one task."""
    totals = np.zeros((len(centres), centres.shape[1] + 1), object)
    for batch in batches:
        vectors, nearest, _, _ = _look(batch, centres, reach)
        for c in np.unique(nearest):
            own = vectors[nearest == c]
            totals[c, 0] += len(own)
            totals[c, 1:] += own.sum(axis=0).astype(object)
    at = [(c, d) for c in range(totals.shape[0]) if totals[c, 0] for d in range(totals.shape[1])]
    if at:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([c for c, _ in at], pa.int32()),
                pa.array([d - 1 for _, d in at], pa.int32()),
                pa.array([totals[p] for p in at], pa.decimal128(38, 0)),
            ],
            ["cluster", "component", "total"],
        )


def _place(
    batches: Iterator[pa.RecordBatch], centres: np.ndarray, reach: np.ndarray
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, nearest, best, used = _look(batch, centres, reach)
        columns = [batch.column("id"), pa.array(nearest, pa.int32()), pa.array(best.tolist(), pa.int64()), pa.array(used)]
        yield pa.RecordBatch.from_arrays(columns, ["id", "cluster", "distance", "n_exact"])


def _reach(centres: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([away(centres, p) for p in pivots], axis=1)


def cluster(
    df: DataFrame,
    dims: int = 64,
    k: int = 8,
    rounds: int = 10,
    scale: int = 1024,
    salt: str = "3",
    pivots: int = PIVOTS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance, n_exact) per usable vector, and the final centroids.

    A component x becomes floor(scale * x). The first centroids are the ``k`` vectors with the
    least sha256 of ``salt:id``. Each round assigns every vector to its nearest centroid and
    replaces every centroid that has vectors by floor(sum / count); then vectors are assigned
    once more. ``n_exact`` is the number of exact distances that a vector needed then.
    """
    vectors = usable(df, dims, id_col, vector_col)
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    named = vectors.where("id IS NOT NULL").withColumn("h", order)
    # Two bounded samples: the starts and, in the same order, the rows pivots are chosen from.
    sample = named.orderBy("h", "x").limit(max(k, PIVOT_SAMPLE)).select("x").collect()
    if not sample:
        # Only rows without an id, or none: nothing can start a centroid.
        return vectors.limit(0).selectExpr("id", "0 cluster", "0L distance", "0 n_exact"), []
    chosen = integers(np.array([r.x for r in sample]), scale)
    centres, fixed = chosen[:k], farthest(chosen, pivots)
    top = vectors.agg(F.max(F.array_max(F.transform("x", F.abs)))).head()[0]
    wide = bool(top * scale > SAFE)
    kind = "decimal(38,0)" if wide else "long"
    table = stored(
        vectors.mapInArrow(
            partial(_measure, dims=dims, scale=scale, pivots=fixed, wide=wide),
            f"id long, vector array<{kind}>, pivots array<double>",
        ),
        "pivot-table",
    )
    for _ in range(rounds):
        step = partial(_sums, centres=centres, reach=_reach(centres, fixed))
        sums = table.select("vector", "pivots").mapInArrow(step, "cluster int, component int, total decimal(38,0)")
        # At most k * (dims + 1) rows.
        found = sums.groupBy("cluster", "component").agg(F.sum("total").alias("total")).collect()
        by_place = {(r.cluster, r.component): int(r.total) for r in found}
        moved = [
            [by_place[c, d] // by_place[c, -1] for d in range(dims)] if (c, -1) in by_place else centres[c].tolist()
            for c in range(len(centres))
        ]
        centres = _matrix(moved)
    step = partial(_place, centres=centres, reach=_reach(centres, fixed))
    out = stored(table.mapInArrow(step, "id long, cluster int, distance long, n_exact int"), "assigned")
    return out, [[int(x) for x in c] for c in centres]


def _matrix(rows: list[list[int]]) -> np.ndarray:
    top = max(abs(x) for r in rows for x in r)
    return np.array(rows, np.int64 if top <= SAFE else object)


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """The assignment with the sums of distances and the digest of each centroid's components."""
    # One row per centroid, so both sides of this join are bounded by k.
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    total = sum(int(r.s) for r in sums)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    rows = [(r.cluster, int(r.s), total, digest[r.cluster]) for r in sums]
    facts = assigned.sparkSession.createDataFrame(
        rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return assigned.join(F.broadcast(facts), "cluster")
