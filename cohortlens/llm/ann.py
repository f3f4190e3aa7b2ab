"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample of vectors (``SAMPLE`` rows, chosen by hash) and every
row descends to its leaf. A query keeps a priority queue of tree nodes, opens the node whose
centre has the largest inner product with it, and visits leaves in the order they surface. How
many leaves it visits is calibrated: for ``CALIBRATION`` sampled vectors the true neighbours are
found among all rows, and visits widen until the mean share of them that lies in visited leaves
reaches ``target``.

Neighbouring leaves form groups of bounded size, a leaf with more rows (many equal vectors) is
dealt over several; queries come in blocks. A task holds one group and one block, and emits at
most ``k`` rows per query. Scores are recomputed one vector at a time, so equal vectors get
equal scores wherever they lie.

Defined results: vectors that are null, zero, of another than the most common length, or hold
null or non-finite components take no part, nor do rows without an id; of repeated query ids the
least vector is searched for, and never finds rows of its own id; repeated rows are candidates
of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.llm.common import stored

SAMPLE = 16_384
CALIBRATION = 200
FAN = 8
MAX_LEAVES = 4_096
GROUP_ROWS = 16_384
BLOCK_QUERIES = 8_192


@dataclass
class Tree:
    centres: np.ndarray  # one row per node
    children: list[list[int]]  # of each node; none for a leaf
    leaf_of: dict[int, int]  # node to leaf number, neighbours in the tree being neighbours

    def descend(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.zeros(len(x), np.int64)
        work = [(0, np.arange(len(x)))]
        while work:
            node, rows = work.pop()
            if not self.children[node]:
                out[rows] = self.leaf_of[node]
                continue
            c = self.centres[self.children[node]]
            near = np.argmin((c**2).sum(axis=1) - 2 * (x[rows] @ c.T), axis=1)
            for k, child in enumerate(self.children[node]):
                if len(own := rows[near == k]):
                    work.append((child, own))
        return out

    def visits(self, q: np.ndarray, n: int) -> list[int]:
        """The first ``n`` leaves of a best-bin-first traversal."""
        heap, found = [(0.0, 0)], []
        while heap and len(found) < n:
            _, node = heapq.heappop(heap)
            own = self.children[node]
            if not own:
                found.append(self.leaf_of[node])
                continue
            for s, child in zip((self.centres[own] @ q).tolist(), own, strict=True):
                heapq.heappush(heap, (-s, child))
        return found


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    near = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(axis=1) - 2 * (x @ centres.T), axis=1)
        used = np.unique(near)
        centres = np.stack([x[near == j].mean(axis=0) for j in used])
    near = np.argmin((centres**2).sum(axis=1) - 2 * (x @ centres.T), axis=1)
    return centres, near


def fit_tree(x: np.ndarray, leaves: int, seed: int = 1) -> Tree:
    rng = np.random.default_rng(seed)
    size = max(1, len(x) // max(1, leaves))
    tree = Tree(x.mean(axis=0)[None, :] if len(x) else np.zeros((1, 0)), [[]], {})
    centres = [tree.centres[0]]

    def grow(node: int, rows: np.ndarray) -> None:
        if len(rows) > size and len(np.unique(x[rows], axis=0)) > 1:
            own, near = kmeans(x[rows], min(FAN, max(2, len(rows) // size)), rng)
            parts = [rows[near == j] for j in range(len(own))]
            if sum(len(p) > 0 for p in parts) > 1:
                for c, part in zip(own, parts, strict=True):
                    if len(part):
                        centres.append(c)
                        tree.children.append([])
                        tree.children[node].append(len(centres) - 1)
                        grow(len(centres) - 1, part)
                return
        tree.leaf_of[node] = len(tree.leaf_of)

    grow(0, np.arange(len(x)))
    tree.centres = np.stack(centres)
    return tree


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vec) of the rows that take part, in double precision."""
    v = F.col("vec")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(finite & F.exists(v, lambda x: x != 0))
    # Lengths: one small aggregate.
    common = rows.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").head()
    return rows.where(F.size(v) == (common["n"] if common else 0))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def best(
    q: np.ndarray,
    own: np.ndarray,
    x: np.ndarray,
    ids: np.ndarray,
    k: int,
    leaves: list | None = None,
    leaf: np.ndarray | None = None,
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k best rows: (query position, row positions, scores).

    With ``leaves`` (of each query) and ``leaf`` (of each row) only rows in a query's leaves.
    """
    for at in range(0, len(q), 128):
        s = q[at : at + 128] @ x.T
        if leaves is not None:
            for i, visited in enumerate(leaves[at : at + 128]):
                s[i, ~np.isin(leaf, visited)] = -np.inf
        s[own[at : at + 128, None] == ids[None, :]] = -np.inf
        for i, row in enumerate(s):
            n = min(k, len(row))
            edge = np.partition(row, len(row) - n)[len(row) - n]
            near = np.flatnonzero((row >= edge - 1e-9 * (1 + abs(edge))) & (row > -np.inf))
            exact = (x[near] * q[at + i]).sum(axis=1)
            order = np.lexsort((ids[near], -exact))[:k]
            yield at + i, near[order], exact[order]


def _assign(tree: Tree) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = pa.array(tree.descend(matrix(batch.column("vec"))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("vec"), leaf], ["vec_id", "vec", "leaf"]
            )

    return run


def calibrate(tree: Tree, index: DataFrame, ids: np.ndarray, x: np.ndarray, k: int, target: float) -> int:
    """Leaf visits that find ``target`` of the true neighbours of the sampled vectors ``x``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, leaf = batch.column("vec_id").to_numpy(), batch.column("leaf").to_numpy()
            found = [(i, leaf[r], rows[r], s) for i, r, s in best(x, ids, matrix(batch.column("vec")), rows, k)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)),
                    *(pa.array(np.concatenate([f[c] for f in found])) for c in (1, 2, 3)),
                ],
                ["q", "leaf", "vec_id", "score"],
            )

    order = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    true = (
        index.mapInArrow(run, "q long, leaf long, vec_id long, score double")
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("q", "leaf").collect()  # at most CALIBRATION * k rows
    )
    place = [{leaf: n for n, leaf in enumerate(tree.visits(v, len(tree.leaf_of)))} for v in x]
    needed = np.sort([place[r["q"]][r["leaf"]] + 1 for r in true])
    if not len(needed):
        return 1
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)])


def nearest(
    df: DataFrame,
    is_query: Column,
    k: int = 20,
    target: float = 0.97,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products among other rows.

    ``is_query`` is a condition on ``vec_id``.
    """
    rows = stored(usable(df, id_col, vector_col), "vectors")
    n = rows.count()
    if n == 0:
        return rows.selectExpr("vec_id AS query_id", "0 AS rank", "vec_id", "0.0D AS score")
    chosen = F.shiftrightunsigned(F.xxhash64("vec_id", "vec"), 24) < F.lit(int(min(1.0, SAMPLE / max(1, n)) * 2**40))
    sample = rows.where(chosen).orderBy(F.xxhash64("vec_id", "vec"), "vec_id").limit(2 * SAMPLE).collect()
    x = np.array([r["vec"] for r in sample], float).reshape(len(sample), -1)
    leaves = int(min(MAX_LEAVES, max(1, n**0.5), max(1, len(sample) // 16)))
    tree = fit_tree(x, leaves)
    schema = "vec_id long, vec array<double>, leaf long"
    index = stored(rows.mapInArrow(_assign(tree), schema), "index")
    some = sample[:CALIBRATION]
    visits = calibrate(tree, index, np.array([r["vec_id"] for r in some], np.int64), x[: len(some)], k, target)

    # Leaves to groups: at most MAX_LEAVES counts, whatever the number of rows.
    counts = {r["leaf"]: r["count"] for r in index.groupBy("leaf").count().collect()}
    group_of, parts, size = {}, [1], 0
    for leaf in sorted(counts):
        if size and size + counts[leaf] > GROUP_ROWS:
            parts.append(1)
            size = 0
        size += counts[leaf]
        group_of[leaf] = len(parts) - 1
        parts[-1] = max(1, -(-size // GROUP_ROWS))
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("vec").alias("vec"), F.count("*").alias("own"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch.column("vec"))
            rows = []
            for i, (v, same) in enumerate(zip(vectors, batch.column("own").to_pylist(), strict=True)):
                own: dict[int, list[int]] = {}
                chosen = tree.visits(v, visits)
                held = sum(counts.get(leaf, 0) for leaf in chosen)
                if held < k + same:  # further leaves, until k rows besides the query's own are at hand
                    for leaf in tree.visits(v, len(tree.leaf_of))[len(chosen) :]:
                        if held >= k + same:
                            break
                        chosen = [*chosen, leaf]
                        held += counts.get(leaf, 0)
                for leaf in chosen:
                    if leaf in group_of:
                        own.setdefault(group_of[leaf], []).append(leaf)
                rows += [(i, g, p, held) for g, held in own.items() for p in range(parts[g])]
            at, g, p, held = zip(*rows, strict=True) if rows else ((), (), (), ())
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(at), batch.column("vec").take(at),
                    pa.array(g, pa.int64()), pa.array(p, pa.int64()), pa.array(held, pa.list_(pa.int64())),
                ],
                ["query_id", "vec", "group", "part", "leaves"],
            )

    asked = stored(
        queries.mapInArrow(
            probe, "query_id long, vec array<double>, group long, part long, leaves array<long>"
        ),
        "asked",
    )
    # A group is sent once for every BLOCK_QUERIES queries that visit it, and not at all if none does.
    visited = asked.where("part = 0").groupBy("group").count().collect()  # at most MAX_LEAVES rows
    blocks = [0] * len(parts)
    for r in visited:
        blocks[r["group"]] = -(-r["count"] // BLOCK_QUERIES)
    block_counts = F.get(F.array(*map(F.lit, blocks)), F.col("group").cast("int")).cast("long")
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), block_counts))
    leaf_groups = F.array(*(F.lit(group_of.get(i, 0)) for i in range(len(tree.leaf_of))))
    part_counts = F.array(*map(F.lit, parts))
    placed = index.select(
        "vec_id", "vec", "leaf", F.get(leaf_groups, F.col("leaf").cast("int")).cast("long").alias("group")
    )
    placed = placed.select(
        "*",
        F.pmod(F.xxhash64("vec_id", "vec"), F.get(part_counts, F.col("group").cast("int"))).alias("part"),
        F.explode(F.filter(F.sequence(F.lit(0).cast("long"), block_counts), lambda b: b < block_counts)).alias("block"),
    )

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(q) and len(c):
            ids, own = c["vec_id"].to_numpy(), q["query_id"].to_numpy()
            x, leaf = np.stack(c["vec"]), c["leaf"].to_numpy()
            for i, near, s in best(np.stack(q["vec"]), own, x, ids, k, q["leaves"].tolist(), leaf):
                out["query_id"].append(np.full(len(near), own[i]))
                out["vec_id"].append(ids[near])
                out["score"].append(s)
        return pd.DataFrame({n: np.concatenate(v) if v else [] for n, v in out.items()})

    key = ["group", "part", "block"]
    found = (
        asked.groupBy(*key).cogroup(placed.groupBy(*key))
        .applyInPandas(search, "query_id long, vec_id long, score double")
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
