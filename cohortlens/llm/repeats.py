"""Removal of long repeats by prefix-free parsing.

A rolling hash over ``WINDOW`` bytes triggers phrase ends. Every start of a ``length``-byte string
belongs to the first trigger at or after it, so it is a suffix of one phrase followed by the rest
of the parse: the two coordinates by which prefix-free parsing puts a corpus in order. Removal
only asks which starts agree for ``length`` bytes, that is, which are equal in an order cut at
that depth. The orders of phrase suffixes and of parses are therefore kept as equality classes
(128 bits of fingerprints) instead of ranks, and no suffix array of the corpus is ever held in
one place:

1. Each run of starts with one trigger gets two classes: its core (the bytes all its strings
   share) and its whole context. Cores that occur once are finished.
2. A context that occurs twice is repeated as a whole: all its starts are.
3. Only a run whose core repeats and whose context does not, at the edge of a repeat, is opened:
   its starts are compared one by one with one run of every other context of that core.

The starts go back to their documents, where covered bytes are cut out. Starts without a trigger
nearby (long runs of a byte) use denser triggers and at last themselves.

Defined results: null text counts as empty; texts shorter than ``length`` bytes are kept; rows
with a null id count as documents; repeated rows are repeats of each other; very long texts are
read in blocks; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import documents, row_key, stored

U = np.uint64
WINDOW = 16
SPARSE, DENSE = 96, 12  # one trigger in so many positions
CHUNK = 48  # starts that one run holds at most
BLOCK = 1 << 17  # bytes worked on at a time: about 60 times as much memory while they are parsed

FLUSH = 1 << 22  # bytes of kept texts in one output batch

_MADE: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    """Byte values and powers of the base, made once per worker process."""
    if not _MADE:
        base = 0x9E3779B97F4A7C15 | 1
        n = BLOCK + 4096
        _MADE["byte"] = np.random.default_rng(11).integers(1, 2**64, 256, dtype=U)
        for name, b in (("power", base), ("inverse", pow(base, -1, 2**64))):
            powers = np.full(n, b, U)
            powers[0] = 1
            _MADE[name] = np.cumprod(powers)
    return _MADE


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Rolling:
    """Hashes of any substring of a block of bytes."""

    def __init__(self, data: np.ndarray) -> None:
        made = _tables()
        self.inverse = made["inverse"]
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(made["byte"][data] * made["power"][: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def windows(self) -> np.ndarray:
        n = len(self.sums) - WINDOW
        return mix((self.sums[WINDOW:] - self.sums[:n]) * self.inverse[:n])


def runs(data: np.ndarray, spans: list[tuple[int, int]], length: int) -> dict[str, np.ndarray]:
    """Runs of starts with one trigger: first start, count, distance to the trigger, classes.

    ``spans`` are the half-open ranges of starts to deal with; each has ``length`` bytes ahead.
    """
    chunk = min(CHUNK, length)
    reach = length - WINDOW  # a trigger beyond does not lie inside the string
    roll = Rolling(data)
    p = np.concatenate([np.arange(lo, hi) for lo, hi in spans])
    trigger = np.full(len(p), -1, np.int64)
    level = np.full(len(p), 2, np.int64)
    if reach > 0 and len(data) >= WINDOW:
        h = roll.windows() >> U(20)
        for k, rate in enumerate((SPARSE, DENSE)):
            at = np.flatnonzero(level == 2)
            flags = h % U(rate) == 0 if k == 0 else (h >> U(8)) % U(rate) == 0
            ends = np.r_[np.flatnonzero(flags), len(data) + length]
            found = ends[(np.cumsum(flags) - flags)[p[at]]]
            near = found - p[at] <= reach
            trigger[at[near]] = found[near]
            level[at[near]] = k
    alone = level == 2
    trigger[alone] = p[alone]
    part = (trigger - p) // chunk
    key = (trigger * 16 + part) * 4 + level
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (p[1:] != p[:-1] + 1)])
    last = np.r_[first[1:], len(p)] - 1
    start, end, to = p[first], p[last], trigger[first]
    near_end = to - part[first] * chunk
    core = roll.of(near_end, near_end - chunk + 1 + length)
    core = mix(core ^ (level[first] * 64 + part[first]).astype(U))
    context = roll.of(start, end + length)
    context = mix(context ^ ((to - start) * 4096 + (end - start)).astype(U))
    return {"start": start, "n": end - start + 1, "off": to - start, "core": core, "context": context}


def _blocks(sizes: list[int], length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first row, last row + 1, byte from, byte to) of at most about BLOCK bytes of texts.

    Several short texts share a block; one long text is divided, its blocks overlapping by what
    a string at the last start needs.
    """
    at = 0
    while at < len(sizes):
        if sizes[at] > BLOCK:
            for lo in range(0, sizes[at] - length + 1, BLOCK):
                yield at, at + 1, lo, min(sizes[at], lo + BLOCK + length - 1)
            at += 1
            continue
        end, total = at, 0
        while end < len(sizes) and total + sizes[end] <= BLOCK:
            total += sizes[end]
            end += 1
        yield at, end, 0, total
        at = end


def _parse(length: int, names: list[str]) -> Callable:
    """Runs of every document of a batch as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            sizes = [len(t.as_buffer() or b"") if t.is_valid else 0 for t in texts]
            for first, last, lo, hi in _blocks(sizes, length):
                rows = [i for i in range(first, last) if sizes[i] >= length]
                if not rows:
                    continue
                own = [np.frombuffer(texts[i].as_buffer(), np.uint8) for i in rows]
                if len(rows) == 1:
                    own = [own[0][lo:hi]]
                bounds = np.cumsum([0] + [len(x) for x in own])
                spans = [(a, b - length + 1) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                found = runs(np.concatenate(own), spans, length)
                place = np.searchsorted(bounds, found["start"], "right") - 1
                moved = lo if len(rows) == 1 else 0
                found["start"] = found["start"] - bounds[place] + moved
                at = pa.array(np.array(rows)[place])
                columns = []
                for name in names:
                    if name in found:
                        columns.append(pa.array(found[name].astype(np.int64, copy=False).view(np.int64)))
                    else:
                        columns.append(batch.column(name).take(at))
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _open(length: int) -> Callable:
    """The starts of the runs asked for, each with the hash of its string."""
    names = ["doc_id", "key", "core", "single", "off", "hash", "start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for i in range(len(batch)):
                data = np.frombuffer(texts[i].as_buffer(), np.uint8)
                asked = batch.column("asked")[i].values
                start, n, off, core, single = (
                    asked.field(f).to_numpy(zero_copy_only=False)
                    for f in ("start", "n", "off", "core", "single")
                )
                block = start // BLOCK
                for b in np.unique(block):
                    mine = np.flatnonzero(block == b)
                    lo = int(b) * BLOCK
                    roll = Rolling(data[lo : lo + BLOCK + length + CHUNK])
                    count = n[mine]
                    row = np.repeat(mine, count)
                    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    at = start[row] + step - lo
                    hashes = roll.of(at, at + length).view(np.int64)
                    place = pa.array(np.full(len(row), i))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(place), batch.column("key").take(place)]
                        + [pa.array(c) for c in (core[row], single[row], off[row] - step, hashes, at + lo)],
                        names,
                    )

    return run


def _cut(length: int) -> Callable:
    """Bytes that stay, and the removed spans, of documents with their repeated starts."""
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(data: np.ndarray, found: pa.Scalar) -> tuple[bytes, list[dict]]:
        lo = found.values.field("start").to_numpy()
        hi = lo + found.values.field("n").to_numpy() + length - 1
        edge = np.zeros(len(data) + 1, np.int32)
        np.add.at(edge, lo, 1)
        np.add.at(edge, hi, -1)
        gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
        turn = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
        return data[~gone].tobytes(), [{"start": a, "end": b} for a, b in turn.reshape(-1, 2).tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            first, held, sizes, kept, spans = 0, 0, [], [], []
            for i in range(len(batch)):
                data = np.frombuffer(texts[i].as_buffer(), np.uint8)
                found = batch.column("found")[i]
                own, removed = cut(data, found) if found.is_valid else (texts[i].as_py(), [])
                sizes.append(len(data))
                kept.append(own)
                spans.append(removed)
                held += len(own)
                if held > FLUSH or i == len(batch) - 1:
                    columns = [pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, spans_type)]
                    ids = batch.column("doc_id").slice(first, len(sizes))
                    yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "n_bytes", "kept", "spans"])
                    first, held, sizes, kept, spans = i + 1, 0, [], [], []

    return run


def remove_repeats(
    df: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, kept, spans) for every row of ``df``.

    ``kept`` are the bytes not covered by any ``length``-byte string that also starts elsewhere;
    ``spans`` are the maximal removed runs.
    """
    docs = documents(df, id_col, text_col).withColumn("key", row_key())
    cores = (
        docs.mapInArrow(_parse(length, ["core"]), "core long")
        .groupBy("core").count().where("count > 1").select("core")
    )
    names = ["doc_id", "key", "core", "context", "start", "n", "off"]
    parsed = docs.mapInArrow(_parse(length, names), ", ".join(f"{n} long" for n in names))
    shared = stored(parsed.join(cores, "core", "left_semi"), "shared-runs")

    # One row per context; the fields of its first run stand for all runs with it.
    fields = ["doc_id", "key", "start", "n", "off"]
    contexts = stored(
        shared.groupBy("core", "context").agg(
            F.count("*").alias("times"), *(F.first(c).alias(c) for c in fields)
        ),
        "contexts",
    )
    mixed = contexts.groupBy("core").count().where("count > 1").select("core")
    asked = (
        contexts.join(mixed, "core", "left_semi")
        .select("doc_id", "key", F.struct("start", "n", "off", "core", (F.col("times") == 1).alias("single")).alias("a"))
        .groupBy("doc_id", "key").agg(F.collect_list("a").alias("asked"))
        .withColumnRenamed("doc_id", "of")
    )
    opened = docs.dropDuplicates(["doc_id", "key"]).join(
        asked.withColumnRenamed("key", "of_key"),
        F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")),
    )
    starts = stored(
        opened.select("doc_id", "key", "text", "asked").mapInArrow(
            _open(length),
            "doc_id long, key long, core long, single boolean, off long, hash long, start long",
        ),
        "starts",
    )
    equal = starts.groupBy("core", "off", "hash").count().where("count > 1").drop("count")
    edges = starts.where("single").join(equal, ["core", "off", "hash"], "left_semi")

    whole = shared.join(
        contexts.where("times > 1").select("core", "context"), ["core", "context"], "left_semi"
    )
    found = (
        whole.select("doc_id", "key", F.struct("start", "n").alias("f"))
        .union(edges.select("doc_id", "key", F.struct("start", F.lit(1).cast("long").alias("n"))))
        .groupBy("doc_id", "key").agg(F.collect_list("f").alias("found"))
        .select(F.col("doc_id").alias("of"), F.col("key").alias("of_key"), "found")
    )
    return (
        docs.join(
            found,
            F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")),
            "left",
        )
        .select("doc_id", "text", "found")
        .mapInArrow(
            _cut(length),
            "doc_id long, n_bytes long, kept binary, spans array<struct<start: long, end: long>>",
        )
    )
