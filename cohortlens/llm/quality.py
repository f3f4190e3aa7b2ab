"""Quality classifier: weak labels, reconciled by expectation-maximisation, train a hashed scorer.

1. Overlapping heuristic labellers vote keep, reject or abstain on every whole document.
2. Documents are counted by their pattern of votes (at most 3 ** labellers rows, whatever the
   number of documents), and expectation-maximisation over these counts estimates how often
   each labeller is right.
3. The posterior of a document's pattern is its label. A bounded sample of documents
   (``sample`` rows, chosen by hash) with these labels trains a linear scorer over hashed
   features: shapes of words and of neighbouring words, and repeats inside the document.
4. The scorer, of fixed size, is applied to all documents.

Defined results: null and empty texts get the score of no evidence, 0.5, and stay; null and
repeated ids and repeated rows are carried through; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import documents, row_key, stored

SAMPLE = 20_000  # documents that train the scorer
BITS = 15  # the scorer has 2**BITS weights
THRESHOLD = 0.3  # documents below go: only clear evidence removes one
ABSTAIN, KEEP, REJECT = 0, 1, 2

_SYMBOLS = b"*#$%&@^~=<>{}[]\\_"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
# Letters by case, digits, and bytes beyond ASCII as lower-case letters.
_SHAPE = bytes(
    65 if c in _UPPER else 97 if c in _LOWER or c > 127 else 48 if 48 <= c <= 57 else c
    for c in range(256)
)
# A word of letters with at most one mark behind it.
_PLAIN = re.compile(rb"(?<!\S)[A-Za-z\x80-\xff]+[.,;:?!]?(?!\S)")
_AGAIN = re.compile(rb"(.)\1+", re.S)


def repeats(words: list[bytes]) -> list[bool]:
    """For every word triple, whether it stood earlier in the text."""
    seen: set[int] = set()
    out = []
    for triple in zip(words, words[1:], words[2:], strict=False):
        h = hash(triple)
        out.append(h in seen)
        seen.add(h)
    return out


def measures(text: bytes) -> dict[str, float]:
    words = text.split()
    n = max(1, len(words))
    upper = len(text) - len(text.translate(None, _UPPER))
    lower = len(text) - len(text.translate(None, _LOWER))
    triples = repeats(words)
    return {
        "symbols": (len(text) - len(text.translate(None, _SYMBOLS))) / max(1, len(text)),
        "upper": upper / max(1, upper + lower),
        "repeated": sum(triples) / max(1, len(triples)),
        "doubled": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        "bars": text.count(b" | ") / n,
        "bangs": text.count(b"!!") / n,
        "plain": len(_PLAIN.findall(text)) / n,
        "ends": (text.count(b".") + text.count(b"?") + text.count(b"!")) / n,
    }


# Each of these sees one defect, and rejects above its bound.
DEFECTS = (
    ("symbols", 0.08),
    ("upper", 0.4),
    ("repeated", 0.4),
    ("doubled", 0.2),
    ("bars", 0.15),
    ("bangs", 0.15),
)
MIN_WORDS = 8  # below, a text says too little for any labeller
LABELLERS = len(DEFECTS) + 2


def votes(text: bytes) -> str:
    """One vote per labeller: the defects reject or abstain, the last two keep or abstain."""
    if len(text.split(None, MIN_WORDS)) < MIN_WORDS:
        return str(ABSTAIN) * LABELLERS
    m = measures(text)
    out = [REJECT if m[name] > high else ABSTAIN for name, high in DEFECTS]
    varied = m["repeated"] < 0.1 and m["doubled"] < 0.03
    prose = varied and m["plain"] > 0.85 and m["upper"] < 0.2
    sentences = varied and 0.01 < m["ends"] < 0.4 and m["symbols"] < 0.02 and m["bars"] < 0.02
    out += [KEEP if prose else ABSTAIN, KEEP if sentences else ABSTAIN]
    return "".join(map(str, out))


def estimate(counts: dict[str, int], rounds: int = 100) -> dict[str, float]:
    """Expectation-maximisation over vote patterns: the probability of good for each.

    A labeller that votes is right with its own accuracy, estimated from where labellers
    overlap; a few pseudo-votes hold rarely used ones near the start. Good and bad count as
    equally likely beforehand, so a common class does not outvote a labeller that is alone.
    """
    patterns = sorted(counts)
    if not patterns:
        return {}
    v = np.array([[int(c) for c in p] for p in patterns])
    n = np.array([counts[p] for p in patterns], float)
    sign = (v == KEEP).astype(float) - (v == REJECT)
    accuracy = np.full(v.shape[1], 0.9)
    good = np.full(len(patterns), 0.5)
    for _ in range(rounds):
        odds = sign @ np.log(accuracy / (1 - accuracy))
        good = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        right = (n * good) @ (v == KEEP) + (n * (1 - good)) @ (v == REJECT)
        accuracy = np.clip((right + 9) / (n @ (v != ABSTAIN) + 10), 0.55, 0.995)
    good[(v == ABSTAIN).all(axis=1)] = 0.5
    return dict(zip(patterns, good.tolist(), strict=True))


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed positions and values: shares of word shapes, of pairs of shapes, and of repeats."""
    words = text.split()
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    shapes = _AGAIN.sub(rb"\1", text.translate(_SHAPE)).split()
    counts = Counter(shapes)
    counts.update(zip(shapes, shapes[1:], strict=False))
    n = len(words) + MIN_WORDS  # a short text is weak evidence
    held: dict[int, float] = {0: 1.0}
    for shape, c in counts.items():
        key = shape if isinstance(shape, bytes) else b" ".join(shape)
        at = 8 + zlib.crc32(key) % ((1 << BITS) - 8)
        held[at] = held.get(at, 0.0) + c / n
    triples = repeats(words)
    held[1] = 4 * sum(triples) / n
    held[2] = 4 * sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    return np.fromiter(held.keys(), np.int64), np.fromiter(held.values(), float)


def train(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Logistic regression on probabilities as labels, classes weighted alike."""
    weights = np.zeros(1 << BITS)
    if not len(rows):
        return weights
    at = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    share = min(0.95, max(0.05, good.mean()))
    balance = good / share + (1 - good) / (1 - share)
    balance /= balance.sum()
    speed = np.full(1 << BITS, 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * weights[at], len(rows)), -30, 30)))
        slope = np.bincount(at, value * (balance * (p - good))[row], 1 << BITS) + 1e-6 * weights
        speed += slope**2
        weights -= 0.5 * slope / np.sqrt(speed)
    return weights


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    return (t.as_py() for t in batch.column("text").cast(pa.binary()))


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pattern = pa.array([votes(t) for t in _texts(batch)], pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("key"), pattern], ["doc_id", "key", "pattern"]
        )


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t) for t in _texts(batch)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("key"),
                pa.array([f[0] for f in found], pa.list_(pa.int64())),
                pa.array([f[1] for f in found], pa.list_(pa.float64())),
            ],
            ["key", "at", "value"],
        )


def _score(weights: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in _texts(batch)]
            scores = [float(weights[at] @ value) if len(at) else 0.0 for at, value in found]
            p = 1 / (1 + np.exp(-np.clip(np.array(scores, float), -30, 30)))
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(p)], names + ["score"]
            )

    return run


def fit(df: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights of the scorer, from the documents alone."""
    docs = documents(df, id_col, text_col).withColumn("key", row_key())
    voted = stored(docs.mapInArrow(_vote, "doc_id long, key long, pattern string"), "votes")
    counts = {r["pattern"]: r["count"] for r in voted.groupBy("pattern").count().collect()}
    good = estimate(counts)
    total = sum(counts.values())
    if not total:
        return np.zeros(1 << BITS)
    # About ``sample`` documents, and never more than twice as many, by the hash of their rows.
    limit = int(min(1.0, sample / total) * 2**40)
    chosen = F.shiftrightunsigned(F.xxhash64("key"), 24) < F.lit(limit)
    labels = {
        r["key"]: r["pattern"]
        for r in voted.where(chosen).dropDuplicates(["key"]).select("key", "pattern")
        .orderBy("key").limit(2 * sample).collect()
    }
    rows = docs.where(chosen).dropDuplicates(["key"]).select("key", "text").mapInArrow(
        _features, "key long, at array<long>, value array<double>"
    )
    held = {
        r["key"]: (np.array(r["at"], np.int64), np.array(r["value"]))
        for r in rows.orderBy("key").limit(2 * sample).collect()
    }
    keys = sorted(k for k in held if k in labels and good[labels[k]] != 0.5 and len(held[k][0]))
    return train([held[k] for k in keys], np.array([good[labels[k]] for k in keys]))


def score(df: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, score) for every row of ``df``; 1 is good."""
    docs = documents(df, id_col, text_col).withColumn("key", row_key())
    return docs.mapInArrow(_score(weights), "doc_id long, key long, score double")


def keep_good(
    df: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``df``, all columns, whose score reaches ``threshold``."""
    weights = fit(df, id_col=id_col, text_col=text_col)
    judge = _score(weights)

    @F.pandas_udf("double")
    def judged(text):  # noqa: ANN001, ANN202
        batch = pa.RecordBatch.from_arrays([pa.array(text, pa.string())], ["text"])
        return next(judge(iter([batch]))).column("score").to_pandas()

    judged_text = judged(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return df.where(judged_text >= F.lit(threshold))
