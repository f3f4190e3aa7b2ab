"""Quality rules: a hashed n-gram log-likelihood ratio beside plain base rules.

Words and word pairs are hashed into ``BUCKETS`` buckets. One multinomial is counted over the
whole corpus, one over the trusted target (the documents that the label table calls good). A
document's score is the mean over its n-grams of the log of the ratio of the two smoothed
probabilities, so long and short texts compare. The weights are integers (millionths), so sums do
not depend on the order, and the threshold is a cut, not a draw: every document is decided alike
on every run. The cut is the one at which most labelled documents, good and bad weighing the same,
fall on their own side. It is found from counts per score step over all labelled documents.

A word's hash is the head of its md5; a pair's hash is arithmetic on its two words' hashes. Both
can be written in SQL, and the query is checked that way.

Defined results: null text counts as empty: no words, score zero; a document without words fails
the base rules; documents with null or repeated ids are scored row by row, labels apply to every
row with their id (of several labels for one id the lowest counts); without labels of both
kinds only the base rules decide; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import documents, stored

BUCKETS = 1 << 16
PAIR = 31  # a pair's hash is PAIR times the first word's plus the second's
UNIT = 1_000_000  # weights in millionths
STEP = 10_000  # width of a score step, in weight units, in the search for the cut
MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
MEMORY = 200_000  # words whose hash a worker keeps

Batches = Iterator[pa.RecordBatch]


class Hasher:
    """28-bit hashes of words, with a bounded memory."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > MEMORY:
            known.clear()
        for w in set(words).difference(known):
            known[w] = int(hashlib.md5(w).hexdigest()[:7], 16)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def ngrams(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of all words and all pairs of neighbours."""
    pairs = hashes[:-1] * PAIR + hashes[1:]
    return np.concatenate([hashes, pairs]) % buckets


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside windows of ``size`` words that occur twice or more in the text.

    Windows get exact ranks by doubling: equal ranks mean equal words, whatever the length.
    """
    n = len(words)
    if n <= size or len(set(words)) == n:
        return 0
    numbers: dict[bytes, int] = {}
    one = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)

    def ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]

    have, rank = 1, one
    while have < size:
        more = min(have, size - have)
        tail = rank if more == have else window_ranks(one, more)
        rank = ranks(rank[: n - have - more + 1], tail[have : n - more + 1])
        have += more
    again = np.bincount(rank)[rank] > 1
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def window_ranks(one: np.ndarray, size: int) -> np.ndarray:
    rank = one
    for k in range(1, size):
        nxt = one[k:]
        rank = np.unique(rank[: len(nxt)] * (int(one.max()) + 1) + nxt, return_inverse=True)[1]
    return rank


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[bytes] = set()
    found = 0
    for line in text.split(b"\n"):
        if line.strip():
            found += line in seen
            seen.add(line)
    return found


def code_points(text: bytes) -> int:
    return len(text.decode(errors="replace"))


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    return (t.as_py() or b"" for t in batch.column("text").cast(pa.binary()))


def _count(batches: Batches, buckets: int) -> Batches:
    """One row per bucket and task: the n-grams of all documents of the task."""
    hasher, total = Hasher(), np.zeros(buckets, np.int64)
    for batch in batches:
        for text in _texts(batch):
            words = text.split()
            if words:
                total += np.bincount(ngrams(hasher(words), buckets), minlength=buckets)
    at = np.flatnonzero(total)
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])


def counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """n-grams per bucket over all of ``docs``; at most ``buckets`` rows reach the driver."""
    rows = (
        docs.select("text").mapInArrow(partial(_count, buckets=buckets), "bucket long, n long")
        .groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    )
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def weights(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Millionths of log p(target) / p(raw), each count raised by one."""
    p = (target + 1) / (target.sum() + len(target))
    q = (raw + 1) / (raw.sum() + len(raw))
    return np.round(UNIT * np.log(p / q)).astype(np.int64)


def _score(batches: Batches, weight: np.ndarray, names: list[str]) -> Batches:
    hasher = Hasher()
    for batch in batches:
        rows = []
        for text in _texts(batch):
            words = text.split()
            n = len(words)
            score = 0
            if n:
                own = ngrams(hasher(words), len(weight))
                score = int(weight[own].sum()) // len(own)
            spaces = sum(map(text.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
            symbols = sum(text.count(bytes([c])) for c in SYMBOLS)
            rows.append((n, code_points(text) - spaces, symbols, repeated_lines(text), repeated_words(words), score))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kept = [batch.column(c) for c in names]
        yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, pa.int64()) for c in columns)], [*names, *MEASURES])


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"]


def measured(docs: DataFrame, weight: np.ndarray) -> DataFrame:
    """The base measures and the score (weight units a n-gram, rounded down) of every row."""
    names = [c for c in docs.columns if c != "text"]
    kept = ", ".join(f"{docs.schema[c].name} {docs.schema[c].dataType.simpleString()}" for c in names)
    schema = ", ".join(f"{m} long" for m in MEASURES)
    return docs.mapInArrow(partial(_score, weight=weight, names=names), f"{kept}, {schema}")


def best_cut(scores: DataFrame) -> int | None:
    """The score, a multiple of STEP, at which the mean share of good documents at or above it and
    of bad documents below it is largest; the lowest such. None without both kinds.

    Counts per step and kind are bounded: weights lie within about 50 times UNIT.
    """
    step = F.floor(F.col("score") / STEP).cast("long").alias("step")
    rows = scores.groupBy(step, "good").count().collect()
    good = {r.step: r["count"] for r in rows if r.good}
    bad = {r.step: r["count"] for r in rows if not r.good}
    n_good, n_bad = sum(good.values()), sum(bad.values())
    if not n_good or not n_bad:
        return None
    best, cut, above, below = -1, None, n_good, 0
    for s in sorted(good.keys() | bad.keys()):
        # Whole numbers, so that equal shares are equal.
        value = above * n_bad + below * n_good
        if value > best:
            best, cut = value, s * STEP
        above -= good.get(s, 0)
        below += bad.get(s, 0)
    return cut


def judge(
    df: DataFrame, labels: DataFrame, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, measures, score, cut, base_failed, kept) for every row of ``df``.

    ``labels`` (doc_id, quality) names good (1) and bad (0) documents of the corpus.
    """
    docs = documents(df, id_col, text_col)
    facts = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(
        F.col("doc_id").cast("long").alias("of")
    ).agg((F.min("quality") > 0).alias("good"))
    # Labels grow with the corpus, so texts and labels always meet in a shuffle, and once: the
    # cut is found from the stored measures, which are a few numbers per document.
    trusted = docs.hint("shuffle_merge").join(facts.where("good"), F.col("doc_id") == F.col("of"), "left_semi")
    weight = weights(counts(trusted, buckets), counts(docs, buckets))
    scored = stored(measured(docs, weight), "measures")
    labelled = scored.where(f"n_words >= {MIN_WORDS}").join(facts, F.col("doc_id") == F.col("of"))
    out = scored.withColumn("cut", F.lit(best_cut(labelled)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= F.col("cut"), F.lit(True)))


# The same rows in SQL; the figures are those of the constants above.
ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM docs
), placed AS (
  SELECT r, i, w, ('0x' || substr(md5(w), 1, 7))::BIGINT AS h
  FROM (SELECT r, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM words)
), grams AS (
  SELECT r, h % 65536 AS b FROM placed
  UNION ALL
  SELECT r, (h * 31 + next) % 65536 AS b
  FROM (SELECT r, h, lead(h) OVER (PARTITION BY r ORDER BY i) AS next FROM placed) WHERE next IS NOT NULL
), facts AS (
  SELECT doc_id, min(quality) > 0 AS good FROM labels
  WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), named AS (
  SELECT d.r, f.good FROM docs d JOIN facts f USING (doc_id)
), buckets AS (
  SELECT b, count(*) AS n, count(*) FILTER (WHERE good) AS t FROM grams LEFT JOIN named USING (r) GROUP BY b
), totals AS (
  SELECT sum(n) + 65536 AS n, sum(t) + 65536 AS t FROM buckets
), weights AS (
  SELECT b, round(1000000 * ln(((w.t + 1)::DOUBLE / s.t::DOUBLE) / ((w.n + 1)::DOUBLE / s.n::DOUBLE))) AS w
  FROM buckets w, totals s
), scores AS (
  SELECT r, floor(sum(w) / count(*))::BIGINT AS score FROM grams JOIN weights USING (b) GROUP BY r
), lines AS (
  SELECT r, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM docs
), spans AS (
  SELECT r, i, concat_ws(' ', w, lead(w) OVER p, lead(w, 2) OVER p, lead(w, 3) OVER p, lead(w, 4) OVER p) AS s,
    lead(w, 4) OVER p IS NOT NULL AS whole
  FROM placed WINDOW p AS (PARTITION BY r ORDER BY i)
), windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, s) AS times FROM spans WHERE whole
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM windows, range(5) AS o(k) WHERE times > 1 GROUP BY r
), base AS (
  SELECT r, doc_id, len(ws)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    coalesce(score, 0)::BIGINT AS score
  FROM words JOIN lines USING (r) LEFT JOIN covered c USING (r) LEFT JOIN scores USING (r)
), decided AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base
), steps AS (
  SELECT floor(score / 10000.0)::BIGINT AS s, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE NOT good) AS x
  FROM base JOIN named USING (r) WHERE n_words >= 10 GROUP BY 1
), sides AS (
  SELECT s, sum(g) OVER (ORDER BY s DESC) AS above, coalesce(sum(x) OVER (
    ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    sum(g) OVER () AS goods, sum(x) OVER () AS bads
  FROM steps
), cut AS (
  SELECT s * 10000 AS cut FROM sides WHERE goods > 0 AND bads > 0
  ORDER BY above * bads + below * goods DESC, s LIMIT 1
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed,
  NOT base_failed AND coalesce(score >= (SELECT cut FROM cut), true) AS kept
FROM decided
"""
