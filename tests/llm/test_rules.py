import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import pandas as pd
from hypothesis import given
from hypothesis import strategies as st

from cohortlens.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def grams(text):
    h = [int(hashlib.md5(w.encode()).hexdigest()[:7], 16) for w in WORD.findall(text)]
    return [x % 65536 for x in h] + [(a * 31 + b) % 65536 for a, b in zip(h, h[1:], strict=False)]


def brute(rows, labels):
    """Score, verdict per row."""
    good = {}
    for i, q in labels:
        if i is not None and q is not None:
            good[i] = min(good.get(i, q), q)
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t or ""))
        if good.get(i, 0) > 0:
            target.update(grams(t or ""))
    n, m = sum(raw.values()) + 65536, sum(target.values()) + 65536

    def score(text):
        own = grams(text)
        weight = [round(1e6 * math.log(((target[g] + 1) / m) / ((raw[g] + 1) / n))) for g in own]
        return sum(weight) // len(own) if own else 0

    scores = [score(t or "") for _, t in rows]
    named = [(s // 10_000, good[i] > 0) for (i, t), s in zip(rows, scores, strict=True) if i in good and base(t or "")[0] >= 10]
    goods = [s for s, g in named if g]
    bads = [s for s, g in named if not g]
    cut = None
    if goods and bads:
        cut = max({s for s, _ in named}, key=lambda c: (sum(s >= c for s in goods) * len(bads) + sum(s < c for s in bads) * len(goods), -c)) * 10_000
    out = []
    for (i, t), s in zip(rows, scores, strict=True):
        b = base(t or "")
        failed = b[0] < 10 or 100 * b[4] > 20 * b[0]
        out.append((i, *b, s, failed, not failed and (cut is None or s >= cut)))
    return out


def corpus(rng):
    fine = [f"fine{k}" for k in range(80)]
    junk = [f"junk{k}" for k in range(80)]
    rows, labels = [], []
    for i in range(300):
        pool, other = (fine, junk) if i % 3 else (junk, fine)
        words = [rng.choice(other if rng.random() < 0.1 else pool) for _ in range(rng.randint(5, 60))]
        rows.append((i, " ".join(words)))
        if i < 120:
            labels.append((i, int(i % 3 > 0)))
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "a b c d e f g " * 30), (None, rows[4][1]), (4, rows[4][1])]
    rows += [(1004, "x y\nx y\n\n\n x y\nx y"), (1005, "é ü\x0bß\xa0x # * $ % & | < >" + " w" * 8), (1006, "one two three")]
    rows.append((1007, " ".join(rng.choice(junk) for _ in range(60_000))))
    return rows, [*labels, (None, 1), (5, None), (3, 1), (99999, 0)]


def judged(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, score int, kept string")
    named = spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int")
    found = rules.judge(docs.repartition(3), named)
    return found.select("doc_id", *rules.MEASURES, "base_failed", "kept")


def test_matches_brute_force_and_sql(spark):
    rows, labels = corpus(random.Random(5))
    want = sorted(brute(rows, labels), key=str)
    got = sorted((tuple(r) for r in judged(spark, rows, labels).collect()), key=str)
    assert got == want
    assert sum(r[-1] for r in got) > 150
    assert sum(r[-1] for r in got if r[0] is not None and 120 <= r[0] < 300 and r[0] % 3 == 0) < 5
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    con.register("labels", pd.DataFrame(labels, columns=["doc_id", "quality"]).astype("Int64"))
    assert sorted(con.execute(rules.ORACLE).fetchall(), key=str) == want


def test_without_labels_or_rows(spark):
    rows, labels = corpus(random.Random(6))
    for some in ([], [x for x in labels if x[1] == 1]):
        got = judged(spark, rows, some).collect()
        assert all(r.kept == (not r.base_failed) for r in got)
    assert judged(spark, [], labels).count() == 0


@given(st.text("ab \n\t#", max_size=60))
def test_base_measures(text):
    raw = text.encode()
    n, chars, symbols, lines, repeated = base(text)
    assert rules.repeated_words(raw.split()) == repeated
    assert rules.repeated_lines(raw) == lines and len(raw.split()) == n


@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=80), st.integers(1, 9))
def test_windows_of_any_size(words, size):
    windows = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
    times = Counter(windows)
    assert rules.repeated_words(words, size) == len({i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(size)})
