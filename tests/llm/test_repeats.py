import random
from collections import Counter

import pytest

from cohortlens.llm import repeats
from cohortlens.llm.repeats import remove_repeats


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if counts[d[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans, i = [], 0
        while i < len(d):
            if gone[i]:
                j = i
                while j < len(d) and gone[j]:
                    j += 1
                spans.append((i, j))
                i = j
            else:
                i += 1
        out.append((len(d), bytes(b for b, g in zip(d, gone, strict=True) if not g), spans))
    return out


def corpus(seed, length):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abé ", k=rng.randint(1, 6)))
    prose = lambda n: "".join(word() for _ in range(n))
    shared = [prose(length // 2) for _ in range(4)]
    texts = []
    for _ in range(60):
        parts = [prose(rng.randint(0, length))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 2)
            parts += [s[a : a + rng.randint(length // 2, 2 * length)], prose(rng.randint(0, 20))]
        texts.append("".join(parts))
    texts += [texts[0], texts[1], texts[1], None, "", "x" * (3 * length), "ab" * length, "q" * (length - 1)]
    texts.append("y" * (length + 1))
    return texts


@pytest.mark.parametrize("seed,length", [(1, 400), (2, 60), (3, 24)])
def test_equals_brute_force(spark, seed, length, monkeypatch):
    texts = corpus(seed, length)
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    got = {r.doc_id: r for r in remove_repeats(df.repartition(3), length).collect()}
    for i, (n, kept, spans) in enumerate(brute(texts, length)):
        assert (got[i].n_bytes, bytes(got[i].kept)) == (n, kept), i
        assert [(s.start, s.end) for s in got[i].spans] == spans


def test_blocks_of_a_long_text(spark):
    rng = random.Random(5)
    passage = "".join(rng.choices("abcdefgh ", k=900))
    long = "".join(rng.choices("abcdefgh ", k=repeats.BLOCK - 500)) + passage
    long += "".join(rng.choices("abcdefgh ", k=repeats.BLOCK))
    df = spark.createDataFrame([(1, long), (None, "zz" + passage + "yy"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in remove_repeats(df).collect()}
    at = repeats.BLOCK - 500
    (span,) = got[1].spans
    assert span.start <= at and span.end >= at + 900 and span.end - span.start < 904
    assert len(got[None].kept) == 904 - (span.end - span.start)
    assert got[2].n_bytes == 0 and got[2].spans == []


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(7, "m" * 10 + "n" * 390)] * 2 + [(None, "short")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, len(r.kept)) for r in remove_repeats(df).collect())
    assert got == [(0, 5, 5), (7, 400, 0), (7, 400, 0)]
    assert remove_repeats(df.limit(0)).count() == 0
