import hashlib
import random
import struct

import numpy as np
import xxhash
from pyspark.sql import functions as F

from cohortlens.llm import minhash as M


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def true_likeness(a, b):
    a, b = shingles(a), shingles(b)
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_likeness_follows_jaccard(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["ab", "cd", "ef", "gh", "ij"], k=rng.choice([0, 1, 3, 8, 40, 300]))) for _ in range(120)]
    texts += [None, "", "Same  text\there", "same text here", "w" * 100_000 + " a b c d e f"]
    ids = [3 * i + 5 for i in range(len(texts) - 1)] + [None]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").selectExpr("*", "0 AS signature", "1 AS key")
    got = M.compare_with_edits(df.repartition(3)).select(
        "*", M.likeness("signature", "edited_signature").alias("near_edited"),
        M.likeness("signature", "next_signature").alias("near_next"), M.packed("signature").alias("fp"),
    ).collect()
    order = sorted(zip(ids, texts, strict=True), key=lambda r: (r[0] is not None, r[0] or 0))
    after = {order[k][0]: order[(k + 1) % len(order)][1] or "" for k in range(len(order))}
    errors = []
    for r in got:
        n = len(r.text) // 4
        edited = r.text[: len(r.text) - n] + after[r.doc_id][:n]
        assert r.edited == edited
        errors += [r.near_edited - true_likeness(r.text, edited), r.near_next - true_likeness(r.text, after[r.doc_id])]
        assert len(r.fp) in (0, 2 * M.BINS) and (r.fp == "") == (not r.text.split())
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.25
    by_text = {r.text: r.fp for r in got}
    assert by_text["Same  text\there"] == by_text["same text here"]


def test_ranges_join_up(spark, monkeypatch):
    monkeypatch.setattr(M, "RANGE_ROWS", 7)
    rows = [(i * i, f"text number {i} of many more words") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.edited for r in M.compare_with_edits(df).collect()}
    for k, (i, t) in enumerate(rows):
        n = len(t) // 4
        assert got[i] == t[: len(t) - n] + rows[(k + 1) % 60][1][:n]


def test_edges(spark):
    df = spark.createDataFrame([(1, "one two three four")], "doc_id long, text string")
    (r,) = M.compare_with_edits(df).select("edited", M.packed("signature").alias("fp"), M.likeness("signature", "next_signature").alias("x")).collect()
    assert r.edited == "one two three fone " [: 14] + "one " and r.x == 1.0
    assert M.compare_with_edits(df.limit(0)).count() == 0
    twice = df.union(df).union(df)
    fps = M.fingerprint_documents(twice).select(F.sha2("fingerprint", 256)).distinct().collect()
    assert len(fps) == 1 and M.compare_with_edits(twice).count() == 3
    assert hashlib.sha256(b"").hexdigest() != fps[0][0]


def spark_hash(*values):
    """Spark's xxhash64 of texts (str), longs (int) and ints (one-tuples)."""
    h = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<i", *v) if isinstance(v, tuple) else struct.pack("<q", v)
        h = xxhash.xxh64_intdigest(raw, h)
    return h - 2**64 if h >= 2**63 else h


def brute_fingerprint(text):
    words = [spark_hash(w) for w in text.lower().split()]
    if not words:
        return ""
    hashes = [spark_hash(*words[i : i + 5]) for i in range(max(1, len(words) - 4))]
    held = {}
    for h in sorted(hashes, reverse=True):
        held[(h >> 57) + 64] = h
    probes, out = M.probes(), ""
    for j in range(M.BINS):
        tried = [j, *(own[j] for own in probes)]
        found = next((held[b] for b in tried if b in held), None)
        if found is None:
            found = min((spark_hash((j,), b), y) for b, y in held.items())[1]
        out += f"{spark_hash(found, (j,)) & 255:02x}"
    return out


def test_fingerprints_match_brute_force(spark):
    rng = random.Random(7)
    texts = ["", "one", "one two three four five", "A b  c\td e f g"]
    texts += [" ".join(rng.choices("abcdefghij", k=rng.choice([6, 9, 14, 60, 400, 2000]))) for _ in range(25)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in M.fingerprint_documents(df).collect()}
    assert got == {i: brute_fingerprint(t) for i, t in enumerate(texts)}


def test_probes_are_independent():
    probes = M.probes()
    assert len(set(zip(*probes, strict=True))) == M.BINS
    assert len({b for own in probes for b in own}) > 120
    # The spread of the estimate over few shingles, against bins that choose at random anew.
    rng, own = random.Random(5), random.Random(6)

    def spread(sequences):
        errors = []
        for _ in range(400):
            both = [rng.getrandbits(64) for _ in range(8)]
            sides = [both + [rng.getrandbits(64) for _ in range(2)] for _ in range(2)]
            bins = [{h >> 57: h for h in sorted(s, reverse=True)} for s in sides]
            tried = sequences()
            equal = 0
            for j in range(M.BINS):
                values = [next((b[x] for x in [j, *tried[j]] if x in b), None) for b in bins]
                equal += values[0] == values[1]
            errors.append(equal / M.BINS - 8 / 12)
        return np.std(errors)

    sequences = list(zip(*M.probes(40), strict=True))
    fixed = spread(lambda: sequences)
    free = spread(lambda: [[own.randrange(M.BINS) for _ in range(40)] for _ in range(M.BINS)])
    assert fixed < 1.15 * free


def test_ids_of_very_many_rows_are_divided(spark, monkeypatch):
    monkeypatch.setattr(M, "RANGE_ROWS", 3)
    monkeypatch.setattr(M, "MAX_HOT", 40)
    rows = [(None, f"null {i} text of several more words") for i in range(70)]
    rows += [(50, f"fifty {i} text of several more words") for i in range(80)]
    rows += [(i, f"id {i} text of several more words") for i in range(0, 100, 3)] + [(-(1 << 63), "least of all ids")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = df.select("doc_id", "text", M.row_key().alias("key"))
    placed = M._with_range(keyed).collect()
    order = sorted(placed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.key))
    assert [r["range"] for r in order] == sorted(r["range"] for r in placed)
    assert len({r["range"] for r in placed if r.doc_id is None}) > 20 < len({r["range"] for r in placed if r.doc_id == 50})
    after = {r.text: order[(k + 1) % len(order)].text for k, r in enumerate(order)}
    got = M.compare_with_edits(df.repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        n = len(r.text) // 4
        assert r.edited == r.text[: len(r.text) - n] + after[r.text][:n]
