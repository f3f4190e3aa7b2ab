from collections import defaultdict

import numpy as np
import pytest
import xxhash

from cohortlens.llm import simhash

U = np.uint64


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def noisy(rng, n, groups):
    base = rng.integers(0, 2**64, groups, dtype=U)
    out = base[rng.integers(0, groups, n)]
    for _ in range(4):
        flip = U(1) << rng.integers(0, 64, n).astype(U)
        out = np.where(rng.random(n) < 0.5, out ^ flip, out)
    return out


def test_fingerprints_match_brute_force():
    texts = ["", "a", "A b", "one two three four", "ß É x\x0by\x1cz " * 200, "q " * 1000]
    for t in texts:
        assert simhash.majority(simhash.shingle_hashes(t.encode(), 3)) == brute_fingerprint(t)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_forest_spans_all_links(seed):
    rng = np.random.default_rng(seed)
    fps = np.unique(noisy(rng, 500, 12))
    a, b = simhash.forest(np.zeros(len(fps), np.int64), fps, 3, chunk=50)
    place = {int(f): i for i, f in enumerate(fps)}
    roots = brute_components([int(f) for f in fps])
    got = defaultdict(set)
    root = list(range(len(fps)))
    for x, y in zip(a, b, strict=True):
        root[place[int(x)]] = place[int(y)]
    for i, r in enumerate(root):
        got[r].add(i)
    want = defaultdict(set)
    for i, r in enumerate(roots):
        want[r].add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("max_bucket", [50_000, 3])
def test_links_in_spark(spark, max_bucket):
    from cohortlens.llm.common import components

    fps = np.unique(noisy(np.random.default_rng(7), 300, 10))
    values = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    found = components(simhash.links(values, 3, max_bucket)).collect()
    groups = defaultdict(set)
    for r in found:
        groups[r.root].add(r.node)
    want = defaultdict(set)
    for i, r in enumerate(brute_components([int(f) for f in fps])):
        want[r].add(int(fps.view(np.int64)[i]))
    assert sorted(map(sorted, groups.values())) == sorted(
        sorted(g) for g in want.values() if len(g) > 1
    )


def test_edge_rows(spark):
    rows = [(1, None, "k"), (2, "", "k"), (None, "a b c d", "k"), (5, "a b c d", "k"), (5, "a b c d", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = {(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(df).collect()}
    fp = int(np.array([brute_fingerprint("a b c d")], U).view(np.int64)[0])
    assert got == {(1, 0, 1), (2, 0, 1), (None, fp, 5), (5, fp, 5)}
    assert simhash.near_duplicates(df).count() == 5
    assert simhash.near_duplicates(df.limit(0)).count() == 0
