import random
from collections import Counter
from functools import reduce

import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortlens.llm import alignment
from cohortlens.llm.alignment import Fragment, Tokens, compose, finished, written

PATHS = (P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
TOOL = alignment.pair(*PATHS)
A = Tokenizer.from_file(PATHS[0])
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def brute(text):
    """Groups of the whole text by the plain tokenizers, or none."""
    if not text:
        return []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    names = {chr(k): v for k, v in zip(map(ord, alignment._byte_letters()), alignment._byte_letters().values(), strict=True)}
    a_bytes = [bytes(names[c] for c in A.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return []
    groups, own, i, j, at, bt = [], ([], []), 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if at <= bt and i < len(a):
            own[0].append(a[i])
            at += len(a_bytes[i])
            i += 1
        else:
            own[1].append(b[j])
            bt += len(b_bytes[j])
            j += 1
        if at == bt:
            groups.append(own)
            own = ([], [])
    return groups


def shown(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


PIECES = ["the ", " of", "tion", "  ", " ", "\n", "\t", "'s", "don't", "é", "ß", "漢字", "かな", "😀", "▁", "\xa0", " ", "\x1c", "1234", "<|endoftext|>", "<s>", "<0x41>", "...", "word", "Word", "ZZZ", "\r\n", ",", "'", "a'", "́", "ﬁ"]
TEXTS = st.lists(st.sampled_from(PIECES) | st.text(max_size=4), max_size=25).map("".join)


@settings(max_examples=1500, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=4))
def test_whole_texts_match_the_plain_tokenizers(texts):
    for text, got in zip(texts, TOOL.aligned(texts), strict=True):
        want = brute(text)
        assert got[3] == shown(want)
        assert got[:3] == (sum(len(a) for a, _ in want), sum(len(b) for _, b in want), len(want))


@settings(max_examples=800, deadline=None)
@given(TEXTS, st.integers(1, 12), st.randoms())
def test_ranges_compose_in_any_order(text, size, rng):
    if not text or not brute(text):
        return
    found = [TOOL.fragment(*r) for r in TOOL.ranges(text, size)]
    while len(found) > 1:
        i = rng.randrange(len(found) - 1)
        found[i : i + 2] = [compose(found[i], found[i + 1])]
    assert finished(found[0])[0] == shown(brute(text))
    assert (found[0].n_a, found[0].n_b) == tuple(sum(len(g[k]) for g in brute(text)) for k in (0, 1))


def single(side, token, end):
    return Fragment(prefix=Tokens([token], [end], [], []) if side else Tokens([], [], [token], [end]), n_a=side, n_b=1 - side)


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(1, 30)), st.sets(st.integers(1, 30)), st.randoms())
def test_composition_is_associative(a, b, rng):
    """Token by token, with equal ends in either order of the sides' ranges."""
    a, b = sorted(a | {31}), sorted(b | {31})
    items = sorted([(e, 1) for e in a] + [(e, 0) for e in b])
    frags = [single(side, e, e) for e, side in items]
    left = reduce(compose, frags)
    right = reduce(lambda x, y: compose(y, x), reversed(frags))
    some = list(frags)
    while len(some) > 1:
        i = rng.randrange(len(some) - 1)
        some[i : i + 2] = [compose(some[i], some[i + 1])]
    texts = [finished(x)[0] for x in (left, right, some[0])]
    ends = sorted(set(a) & set(b))
    want = [([x for x in a if lo < x <= hi], [x for x in b if lo < x <= hi]) for lo, hi in zip([0, *ends], ends, strict=False)]
    assert texts == [shown(want)] * 3
    assert compose(Fragment(), left) == compose(left, Fragment()) == left or finished(compose(left, Fragment()))[0] == texts[0]


def documents():
    rng = random.Random(8)
    words = ["the", "of", "naïve", "tokenization", "don't", "漢字かな", "😀", "x" * 90, "Straße", "1234567"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " "), (103, "a▁b"), (104, "  two  spaces \n x "), (None, rows[3][1]), (3, rows[3][1])]
    long = " ".join(rng.choice(words) for _ in range(2500))
    rows += [(200, long), (201, long + "\n" + "漢字、" * 900), (202, "a" * 3000), (203, long + "▁")]
    return rows


def brute_documents(rows):
    groups = [brute(t) for _, t in rows]
    counts = Counter((a[-1], b[-1]) for g in groups for a, b in g)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for (i, _), g in zip(rows, groups, strict=True):
        links = [(a[-1], b[-1]) for a, b in g]
        best = sum(counts[x] == most[x[1]] for x in links)
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), best, sum(counts[x] for x in links), shown(g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("frequent", [1 << 17, 20, 0])
def test_documents_match_brute_force(spark, frequent):
    rows = documents()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row int, links string")
    found = alignment.align(df.repartition(3), *PATHS, frequent=frequent, long=2000)
    joined = found.documents.join(found.scores, "row", "left").collect()
    got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_best or 0, r.count_sum or 0, r.groups) for r in joined]
    assert sorted(got, key=str) == brute_documents(rows)
    assert all(len(r.links) == r.n_groups for r in joined)


def test_empty_table(spark):
    found = alignment.align(spark.createDataFrame([], "doc_id long, text string"), *PATHS)
    assert found.documents.count() == 0 and found.scores.count() == 0


def test_written_groups():
    text, codes = written([Tokens([1, 2], [1, 2], [3], [2])])
    assert text == ["1,2|3"] and codes[0].tolist() == [2 << 15 | 3]
