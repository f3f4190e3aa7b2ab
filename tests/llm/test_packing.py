import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlens.llm import packing

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def expected(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


TEXTS = [
    None, "", "Hello, World's end! it's 1234", "ñandú ÉTÉ ß ﬁ İstanbul ΟΔΟΣ x\x1cy z\x85w",
    "áb é ́x", "<|endoftext|> a <|startoftext|>b", "日本語 テスト", "_a_b__ c-d",
    "x y z", "word " * 5000, "'S 'LL don'T", "½ ² ٣", "<| x", "𝔘nicode ퟿",
]


def test_encoder_equals_tokenizer(tokenizer):
    got = packing.encoder(PATH)([t or "" for t in TEXTS])
    for text, raw in zip(TEXTS, got, strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == expected(tokenizer, text)[:-1], repr(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_encoder_on_any_text(text):
    whole = packing.encoder(PATH).tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.encoder(PATH)([text])[0], "<u4").tolist() == whole


def test_differencing_balances():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 257, 800).tolist()
    groups = packing.windows(lengths, 2048)
    assert sorted(i for g in groups for i in g) == list(range(800))
    sums = [sum(lengths[i] for i in g) for g in groups]
    assert max(sums) <= 2048 and sum(sums) > 0.97 * 2048 * len(sums)
    assert packing.windows([], 10) == [] and packing.windows([10, 10, 1], 10) != []


def test_pack_is_an_exact_round_trip(spark, tokenizer):
    rows = [(i, t, "z") for i, t in enumerate(TEXTS)] + [(None, "no id", "z"), (3, TEXTS[3], "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.pack(df, PATH).collect()
    for i, text in enumerate(TEXTS):
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        ids = expected(tokenizer, text)
        copies = 2 if i == 3 else 1
        assert sum(r.length for r in own) == copies * len(ids)
        if copies == 1:
            assert [x for r in own for x in r.ids] == ids
        for r in own:
            assert r.ids == ids[r.start : r.start + r.length] and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_pipeline_returns_windows_of_ids(spark, tokenizer):
    import corpus_pipeline

    rows = [(i, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.packing(spark, docs, "").collect()
    for i, text in enumerate(TEXTS):
        own = sorted((r.start, r.ids) for r in got if r.doc_id == i)
        assert [x for _, ids in own for x in ids] == expected(tokenizer, text)


def test_digest_is_that_of_the_placed_ids():
    import pyarrow as pa

    ids = [[7, 8, 9], [1], [5] * 40]
    n = pa.array([len(i) for i in ids], pa.int64())
    columns = {"doc_id": n, "start": n, "length": n, "doc_tokens": n, "ids": pa.array(ids, pa.list_(pa.int32())), "piece": pa.array([2, 0, 1]), "batch": pa.array([3, 3, 3])}
    got = packing._place(pa.table(columns), 64).to_pylist()
    assert [r["ids"] for r in got] == [ids[1], ids[2], ids[0]]
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in got)
    assert len({r["sequence_id"] for r in got}) == 1 and got[0]["sequence_id"] == 3 * 2 * packing.BATCH


LATIN = st.characters(min_codepoint=0, max_codepoint=255)
TRICKY = st.sampled_from(["'s", "'re", "''ll", "'", " ", "\n", "..", "!'", "d", "7", "½", "É", "\xa0", "\x85", "\x00", "\x1d", "<|", "ab'tcd", "a" * 500])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(LATIN, max_size=12), TRICKY).map(str), max_size=12), st.integers(1, 60))
def test_blocks_of_latin_texts(parts, block):
    """Joined in several ways, cut into blocks of any size."""
    texts = ["".join(parts), " ".join(parts), *parts]
    encode = packing.encoder(PATH)
    was, packing.BLOCK = packing.BLOCK, block
    try:
        got = encode(texts)
    finally:
        packing.BLOCK = was
    for text, raw in zip(texts, got, strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_every_token_makes_itself_and_the_libraries_agree(tokenizer):
    """What the faster library needs to give the same ids; every entry of the vocabulary as a word."""
    import pyarrow as pa

    assert packing.never_made(PATH) == frozenset()
    encode = packing.encoder(PATH)
    assert encode.fast is not None
    letters = {chr(i) for i in range(256)} - {chr(0)}
    words = {t.replace("</w>", "").lower() for t in tokenizer.get_vocab()}
    words = sorted({p for w in words if set(w) <= letters for p in packing._PARTS.findall(w)})
    ids, first, size = encode._ids_of(pa.array([w.encode("latin-1") for w in words], pa.binary()))
    for i, raw in enumerate(encode._encode(words)):
        assert ids[first[i] : first[i] + size[i]].tobytes() == raw, words[i]


def test_a_vocabulary_without_that_order_goes_by_parts(tmp_path):
    import json

    with open(PATH) as file:
        spec = json.load(file)
    vocab = spec["model"]["vocab"]
    a, b = sorted(vocab, key=vocab.get)[600:602]
    vocab[a], vocab[b] = vocab[b], vocab[a]
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    encode = packing.Encoder(str(path))
    assert encode.fast is None
    for text in TEXTS[1:8]:
        whole = encode.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode([text])[0], "<u4").tolist() == whole
