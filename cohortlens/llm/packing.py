"""Packing: token windows balanced by Karmarkar-Karp multiway differencing.

Every document is tokenised whole and ends with one closing id. It is cut into full windows
(sequences of their own) and a rest in pieces of at most ``piece`` ids. Pieces are dealt into
batches of bounded size; inside a batch the differencing method merges partial partitions with
opposing imbalances, the fullest slots of one with the emptiest of the other, into near-equal
windows. The batch starts with the fewest windows its ids need, and takes more whenever the
fullest window would exceed the capacity. A window whose length is a power of two needs no
padding.

Defined results: null text counts as empty and yields just the closing id; null and repeated
ids are carried through; repeated rows are packed once each; an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.alignment import _byte_letters as byte_letters
from cohortlens.llm.common import documents, stored

CAPACITY = 2048
PIECE = 256
BATCH = 4096  # pieces balanced together
CLOSING_ID = 1

# Letters and digits of Latin-1, where every text is in normal form.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾"
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")
# Where Python and the tokenizer differ about white space, or a special token is spelled.
_ODD = re.compile(r"[\x1c-\x1f]|<\|")

# The same pattern by kinds of bytes, for blocks of Latin-1 texts that each end with a zero byte.
_BYTES = [chr(i) for i in range(256)]
_LOWER = np.frombuffer("".join(_BYTES).lower().encode("latin-1"), np.uint8)
_SPACE, _LETTER, _DIGIT, _OTHER, _END = range(5)
_KIND = np.array(
    [
        _SPACE if c.isspace() else _LETTER if re.match(f"[{_L}]", c) else _DIGIT if re.match(f"[{_N}]", c) else _OTHER
        for c in _BYTES
    ],
    np.uint8,
)
_KIND[0] = _END
_UNSAFE = b"\0\x1c\x1d\x1e\x1f"
BLOCK = 1 << 20  # bytes of texts divided at a time, at about 30 times as much memory
LONG = 400  # bytes of a part that the faster library takes


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def divide(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The distinct parts of lower-cased Latin-1 texts and, for all texts, the place of each part in
    them; the end of a text is a part too, a zero byte."""
    data = _LOWER[np.frombuffer(b"\0".join([*texts, b""]), np.uint8)]
    kind = _KIND[data]
    solid = kind != _SPACE
    starts = solid.copy()
    starts[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT) | (kind[1:] == _END)
    marks = np.flatnonzero((data == ord("'")) & starts)
    if len(marks):
        # An apostrophe takes one of the short endings with it; a zero byte follows every text.
        a, b = data[marks + 1], data[np.minimum(marks + 2, len(data) - 1)]
        two = np.zeros(len(marks), bool)
        for x, y in (b"re", b"ve", b"ll"):
            two |= (a == x) & (b == y)
        ending = two | np.isin(a, np.frombuffer(b"stmd", np.uint8))
        marks, size = marks[ending], np.where(two[ending], 3, 2)
        starts[marks + 1] = False
        after = marks + size
        starts[after] |= kind[after] == _LETTER
    at = np.flatnonzero(starts)
    offsets = np.append(np.cumsum(solid, dtype=np.int32)[at] - 1, np.count_nonzero(solid)).astype(np.int32)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data[solid])]
    found = pa.Array.from_buffers(pa.binary(), len(at), buffers).dictionary_encode()
    return found.dictionary, found.indices.to_numpy()


@lru_cache
def never_made(path: str) -> frozenset[str]:
    """Tokens that merging by rank never makes, not even of their own letters.

    A token stands for two neighbours that would merge into it. If it makes itself, the only
    neighbours that can come up inside its letters are those of its own rule, so merging whatever
    spells a token (as the faster library does) is merging by the rules. Tokens that do not make
    themselves are left out there; they never come up here.
    """
    with open(path) as file:
        model = json.load(file)["model"]
    suffix = model["end_of_word_suffix"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    rank = {p: i for i, p in enumerate(pairs)}
    letters: dict[str, list[str]] = {}
    never = set()
    for a, b in pairs:
        own = letters.get(a, [a]) + letters.get(b, [b])
        letters[a + b] = own
        while len(own) > 1:
            best, i = min((rank.get(p, len(rank)), i) for i, p in enumerate(zip(own, own[1:], strict=False)))
            if best == len(rank):
                never.add(a + b)
                break
            own = [*own[:i], own[i] + own[i + 1], *own[i + 2 :]]
    return frozenset(never) if suffix else frozenset()


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes.

    White space and the tokenizer's own pattern always divide, so a text's ids are those of its
    parts in order. Latin-1 texts are divided in blocks, and each distinct part of a block is
    encoded once, by a faster library with the same vocabulary where that is sure to be the same.
    Other texts go through the tokenizer by parts, with a bounded memory of two generations: what
    is used again is kept.
    """

    def __init__(self, path: str, limit: int = 300_000, never: frozenset[str] | None = None) -> None:
        # Spark runs a task per core; the tokenizer's own threads would only compete with them.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.limit = limit
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        with open(path) as file:
            self.fast, self.last = self._ranked(json.load(file)["model"], never_made(path) if never is None else never)

    def _ranked(self, model: dict, never: frozenset[str]) -> tuple:
        """The vocabulary in the faster library, a space standing for the end of a word, and which
        ids end a word; nothing if ids do not follow the merges."""
        import tiktoken

        visible, suffix, vocab = byte_letters(), model["end_of_word_suffix"] or "", model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        single = {c: vocab.get(c) for c in visible} | {c + suffix: vocab.get(c + suffix) for c in visible}
        merged = [vocab.get(a + b) for a, b in pairs]
        order = range(len(single), len(single) + len(pairs))
        if not suffix or sorted(single.values(), key=lambda i: -1 if i is None else i) != list(range(len(single))) or merged != list(order):
            return None, None
        last = np.zeros(len(single) + len(pairs), bool)
        ranks: dict[bytes, int] = {}
        ended = {c + suffix for c in visible}
        spelled = {c: bytes([x]) for c, x in visible.items()}
        spelled |= {c + suffix: bytes([x]) + b" " for c, x in visible.items()}
        for a, b in pairs:
            spelled[a + b] = spelled[a] + spelled[b]
            if b in ended:
                ended.add(a + b)
        for token, raw in spelled.items():
            last[vocab[token]] = token in ended
            if token not in never:
                ranks[raw] = vocab[token]
        if len(ranks) != len(spelled) - len(never):
            return None, None
        return tiktoken.Encoding("words", pat_str=r"[^ ]+ ", mergeable_ranks=ranks, special_tokens={}), last

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _ids_of(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of distinct parts, and for each part its first place among them and their number."""
        own = parts.to_pylist()
        short = [i for i, p in enumerate(own) if p != b"\0" and len(p) <= LONG]
        text = b" ".join([*(own[i] for i in short), b""]).decode("latin-1")
        ids = [np.array(self.fast.encode_ordinary(text), "<u4")]
        ends = np.flatnonzero(self.last[ids[0]]) + 1
        if len(ends) != len(short):
            raise RuntimeError("the two tokenizer libraries divide words differently")
        first, size = np.zeros(len(own), np.int32), np.zeros(len(own), np.int32)
        size[short] = np.diff(ends, prepend=0)
        first[short] = ends - size[short]
        at = len(ids[0])
        for i, p in enumerate(own):
            if len(p) > LONG:
                ids.append(np.frombuffer(self._encode([p.decode("latin-1")])[0], "<u4"))
                first[i], size[i] = at, len(ids[-1])
                at += len(ids[-1])
        return np.concatenate(ids), first, size

    def _block(self, texts: list[bytes]) -> list[bytes]:
        parts, number = divide(texts)
        ids, first, size = self._ids_of(parts)
        n = size[number]
        to = np.cumsum(n, dtype=np.int32)
        whole = ids[np.arange(to[-1], dtype=np.int32) + np.repeat(first[number] - to + n, n)]
        end = parts.index(pa.scalar(b"\0", parts.type)).as_py()
        bounds = [0, *to[number == end].tolist()]
        return [whole[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]

    def _segments(self, raw: bytes) -> Iterator[bytes]:
        """A long text cut at blanks into about ``BLOCK`` bytes each."""
        lo = 0
        while len(raw) - lo > BLOCK:
            hi = raw.rfind(b" ", lo + 1, lo + BLOCK)
            hi = hi if hi > 0 else raw.find(b" ", lo + BLOCK)
            if hi < 0:
                break
            yield raw[lo:hi]
            lo = hi
        yield raw[lo:]

    def _divide(self, text: str) -> list[str]:
        if _ODD.search(text):
            return [text]
        parts: list[str] = []
        for chunk in text.split():
            if _latin(chunk):
                parts += _PARTS.findall(chunk.lower())
            else:
                parts.append(chunk)
        return parts

    def _by_parts(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.limit:
            self.before, self.known = self.known, {}
        known, before = self.known, self.before
        divided = [self._divide(t) for t in texts]
        missing = set().union(*divided).difference(known)
        kept = [p for p in missing if p in before]
        known.update((p, before[p]) for p in kept)
        new = list(missing.difference(kept))
        if new:
            known.update(zip(new, self._encode(new), strict=True))
        return [b"".join(map(known.__getitem__, parts)) for parts in divided]

    def _plain(self, text: str) -> bytes | None:
        """The text in Latin-1, if the faster way can take it."""
        if self.fast is None or "<|" in text or not _latin(text):
            return None
        raw = text.encode("latin-1")
        return raw if len(raw.translate(None, _UNSAFE)) == len(raw) else None

    def __call__(self, texts: list[str]) -> list[bytes]:
        out, block, held, rest = [b""] * len(texts), [], 0, []

        def flush() -> None:
            for (i, _), ids in zip(block, self._block([raw for _, raw in block]), strict=True):
                out[i] += ids
            block.clear()

        for i, text in enumerate(texts):
            plain = self._plain(text)
            if plain is None:
                rest.append(i)
                continue
            for raw in self._segments(plain):
                if block and held + len(raw) > BLOCK:
                    flush()
                    held = 0
                block.append((i, raw))
                held += len(raw)
        if block:
            flush()
        for i, ids in zip(rest, self._by_parts([texts[i] for i in rest]), strict=True):
            out[i] = ids
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, never: frozenset[str] | None = None) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, never=never)
    return _ENCODERS[path]


def _cut(
    batches: Iterator[pa.RecordBatch], path: str, never: frozenset[str], capacity: int, piece: int
) -> Iterator[pa.RecordBatch]:
    """Pieces of every document of a batch, about ``BLOCK`` characters at a time."""
    encode = encoder(path, never)
    closing = np.array([CLOSING_ID], "<u4").tobytes()
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        at = 0
        while at < len(texts):
            end, size, some = at, 0, []
            while end < len(texts) and (size < BLOCK or not some):
                some.append(texts[end].as_py())
                size += len(some[-1])
                end += 1
            rows: list[tuple] = []
            whole = [raw + closing for raw in encode(some)]
            for doc, raw in zip(ids[at:end], whole, strict=True):
                total, start = len(raw) // 4, 0
                while start < total:
                    full = total - start >= capacity
                    n = capacity if full else min(piece, total - start)
                    rows.append((doc, start, n, total))
                    start += n
            at = end
            columns = list(zip(*rows, strict=True))
            # The pieces follow each other, so their lengths divide the ids of all texts.
            ends = np.cumsum([0, *columns[2]], dtype=np.int32)
            own = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(whole), "<i4")))
            names = ["doc_id", "start", "length", "doc_tokens", "ids"]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), own], names)


def differencing(lengths: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp for ``k`` groups, balanced form: positions with near-equal sums.

    The lengths, longest first, start as partial partitions of ``k`` neighbours. The two with
    the largest imbalance are merged, largest sum to smallest, until one is left.
    """
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    heap = []
    for tie, at in enumerate(range(0, len(order), k)):
        own = order[at : at + k]
        sums = np.zeros(k, np.int64)
        sums[: len(own)] = [lengths[i] for i in own]
        slots = [[i] for i in own] + [[] for _ in range(k - len(own))]
        heap.append((-int(sums.max() - sums.min()), tie, sums, slots))
    heapq.heapify(heap)
    tie = len(lengths)
    while len(heap) > 1:
        _, _, a, own = heapq.heappop(heap)
        _, _, b, other = heapq.heappop(heap)
        sums = a + b[::-1]
        down = np.argsort(-sums, kind="stable")
        merged = [own[i] + other[k - 1 - i] for i in down.tolist()]
        sums = sums[down] - sums.min()
        heapq.heappush(heap, (-int(sums[0]), tie, sums, merged))
        tie += 1
    return heap[0][3] if heap else []


def windows(lengths: list[int], capacity: int) -> list[list[int]]:
    """The fewest near-equal windows, more whenever one exceeds the capacity."""
    k = -(-sum(lengths) // capacity)
    while lengths:
        groups = differencing(lengths, k)
        if max(sum(lengths[i] for i in g) for g in groups) <= capacity:
            return groups
        k += 1
    return []


def _place(table: pa.Table, capacity: int) -> pa.Table:
    table = table.sort_by("piece")
    lengths = table["length"].to_pylist()
    rest = [i for i, n in enumerate(lengths) if n < capacity]
    full = [[i] for i, n in enumerate(lengths) if n == capacity]
    found = windows([lengths[i] for i in rest], capacity)
    groups = full + [[rest[i] for i in g] for g in found if g]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for s, group in enumerate(groups):
        at = 0
        for i in group:
            sequence[i], offset[i] = s, at
            at += lengths[i]
    ids = table["ids"]
    digests = [
        zlib.crc32(own.values.to_numpy().astype("<u4", copy=False)) for c in ids.chunks for own in c
    ]
    first = table["batch"][0].as_py() * (2 * BATCH)
    out = {c: table[c] for c in ("doc_id", "start", "length")}
    out |= {"ids_crc32": pa.array(digests, pa.int64()), "doc_tokens": table["doc_tokens"], "ids": ids}
    return pa.table(out | {"sequence_id": pa.array(first + sequence), "offset": pa.array(offset)})


def pack(
    df: DataFrame,
    vocabulary: str,
    capacity: int = CAPACITY,
    piece: int = PIECE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, ids, sequence_id, offset.

    ``vocabulary`` is the path of a tokenizer file that every executor can read. ``ids_crc32`` is
    taken from the ids of the placed piece.
    """
    cut = documents(df, id_col, text_col).mapInArrow(
        partial(_cut, path=vocabulary, never=never_made(vocabulary), capacity=capacity, piece=piece),
        "doc_id long, start long, length long, doc_tokens long, ids array<int>",
    )
    # The written pieces are numbered by file and row, so a repeated task numbers them alike.
    pieces = stored(cut, "pieces")
    batches = max(1, -(-pieces.count() // (BATCH // 2)))
    pieces = pieces.withColumn("piece", F.monotonically_increasing_id())
    dealt = pieces.withColumn("batch", F.pmod(F.xxhash64("piece"), F.lit(batches)))

    def place(table: pa.Table) -> pa.Table:
        return _place(table, capacity)

    return dealt.groupBy("batch").applyInArrow(
        place,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>, "
        "sequence_id long, offset long",
    )
