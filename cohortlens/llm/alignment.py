"""Cross-tokenizer alignment by an associative monoid of fragments.

Two tokenizers cut the same bytes. Where a token of A and a token of B end at the same byte, both
token sequences can be cut; between two such ends lies a group. A fragment describes a byte range:
an open prefix (the tokens up to its first common end, whose beginning may lie outside), closed
groups, and an open suffix (the tokens behind its last common end). Fragments compose: the suffix
of the left and the prefix of the right are regrouped, all else is only joined. Composition is
associative, so any division of a document and any tree of compositions give the same groups.

Ordinary texts are products of fragments of their words: neither tokenizer merges across the space
before a word, so a word's fragment is closed on both sides and a worker keeps it in a bounded
memory. A text of more than ``LONG`` characters is divided into byte ranges that go to different
tasks, and its fragments are composed by a tree of shuffles. There each tokenizer has its own safe
places to start, so ranges are not closed and the open ends matter. A safe place for A lies between
a letter and something its pattern never joins to it; a safe place for B between two characters
that are neighbours in none of its pieces.

Link counts are taken over the corpus by Spark. To score documents, the most frequent pairs (at
most ``FREQUENT``) go to all tasks; links of other pairs meet their counts in a shuffled join.

Defined results: null or empty texts, and texts that a tokenizer does not reproduce byte for byte,
have no tokens; null and repeated ids are carried through; repeated rows are counted as often as
they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import documents, stored

LONG = 1 << 16  # characters of a text, and of a byte range of a longer text
FAN = 16  # fragments composed at once
FREQUENT = 1 << 17  # pairs that every task may hold
MEMORY = 80_000  # words whose fragments a worker keeps, twice
WORD = 64  # longer words are not kept
RUN = 1 << 14  # characters of new words that go through the tokenizers at once
FLUSH = 1 << 19  # characters of one output batch
COUNT = 40  # bits of a count; two share a number
B_BITS = 15

Batches = Iterator[pa.RecordBatch]

# Behind a letter, the pattern of A never goes on with one of these.
_A_CUT = re.compile(r"(?<=[^\W\d_])(?=[ \n\t0-9!-&(-/:-@\[-`{-~、。！，？])")
_WORD = re.compile(r"(?<=\S)(?= )")
_ODD = re.compile(r"\s |\s\Z")


class Tokens(NamedTuple):
    """Ids and the byte offsets of their ends, of both tokenizers."""

    a: list[int]
    a_end: list[int]
    b: list[int]
    b_end: list[int]

    def plus(self, other: Tokens) -> Tokens:
        return Tokens(*(x + y for x, y in zip(self, other, strict=True)))


NONE = Tokens([], [], [], [])
Group = tuple[list[int], list[int]]


@dataclass
class Fragment:
    """``cut``: holds a common end. Without one, all tokens are in ``prefix``."""

    cut: bool = False
    prefix: Tokens = NONE
    closed: list[str] = field(default_factory=list)
    links: list[np.ndarray] = field(default_factory=list)
    suffix: Tokens = NONE
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0


def regroup(t: Tokens) -> tuple[list[Tokens], Tokens]:
    """The groups of open tokens, and the tokens behind their last common end."""
    common = sorted(set(t.a_end) & set(t.b_end))
    found, i, j = [], 0, 0
    for end in common:
        p, q = t.a_end.index(end, i) + 1, t.b_end.index(end, j) + 1
        found.append(Tokens(t.a[i:p], t.a_end[i:p], t.b[j:q], t.b_end[j:q]))
        i, j = p, q
    return found, Tokens(t.a[i:], t.a_end[i:], t.b[j:], t.b_end[j:])


def written(groups: list[Tokens]) -> tuple[list[str], list[np.ndarray]]:
    """Groups as text, and the codes of their links."""
    if not groups:
        return [], []
    text = ";".join(f"{','.join(map(str, g.a))}|{','.join(map(str, g.b))}" for g in groups)
    return [text], [np.array([g.a[-1] << B_BITS | g.b[-1] for g in groups], np.int32)]


def compose(x: Fragment, y: Fragment) -> Fragment:
    groups, rest = regroup((x.suffix if x.cut else x.prefix).plus(y.prefix))
    out = Fragment(n_a=x.n_a + y.n_a, n_b=x.n_b + y.n_b)
    prefix, closed, links = x.prefix, x.closed, x.links
    if not x.cut:
        prefix, closed, links = (groups.pop(0) if groups else NONE), [], []
        if prefix is NONE:
            out.prefix = rest
            return out
    text, codes = written(groups)
    out.cut, out.prefix, out.suffix = True, prefix, y.suffix if y.cut else rest
    out.closed, out.links = closed + text + y.closed, links + codes + y.links
    out.n_groups = x.n_groups + y.n_groups + len(groups)
    return out


def finished(x: Fragment) -> tuple[str, np.ndarray, int]:
    """Groups as text, link codes and number of groups of a whole document's fragment."""
    if any(x.suffix) or not x.cut:
        raise ValueError("the tokenizers do not end together")
    text, codes = written([x.prefix])
    return ";".join(text + x.closed), np.concatenate(codes + x.links), x.n_groups + 1


class Pair:
    """The two tokenizers, the bytes of their tokens, and the groups of a batch of texts."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer, pre_tokenizers

        self.slow = Tokenizer.from_file(a_path)
        self.slow.encode_special_tokens = True
        self.piece = sentencepiece.SentencePieceProcessor(model_file=b_path)
        with open(a_path) as file:
            model = json.load(file)["model"]
        visible = _byte_letters()
        special = {t.content for t in self.slow.get_added_tokens_decoder().values()}
        own = {t: i for t, i in model["vocab"].items() if t not in special}
        names = {i: bytes(visible[c] for c in t) for t, i in own.items()}
        self.a_bytes = [names.get(i, b"") for i in range(max(names) + 1)]
        n = self.piece.get_piece_size()
        if n > 1 << B_BITS or len(self.a_bytes) > 1 << (31 - B_BITS):
            raise ValueError("vocabularies too large for 32-bit pair codes")
        self.b_bytes = [self._piece_bytes(i) for i in range(n)]
        self.space = self.piece.piece_to_id("▁")
        self.a_size = np.array([len(x) for x in self.a_bytes])
        self.b_size = np.array([len(x) for x in self.b_bytes])
        pieces = [p for i in range(n) if not self.piece.is_byte(i) for p in [self.piece.id_to_piece(i)]]
        #: Neighbours inside pieces: B may only be cut between others.
        self.joined = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.by_word = not any(p[0] != "▁" and p[1] == "▁" for p in self.joined)
        self.breaks = any("\n" in p for p in pieces)
        numbers = [str(i) for i in range(max(n, len(self.a_bytes)))]
        self.shown = np.array([[x + sep for x in numbers] for sep in ",|;"], object)
        self.fast = self._ranked(own, model["merges"])
        self.known: dict[str, tuple] = {}
        self.before: dict[str, tuple] = {}

    def _piece_bytes(self, i: int) -> bytes:
        if self.piece.is_byte(i):
            return bytes([int(self.piece.id_to_piece(i)[3:-1], 16)])
        if self.piece.is_control(i) or self.piece.is_unknown(i):
            return b""
        return self.piece.id_to_piece(i).replace("▁", " ").encode()

    def _ranked(self, own: dict[str, int], merges: list) -> object:
        """The same vocabulary in a faster library, where ids follow the order of the merges."""
        import public_tokenizers
        import tiktoken

        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        ranks = [own["".join(m)] for m in pairs]
        if ranks != list(range(len(own) - len(ranks), len(own))):
            return None
        found = {x: i for i, x in enumerate(self.a_bytes) if x}
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=found, special_tokens={})

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts as they follow other text: none gets a space of its own."""
        own = [t[1:] if t[0] == " " else "\n" + t for t in texts]
        found = self.piece.encode(own, num_threads=1)
        # A lone space is a piece that the encoder's own space does not make.
        found = [ids if o else [self.space] for ids, o in zip(found, own, strict=True)]
        return [ids if t[0] == " " else ids[2:] for ids, t in zip(found, texts, strict=True)]

    def words(self, text: str) -> list[str]:
        """Words with the space before them (left out), or the whole text where that is not safe."""
        if not self.by_word:
            return [text]
        if _ODD.search(text) or text[0] == " ":
            return [w[1:] for w in _WORD.split(" " + text)]
        return text.split(" ")

    def learn(self, words: list[str]) -> dict[str, tuple | None]:
        """(counts, groups, links) of each word behind a space; none where bytes differ.

        Words that may follow each other without merging are one sequence for the tokenizers.
        """
        out: dict[str, tuple | None] = {}
        run: list[str] = []
        size = 0
        for w in words:
            if not w or w[-1].isspace() or len(w) > WORD:
                self._learn([w], out)
                continue
            run.append(w)
            size += len(w)
            if size > RUN:
                self._learn(run, out)
                run, size = [], 0
        if run:
            self._learn(run, out)
        return out

    def _learn(self, words: list[str], out: dict[str, tuple | None]) -> None:
        text = " " + " ".join(words)
        raw = text.encode()
        a_ids = self.fast.encode_ordinary(text) if self.fast is not None and (len(words) > 1 or len(text) <= 1000) else self.slow_a(text)
        b_ids = self.encode_b([text])[0]
        if not b"".join(map(self.a_bytes.__getitem__, a_ids)) == raw == b"".join(map(self.b_bytes.__getitem__, b_ids)):
            if len(words) == 1:
                out[words[0]] = None
            else:
                half = len(words) // 2
                self._learn(words[:half], out)
                self._learn(words[half:], out)
            return
        a, b = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
        text_of, links, marks = self.grouped(a, b)
        # Words end where both sequences end: their tokens and groups follow from the bytes.
        ends = np.cumsum([0, *(len(w.encode()) + 1 for w in words)])
        a_from = np.searchsorted(np.cumsum(self.a_size[a]), ends, "right")
        b_from = np.searchsorted(np.cumsum(self.b_size[b]), ends, "right")
        at = (a_from + b_from).tolist()
        groups = (np.searchsorted(marks, a_from, "right") * 4).tolist()
        counts = (np.diff(a_from) | np.diff(b_from) << COUNT).tolist()
        codes = links.tobytes()
        for k, w in enumerate(words):
            out[w] = (counts[k], "".join(text_of[at[k] : at[k + 1]])[:-1], codes[groups[k] : groups[k + 1]])

    def slow_a(self, text: str) -> list[int]:
        return self.slow.encode(text, add_special_tokens=False).ids

    def grouped(self, a: np.ndarray, b: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Tokens of one sequence as text in the order of the groups, link codes, and the number
        of A tokens up to each group's end. Both sequences cover the same bytes."""
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        _, i, j = np.intersect1d(a_end, b_end, assume_unique=True, return_indices=True)
        links = (a[i] << B_BITS | b[j]).astype(np.int32)
        # Tokens of a side up to each token's group, its own side's place included.
        ga = np.searchsorted(i, np.arange(len(a)))
        gb = np.searchsorted(j, np.arange(len(b)))
        a_mark, b_mark = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_mark[i], b_mark[j] = 1, 2
        before_b = np.r_[0, j + 1][ga]
        upto_a = (i + 1)[gb]
        out = np.empty(len(a) + len(b), object)
        out[np.arange(len(a)) + before_b] = self.shown[a_mark, a]
        out[np.arange(len(b)) + upto_a] = self.shown[b_mark, b]
        return out.tolist(), links, i + 1

    def aligned(self, texts: list[str]) -> Iterator[tuple]:
        """(n_a, n_b, n_groups, groups, links) of whole texts; empty for texts without tokens."""
        if len(self.known) > MEMORY:
            self.before, self.known = self.known, {}
        divided = [self.words(t) if t else [] for t in texts]
        missing = set().union(*divided).difference(self.known)
        kept = {w: self.before[w] for w in missing if w in self.before}
        self.known |= kept
        found = self.learn(list(missing.difference(kept)))
        self.known |= found
        for words in divided:
            parts = list(map(self.known.__getitem__, words))
            if parts and None not in parts:
                counts, groups, links = zip(*parts, strict=True)
                total, codes = sum(counts), b"".join(links)
                yield total & ((1 << COUNT) - 1), total >> COUNT, len(codes) // 4, ";".join(groups), codes
            else:
                yield 0, 0, 0, "", b""
        for w in found:
            if len(w) > WORD:
                del self.known[w]

    def ranges(self, text: str, size: int = LONG) -> Iterator[tuple[str, int, str, int]]:
        """Byte ranges of a long text: the characters of A and of B, each with its first byte."""
        s = " " + text
        a, b, a_byte, b_byte = 0, 0, 0, 0
        while a < len(s) or b < len(s):
            target = max(a, b) + size
            a_next, b_next = self._next_a(s, target), self._next_b(s, target)
            yield s[a:a_next], a_byte, s[b:b_next], b_byte
            a_byte += len(s[a:a_next].encode())
            b_byte += len(s[b:b_next].encode())
            a, b = a_next, b_next

    def _next_a(self, s: str, at: int) -> int:
        found = _A_CUT.search(s, at) if at < len(s) and self.fast is not None else None
        return found.start() if found else len(s)

    def _next_b(self, s: str, at: int) -> int:
        while at < len(s):
            x, y = s[at - 1 : at + 1].replace(" ", "▁")
            if x + y not in self.joined and not (y != "▁" and self.breaks):
                return at
            at += 1
        return len(s)

    def fragment(self, a_text: str, a_at: int, b_text: str, b_at: int) -> Fragment | None:
        """The fragment of a byte range; none if a tokenizer does not reproduce its bytes."""
        a = np.array(self.slow_a(a_text) if a_text else [], np.int64)
        b = np.array(self.encode_b([b_text])[0] if b_text else [], np.int64)
        for ids, names, text in ((a, self.a_bytes, a_text), (b, self.b_bytes, b_text)):
            if b"".join([names[i] for i in ids.tolist()]) != text.encode():
                return None
        a_end, b_end = a_at + np.cumsum(self.a_size[a]), b_at + np.cumsum(self.b_size[b])
        _, i, j = np.intersect1d(a_end, b_end, assume_unique=True, return_indices=True)

        def tokens(p: int | None, q: int | None, r: int | None, s: int | None) -> Tokens:
            return Tokens(*(x.tolist() for x in (a[p:q], a_end[p:q], b[r:s], b_end[r:s])))

        out = Fragment(n_a=len(a), n_b=len(b))
        if not len(i):
            out.prefix = tokens(0, None, 0, None)
            return out
        out.cut, out.n_groups = True, len(i) - 1
        out.prefix, out.suffix = tokens(0, i[0] + 1, 0, j[0] + 1), tokens(i[-1] + 1, None, j[-1] + 1, None)
        if out.n_groups:
            # Both sides start behind the first common end, so sizes add up alike from there.
            text, links, _ = self.grouped(a[i[0] + 1 : i[-1] + 1], b[j[0] + 1 : j[-1] + 1])
            out.closed, out.links = ["".join(text)[:-1]], [links]
        return out


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies show printable bytes as they are, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair(a_path: str, b_path: str) -> Pair:
    """One pair of tokenizers per worker process."""
    if (a_path, b_path) not in _PAIRS:
        _PAIRS[a_path, b_path] = Pair(a_path, b_path)
    return _PAIRS[a_path, b_path]


SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, groups string, links array<int>"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "groups", "links"]


def _batch(ids: list, rows: list[tuple]) -> pa.RecordBatch:
    n_a, n_b, n_groups, groups, links = zip(*rows, strict=True)
    ends = np.cumsum([0, *(len(x) // 4 for x in links)], dtype=np.int32)
    flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(links), np.int32)))
    counts = (pa.array(x, pa.int64()) for x in (ids, n_a, n_b, n_groups))
    return pa.RecordBatch.from_arrays([*counts, pa.array(groups, pa.string()), flat], COLUMNS)


def _whole(batches: Batches, paths: tuple[str, str]) -> Batches:
    """Documents that one task deals with whole."""
    tool = pair(*paths)
    for batch in batches:
        ids, texts, at = batch.column("doc_id").to_pylist(), batch.column("text"), 0
        while at < len(ids):
            some, size = [], 0
            while at + len(some) < len(ids) and size < FLUSH:
                some.append(texts[at + len(some)].as_py())
                size += len(some[-1])
            yield _batch(ids[at : at + len(some)], list(tool.aligned(some)))
            at += len(some)


def _divide(batches: Batches, paths: tuple[str, str], size: int) -> Batches:
    tool = pair(*paths)
    names = ["number", "doc_id", "part", "a_text", "a_at", "b_text", "b_at"]
    for batch in batches:
        for number, doc, text in zip(*(batch.column(c) for c in ("number", "doc_id", "text")), strict=True):
            for part, found in enumerate(tool.ranges(text.as_py(), size)):
                row = [number.as_py(), doc.as_py(), part, *found]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)


_OPEN = ["a", "a_end", "b", "b_end"]
FRAGMENT = (
    "number long, doc_id long, part long, valid boolean, cut boolean, n_a long, n_b long, n_groups long, "
    + "".join(f"{side}_{c} array<long>, " for side in ("prefix", "suffix") for c in _OPEN)
    + "closed string, links array<int>"
)


def _fragment_batch(number: int, doc: int | None, part: int, x: Fragment | None) -> pa.RecordBatch:
    y = x or Fragment()
    links = np.concatenate(y.links) if y.links else np.empty(0, np.int32)
    cells: dict[str, pa.Array] = {}
    for name, value in (("number", number), ("doc_id", doc), ("part", part)):
        cells[name] = pa.array([value], pa.int64())
    cells |= {"valid": pa.array([x is not None]), "cut": pa.array([y.cut])}
    for name in ("n_a", "n_b", "n_groups"):
        cells[name] = pa.array([getattr(y, name)], pa.int64())
    for side in ("prefix", "suffix"):
        for c, values in zip(_OPEN, getattr(y, side), strict=True):
            cells[f"{side}_{c}"] = pa.array([values], pa.list_(pa.int64()))
    cells["closed"] = pa.array([";".join(y.closed)], pa.string())
    cells["links"] = pa.ListArray.from_arrays(pa.array([0, len(links)], pa.int32()), pa.array(links))
    return pa.RecordBatch.from_pydict(cells)


def _fragment_of(row: dict) -> Fragment | None:
    if not row["valid"].as_py():
        return None
    out = Fragment(cut=row["cut"].as_py(), **{c: row[c].as_py() for c in ("n_a", "n_b", "n_groups")})
    out.prefix, out.suffix = (Tokens(*(row[f"{side}_{c}"].as_py() for c in _OPEN)) for side in ("prefix", "suffix"))
    if out.n_groups:
        out.closed, out.links = [row["closed"].as_py()], [row["links"].values.to_numpy()]
    return out


def _tokenise(batches: Batches, paths: tuple[str, str]) -> Batches:
    tool = pair(*paths)
    for batch in batches:
        for i in range(len(batch)):
            number, doc, part, *given = (batch.column(c)[i].as_py() for c in batch.schema.names)
            yield _fragment_batch(number, doc, part, tool.fragment(*given))


def _join(table: pa.Table) -> pa.Table:
    """One fragment of up to FAN neighbours."""
    table = table.sort_by("part")
    rows = [{c: table[c][i] for c in table.column_names} for i in range(len(table))]
    found = [_fragment_of(r) for r in rows]
    whole = None if None in found else reduce(compose, found)
    first = rows[0]
    out = _fragment_batch(first["number"].as_py(), first["doc_id"].as_py(), first["part"].as_py() // FAN, whole)
    return pa.Table.from_batches([out])


def _finish(batches: Batches) -> Batches:
    for batch in batches:
        for i in range(len(batch)):
            x = _fragment_of({c: batch.column(c)[i] for c in batch.schema.names})
            row = (0, 0, 0, "", b"")
            if x is not None:
                groups, links, n = finished(x)
                row = (x.n_a, x.n_b, n, groups, links.astype(np.int32).tobytes())
            yield _batch([batch.column("doc_id")[i].as_py()], [row])


def _long_documents(docs: DataFrame, paths: tuple[str, str], size: int) -> DataFrame:
    """Fragments of byte ranges, composed by a tree: FAN neighbours per step and document."""
    spark = docs.sparkSession
    numbered = stored(docs.withColumn("number", F.monotonically_increasing_id()), "long-texts")
    ranges = numbered.mapInArrow(
        partial(_divide, paths=paths, size=size),
        "number long, doc_id long, part long, a_text string, a_at long, b_text string, b_at long",
    )
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = ranges.repartition(tasks, "number", "part")
    parts = stored(spread.mapInArrow(partial(_tokenise, paths=paths), FRAGMENT), "fragments")
    last = parts.agg(F.max("part")).head()[0]
    while last is not None and last > 0:
        parts = stored(parts.groupBy("number", F.floor(F.col("part") / FAN)).applyInArrow(_join, FRAGMENT), "composed")
        last //= FAN
    return parts.mapInArrow(_finish, SCHEMA)


class Alignment(NamedTuple):
    """``documents``: row, doc_id, n_a, n_b, n_groups, groups, links (pair codes).
    ``pairs``: code, a, b, n, best. ``scores``: row, n_best, count_sum."""

    documents: DataFrame
    pairs: DataFrame
    scores: DataFrame


def _frequent_from(pairs: DataFrame, most: int) -> int:
    """The least count at which at most ``most`` pairs have it or a larger one."""
    step = F.floor(F.log2("n") * 16).cast("int").alias("step")
    found = sorted(((r.step, r["count"], r.top) for r in pairs.groupBy(step).agg(F.count("*").alias("count"), F.max("n").alias("top")).collect()), reverse=True)
    held, above = 0, None
    for _, count, top in found:
        held += count
        if held > most:
            return top + 1
        above = top
    return 0 if above is not None else 1


def align(
    df: DataFrame,
    a_path: str,
    b_path: str,
    frequent: int = FREQUENT,
    long: int = LONG,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Alignment:
    """Groups, links and link counts of every document, see ``Alignment``."""
    paths = (a_path, b_path)
    docs = documents(df, id_col, text_col)
    short = docs.where(F.length("text") <= long).mapInArrow(partial(_whole, paths=paths), SCHEMA)
    found = short.union(_long_documents(docs.where(F.length("text") > long), paths, long))
    rows = stored(found.withColumn("row", F.monotonically_increasing_id()), "alignment")

    counted = stored(rows.select(F.explode("links").alias("code")).groupBy("code").agg(F.count("*").alias("n")), "pair-counts")
    b_id = F.col("code").bitwiseAND(F.lit((1 << B_BITS) - 1))
    # At most as many rows as B has ids.
    highest = counted.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))
    named = counted.select("code", F.shiftright("code", B_BITS).alias("a"), b_id.alias("b"), "n")
    pairs = stored(
        named.join(highest, "b").select("code", "a", "b", "n", (F.col("n") == F.col("most")).alias("best")), "pairs"
    )

    least = _frequent_from(pairs, frequent)
    top = pairs.where(F.col("n") >= least).orderBy("code").select("code", "n", "best").collect()
    codes = np.array([r.code for r in top], np.int32)
    sums = np.array([r.n for r in top], np.int64)
    best = np.array([r.best for r in top], np.int64)

    def look(batches: Batches) -> Batches:
        """Sums over links of frequent pairs, and the other links as they are."""
        for batch in batches:
            lists = batch.column("links")
            links, number = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(codes, links), max(len(codes) - 1, 0))
            here = codes[at] == links if len(codes) else np.zeros(len(links), bool)
            row = batch.column("row").to_numpy()
            n = len(lists)
            starts = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
            total = np.r_[0, np.cumsum(np.where(here, sums[at], 0))] if len(codes) else np.zeros(len(links) + 1, np.int64)
            won = np.r_[0, np.cumsum(np.where(here, best[at], 0))] if len(codes) else np.zeros(len(links) + 1, np.int64)
            rest = ~here
            none, k = pa.nulls(int(rest.sum()), pa.int64()), pa.nulls(n, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(row), k, pa.array(np.diff(won[starts])), pa.array(np.diff(total[starts]))], LOOKED
            )
            if len(none):
                yield pa.RecordBatch.from_arrays([pa.array(row[number[rest]]), pa.array(links[rest]), none, none], LOOKED)

    LOOKED = ["row", "code", "n_best", "count_sum"]
    looked = stored(rows.select("row", "links").mapInArrow(look, "row long, code int, n_best long, count_sum long"), "looked-up")
    rare = looked.where("code IS NOT NULL").groupBy("row", "code").agg(F.count("*").alias("times"))
    rare = rare.join(pairs.where(F.col("n") < least), "code").select(
        "row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("n") * F.col("times")).alias("count_sum")
    )
    scores = looked.where("code IS NULL").select("row", "n_best", "count_sum").union(rare)
    scores = scores.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return Alignment(rows, pairs, scores)
