"""Personal data: base patterns, and boosted trees over a high-recall set of candidates.

Base spans follow fixed rules and always stay. Beside them generators propose overlapping
candidates for every kind: spelled-out addresses, runs of digits in any grouping, dotted
numbers. Gradient boosted trees score a candidate by its format and by the characters and words
around it, never by the test that makes a base span. They are trained on a bounded sample of the
documents (``SAMPLE`` candidates, chosen by a hash of their text): candidates on a base span of
their kind are positive, those that fail their own kind's check negative, others follow the words
around them or stay unlabelled; base spans are also rewritten without plus or spelled out. A part
of the sample is held out, and each kind's threshold is the lowest score whose held-out precision,
base spans aside, reaches
``PRECISION``; a kind without such a score adds nothing. Of selected candidates that overlap,
the one with the best score stays, and none overlaps a base span.

Defined results: null text counts as empty; null and repeated ids and repeated rows are carried
through; without base spans nothing can be learned and only base spans (none) come back; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import documents, row_key, stored

SAMPLE = 40_000
PRECISION = 0.98
ROUNDS, DEPTH, CUTS, RATE = 40, 3, 16, 0.3

# The kinds in their order, and the patterns of base spans.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DIGIT = re.compile(r"[0-9]")
_DIGITS = re.compile(r"[0-9]+")
# Candidates beyond the base: wider forms, bounded in length.
_NUMBER = re.compile(r"(?<![0-9A-Za-z.])[+(]?[0-9](?:[ ().-]{0,2}[0-9]){7,20}(?![0-9A-Za-z])")
_QUAD = re.compile(r"(?<![0-9.])[0-9]{1,4}(?:[.,][0-9]{1,4}){3}(?![0-9])")
_SPELLED = re.compile(
    r"[A-Za-z0-9._%+-]{1,64} ?[\[({ ](?:at|@)[\])} ] ?[A-Za-z0-9-]{1,63}"
    r"(?: ?[\[({ ](?:dot|\.)[\])} ] ?[A-Za-z0-9-]{1,63}){1,4}"
)
_AT = re.compile(r"[\[({ ](?:at|@)[\])} ] ?[A-Za-z0-9-]{1,63} ?[\[({ ](?:dot|\.)[\])} ]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @: linear however long a run of letters is."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", end)


def base_and_failed(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and matches that a check turned down."""
    base: list[Span] = []
    failed: list[Span] = []
    if "@" in text:
        base += [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = m.group().split(".")
            good = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)
            (base if good else failed).append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            good = 16 <= len(digits) <= 19 and luhn(digits)
            (base if good else failed).append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                n = sum(map(len, _DIGITS.findall(m.group())))
                (base if 8 <= n <= 15 else failed).append(("phone", *m.span()))
    return base, failed


def candidates(text: str) -> list[Span]:
    out: list[Span] = []
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            out += [("card", *m.span()), ("phone", *m.span())]
        out += [("ip", *m.span()) for m in _QUAD.finditer(text)]
    if _AT.search(text):
        out += [("email", *m.span()) for m in _SPELLED.finditer(text)]
    return out


_HINTS = re.compile(r"(?i)\b(?:(tel|phone|call|fax|mobile)|(mail|e-mail|contact)|(ip|host|server)|(card|visa|credit|iban))\b")


def describe(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    kind, start, end = span
    own = text[start:end]
    groups = [len(g) for g in _DIGITS.findall(own)]
    digits = sum(groups)
    before, after = text[max(0, start - 24) : start], text[end : end + 24]
    hint = [0.0] * 4
    for m in _HINTS.finditer(before + " " + after):
        hint[m.lastindex - 1] = 1.0
    return [
        float(KINDS.index(kind)), float(end - start), float(digits), float(len(groups)),
        float(max(groups, default=0)), float(groups[0] if groups else 0),
        float(groups[-1] if groups else 0), float(own.count(" ")), float(own.count("-")),
        float(own.count(".")), float(own.count("(")), float(sum(c.isalpha() for c in own)),
        float(before[-1:].isspace() or not before), float(after[:1].isspace() or not after),
        float(after[:1] in ".,;:!?" and bool(after)), *hint,
        float(sum(map(own.count, "[{"))), float(" dot " in own or "dot]" in own or "dot)" in own), float(own[-3:].istitle()),
    ]


@dataclass
class Forest:
    """Boosted trees as arrays: (feature, cut) per inner node, a value per leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    start: float
    thresholds: dict[str, float]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[np.arange(len(x)), f[node]] > c[node])
            total += v[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray) -> Forest:
    """Gradient boosting with the logistic loss on binned features."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, CUTS + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(c, col) for c, col in zip(cuts, x.T, strict=True)], axis=1)
    share = min(0.99, max(0.01, y.mean()))
    start = float(np.log(share / (1 - share)))
    total = np.full(len(y), start)
    inner, features, limits, values = 2**DEPTH - 1, [], [], []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-total))
        slope, weight = y - p, p * (1 - p) + 1e-6
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for n in range(inner):
            rows = np.flatnonzero(node == n)
            gain, found = 1e-6, None
            for j, own in enumerate(cuts):
                if not len(own) or not len(rows):
                    continue
                g = np.cumsum(np.bincount(bins[rows, j], slope[rows], len(own) + 1))
                h = np.cumsum(np.bincount(bins[rows, j], weight[rows], len(own) + 1))
                left = g[:-1] ** 2 / (h[:-1] + 1)
                right = (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 1)
                gains = left + right - g[-1] ** 2 / (h[-1] + 1)
                if gains.max() > gain:
                    gain, found = gains.max(), (j, int(gains.argmax()))
            if found:
                feature[n], cut[n] = found[0], cuts[found[0]][found[1]]
            node[rows] = 2 * n + 1 + (x[rows, feature[n]] > cut[n])
        leaf = node - inner
        g, h = np.bincount(leaf, slope, inner + 1), np.bincount(leaf, weight, inner + 1)
        value = RATE * g / (h + 1)
        total += value[leaf]
        features.append(feature)
        limits.append(cut)
        values.append(value)
    return Forest(np.array(features), np.array(limits), np.array(values), start, {})


class Covered:
    """The union of spans as sorted, disjoint intervals: an overlap is one bisection."""

    def __init__(self, spans: Iterable[Span] = ()) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, start, end in sorted(spans, key=lambda s: s[1]):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, span: Span) -> bool:
        at = bisect_left(self.starts, span[2])
        return at > 0 and self.ends[at - 1] > span[1]

    def add(self, span: Span) -> None:
        """A span that meets no other."""
        at = bisect_left(self.starts, span[1])
        self.starts.insert(at, span[1])
        self.ends.insert(at, span[2])


def by_kind(spans: list[Span]) -> dict[str, Covered]:
    return {k: Covered(s for s in spans if s[0] == k) for k in KINDS}


def _own_check(kind: str, own: str) -> bool:
    """What a kind's digits must satisfy, in whatever form they are written."""
    groups = _DIGITS.findall(own)
    n = sum(map(len, groups))
    if kind == "card":
        return 16 <= n <= 19 and luhn("".join(groups))
    if kind == "phone":
        return 8 <= n <= 15
    return kind != "ip" or all(int(g) <= 255 for g in groups)


def _hinted(text: str, span: Span) -> set[str]:
    around = text[max(0, span[1] - 24) : span[1]] + " " + text[span[2] : span[2] + 24]
    return {("phone", "email", "ip", "card")[m.lastindex - 1] for m in _HINTS.finditer(around)}


_PLAIN_NUMBER = re.compile(r"[0-9]+|(?:19|20)[0-9]{2}[ .-].*")  # bare digits; dates and years
_PLUS = re.compile(r"\+[0-9]{1,3}[ .-]*")


def other_forms(text: str, span: Span) -> Iterator[tuple[str, Span, int]]:
    """A base span written in a form that the base rules miss, and a clean look-alike of it."""
    kind, start, end = span
    own, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 40]
    made: list[tuple[str, int]] = []
    if kind == "phone":
        made = [(_PLUS.sub("", own, count=1), 1), ("".join(_DIGITS.findall(own))[:15], 0)]
    elif kind == "email":
        name, _, domain = own.partition("@")
        words = domain.split(".")
        made = [(f"{name} [at] {' [dot] '.join(words)}", 1), (f"{name} (at) {' (dot) '.join(words)}", 1)]
        made += [(f"{words[0]}.{name} [at] {' [dot] '.join(words)}", 1)]  # points in the name
        made += [(f"{name} at {' dot '.join(words)}", 1), (f"arrived at {words[0]} . Then", 0)]
    # With the words around them and without those that give the kind away.
    around = [(before, after), (_HINTS.sub("", before), _HINTS.sub("", after))]
    for (before, after), (form, label) in ((c, m) for c in around for m in made):
        new = before + form + after
        at = len(before)
        for c in candidates(new):
            if c[0] == kind and c[1] <= at + 1 and c[2] >= at + len(form) - 1 and (label == 0 or _own_check(kind, form)):
                yield new, c, label


def labelled(text: str) -> list[tuple[Span, int, int, list[float]]]:
    """(span, form, label, description) of candidates with a settled label.

    A candidate is judged by its own kind only: its base spans, its own check, and the words
    around it. Failed matches of another kind say nothing about it, and what remains undecided
    has no label. Form 0 is a base span, which needs no tree; the others are what trees may add.
    """
    base, failed = base_and_failed(text)
    own_base, own_failed, any_base = by_kind(base), by_kind(failed), Covered(base)
    out = []
    for span in candidates(text) + [s for s in base if s[0] == "email"]:
        kind, own, hints = span[0], text[span[1] : span[2]], _hinted(text, span)
        if own_base[kind].meets(span):
            out.append((span, 0, 1, describe(text, span)))
            continue
        if not _own_check(kind, own) or any_base.meets(span):
            label = 0
        elif kind != "card" and own_failed[kind].meets(span):
            label = 0
        elif kind in hints:
            label = 1
        elif hints or (kind == "phone" and _PLAIN_NUMBER.fullmatch(own)):
            label = 0
        else:
            continue
        out.append((span, 1, label, describe(text, span)))
    for span in base:
        for form, (new, c, label) in enumerate(other_forms(text, span), 2):
            out.append((span, form, label, describe(new, c)))
    return out


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(k, *r) for k, t in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True) for r in labelled(t.as_py())]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1][1] for r in rows], pa.int64()),
                pa.array([r[1][0] for r in rows], pa.string()),
                pa.array([r[2] for r in rows], pa.int32()),
                pa.array([r[4] for r in rows], pa.list_(pa.float64())),
                pa.array([r[3] for r in rows], pa.int32()),
            ],
            ["key", "start", "kind", "form", "x", "y"],
        )


def fit(docs: DataFrame, sample: int = SAMPLE) -> Forest | None:
    """Trees and thresholds; ``docs`` has text and key."""
    numbers = docs.where(F.col("text").rlike("[0-9@]")).select("key", "text")
    total = numbers.count()
    if not total:
        return None
    # Documents by hash.
    chosen = F.shiftrightunsigned(F.xxhash64("key"), 24) < F.lit(int(min(1.0, sample / total) * 2**40))
    rows = numbers.where(chosen).dropDuplicates(["key"]).mapInArrow(
        _learn, "key long, start long, kind string, form int, x array<double>, y int"
    )
    # The candidates to learn from are chosen by hash too, with the share their number allows.
    rows = stored(rows, "labelled")
    share = int(min(1.0, 2 * sample / max(1, rows.count())) * 2**40)
    rows = rows.where(F.shiftrightunsigned(F.xxhash64("key", "start", "kind", "form"), 24) < F.lit(share))
    got = sorted((r["key"], r["x"], r["y"], r["form"]) for r in rows.collect())
    if not got:
        return None
    x, y = np.array([g[1] for g in got]), np.array([g[2] for g in got], float)
    held = np.array([g[0] % 4 == 0 for g in got])
    if y[~held].min(initial=1) == 1 or y[~held].max(initial=0) == 0:
        return None
    forest = boost(x[~held], y[~held])
    score = forest.score(x[held])
    added = np.array([g[3] > 0 for g in got])[held]
    for i, kind in enumerate(KINDS):
        own = (x[held][:, 0] == i) & added  # base spans are no measure of what trees add
        order = np.argsort(-score[own], kind="stable")
        s, hit = score[own][order], y[held][own][order]
        right = np.cumsum(hit) / np.arange(1, len(hit) + 1)
        enough = np.flatnonzero((right >= PRECISION) & (np.arange(len(hit)) >= 19) & (s >= 0.5))
        forest.thresholds[kind] = float(s[enough[-1]]) if len(enough) else np.inf
    return forest


def spans_of(text: str, forest: Forest | None) -> tuple[list[Span], list[Span]]:
    """(base spans, added spans)."""
    base, failed = base_and_failed(text)
    if forest is None:
        return base, []
    # What a base check has turned down for a kind is not that kind.
    taken, turned_down = Covered(base), by_kind([f for f in failed if f[0] != "card"])
    open_ = [c for c in candidates(text) if not taken.meets(c) and not turned_down[c[0]].meets(c)]
    if not open_:
        return base, []
    scores = forest.score(np.array([describe(text, c) for c in open_]))
    added: list[Span] = []
    held = Covered()
    for i in np.argsort(-scores, kind="stable"):
        kind, start, end = open_[i]
        if not _own_check(kind, text[start:end]):
            continue
        if scores[i] >= forest.thresholds[kind] and not held.meets(open_[i]):
            added.append((kind, start, end))
            held.add(open_[i])
    return base, added


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _find(forest: Forest | None) -> Callable:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def rows(spans: list[Span]) -> list[dict]:
        return [dict(zip(("kind", "start", "end"), s, strict=True)) for s in in_order(spans)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans_of(t.as_py(), forest) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([rows(b) for b, _ in found], kind),
                    pa.array([rows(b + a) for b, a in found], kind),
                ],
                ["doc_id", "base", "spans"],
            )

    return run


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans): base spans and all spans, in the order of kinds and starts."""
    docs = documents(df, id_col, text_col).withColumn("key", row_key())
    span = "array<struct<kind: string, start: long, end: long>>"
    return docs.select("doc_id", "text").mapInArrow(
        _find(fit(docs)), f"doc_id long, base {span}, spans {span}"
    )


def listed(column: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
