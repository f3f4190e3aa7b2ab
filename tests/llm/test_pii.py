import random
import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlens.llm import pii


def luhn(digits):
    r = [int(c) for c in digits][::-1]
    return (sum(r[::2]) + sum(sum(divmod(2 * x, 10)) for x in r[1::2])) % 10 == 0


def plain(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


PIECES = st.sampled_from(["a@b.c", "@", "x.y@", "d-e.f", "1", "255", "256.", "1.2.3.4", "4111 1111 1111 1111", " ", "-", ".", "+1", "(555) 010-9999", "é", "٣", "\n", "a_%"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_base_spans_equal_plain_patterns(text):
    assert pii.base_and_failed(text)[0] == plain(text)


def test_long_runs_are_linear():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 100_000, "+1" + " " * 200_000, "a" * 300_000 + "@b.c"):
        assert len(pii.base_and_failed(text)[0]) <= 1 or text.startswith("1.")
        pii.candidates(text)


def test_boosting_learns_a_rule():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 9, (3000, 4)).astype(float)
    y = ((x[:, 0] > 4) & (x[:, 2] < 3) | (x[:, 1] == 8)).astype(float)
    forest = pii.boost(x[:2000], y[:2000])
    assert np.mean((forest.score(x[2000:]) > 0.5) == y[2000:]) > 0.97


def test_in_spark(spark):
    rng = random.Random(1)
    number = lambda n: "".join(rng.choices("0123456789", k=n))
    rows = []
    for i in range(1500):
        bits = [f"call +1 ({number(3)}) {number(3)}-{number(4)} now", f"id {number(16)} end", f"x{i}@mail.example.com", "1.2.3.999", "plain words"]
        rows.append((i, " ".join(rng.sample(bits, 3)), "x"))
    rows += [(None, None, "x"), (5000, "", "x"), (5001, "reach me (717) 555-0202 now", "x"), (5001, "reach me (717) 555-0202 now", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pii.find_personal_data(df).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] or "" for r in rows}
    for r in got:
        base = [tuple(s) for s in r.base]
        assert base == pii.in_order(plain(texts[r.doc_id]))
        assert {tuple(s) for s in r.spans} >= set(base)
        assert not any(s.kind == "phone" and texts[r.doc_id][s.start : s.end].isdigit() for s in r.spans)
    assert pii.find_personal_data(df.limit(0)).count() == 0


def test_planted_forms_are_found_and_clean_numbers_left_alone(spark):
    rng = random.Random(5)
    names = ["bob", "eve7", "carla.m", "dan_x", "fred"]
    number = lambda n: "".join(rng.choices("123456789", k=n))
    rows = []
    for i in range(1200):
        bits = [f"call +1 ({number(3)}) {number(3)}-{number(4)} now", f"{rng.choice(names)}@mail.example.com wrote", f"order {number(12)} sent", "on 2021-03-04 10 at noon . Then"]
        rows.append((i, " ".join(rng.sample(bits, 3))))
    planted = ["reach me (717) 555-0202 now", "ask ann.lee [at] mail [dot] example [dot] com today"]
    clean = ["order 123456789012 sent", "it arrived at noon . Then we left"]
    rows += [(5000 + i, t) for i, t in enumerate(planted + clean)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: {(s.kind, planted[r.doc_id - 5000][s.start : s.end]) if r.doc_id < 5002 else s.kind for s in r.spans} for r in pii.find_personal_data(df).where("doc_id >= 5000").collect()}
    assert found[5000] == {("phone", "(717) 555-0202")}
    assert found[5001] == {("email", "ann.lee [at] mail [dot] example [dot] com")}
    assert found[5002] == set() and found[5003] == set()


def test_fit_does_not_depend_on_the_layout(spark):
    rows = [(i, f"call +1 (555) {100 + i % 800}-{1000 + i} now or id {i * 7919:012d} end") for i in range(600)]
    docs = spark.createDataFrame(rows, "key long, text string")
    one, other = (pii.fit(d, sample=300) for d in (docs.repartition(2), docs.orderBy("text", ascending=False).repartition(7)))
    assert np.array_equal(one.value, other.value) and one.thresholds == other.thresholds


def test_long_texts_take_linear_time(spark):
    """Five megabytes of personal data and look-alikes, base and trees together."""
    rng = random.Random(3)
    pieces = ["mail to ab.c@de.org now", "call +1 555 0100 200 or 555-0100-2000", "from 10.0.0.1 or 10.0.300.1", "card 4111 1111 1111 1111", "id 12345678901", "x [at] y [dot] org"]
    text = " ".join(rng.choice(pieces) for _ in range(220_000))
    assert len(text) > 5_000_000
    forest = pii.Forest(np.zeros((1, 7), int), np.full((1, 7), np.inf), np.zeros((1, 8)), 2.0, dict.fromkeys(pii.KINDS, 0.5))
    start = time.process_time()
    base, added = pii.spans_of(text, forest)
    assert time.process_time() - start < 60 and len(base) > 100_000 and len(added) > 50_000
    short = text[:20_000]
    plain = lambda s, others: any(s[1] < o[2] and o[1] < s[2] for o in others)
    base, failed = pii.base_and_failed(short)
    found = pii.candidates(short)
    covered, kinds = pii.Covered(base), pii.by_kind(failed)
    assert [covered.meets(c) for c in found] == [plain(c, base) for c in found]
    assert [kinds[c[0]].meets(c) for c in found] == [plain(c, [f for f in failed if f[0] == c[0]]) for c in found]
    added = pii.spans_of(short, forest)[1]
    assert not any(plain(a, added[:i]) or plain(a, base) for i, a in enumerate(added))
