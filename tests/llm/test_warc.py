import base64
import hashlib

import pytest

from cohortlens.llm import warc


def test_round_trip(spark, tmp_path):
    big = "<p>é漢</p>" * 9000
    rows = [
        (1, "u1\nx: y", "same"), (2, "u2", "same"), (3, None, ""), (4, "u4", None), (5, "u5", big),
        (6, "u6", big + "x"), (9, "u9", big), (None, "n", "same"), (None, "n", "alone\r\n\r\nWARC/1.1\r\n"),
        (7, "u7", "WARC/1.1\r\n\r\n0\r\n\r\n"), (5, "u5", big), (9, "u9", big),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS first", "2 AS digest")
    path = warc.write_archives(df.repartition(3), str(tmp_path / "w"), segment=1000)
    got = warc.read_archives(spark, path).collect()
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        to = last[h or ""]
        again = to != -1 and to != i
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        want.append((i, len(p), digest, "revisit" if again else "response", to if again else None))
    assert sorted(map(str, want)) == sorted(
        str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got
    )
    assert {bytes(r.payload) for r in got if r.payload is not None} == {(h or "").encode() for _, _, h in rows}
    empty = warc.write_archives(df.limit(0), str(tmp_path / "e"))
    assert warc.read_archives(spark, empty).count() == 0


def test_small_payloads_are_all_responses(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    path = warc.write_archives(df, str(tmp_path / "m"), min_bytes=3)
    assert {r.record_type for r in warc.read_archives(spark, path).collect()} == {"response"}


def test_segments_are_verified():
    parts = [{"origin": "o", "number": n, "total": 6 if n == 2 else None, "page_id": 1, "digest": "d", "block": b"abc"} for n in (2, 1)]
    assert warc.reassembled(parts) == ([1], b"abcabc", "d")
    for bad in (parts[:1], parts[1:], [parts[0] | {"total": 7}, parts[1]]):
        with pytest.raises((ValueError, KeyError)):
            warc.reassembled(bad)
    assert warc.unframed(b"HTTP/1.1 200 OK\r\n\r\nplain") == b"plain"
    with pytest.raises(ValueError):
        warc.unframed(warc.HEAD + b"2\r\nabc\r\n0\r\n\r\n")
