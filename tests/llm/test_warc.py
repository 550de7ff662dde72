import hashlib

import pytest
from pyspark.sql import types as T

from pagemill.llm import warc

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


def fixture():
    big = "<p>é\r\n日本" * 40000
    same = "<p>" + "same " * 400
    out = [(i, f"http://x/{i}?a=ü %41", same) for i in range(30)] + [(100, "u", big), (101, None, None), (102, "u", ""), (103, "u\r\nWARC/1.1", "WARC/1.1\r\n\r\n0\r\n\r\n")]
    out += [(104, "u", "x" * 999), (105, "u", "x" * 999), (106, "u", "x" * 1000), (107, "v", "x" * 1000), (107, "v", "x" * 1000)]
    return out + [(None, "u", same), (108, "u", "é" * 500), (109, "w", "é" * 500), (110, "w", "é" * 499)]


def want(rows):
    out = []
    for i, u, h in rows:
        raw = (h or "").encode()
        top = max((j for j, _, k in rows if (k or "") == (h or "") and j is not None), default=None)
        revisit = len(raw) >= 1000 and i is not None and i < top
        out.append((i, u, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top if revisit else None, None if revisit else raw))
    return out


@pytest.mark.parametrize("segment", [700, warc.SEGMENT])
def test_round_trip(spark, segment):
    rows = fixture()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as digest", "1 as number", "'y' as same")
    got = warc.round_trip(df, segment)
    got = [(r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got.collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[4], r[1] or "")
    assert sorted(got, key=order) == sorted(want(rows), key=order)


def test_a_url_that_looks_like_a_marker_comes_back(spark):
    rows = [(1, "urn:null", "a"), (2, None, "b"), (3, "", "c"), (4, "null", "d")]
    got = warc.round_trip(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["page_id"], r["url"], bytes(r["payload"]).decode()) for r in got) == rows


def test_originals_in_a_shuffle(spark):
    df = spark.createDataFrame(fixture(), SCHEMA)
    sent, shuffled = (sorted(map(str, warc.with_originals(df, small=x).drop("html").collect())) for x in (True, False))
    assert sent == shuffled


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_broken_archives_are_told():
    parts = [(1, None, b"ab"), (3, 5, b"e"), (2, None, b"cd")]
    assert warc.reassemble(parts) == b"abcde"
    for bad in (parts[:1] + parts[2:], [(1, None, b"ab"), (2, 9, b"c")], [(2, 2, b"ab")]):
        with pytest.raises(warc.WarcError):
            warc.reassemble(bad)
    assert warc.unchunked(b"3;x=1\r\nabc\r\nA\r\n0123456789\r\n0\r\nT: 1\r\n\r\n") == b"abc0123456789"
    for bad in (b"3\r\nab", b"zz\r\n", b"", b"3\r\nabc\r\n"):
        with pytest.raises(warc.WarcError):
            warc.unchunked(bad)
    one = warc.records("urn:x", 1, "u", "html", hashlib.sha1(b"html").hexdigest(), None)[0].encode() + b"\r\n"
    assert len(list(warc.parse(one * 2))) == 2
    with pytest.raises(warc.WarcError):
        list(warc.parse(one[:-3]))
