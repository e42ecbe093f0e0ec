import gzip
import hashlib

import pytest

from tarnspark.llm import warc


def plain(rows):
    out = []
    for i, _, h in rows:
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        first = min(same) if same else None
        p = (h or "").encode()
        out.append((i, len(p), warc.base32_sha1(p), "response" if first is None or i == first else "revisit", None if first is None or i == first else first))
    return sorted(out, key=str)


def test_pages(spark):
    rows = [(3, "http://h/a", "<p>x</p>"), (1, "http://h/b\r\nX: y", "<p>x</p>"), (2, None, None), (5, "u", ""), (7, "http://h/c", "WARC/1.1\r\n\r\nContent-Length: 9\r\n\r\n"), (8, "http://h/é", "é" * 70_000), (3, "http://h/a", "<p>x</p>"), (None, "n", "<p>x</p>"), (1, "http://h/b", "other")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string")
    got = warc.page_captures(df)
    seen = sorted((tuple(r)[:5] for r in got.collect()), key=str)
    assert seen == plain(rows)
    assert got.where("request_id is null").count() == 0
    assert warc.page_captures(df.limit(0)).count() == 0


def test_segments_are_gzip_files_and_records_parse():
    raw = warc.capture(1, "http://h/", b"abc\r\n\r\n", hashlib.sha1(b"abc\r\n\r\n").hexdigest(), 7, None, None)
    joined = b"".join(warc._member(r) for r in raw)
    assert gzip.decompress(joined) == b"".join(raw)
    assert [m for m in warc.members_of(joined)] == raw
    (headers, block), *_ = list(warc.records_of(b"".join(raw)))
    assert warc.parse(headers, block)["payload"] == b"abc\r\n\r\n" and warc.parse(headers, block)["digest_ok"]
    with pytest.raises(ValueError):
        list(warc.records_of(raw[0][:-20]))


def test_assembly_follows_links_either_way(spark):
    rows = [("m1", "response", []), ("q1", "request", ["m1"]), ("d1", "metadata", ["q1"]), ("m2", "resource", ["q2"]), ("q2", "request", []), ("d3", "metadata", ["gone"]), ("m4", "revisit", [])]
    df = spark.createDataFrame(rows, "record_id string, record_type string, concurrent_to array<string>")
    got = {r.capture_id: tuple(getattr(r, x) and getattr(r, x).record_id for x in ("main", "request", "metadata")) for r in warc.assemble(df).collect()}
    assert got == {"m1": ("m1", "q1", "d1"), "m2": ("m2", "q2", None), "m4": ("m4", None, None), "gone": (None, None, "d3")}


def test_what_cannot_be_read_is_a_row_with_error(spark):
    good = warc.capture(1, "http://h/", b"abc", hashlib.sha1(b"abc").hexdigest(), 3, None, None)
    no_length = good[0].replace(b"Content-Length: ", b"X-Length: ", 1)
    packed = [warc._member(r) for r in good]
    contents = [
        b"".join([packed[0], warc._member(no_length), packed[1]]),  # one bad record among good ones
        packed[0] + packed[1][:-9],  # cut member
        packed[0] + packed[1][:12] + b"\xff" * 40,  # broken member
        good[0] + good[1][:-20],  # cut record, uncompressed
        b"no archive", None,
    ]
    df = spark.createDataFrame([(f"a{k}", 0, c) for k, c in enumerate(contents)], "archive string, segment int, content binary")
    got = warc.read_records(df).collect()
    assert [sum(r.archive == f"a{k}" and r.error is None for r in got) for k in range(6)] == [2, 1, 1, 1, 0, 0]
    assert [sum(r.archive == f"a{k}" and r.error is not None for r in got) for k in range(6)] == [1, 1, 1, 1, 1, 0]
    assert all(r.record_id is None for r in got if r.error is not None)
    assert warc.assemble(warc.read_records(df).drop("payload").where("archive = 'a0'")).count() == 1
