"""WARC: exact round trips."""

import base64
import gzip
import hashlib
import random

import pytest

from marlspark.llm import warc as W


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_round_trip_matches_brute_force(spark):
    rows = [(1, "u", "<p>é</p>", 0), (2, "u", None, 0), (3, None, "", 0), (4, "u", "x" * 100_000, 0), (5, "v", "x" * 100_000, 0), (6, "v", "y" * 70_001 + "\r\n\r\nWARC/1.1\r\n", 0), (7, "a\r\nb", "<p>é</p>", 0), (8, "u", "0\r\n\r\n", 0)]
    got = {r.page_id: r for r in W.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, digest int"), segment_bytes=4096).collect()}
    assert len(got) == len(rows)
    for page_id, _, html, _ in rows:
        keep = max(p for p, _, h, _ in rows if (h or "") == (html or ""))
        want = (len((html or "").encode()), digest(html), "response" if keep == page_id else "revisit", None if keep == page_id else keep)
        r = got[page_id]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == want


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "u", "z" * 9000), (1, "u", "z" * 9000), (None, "u", "z" * 9000), (None, "u", "only"), (2, "u", "z")]
    got = W.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), segment_bytes=1000).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in got) == [("1", 9000, "response", None), ("1", 9000, "response", None), ("2", 1, "response", None), ("None", 4, "response", None), ("None", 9000, "revisit", 1)]


def test_empty(spark):
    assert W.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_reassembly_checks():
    parts = [(2, None, b"bc"), (1, None, b"a"), (3, 4, b"d")]
    assert W.joined(parts) == b"abcd"
    for bad in ([parts[0], parts[2]], parts[:2], [*parts[:2], (3, 5, b"d")]):
        with pytest.raises(ValueError):
            W.joined(bad)
    assert W.dechunked(b"3;ext=1\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        W.dechunked(b"3\r\nabcd\r\n0\r\n\r\n")
    for payload in (b"", b"x", b"\r\n0\r\n\r\n" * 3000):
        assert W.dechunked(W.chunked(payload)) == payload


def archive(pages, segment_bytes=1000):
    return [r + W.CRLF for page_id, payload in pages for r in W.records(page_id, "u", payload, None, False, segment_bytes)]


def test_archives_of_others(spark, tmp_path):
    rng = random.Random(4)
    pages = [(i, rng.randbytes(rng.choice((0, 10, 900, 5000, 200_000)))) for i in range(20)]
    records = archive(pages)
    rng.shuffle(records)  # segments in any order, over several archives
    (tmp_path / "plain.warc").write_bytes(b"".join(records[:200]))
    (tmp_path / "members.warc.gz").write_bytes(b"".join(map(gzip.compress, records[200:500])))
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(b"".join(records[500:])) + b"\0" * 20)
    got = {r.page_id: bytes(r.payload) for r in W.read(spark, str(tmp_path)).collect()}
    assert got == dict(pages)


def test_parts_of_any_size_are_parsed():
    records = archive([(1, b"a" * 3000), (2, b""), (3, b"\r\n\r\nWARC/1.1\r\n" * 50)])
    whole = b"".join(records)
    want = list(W.parse([whole]))
    assert len(want) == len(records)
    for step in (1, 7, 100, 4096):
        assert list(W.parse(whole[i : i + step] for i in range(0, len(whole), step))) == want
    packed = gzip.compress(whole[:5000]) + gzip.compress(whole[5000:])
    assert list(W.parse(W.inflated(packed, step=64))) == want
    for bad in (whole[:-1], whole[:-30], b"nothing of the kind\r\n\r\n", whole + b"x"):
        with pytest.raises(ValueError):
            list(W.parse([bad]))
    with pytest.raises(ValueError):
        list(W.inflated(packed[:-9]))


def test_differing_segments_of_one_number_are_an_error():
    parts = [(1, None, b"a"), (2, 3, b"bc")]
    assert W.joined(W.distinct([*parts, *parts])) == b"abc"
    for other in ((1, None, b"x"), (2, 4, b"bc")):
        with pytest.raises(ValueError):
            W.distinct([*parts, other])
