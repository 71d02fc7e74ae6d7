import hashlib

import pytest
from hypothesis import given, settings, strategies as st

from quern.llm.scratch import new_path
from quern.llm.warc import BrokenArchive, base32_sha1, chunked, parsed, read_archives, records_of, unchunked, write_archives

PAGES = "page_id long, url string, html string, first int, sha string"


def through(spark, rows, **how):
    pages, to = spark.createDataFrame(rows, PAGES).repartition(3), new_path(spark, "test-warc")
    write_archives(pages, to, **how)
    return read_archives(spark, to)


@given(st.binary(max_size=3000), st.integers(1, 700))
@settings(max_examples=50, deadline=None)
def test_framing(payload, size):
    assert unchunked(chunked(payload, size)) == payload


def test_round_trip(spark):
    html = [None, "", "<p>é</p>", "WARC/1.0\r\n\r\nfalse start\r\n\r\n", "x" * 50_000, "ÿ\r\n0\r\n\r\n" * 3_000, "x" * 50_000, "same", "same", "same"]
    rows = [(10 + n, None if n == 3 else f"http://e.org/{n}\r\nX: y", h, 1, "s") for n, h in enumerate(html)]
    found = {r["page_id"]: r for r in through(spark, rows, segment_bytes=1_000).collect()}
    assert set(found) == {r[0] for r in rows}
    for i, _, h, *_ in rows:
        payload = (h or "").encode()
        first = min(j for j, _, g, *_ in rows if (g or "") == (h or ""))
        r = found[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), base32_sha1(payload))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if i == first else ("revisit", first))
        assert r["payload"] is None if i != first else bytes(r["payload"]) == payload
    assert base32_sha1(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and hashlib.sha1(b"").digest_size == 20


def test_small_payloads_are_responses(spark):
    found = through(spark, [(1, "u", "ab", 1, "s"), (2, "u", "ab", 1, "s"), (3, "u", "abcdef", 1, "s"), (4, "u", "abcdef", 1, "s")], least_revisit=4).collect()
    assert {r["page_id"]: r["refers_to"] for r in found} == {1: None, 2: None, 3: None, 4: 3}


def test_null_and_repeated_identifiers(spark):
    rows = [(None, "u", "a", 1, "s"), (5, "u", "a", 1, "s"), (5, "u", "a", 1, "s"), (None, "u", "b" * 5000, 1, "s"), (6, "u", "c" * 5000, 1, "s"), (6, "u", "c" * 5000, 1, "s")]
    found = through(spark, rows, segment_bytes=900).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in found), key=repr) == sorted(
        [(None, 1, "revisit", 5), (5, 1, "response", None), (5, 1, "response", None), (None, 5000, "response", None), (6, 5000, "response", None), (6, 5000, "response", None)], key=repr)


def test_empty(spark):
    assert through(spark, []).collect() == []


def test_broken_archives(spark):
    parts = list(records_of(1, "u", b"z" * 5000, None, "0-1", 1000))
    assert len(parts) > 3
    whole = [p + b"\r\n\r\n" for p in parts]
    with pytest.raises(BrokenArchive):
        list(parsed(whole[0][:-1] + b"!" + whole[1]))
    for name, data in (("gap", [whole[0], *whole[2:]]), ("end", whole[:-1])):
        to = new_path(spark, f"broken-{name}")
        spark.createDataFrame([(b"".join(data).decode("latin-1"),)], "value string").coalesce(1).write.option("compression", "gzip").option("lineSep", "\r\n\r\n").text(to)
        with pytest.raises(Exception, match="segments missing|wrong total|no record"):
            read_archives(spark, to).collect()
