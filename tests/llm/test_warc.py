"""WARC archives: exact round trips of hostile payloads, revisits against brute force."""

from __future__ import annotations

import gzip
import hashlib
from collections import Counter
from pathlib import Path

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import warc

SCHEMA = "page_id long, url string, html string"
BIG = "<p>" + "identical text of a page " * 60
ODD = ["", "\r\n", "\r\n\r\n", "a\r\n\r\nb\r\n", "\r\r\n\r\n\n\r", "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n", "é漢😀" * 500, "x" * 999, "x" * 1000, "\n" * 1200, "\r" * 1001, "\r\n" * 800]


def rows() -> list[tuple]:
    out = [(i, f"http://a/{i}", t) for i, t in enumerate(ODD)]
    out += [(100 + i, f"http://b/{i % 3}", BIG) for i in range(30)]
    out += [(200, "http://tie", BIG * 2), (200, "http://tie", BIG * 2), (200, "http://tie", BIG * 2), (200, "http://tia", BIG * 2), (199, None, BIG * 2)]
    out += [(None, "http://none", BIG * 3), (None, None, BIG * 3), (-5, "u r\nl\r", BIG * 3), (None, "http://x", BIG * 4), (None, "http://x", BIG * 4)]
    out += [(300, "http://c", None), (300, "http://c", None), (301, None, "short"), (302, None, "short"), (303, "", "x" * 1000)]
    return out


def brute(table: list[tuple]) -> Counter:
    groups: dict[bytes, list] = {}
    for page, url, html in table:
        groups.setdefault((html or "").encode(), []).append((page, url))
    out = Counter()
    for body, members in groups.items():
        told = (len(body), hashlib.sha1(body).hexdigest())
        rank = sorted(members, key=lambda m: (m[0] is not None, m[0] or 0, m[1] is not None, m[1] or ""))
        for k, (page, _) in enumerate(rank):
            first = k == len(rank) - 1 or len(body) < warc.LEAST_BYTES
            out[page, *told, "response" if first else "revisit", None if first else rank[-1][0], True] += 1
    return out


def test_brute_force_over_hostile_rows(spark, monkeypatch):
    pages = spark.createDataFrame(rows(), SCHEMA).withColumns({c: F.lit("?") for c in ("size", "sha1", "sha256", "first", "n", "record")}).repartition(3)
    want = brute(rows())
    assert Counter(map(tuple, warc.archive_and_resolve(pages).collect())) == want
    monkeypatch.setattr(warc, "COPIES_AT_ONCE", 2)  # copies of equal rows in pieces
    assert Counter(map(tuple, warc.archive_and_resolve(pages).collect())) == want


def test_without_broadcast(spark):
    pages = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert Counter(map(tuple, warc.archive_and_resolve(pages).collect())) == brute(rows())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_archives_are_warc_and_hold_each_payload_once(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_archives(spark.createDataFrame(rows(), SCHEMA).repartition(2), path, "2024-01-31T12:00:00Z")
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(Path(path).glob("*.gz")))
    at, kinds, ids, refers = 0, Counter(), set(), set()
    while at < len(whole):  # cut by lengths alone
        head, _, _ = whole[at:].partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        end = at + len(head) + 4 + int(fields["Content-Length"])
        assert head.startswith(b"WARC/1.1\r\n") and whole[end : end + 4] == b"\r\n\r\n"
        kinds[fields["WARC-Type"]] += 1
        ids.add(fields["WARC-Record-ID"])
        assert fields["WARC-Date"] == "2024-01-31T12:00:00Z"
        refers |= {fields["WARC-Refers-To-Target-URI"]} if fields["WARC-Type"] == "revisit" else set()
        at = end + 4
    assert sum(kinds.values()) == len(rows()) == len(ids) and kinds["revisit"] == sum(n for k, n in brute(rows()).items() if k[3] == "revisit")
    assert refers == {"http://b/2", "http://tie", "u%20r%0Al%0D", "http://x", "urn:page:303"}
    assert whole.count(BIG.encode() + b"\r\n\r\n") == 4  # one of each of the four long payloads
    back = warc.read_archives(spark, path, with_payload=True).where("record_type = 'response'").collect()
    held = Counter((None if r.page_id is None else int(r.page_id), bytes(r.payload)) for r in back)
    assert all((303 if t == "x" * 1000 else i, t.encode()) in held for i, t in enumerate(ODD))
    assert {r.target_uri for r in back} >= {"urn:page:301", "http://tie", "u%20r%0Al%0D"}


def test_changed_payloads_and_cut_archives(spark, tmp_path):
    record = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:00\r\nContent-Type: application/http\r\nContent-Length: 23\r\n\r\nHTTP/1.1 200 OK\r\n\r\nbody\r\n\r\n"
    (tmp_path / "a.txt.gz").write_bytes(gzip.compress(record.encode()))
    (row,) = warc.read_archives(spark, str(tmp_path / "a.txt.gz")).collect()
    assert not row.intact and row.payload_bytes == 4
    (tmp_path / "b.txt.gz").write_bytes(gzip.compress(record.encode()[:-9]))
    try:
        warc.read_archives(spark, str(tmp_path / "b.txt.gz")).collect()
    except Exception as e:
        assert "ends inside a record" in str(e)
    else:
        raise AssertionError("a cut archive was read")
    lost = spark.createDataFrame([("revisit", "a", "1", "u", "gone", 5, "d", True)], warc.RECORDS)
    assert [r.refers_to for r in warc.resolve_revisits(lost).collect()] == [None]


def test_empty_table(spark):
    assert warc.archive_and_resolve(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"\r", b"\n", b"\r\n", b"a", b"WARC/1.1\r\n", b""]), max_size=12).map(b"".join), max_size=6))
def test_parser_takes_any_payload(payloads):
    stream = b""
    for body in payloads:
        block = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + body
        stream += b"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    parser = warc._Parser(True)
    lines = stream.split(b"\r\n")[:-1] if stream else []
    got = [row for line in lines if (row := parser.feed(line)) is not None]
    assert [r[-1] for r in got] == payloads and [r[5] for r in got] == list(map(len, payloads)) and parser.fields is None
