import gzip

import pytest

from cashlens.llm import queries, warc

SHAPE = "page_id long, url string, html string, digest string, first long, type string, of long"
LONG = "<p>" + "lorem ä 𝄞 " * 20_000
ROWS = [(3, "u", LONG), (1, "u v", LONG), (2, None, "x" * 99), (4, "u", "x" * 99), (5, "u", "y" * 100), (6, "u", "y" * 100), (7, "u", None), (8, "u", "")]
ROWS += [(9, "u", "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nb" * 9), (10, "u", "0\r\n\r\n"), (11, "u", "twice" * 30_000), (11, "u", "twice" * 30_000)]
ROWS += [(12, "u", "one"), (12, "u", "other"), (None, "u", "y" * 100), (None, "u", "y" * 100)]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "x", 1) for r in rows], SHAPE)


def test_round_trip(spark):
    first = {}
    for i, _, html in sorted((r for r in ROWS if r[0] is not None), key=lambda r: r[0]):
        if len((html or "").encode()) >= 100:
            first.setdefault(html, i)
    want = []
    for i, _, html in ROWS:
        to = first.get(html, i) if i is not None else None
        want.append((i, None if to != i else html or "", "revisit" if to != i else "response", to if to != i else None, None))
    found = warc.archive_round_trip(pages(spark, ROWS)).collect()
    got = [(r.page_id, None if r.payload is None else r.payload.decode(), r.type, r.refers_to_page, r.fault) for r in found]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert warc.archive_round_trip(pages(spark, ROWS).limit(0)).count() == 0


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    found = queries.op8_warc(spark, sf_dir).collect()
    html = {r.page_id: r.html.encode() for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert {r.page_id: r.payload_bytes for r in found} == {i: len(b) for i, b in html.items()} and len(found) == len(html)


def test_foreign_archives_and_faults(spark, tmp_path):
    def record(kind, rid, block, *more):
        head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", *more, f"Content-Length: {len(block)}"]
        return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    origin = "WARC-Segment-Origin-ID: "
    message = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3;x=1\r\nabc\r\n2\r\nde\r\n0\r\nTrailer: 1\r\n\r\n"
    whole = [record("response", "<a>", message[:60], "WARC-Segment-Number: 1")]
    rest = record("continuation", "<a2>", message[60:], origin + "<a>", "WARC-Segment-Number: 2", f"WARC-Segment-Total-Length: {len(message)}")
    gap = [record("response", "<b>", b"x", "WARC-Segment-Number: 1"), record("continuation", "<b3>", b"z", origin + "<b>", "WARC-Segment-Number: 3", "WARC-Segment-Total-Length: 2")]
    short = [record("response", "<c>", b"x", "WARC-Segment-Number: 1"), record("continuation", "<c2>", b"z", origin + "<c>", "WARC-Segment-Number: 2", "WARC-Segment-Total-Length: 3")]
    cut = [record("response", "<d>", message[:-20])]
    plain = [record("response", "<e>", b"HTTP/1.1 200 OK\r\n\r\nbody"), record("response", "<f>", b"no head")]
    (tmp_path / "1.warc").write_bytes(rest + b"".join(gap + cut))
    (tmp_path / "2.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in whole + short + plain))
    found = {r.origin: (r.payload, r.fault) for r in warc.reassemble(warc.read_records(spark, str(tmp_path))).collect()}
    assert found == {
        "<a>": (b"abcde", None),
        "<b>": (None, "segment missing or repeated"),
        "<c>": (None, "length differs from the total"),
        "<d>": (None, "chunked framing broken"),
        "<e>": (b"body", None),
        "<f>": (None, "no HTTP head"),
    }


def test_chunks():
    assert warc.dechunked(warc.chunked("ä" * 20_000).encode()) == ("ä" * 20_000).encode()
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc")


def test_equal_rows_travel_once(spark, tmp_path):
    """Copies of a record in an archive are one row with a count, so a group holds as many as there are archives."""
    rows = [(1, "u", "same text " * 20)] * 500 + [(2, "u", "z" * 90_000)] * 40
    warc.write_archives(pages(spark, rows).coalesce(1), str(tmp_path / "w"))
    records = warc.read_records(spark, str(tmp_path / "w"))
    assert records.count() < 20 and sum(r.times for r in records.where("page_id = 1").collect()) == 500
    found = [(r.page_id, r.fault) for r in warc.reassemble(records).collect()]
    assert sorted(found) == [(1, None)] * 500 + [(2, None)] * 40
