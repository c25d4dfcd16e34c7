"""WARC archives: writing records (with segments and revisits) and reassembling them when read back.

A record is written as one text row; the row separator of Spark's text writer is the blank line that ends a record, so
the files are plain WARC, gzipped. Payloads go out as HTTP responses in chunked transfer framing. Readers find records by
the lengths that their heads state.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cashlens.llm.arrowtext import parts
from cashlens.llm.shelf import Shelf, new_path

SEGMENT_CHARS = 32_768  # of the HTTP message in a segment; a longer record goes out in continuations
CHUNK_CHARS = 8_192
LEAST_REVISIT = 100  # bytes; smaller payloads are stored each time
FILE_RECORDS = 1_000  # in an archive file, so that a reader holds a bounded one
END = "\r\n\r\n"


def record_id(*names: object) -> str:
    """A URN that is the same in every run."""
    h = hashlib.md5(repr(names).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def chunked(payload: str) -> str:
    """HTTP chunked framing of a text's UTF-8."""
    out = []
    for at in range(0, len(payload), CHUNK_CHARS):
        chunk = payload[at : at + CHUNK_CHARS]
        out.append(f"{len(chunk.encode()):x}\r\n{chunk}\r\n")
    return "".join(out) + "0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of chunked framing; chunk extensions and trailers are skipped. ValueError if it is cut short."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        chunk = body[end + 2 : end + 2 + size]
        if len(chunk) < size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("chunk cut short")
        out.append(chunk)
        at = end + 4 + size


def _head(kind: str, rid: str, block: str, page: object, uri: str | None, more: list[str]) -> str:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", "WARC-Date: 2000-01-01T00:00:00Z"]
    if uri:
        lines.append("WARC-Target-URI: " + re.sub(r"\s", "%20", uri))
    if page is not None:
        lines.append(f"WARC-Page-ID: {page}")
    lines += more + ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block.encode())}"]
    return "\r\n".join(lines) + END + block


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    columns = ("page_id", "url", "html", "first", "digest")
    for batch in batches:
        for part in parts(iter([batch]), "html"):
            out = []
            for page, uri, html, first, digest in zip(*(part.column(c).to_pylist() for c in columns)):
                stated = f"WARC-Payload-Digest: sha256:{digest}"
                if first is not None:
                    to, its_uri = first["page_id"], first["url"]
                    more = [stated, f"WARC-Refers-To: {record_id(to, its_uri, digest)}", f"WARC-Refers-To-Page: {to}"]
                    more += [f"WARC-Payload-Length: {len(html.encode())}"]
                    out.append(_head("revisit", record_id(page, uri, digest), f"HTTP/1.1 200 OK{END}", page, uri, more))
                    continue
                message = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked{END}" + chunked(html or "")
                rid = record_id(page, uri, digest)
                blocks = [message[at : at + SEGMENT_CHARS] for at in range(0, len(message), SEGMENT_CHARS)]
                if len(blocks) == 1:
                    out.append(_head("response", rid, message, page, uri, [stated]))
                    continue
                out.append(_head("response", rid, blocks[0], page, uri, [stated, "WARC-Segment-Number: 1"]))
                for number, block in enumerate(blocks[1:], 2):
                    more = [f"WARC-Segment-Origin-ID: {rid}", f"WARC-Segment-Number: {number}"]
                    if number == len(blocks):
                        more.append(f"WARC-Segment-Total-Length: {len(message.encode())}")
                    out.append(_head("continuation", record_id(rid, number), block, page, uri, more))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])


def payload_digest(html: Column) -> Column:
    return F.sha2(F.coalesce(html, F.lit("")).cast("binary"), 256)


def write_archives(pages: DataFrame, path: str) -> None:
    """One record per row of pages (page_id, url, html), as files of up to FILE_RECORDS records.

    Of rows with equal payloads of at least LEAST_REVISIT bytes that with the smallest page_id is a response and the
    others revisit it; rows without page_id are always responses. A null html is an empty payload.
    """
    shelf = Shelf(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    rows = rows.withColumn("digest", payload_digest(F.col("html")))
    long_ = rows.filter((F.octet_length("html") >= LEAST_REVISIT) & F.col("page_id").isNotNull())
    marks = shelf.put(long_.select("page_id", "url", "digest"))
    least = F.min(F.struct("page_id", "url")).alias("first")
    firsts = marks.groupBy("digest").agg(least, F.count(F.lit(1)).alias("n"))
    firsts = shelf.put(firsts.filter("n > 1").select("digest", "first"))
    again = marks.join(firsts, "digest").filter("page_id <> first.page_id")
    again = shelf.put(again.select(F.col("page_id").alias("of"), F.col("digest").alias("d"), "first").distinct())
    joined = rows.join(again, (F.col("page_id") == F.col("of")) & (F.col("digest") == F.col("d")), "left")
    records = joined.select("page_id", "url", "html", "first", "digest").mapInArrow(_records, "value string")
    records.write.option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS).text(path, compression="gzip")
    shelf.keep()


#: What a record is read as. A continuation has its origin's id in `origin`; other records have their own there.
RECORD = (
    "origin string, number int, type string, page_id long, uri string, refers_to string, refers_to_page long, "
    "stated_digest string, stated_length long, total_length long, block binary, times int"
)


def _fields(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def records_of(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an uncompressed archive, by the lengths that the heads state."""
    at = 0
    while (at := content.find(b"WARC/1.", at)) >= 0:
        end = content.index(b"\r\n\r\n", at)
        fields = _fields(content[at:end])
        length = int(fields["content-length"])
        block = content[end + 4 : end + 4 + length]
        if len(block) < length:
            raise ValueError("record cut short")
        yield fields, block
        at = end + 4 + length


def inflated(content: bytes) -> bytes:
    """The content of an archive, whether plain or gzipped (in one member or one for each record)."""
    out = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(content))
        content = member.unused_data
    return b"".join(out) or content


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = lambda x: None if x is None else int(x)
    for batch in batches:
        for content in batch.column("content"):
            rows: dict[tuple, int] = {}
            for fields, block in records_of(inflated(content.as_py())):
                digest = fields.get("warc-payload-digest", "")
                record = (
                    fields.get("warc-segment-origin-id") or fields.get("warc-record-id"),
                    int(fields.get("warc-segment-number", 1)),
                    fields["warc-type"],
                    number(fields.get("warc-page-id")),
                    fields.get("warc-target-uri"),
                    fields.get("warc-refers-to"),
                    number(fields.get("warc-refers-to-page")),
                    digest.rpartition(":")[2] or None,
                    number(fields.get("warc-payload-length")),
                    number(fields.get("warc-segment-total-length")),
                    block,
                )
                # Equal records of an archive are one row with a count.
                rows[record] = rows.get(record, 0) + 1
                if len(rows) == FILE_RECORDS:
                    yield _table(rows)
                    rows = {}
            if rows:
                yield _table(rows)


def _table(counted: dict[tuple, int]) -> pa.RecordBatch:
    rows = [(*record, times) for record, times in counted.items()]
    names = [field.split()[0] for field in RECORD.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    types = [kinds[field.split()[1]] for field in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives below a path, segments apart (columns: RECORD).

    Equal records of an archive are one row that stands for as many `times`.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read, RECORD)


def _payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads, faults, copies = [], [], []
        for kind, segments in zip(batch.column("type").to_pylist(), batch.column("segments").to_pylist()):
            # The same record may have been written several times: its segments then come in equal copies.
            distinct, written = [], []
            for s in segments:
                times = s.pop("times")
                if distinct and s == distinct[-1]:
                    written[-1] += times
                else:
                    distinct.append(s)
                    written.append(times)
            numbers = [s["number"] for s in distinct]
            total = distinct[-1]["total_length"]
            message = b"".join(s["block"] for s in distinct)
            fault = None
            times = written[0]
            if numbers != list(range(1, len(numbers) + 1)) or set(written) != {times}:
                fault = "segment missing or repeated"
            elif total is not None and total != len(message) or total is None and len(numbers) > 1:
                fault = "length differs from the total"
            payload = None
            if fault is None and kind != "revisit":
                head, blank, body = message.partition(b"\r\n\r\n")
                if not blank:
                    fault = "no HTTP head"
                elif re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head):
                    try:
                        payload = dechunked(body)
                    except ValueError:
                        fault = "chunked framing broken"
                else:
                    payload = body
            payloads.append(payload)
            faults.append(fault)
            copies.append(times)
        kept = batch.drop_columns(["segments"])
        yield pa.RecordBatch.from_arrays(
            [*kept.columns, pa.array(payloads, pa.binary()), pa.array(faults, pa.string()), pa.array(copies, pa.int32())],
            [*kept.schema.names, "payload", "fault", "copies"],
        )


def reassemble(records: DataFrame) -> DataFrame:
    """One row per record: its fields, payload, and fault (null if whole).

    Continuations are grouped by the id of their origin and joined in order of segment number; their total length must
    be the stated one, numbers must run from 1 without gap or repeat. Chunked transfer framing is then decoded. A record
    at fault has a null payload. Revisits have none of their own. A record written several times gives as many rows.
    """
    segmented = records.withColumn("many", (F.col("type") == "continuation") | (F.col("number") > 1))
    segment = F.struct("number", "total_length", "block", "times")
    first = lambda c: F.min(F.when(F.col("type") != "continuation", F.col(c))).alias(c)
    fields = ["type", "page_id", "uri", "refers_to", "refers_to_page", "stated_digest", "stated_length"]
    grouped = segmented.groupBy("origin").agg(
        *[first(c) for c in fields], F.array_sort(F.collect_list(segment)).alias("segments")
    )
    shape = (
        "origin string, type string, page_id long, uri string, refers_to string, refers_to_page long, stated_digest string, "
        "stated_length long, payload binary, fault string, copies int"
    )
    whole = grouped.mapInArrow(_payload, shape)
    return whole.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")


def archive_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes archives to `path` (a folder of its own on the shared shelf if none), reads them back, reassembles.

    Rows as `reassemble` gives them, one per row of pages. Null and empty pages are records with an empty payload; a
    null page id stays null and revisits nothing; rows may repeat a page id, with the same or other content. An empty
    table gives no rows; other columns are ignored.
    """
    target = path or new_path(pages.sparkSession, "archives")
    write_archives(pages, target)
    return reassemble(read_records(pages.sparkSession, target))
