"""WARC archives in which equal payloads are stored once, and the resolution of their revisit records.

Only headers (ids, sizes, digests) are shuffled, by payload digest: every digest that several records share gets one
response, and its other records become revisits.  Archives are gzip text files of Spark's own writer, so they go to any
file system that Spark knows and a lost executor's files are written again; reading goes through Spark's text reader and
cuts records by their lengths, so payloads may hold any bytes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, shared_dir

#: Payloads shorter than this are stored with every record.
LEAST_BYTES = 1000
#: Copies of one row that one task writes as revisits.
COPIES_AT_ONCE = 10_000
#: Records and payload bytes that the reader returns at once.
PIECE_ROWS = 2_000
PIECE_BYTES = 8 << 20

CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "record_type string, record_id string, page_id string, target_uri string, refers_to_record string, payload_bytes long, payload_digest string, intact boolean"


def payload_headers(pages: DataFrame) -> DataFrame:
    """(page_id, url, size, sha1, sha256) of every row; a null html is the empty payload."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", "url", F.octet_length(html).cast("long").alias("size"), F.unhex(F.sha1(html)).alias("sha1"), F.unhex(F.sha2(html, 256)).alias("sha256"))


def _rank() -> Column:
    """What decides the response among equal payloads: the largest page_id, null below all; then the largest url."""
    return F.struct(F.col("page_id").isNotNull().alias("has_id"), F.col("page_id").alias("page_id"), F.col("url").isNotNull().alias("has_url"), F.col("url").alias("url"))


def shared_payloads(headers: DataFrame) -> DataFrame:
    """(sha256, first): of every payload of LEAST_BYTES or more that several rows have, the row that stays a response.

    Two digests guard the group: ``sha256`` decides, so payloads made to collide in SHA-1 stay apart."""
    groups = headers.where(F.col("size") >= LEAST_BYTES).groupBy("sha256").agg(F.max(_rank()).alias("first"), F.count(F.lit(1)).alias("n"))
    return groups.where("n > 1").select("sha256", "first")


def _uuid_of(digest: Column) -> Column:
    h = F.lower(F.hex(digest))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("8"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def _line(name: str, value: Column) -> Column:
    """A header line, empty where the value is null; line ends and blanks inside the value are percent-encoded."""
    for plain, code in (("\r", "%0D"), ("\n", "%0A"), ("\t", "%09"), (" ", "%20")):
        value = F.replace(value, F.lit(plain), F.lit(code))
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def _uri(url: Column, page: Column) -> Column:
    return F.coalesce(F.when(url != "", url), F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("null"))))


def _record(kind: str, record_id: Column, refers_to: tuple[Column, Column] | None, date: str, payload: Column | None) -> Column:
    """The text of one record without its last line end, which the writer adds; ``refers_to`` are the id and the URI of the
    response that a revisit stands for."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(CRLF + CRLF))
    page = F.col("page_id").cast("string")
    lines = [
        F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\n"),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), record_id, F.lit(">"))),
        F.lit(f"WARC-Date: {date}\r\n"),
        _line("WARC-Target-URI", _uri(F.col("url"), F.col("page_id"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.lower(F.hex("sha1")))),
        _line("WARC-Page-ID", page),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
    ]
    if refers_to is not None:
        lines += [_line("WARC-Refers-To", F.concat(F.lit("<urn:uuid:"), refers_to[0], F.lit(">"))), _line("WARC-Refers-To-Target-URI", refers_to[1]), F.lit(f"WARC-Refers-To-Date: {date}\r\nWARC-Profile: {REVISIT_PROFILE}\r\n")]
    block = F.octet_length(http) + (F.col("size") if payload is not None else F.lit(0))
    body = [http] if payload is None else [http, payload]
    return F.concat(*lines, _line("Content-Length", block.cast("string")), F.lit(CRLF), *body, F.lit(CRLF))


def write_archives(pages: DataFrame, path: str, date: str | None = None) -> None:
    """Writes a record for every row of ``pages`` (page_id, url, html) to gzip archives under ``path``.

    * Of rows with equal payloads of LEAST_BYTES or more the one with the largest page_id is a response (ties: the largest
      url; of wholly equal rows any one), the others are revisits of it without a payload.  Shorter payloads are responses.
    * A null html is an empty payload; a null or empty url is written as ``urn:page:<page_id>``; a null page_id leaves its header
      out and ranks below all others.  An empty table gives archives without records.  Other columns are not read.
    * Headers are fresh: the id of a response that others may refer to is made from its payload's SHA-256, all others are
      random; ``date`` (UTC, as 2024-01-31T12:00:00Z; now if not given) is every record's date.

    Payloads are read once for the digests and once for writing.  They shuffle only where the table of shared payloads is
    too large to be broadcast; then the join by digest may split a hot digest.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    headers = keep(payload_headers(pages))
    shared = keep(shared_payloads(headers))
    is_first = F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url"))

    # equal rows are counted, never gathered
    members = keep(headers.join(shared, "sha256").groupBy("page_id", "url", "size", "sha1", "sha256", "first", is_first.alias("is_first")).agg(F.count(F.lit(1)).alias("n")))
    copies = members.withColumn("copies", F.col("n") - F.col("is_first").cast("long")).where("copies > 0")
    copies = copies.select("*", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES_AT_ONCE})")).alias("piece"))
    if not members.where(F.col("n") > COPIES_AT_ONCE).isEmpty():
        copies = copies.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    again = copies.select("*", F.explode(F.expr(f"sequence(1L, least({COPIES_AT_ONCE}L, copies - piece * {COPIES_AT_ONCE}))")).alias("copy"))
    revisits = again.select(_record("revisit", F.expr("uuid()"), (_uuid_of(F.col("sha256")), _uri(F.col("first.url"), F.col("first.page_id"))), date, None).alias("record"))

    html = F.coalesce(F.col("html"), F.lit(""))
    bodies = pages.select("page_id", "url", html.alias("html")).select("*", F.octet_length("html").cast("long").alias("size"), F.unhex(F.sha1(F.col("html").cast("binary"))).alias("sha1"), F.unhex(F.sha2(F.col("html").cast("binary"), 256)).alias("sha256"))
    chosen = bodies.join(shared, "sha256", "left").where(F.col("first").isNull() | is_first)
    ties = members.where(F.col("is_first") & (F.col("n") > 1)).select("sha256")
    if not ties.isEmpty():
        tied = chosen.join(ties, "sha256", "left_semi").dropDuplicates(["sha256"])
        chosen = chosen.join(ties, "sha256", "left_anti").unionByName(tied)
    record_id = F.when(F.col("size") >= LEAST_BYTES, _uuid_of(F.col("sha256"))).otherwise(F.expr("uuid()"))
    responses = chosen.select(_record("response", record_id, None, date, F.col("html")).alias("record"))
    responses.unionByName(revisits).write.option("compression", "gzip").option("lineSep", CRLF).text(path)


class _Parser:
    """Cuts the lines of archives (between CRLFs) into records; payloads are digested piece by piece."""

    def __init__(self, with_payload: bool):
        self.with_payload = with_payload
        self.fields: dict[str, str] | None = None
        self.left: int | None = None  # bytes of the block still to come; None outside a block

    def feed(self, line: bytes) -> tuple | None:
        """Takes one line; a record, if it ended there."""
        if self.left is None:
            return self._head(line)
        if self.started:
            self.left -= 2
        self.left -= len(line)
        if self.left < 0:
            raise ValueError(f"a block runs over its Content-Length: {self.fields}")
        if self.in_payload:
            for piece in (b"\r\n", line) if self.payload_started else (line,):
                self.digest.update(piece)
                self.size += len(piece)
                if self.with_payload:
                    self.pieces.append(piece)
            self.payload_started = True
        elif line:
            name, _, value = line.decode("utf-8", "replace").partition(":")
            self.http[name.strip().lower()] = value.strip()
        else:
            self.in_payload = True
        self.started = True
        return self._end() if not self.left else None

    def _head(self, line: bytes) -> None:
        if self.fields is None:
            if line.startswith(b"WARC/"):
                self.fields = {}
            elif line:
                raise ValueError("an archive is read from its middle, or is none: gzip archives are read whole")
        elif line:
            name, _, value = line.decode("utf-8", "replace").partition(":")
            self.fields[name.strip().lower()] = value.strip()
        else:
            self.left = int(self.fields.get("content-length", 0))
            self.started = self.payload_started = False
            self.in_payload = not self.fields.get("content-type", "").startswith("application/http")
            self.http: dict[str, str] = {}
            self.digest, self.size, self.pieces = hashlib.sha1(), 0, []

    def _end(self) -> tuple:
        f, told = self.fields, self.fields.get("warc-payload-digest", "").removeprefix("sha1:")
        kind, found = f.get("warc-type"), self.digest.hexdigest()
        inner = lambda name: f[name].strip("<>").removeprefix("urn:uuid:") if name in f else None
        body = b"".join(self.pieces) if self.with_payload else None
        size, intact = (int(self.http.get("content-length", 0)), True) if kind == "revisit" else (self.size, not told or told == found)
        self.fields = self.left = None
        return kind, inner("warc-record-id"), f.get("warc-page-id"), f.get("warc-target-uri"), inner("warc-refers-to"), size, told if kind == "revisit" else found, intact, body


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """(RECORDS) of every record under ``path``, with the column ``payload`` if asked for.

    Sizes and digests of responses are measured on the payloads read, ``intact`` says whether they meet the header; those
    of revisits come from their headers.  A file is read by one task from its start, with memory for one line between two
    CRLFs; files are as large as the tasks that wrote them."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = RECORDS + ", payload binary"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, rows, held = _Parser(with_payload), [], 0
        for batch in batches:
            lines = batch.column(0)
            for at in range(0, batch.num_rows, 256):
                for line in lines.slice(at, 256).to_pylist():
                    if (row := parser.feed(line)) is not None:
                        rows.append(row)
                        held += len(row[-1] or b"")
                        if len(rows) >= PIECE_ROWS or held >= PIECE_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
                            rows, held = [], 0
        if parser.fields is not None:
            raise ValueError(f"an archive ends inside a record: {parser.fields}")
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    lines = spark.read.schema("value string").option("lineSep", CRLF).text(path).select(F.col("value").cast("binary").alias("line"))
    found = lines.mapInArrow(run, schema)
    return found if with_payload else found.drop("payload")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records`` with ``refers_to``: the page_id of the response that a revisit stands for, null for all others.

    Headers meet by payload digest and record id; a revisit whose response is missing keeps a null."""
    originals = records.where("record_type = 'response'").select("payload_digest", F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"))
    found = records.where("record_type = 'revisit'").join(originals, ["payload_digest", "refers_to_record"], "left")
    rest = records.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("string"))
    return rest.unionByName(found.select(rest.columns))


def archive_and_resolve(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, intact) of archives written from ``pages`` into the
    shared folder and read back; see ``write_archives`` for nulls, ties, repeated rows and empty tables."""
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType
    path = f"{shared_dir(spark)}/tidemark-warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    found = resolve_revisits(keep(read_archives(spark, path)))
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "intact")
