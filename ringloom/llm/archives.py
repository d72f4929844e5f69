"""Legacy ARC archives, their conversion to WARC, and WARC files."""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringloom.llm.common import BATCH_BYTES, drop_table, lean_batches, new_path, settle

#: Field names of an ARC record's header line, by the version that the archive's first record declares.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Payloads shorter than this are never written as revisits.
LEAST_REVISIT = 100
#: Bytes of one WARC file before compression, and of one ARC, about.
WARC_BYTES, ARC_BYTES = 32 << 20, 4 << 20
#: The WARC date of a record whose ARC date is none.
NO_DATE = "1970-01-01T00:00:00Z"
PAGE_HEADER, ORIGINAL_HEADER = "X-Page-Id", "X-Refers-To-Page-Id"
EPOCH = datetime(2020, 1, 1, tzinfo=UTC)
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

RECORD = "record_id string, url string, date string, page_id long, head binary, payload binary, payload_bytes long, payload_digest string, truncated boolean"


# ---- ARC ----


def arc_record(version: int, url: str, date: str, kind: str, block: bytes, offset: int, name: str) -> bytes:
    fields = [url, "0.0.0.0", date, kind]
    if version == 2:
        fields += ["200", "-", "-", str(offset), name]
    return " ".join([*fields, str(len(block))]).encode() + b"\n" + block + b"\n"


def arc_head(version: int, name: str) -> bytes:
    block = f"{version} 0 ringloom\n{ARC_FIELDS[version]}\n".encode()
    return arc_record(version, f"filedesc://{name}", "20200101000000", "text/plain", block, 0, name)


#: The left part of a header line, up to the address and the date of 12 or 14 digits; a URL may hold blanks.
_LEFT = re.compile(r"(?P<url>\S.*?) (?P<ip>[0-9A-Fa-f.:]+|-) (?P<date>\d{12}|\d{14}) (?P<kind>.*)", re.ASCII)
#: A declared length, and a page id.
_LENGTH, _ID = re.compile("[0-9]{1,18}"), re.compile("-?[0-9]{1,19}")


def opened(content: bytes) -> BinaryIO:
    """A stream over plain or gzip-compressed bytes, of any number of members."""
    return gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def taken(stream: BinaryIO, length: int) -> bytes:
    """The next `length` bytes, or what is left; a length that no archive has asks for no more memory than its bytes."""
    parts = []
    while length and (part := stream.read(min(length, 1 << 20))):
        parts.append(part)
        length -= len(part)
    return b"".join(parts)


def header_fields(line: str, names: list[str]) -> dict | None:
    """The fields of a header line by `names`; null if it isn't one. What stands right of the content type has no blanks; the content type and the URL may have some."""
    right = len(names) - 1 - names.index("Content-type")
    left, *rest = line.rsplit(" ", right)
    found = _LEFT.fullmatch(left)
    if found is None or len(rest) != right or not _LENGTH.fullmatch(rest[-1]):
        return None
    return dict(zip(names, [*found.groups(), *rest], strict=True))


def parse_arc(content: bytes) -> Iterator[tuple[int, dict | str, bytes, bool]]:
    """(byte, header fields by name, block, whether it is cut short) of each record after the first, which declares version and field names; and (byte, what is wrong, b"", False) where there is no record. Bytes are counted after decompression.

    Header lines have any length. Blocks are taken by their declared length, so that nothing in them can look like a header. A length that isn't 1 to 18 ASCII digits makes a line none. After lines that aren't a header, the next line that is one goes on; a run of such lines is told once. An archive is read as a stream, a record at a time.
    """
    stream = opened(content)
    names, lost = None, False
    at = 0
    try:
        while line := stream.readline():
            start, at = at, at + len(line)
            text = line.decode("utf-8", "replace").strip("\r\n")
            if not text:
                continue
            if names is None:
                # the first record's own line has the fields of its version, which its block declares after it
                fields = header_fields(text, ARC_FIELDS[2].split()) or header_fields(text, ARC_FIELDS[1].split())
            else:
                fields = header_fields(text, names)
            if fields is None:
                if not lost:
                    yield start, "no header line" if names else "no first record", b"", False
                lost = True
                continue
            length = int(fields["Archive-length"])
            block = taken(stream, length)
            at += len(block)
            lost = False
            if names is None:
                declared = block.decode("ascii", "replace").splitlines()
                names = declared[1].split() if len(declared) > 1 else []
                if names[:4] != ARC_FIELDS[1].split()[:4] or names[-1] != "Archive-length":
                    names = ARC_FIELDS[2 if text.count(" ") >= 9 else 1].split()
                    if not text.startswith("filedesc:"):
                        yield start, fields, block, len(block) < length
            else:
                yield start, fields, block, len(block) < length
    except (OSError, EOFError, zlib.error) as e:
        yield at, f"broken compression: {e}", b"", False


def _arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nth = 0
    for batch in batches:
        parts: list[bytes] = []
        size = 0
        rows = zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html"), strict=True)
        version, name = 1 + nth % 2, f"pages-{nth}.arc"
        for page, url, html in rows:
            if not parts:
                version, name = 1 + nth % 2, f"pages-{nth}.arc"
                parts, nth = [arc_head(version, name)], nth + 1
                size = len(parts[0])
            body = html.as_buffer().to_pybytes() if html.is_valid else b""
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n"
            head += "" if page is None else f"{PAGE_HEADER}: {page}\r\n"
            date = (EPOCH + timedelta(seconds=(page or 0) % 10**8)).strftime("%Y%m%d%H%M%S")
            plain = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "urn:none")
            parts.append(arc_record(version, plain, date, "text/html", head.encode() + b"\r\n" + body, size, name))
            size += len(parts[-1])
            if size >= ARC_BYTES:
                yield _arc_row(name, parts)
                parts = []
        if parts:
            yield _arc_row(name, parts)


def _arc_row(name: str, parts: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(parts)], pa.binary())], ["path", "content"])


def pages_to_arc(pages: DataFrame) -> DataFrame:
    """ARC archives of `pages` (page_id, url, html), of versions 1 and 2 in turn, a few megabytes each: (path, content) as Spark's binaryFile source gives them."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_arcs, "path string, content binary")


# ---- ARC to WARC ----


def arc_date(digits: str) -> str:
    """An ARC date of 12 or 14 digits as a WARC date; NO_DATE for one that is no date, as the all-zero one."""
    try:
        return datetime.strptime(digits.ljust(14, "0"), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return NO_DATE


def page_id(head: bytes) -> tuple[int | None, str | None]:
    """(the page id that an HTTP head declares, if any; what is wrong with it). Ids are 64-bit numbers; of several, the last counts."""
    page = wrong = None
    for line in head.decode("latin-1").split("\r\n"):
        key, _, value = line.partition(":")
        if key.lower() == PAGE_HEADER.lower():
            value = value.strip(" \t")
            known = _ID.fullmatch(value) and -(2**63) <= int(value) < 2**63
            page, wrong = (int(value), None) if known else (None, f"no page id: {value[:40]}")
    return page, wrong


def converted(fields: dict, block: bytes, cut: bool) -> tuple:
    """The parts of a WARC record that stand for an ARC record. Its identifier follows from URL, date and block alone, so conversions repeat."""
    head, gap, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    head += gap
    page, _ = page_id(head)
    name = hashlib.sha256(f"{fields['URL']} {fields['Archive-date']} ".encode() + block).digest()
    record = f"<urn:uuid:{uuid.UUID(bytes=name[:16], version=5)}>"
    return record, fields["URL"], arc_date(fields["Archive-date"]), page, head, payload, len(payload), hashlib.sha256(payload).hexdigest(), cut


def _columns(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    named = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), named, strict=True)], [n for n, _ in named])


def _in_parts(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Batches of some megabytes at most, or of one row that is longer."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + sum(len(v) for v in row if isinstance(v, bytes))
        if size >= BATCH_BYTES // 2:
            yield _columns(held, schema)
            held, size = [], 0
    if held:
        yield _columns(held, schema)


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            found = parse_arc(content.as_buffer().to_pybytes())
            yield from _in_parts((converted(fields, block, cut) for _, fields, block, cut in found if isinstance(fields, dict)), RECORD)


def _errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            found = parse_arc(content.as_buffer().to_pybytes())
            yield from _in_parts(((path, at, wrong) for at, what, block, _ in found if (wrong := _wrong(what, block))), ERRORS)


def _wrong(what: dict | str, block: bytes) -> str | None:
    if isinstance(what, str):
        return what
    return page_id(block.partition(b"\r\n\r\n")[0])[1] if block.startswith(b"HTTP/") else None


ERRORS = "path string, byte long, error string"


def arc_errors(archives: DataFrame) -> DataFrame:
    """Where ARC `archives` (path, content) have no record, or one whose page id is none: path, byte (after decompression), error."""
    return archives.select("path", "content").mapInArrow(_errors, ERRORS)


def arc_to_warc(archives: DataFrame) -> DataFrame:
    """The records of ARC `archives` (path, content), plain or gzip-compressed, with WARC identifiers, dates, types and digests: the columns of RECORD, record_type, and original, (page_id, record_id) of the record that a revisit refers to.

    Of records with equal payloads of LEAST_REVISIT bytes or more, that with the smallest page_id is a response and the others revisit it; records without page_id are responses. Archives are read once, into a table in the shared folder. Only digests and ids meet by digest, smallest ids as one row a digest, summed in part before the shuffle; a digest that a third of the records share is an ordinary skewed join of short rows. Payloads meet their verdicts by a number of their own, so evenly.

    A date that is none becomes NO_DATE; a page id that is none, null; a record that the archive cuts short is kept and marked; lines that are no header are passed over, up to the next that is one. All that is told by arc_errors(), as is broken compression, which ends its archive alone. An empty or headless archive has no records.
    """
    records = settle(archives.select("content").mapInArrow(_convert, RECORD).withColumn("row", F.monotonically_increasing_id()), "records", "zstd")
    long = records.filter((F.col("payload_bytes") >= LEAST_REVISIT) & F.col("page_id").isNotNull()).select("payload_digest", "page_id", "record_id", "row")
    first = long.groupBy("payload_digest").agg(F.min(F.struct("page_id", "record_id")).alias("original"), F.count(F.lit(1)).alias("n"))
    first = first.filter("n > 1").select("payload_digest", "original")
    again = long.join(first, "payload_digest").filter(F.col("page_id") > F.col("original.page_id")).select("row", "original")
    told = records.join(again, "row", "left").drop("row")
    return told.withColumn("record_type", F.when(F.col("original").isNull(), "response").otherwise("revisit"))


# ---- WARC ----


def warc_record(row: dict) -> bytes:
    """A record without the two line ends that close it."""
    revisit = row["record_type"] == "revisit"
    block = row["head"] + (b"" if revisit else row["payload"])
    lines = [
        "WARC/1.0", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {row['record_id']}", f"WARC-Date: {row['date']}",
        f"WARC-Target-URI: {row['url']}", f"WARC-Payload-Digest: sha256:{row['payload_digest']}",
        f"WARC-Payload-Length: {row['payload_bytes']}", "Content-Type: application/http; msgtype=response",
    ]
    if row["page_id"] is not None:
        lines.append(f"{PAGE_HEADER}: {row['page_id']}")
    if row["truncated"]:
        lines.append("WARC-Truncated: unspecified")
    if revisit:
        lines += [
            f"WARC-Refers-To: {row['original']['record_id']}", f"{ORIGINAL_HEADER}: {row['original']['page_id']}", f"WARC-Profile: {PROFILE}",
        ]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: 20\r\n\r\nsoftware: ringloom\r\n"
    started = False
    for batch in batches:
        if batch.num_rows and not started:
            started = True
            name = str(uuid.uuid5(uuid.NAMESPACE_URL, batch.column("record_id")[0].as_py())).encode()
            yield pa.RecordBatch.from_arrays([pa.array([info % name], pa.binary())], ["record"])
        yield from _in_parts(((warc_record(batch.slice(i, 1).to_pylist()[0]),) for i in range(batch.num_rows)), "record binary")


def write_warc(records: DataFrame, path: str, record_bytes: float = 16384) -> None:
    """Write the records of arc_to_warc() as gzip-compressed WARC files under `path`, of about WARC_BYTES before compression where records have `record_bytes` on average. Each record is a value of Spark's text sink, closed by two line ends."""
    lines = records.mapInArrow(_format, "record binary").select(F.col("record").cast("string").alias("value"))
    most = max(1, int(WARC_BYTES / (record_bytes + 600)))
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def parse_warc(content: bytes) -> Iterator[tuple[dict, bytes]]:
    """(headers with lower-case names, block) of each record of plain or gzip-compressed bytes, blocks by their declared length. Read as a stream, a record at a time; anything but a whole record is an error."""
    stream = opened(content)
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {stream.tell() - len(line)}")
        headers = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            headers[key.strip().lower()] = value.strip(" \t\r\n")
        length = int(headers["content-length"])
        block = taken(stream, length)
        if len(block) < length:
            raise ValueError(f"a WARC record is cut short at byte {stream.tell()}")
        yield headers, block


def _read_rows(content: bytes) -> Iterator[tuple]:
    for h, block in parse_warc(content):
        if h["warc-type"] not in ("response", "revisit"):
            continue
        payload, digest = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block, h["warc-payload-digest"].removeprefix("sha256:")
        size = int(h["warc-payload-length"])
        if h["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"record {h['warc-record-id']} doesn't have the payload that it declares")
        page, original = h.get(PAGE_HEADER.lower()), h.get(ORIGINAL_HEADER.lower())
        yield (
            h["warc-record-id"], h["warc-target-uri"], h["warc-date"], None if page is None else int(page), payload, size, digest, h["warc-type"], None if original is None else int(original)
        )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            yield from _in_parts(_read_rows(content.as_buffer().to_pybytes()), READ)


READ = "record_id string, url string, date string, page_id long, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The response and revisit records of the WARC files under `path` that write_warc() wrote, plain or gzip-compressed: the columns of READ. A response whose payload isn't the declared one, or a file that is cut short, is an error."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read, READ)


def archived(pages: DataFrame) -> DataFrame:
    """`pages` (page_id, url, html) through legacy archives and WARC files and back: the records that read_warc() finds.

    The files stay in the shared folder, as read_warc() reads them whenever its rows are asked for. As many records as pages are converted, else it is an error.

    A null html is an empty payload, a null url `urn:none`, and a null page_id a response without one; texts and urls of any length stay whole (blanks and control characters of a url become %XX); rows that repeat a page_id and html are responses both if the id is the smallest of its payload; an empty table gives no rows; other columns are not read. Sets the session's Arrow batches to 8 MB.
    """
    spark = pages.sparkSession
    lean_batches(spark)
    path = new_path(spark, "warc")
    records = arc_to_warc(pages_to_arc(pages))
    n, mean, given = *records.agg(F.count(F.lit(1)), F.avg("payload_bytes")).first(), pages.count()
    if n != given:
        raise ValueError(f"{given} pages made {n} records")
    write_warc(records, path, mean or 0)
    drop_table(records)
    return read_warc(spark, path)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return archived(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN d.page_id > f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN d.page_id > f.first THEN f.first END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND d.payload_bytes >= 100
"""
