"""WARC archives: a writer on Spark's own committer, and a salvage reader.

Writing: each record is one gzip member; Spark's text writer puts runs of
members down byte for byte, with an empty member between them, so archives are
committed as any Spark output is, and an archive's bytes are bounded. Of
records with equal payloads of at least REVISIT_FROM bytes, the one with the
smallest page id is the response.

Reading: each member must decompress with its checksum and hold whole records,
which have the mandatory headers and agree with their block and payload
digests. After a failed check the reader looks for the next WARC version line
inside the member's content, or for the next gzip member or version line of the
archive, goes on there, and reports what lies in between as a gap. What a cut
or damaged member still yields is kept where a digest vouches for it. Each
search goes on where the last one ended, so a damaged archive is read in linear
time. Records that are not compressed are read too.

Edge cases: a null html is an empty payload; a null url or page id is written
as an absent header or `null`; rows that repeat a page id are all written, and
are responses where theirs is the smallest id; of equal payloads whose page ids
are all null each is a response; very long payloads are records like others; an
empty table gives no records; an archive of garbage is one gap; other columns
are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_totals

REVISIT_FROM = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MEMBER = b"\x1f\x8b\x08"
ID_URI = "urn:quern:page:"
#: An empty gzip member; as ISO-8859-1 text it is the separator that the text writer is given.
EMPTY_MEMBER = (b"\x1f\x8b\x08" + bytes(6) + b"\x03\x03" + bytes(9)).decode("latin-1")
#: Bytes that are decompressed at a time.
STEP = 1 << 16
#: Bytes of members that are written in one run, and runs of an archive, at most: readers open an archive whole.
RUN_BYTES, FILE_RUNS = 1 << 20, 64
#: Bytes in which a record's header has to end.
HEAD = 1 << 16
VERSION = b"WARC/1."
#: Records that a reading task hands on at a time.
BATCH = 128


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def format_record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One record: a response with its payload, or a revisit with the HTTP headers alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    name = lambda x: "null" if x is None else str(x)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{ID_URI}{name(page_id)}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{ID_URI}{name(refers_to)}>", f"WARC-Profile: {PROFILE}"]
    head += [
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0, vouched: bool = False) -> tuple[dict[str, str], bytes, bytes, int] | None:
    """(headers, block, payload, end) of the record that starts at `at` and passes all checks, else None.

    vouched: only with a digest that agrees.
    """
    if data[at : at + 7] != VERSION:
        return None
    head_end = data.find(b"\r\n\r\n", at, at + HEAD)
    if head_end < 0:
        return None
    try:
        lines = data[at:head_end].decode().split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers["content-length"])
        headers["warc-type"], headers["warc-record-id"]
    except (UnicodeDecodeError, KeyError, ValueError):
        return None
    begin = head_end + 4
    end = begin + size + 4
    if size < 0 or data[end - 4 : end] != b"\r\n\r\n":
        return None
    block = data[begin : begin + size]
    payload = block
    if headers.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        if stated := re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http):
            headers["http-content-length"] = stated[1].decode()
    stated = [(headers["warc-block-digest"], block)] if "warc-block-digest" in headers else []
    if "warc-payload-digest" in headers and headers["warc-type"] != "revisit":
        stated.append((headers["warc-payload-digest"], payload))
    verdicts = [_agrees(*x) for x in stated]
    if False in verdicts or (vouched and True not in verdicts):
        return None
    return headers, block, payload, end


def _agrees(stated: str, content: bytes) -> bool | None:
    """Whether a digest holds; SHA-1 comes in base 32 or hex; None for unknown algorithms, which are not checked."""
    algorithm, _, value = stated.partition(":")
    if algorithm.lower() not in ("sha1", "sha256", "md5"):
        return None
    digest = hashlib.new(algorithm.lower(), content).digest()
    return value.lower() == digest.hex() or value.upper().rstrip("=") == base64.b32encode(digest).decode().rstrip("=")


def _member(data: memoryview, at: int) -> tuple[bytes, int, bool]:
    """What the gzip member at `at` yields, where reading ended, and whether it is whole."""
    z, out, pos = zlib.decompressobj(31), [], at
    while not z.eof:
        step = data[pos : pos + STEP]
        if not len(step):
            return b"".join(out), pos, False
        before = z.copy()
        try:
            out.append(z.decompress(step))
        except zlib.error:
            for i in range(len(step)):
                try:
                    out.append(before.decompress(step[i : i + 1]))
                except zlib.error:
                    return b"".join(out), pos + i, False
            return b"".join(out), pos + len(step), False
        pos += len(step)
    return b"".join(out), pos - len(z.unused_data), True


class _Marks:
    """Next places of marks in ascending searches: a mark that lies ahead is not looked for again."""

    def __init__(self, data: bytes, marks: tuple[bytes, ...]) -> None:
        self.data, self.found = data, {m: -1 for m in marks}

    def next(self, at: int) -> int:
        for mark, place in self.found.items():
            if place < at:
                place = self.data.find(mark, at)
                self.found[mark] = place if place >= 0 else len(self.data)
        return min(self.found.values())


def _contents(content: bytes, whole: bool):
    """Records and gaps of a member's content, as (start, end, parsed record or None)."""
    at, gap, marks = 0, None, _Marks(content, (VERSION,))
    while at < len(content):
        one = parse_record(content, at, vouched=not whole)
        if one is None:
            gap = at if gap is None else gap
            at = marks.next(at + 1)
            continue
        if gap is not None:
            yield gap, at, None
            gap = None
        yield at, one[3], one
        at = one[3]
    if gap is not None:
        yield gap, len(content), None


def salvage(data: bytes):
    """Yield (kind, start, end, inner start, inner end, headers, payload) of records and gaps, in order.

    start and end are bytes of the archive and cover all of it but empty
    members; inner start and end are bytes of a member's content. A gap inside
    a whole member has both; a damaged member is a gap of the archive, after
    the records that it still yields.
    """
    view, at, gap, marks = memoryview(data), 0, None, _Marks(data, (MEMBER, VERSION))
    while at < len(data):
        found, end, whole = [], None, True
        if data[at : at + 3] == MEMBER:
            content, stop, whole = _member(view, at)
            found = [(at, stop, s, e, one) for s, e, one in _contents(content, whole)]
            if not content or any(f[4] for f in found):
                end = stop
            if not whole:
                found, end = [f for f in found if f[4]], None
        else:
            one = parse_record(data, at)
            if one is not None:
                found, end = [(at, one[3], None, None, one)], one[3]
        if gap is not None and found:
            yield "gap", gap, at, None, None, None, None
            gap = None
        for s, e, inner, last, one in found:
            yield ("gap", s, e, inner, last, None, None) if one is None else ("record", s, e, inner, last, one[0], one[2])
        if end is None or (not found and gap is not None):
            gap = at if gap is None else gap
        at = marks.next(at + 1) if end is None else end
    if gap is not None:
        yield "gap", gap, len(data), None, None, None, None


def _format(batches):
    """Runs of members of RUN_BYTES or a little more."""
    run, size = [], 0
    for b in batches:
        for page_id, url, html, digest, refers in zip(*(c.to_pylist() for c in b.columns)):
            run.append(gzip_member(format_record(page_id, url, (html or "").encode(), digest, refers)))
            size += len(run[-1])
            if size >= RUN_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(run)], type=pa.binary())], names=["members"])
                run, size = [], 0
    if run:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(run)], type=pa.binary())], names=["members"])


def write_archives(pages: DataFrame, path: str) -> None:
    """Write pages (page_id, url, html) as archives under `path`. The page texts are shuffled once."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("digest"))
    sized = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("size"))
    firsts = sized.where(F.col("size") >= REVISIT_FROM).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    later = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    joined = join_totals(rows, firsts, "digest", "left").select("page_id", "url", "html", "digest", later.alias("refers_to"))
    runs = joined.mapInArrow(_format, "members binary")
    runs.select(F.col("members").cast("string").alias("value")).write.option("maxRecordsPerFile", FILE_RUNS).option("lineSep", EMPTY_MEMBER).option("encoding", "ISO-8859-1").text(path)


READ_SCHEMA = (
    "file string, start long, end long, inner_start long, inner_end long, kind string, record_id string, record_type string, uri string,"
    " refers_to string, payload_digest string, payload_bytes long, payload binary"
)


def _row(file: str, found: tuple) -> tuple:
    kind, start, end, inner_start, inner_end, headers, payload = found
    if kind == "gap":
        return (file, start, end, inner_start, inner_end, kind, None, None, None, None, None, None, None)
    h = headers.get
    whole = int(h("http-content-length", 0)) if h("warc-type") == "revisit" else len(payload)
    return (file, start, end, inner_start, inner_end, kind, h("warc-record-id", "").strip("<>"), h("warc-type"), h("warc-target-uri"), h("warc-refers-to", "").strip("<>") or None, h("warc-payload-digest"), whole, payload)


def _read(batches):
    names = [c.split()[0] for c in READ_SCHEMA.split(",")]
    types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in READ_SCHEMA.split(",")]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows) if rows else [()] * len(names), types)], names=names)

    for b in batches:
        for i in range(b.num_rows):
            file, rows = b.column(0)[i].as_py(), []
            for found in salvage(b.column(1)[i].as_py()):
                rows.append(_row(file, found))
                if len(rows) == BATCH:
                    yield table(rows)
                    rows = []
            yield table(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, and one per gap (kind `gap`, with its byte range). Archives are opened by Spark, one file after the other, each whole (those of `write_archives` are bounded)."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_read, READ_SCHEMA)


def gaps(records: DataFrame) -> DataFrame:
    """The log of quarantined byte ranges: of the archive, or inside the content of a member."""
    return records.where("kind = 'gap'").select("file", "start", "end", "inner_start", "inner_end")


def page_records(records: DataFrame) -> DataFrame:
    """Rows (page_id, payload_bytes, payload_digest, record_type, refers_to) of pages that `write_archives` wrote.

    A revisit has no payload of its own; its HTTP header states the full size.
    """
    ident = lambda c: F.when(F.col(c) != f"{ID_URI}null", F.substring(c, len(ID_URI) + 1, 30).cast("long"))
    return records.where("kind = 'record'").select(
        ident("record_id").alias("page_id"), "payload_bytes", F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"), "record_type", ident("refers_to").alias("refers_to")
    )
