"""WARC archives: records of pages are written, and read back whole.

Archives are real WARC files: one per task, in any file system that Spark can
write to (the text writer puts records of UTF-8 after each other; CRLF is the
end that every record has anyway). Each response is an HTTP message in chunked
transfer framing; a payload over ``SEGMENT`` bytes is cut into a first record
and continuation records. Pages of equal payloads are archived once, the
others as revisits.

Reading unzips files in a stream, a record of at most ``SEGMENT`` bytes at a
time. Segments are grouped by their origin's identifier and ordered by number;
the total length is verified, and only then is the chunked framing decoded.
Which payloads are equal is found from digests alone; html stays where it is
while the digests that repeat prove few (see ``looked_up``).
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import looked_up, remove_at_exit, shared_dir, small_batches, staged

#: Payloads of fewer bytes are never revisits.
REVISIT_FROM = 1000
#: Bytes of a record's block at most; longer ones are segmented.
SEGMENT = 64 << 10
CHUNK = 16 << 10
DATE = "2024-01-01T00:00:00Z"
RECORDS_PER_FILE = 2000
_FIRST = re.compile(rb"WARC/1\.[01]\r\n")


class WarcError(ValueError):
    """An archive that doesn't hold what it says."""


def chunked(payload: str) -> str:
    """A text in chunked transfer framing, cut between characters; chunk sizes are of UTF-8 bytes."""
    parts = []
    for i in range(0, len(payload), CHUNK):
        part = payload[i : i + CHUNK]
        parts.append(f"{len(part.encode()):x}\r\n{part}\r\n")
    return "".join(parts) + "0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            raise WarcError(f"no chunk size at byte {at}")
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        at = end + 2 + n
        if body[at : at + 2] != b"\r\n":
            raise WarcError(f"a chunk of {n} bytes is cut short")
        out.append(body[end + 2 : at])
        at += 2


def _record(headers: list[tuple[str, object]], block: str) -> str:
    """A record's text but for its last CRLF, which the writer adds."""
    named = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{named}Content-Length: {len(block.encode())}\r\n\r\n{block}\r\n"


def _one_line(value: str | None) -> str:
    """A header's value: other than printable ASCII is percent-encoded, so that nothing ends the line."""
    return "".join(c if "!" <= c <= "~" and c != "%" else "".join(f"%{b:02X}" for b in c.encode()) for c in value or "")


def _segments(block: str, most: int) -> list[str]:
    """``block`` in parts of at most ``most`` bytes, cut between characters."""
    out, at = [], 0
    step = max(1, most // 4)
    if len(block) <= step or len(block.encode()) <= most:
        return [block]
    while at < len(block):
        end = at + step
        out.append(block[at:end])
        at = end
    return out


def records(
    origin: str, page_id: int | None, url: str | None, html: str | None, digest: str, refers_to: int | None, segment: int = SEGMENT
) -> list[str]:
    """The records of one page: a response, in segments if long, or a revisit."""
    payload = html or ""
    base: list[tuple[str, object]] = [("WARC-Date", DATE)]
    if url is not None:
        base.append(("WARC-Target-URI", _one_line(url)))
    page = [("Page-ID", "null" if page_id is None else page_id), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload.encode())}\r\n\r\n"
        kind = [("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{origin}>"), ("Content-Type", "application/http; msgtype=response")]
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        return [_record([*kind, *base, *page, ("WARC-Profile", profile), ("Refers-To-Page-ID", refers_to)], head)]
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    block = head + chunked(payload)
    parts = _segments(block, segment)
    out = []
    for k, part in enumerate(parts, 1):
        if k == 1:
            headers = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{origin}>"), ("Content-Type", "application/http; msgtype=response"), *base, *page]
            if len(parts) > 1:
                headers.append(("WARC-Segment-Number", 1))
        else:
            headers = [
                ("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{origin}:{k}>"), *base,
                ("WARC-Segment-Origin-ID", f"<{origin}>"), ("WARC-Segment-Number", k),
            ]
            if k == len(parts):
                headers.append(("WARC-Segment-Total-Length", len(block.encode())))
        out.append(_record(headers, part))
    return out


def with_originals(pages: DataFrame, least: int = REVISIT_FROM, small: bool | None = None) -> DataFrame:
    """``pages`` (page_id, url, html) with ``digest`` and, for revisits, ``refers_to``.

    Of rows with equal payloads of at least ``least`` bytes, those with the
    largest page_id are responses. Rows without a page_id are responses too.
    Only digests are shuffled, unless those that repeat are too many to send.
    """
    digest = F.sha1(F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8"))
    may = F.coalesce((F.octet_length("html") >= least) & F.col("page_id").isNotNull(), F.lit(False))
    repeated = pages.where(may).select(digest.alias("same"), "page_id").groupBy("same")
    repeated = repeated.agg(F.max("page_id").alias("original"), F.min("page_id").alias("another"), F.count("*").alias("rows"))
    originals = staged(repeated.where("original <> another").select("same", "original", "rows"))
    # rows that can't be revisits, of which many may be equal, have keys of their own
    own = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))
    hashed = pages.select("page_id", "url", "html", digest.alias("digest"), own.alias("own"))
    keyed = hashed.withColumn("same", F.when(may, F.col("digest")).otherwise(F.col("own"))).drop("own")
    joined = looked_up(keyed, originals, "same", "rows", small)
    refers = F.when(F.col("page_id") < F.col("original"), F.col("original"))
    return joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write(pages: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Archives of all pages below ``path``, gzipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in small_batches([whole], "html"):
                out = []
                for row in batch.to_pylist():
                    out += records(
                        f"urn:pagemill:{task}:{n}", row["page_id"], row["url"], row["html"], row["digest"], row["refers_to"], segment
                    )
                    n += 1
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    made = with_originals(pages).mapInArrow(run, "value string")
    made.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, gzipped or not, unzipped in a stream."""
    held = io.BytesIO(content)
    archive: BinaryIO = gzip.open(held) if content[:2] == b"\x1f\x8b" else held
    n = 0
    while first := archive.readline(1 << 16):
        if not _FIRST.fullmatch(first):
            raise WarcError(f"record {n} doesn't begin with its version")
        headers = {}
        while (line := archive.readline(1 << 20)) != b"\r\n":
            if not line.endswith(b"\r\n"):
                raise WarcError(f"the headers of record {n} are cut short")
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = archive.read(size)
        if len(block) < size or archive.read(4) != b"\r\n\r\n":
            raise WarcError(f"record {n}, of {size} bytes, is cut short")
        n += 1
        yield headers, block


_PARTS = "origin string, number long, total long, type string, page_id long, url string, digest string, refers_to long, block binary"


_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _number(value: str | None) -> int | None:
    return None if value in (None, "null") else int(value)


def read_records(spark, path: str) -> DataFrame:
    """One row for each record of the archives below ``path``; number is null for whole records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _PARTS.split(", ")]
        types = [_KINDS[x.split()[1]] for x in _PARTS.split(", ")]
        rows: list[tuple] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                data, held = batch.column(0)[i].as_py(), 0
                for h, block in parse(data):
                    origin = h.get("warc-segment-origin-id") or h["warc-record-id"]
                    digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
                    number, total = _number(h.get("warc-segment-number")), _number(h.get("warc-segment-total-length"))
                    page, refers = _number(h.get("page-id")), _number(h.get("refers-to-page-id"))
                    rows.append((origin, number, total, h["warc-type"], page, h.get("warc-target-uri"), digest, refers, block))
                    held += len(block)
                    if held > 8 << 20:
                        yield made()
                        rows, held = [], 0
                if rows:
                    yield made()
                    rows = []

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, _PARTS)


def reassemble(parts: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of (segment number, total length if given, block) of one origin, in any order."""
    parts = sorted(parts, key=lambda p: p[0])
    if [p[0] for p in parts] != list(range(1, len(parts) + 1)):
        raise WarcError(f"segments {[p[0] for p in parts]}")
    whole = b"".join(p[2] for p in parts)
    if len(parts) > 1 and parts[-1][1] is None:
        raise WarcError("the last segment is missing")
    if parts[-1][1] not in (None, len(whole)):
        raise WarcError(f"{len(whole)} bytes of {parts[-1][1]}")
    return whole


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response, without its transfer framing."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError("no end of the HTTP headers")
    return unchunked(body) if re.search(rb"(?i)\r\ntransfer-encoding:\s*chunked", head) else body


_PAGE = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _page(first: dict, block: bytes) -> tuple:
    url = None if first["url"] is None else unquote(first["url"])
    if first["type"] == "revisit":
        length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", block)
        if length is None:
            raise WarcError("a revisit without a length")
        return first["page_id"], url, None, int(length[1]), first["digest"], "revisit", first["refers_to"]
    payload = payload_of(block)
    if hashlib.sha1(payload).hexdigest() != first["digest"]:
        raise WarcError(f"the payload of page {first['page_id']} isn't that of its digest")
    return first["page_id"], url, payload, len(payload), first["digest"], "response", None


def read(spark, path: str) -> DataFrame:
    """Each page of the archives: page_id, url, payload (null for revisits), payload_bytes,
    payload_digest, record_type and refers_to. Payloads are held against their digests.

    Only records in segments are shuffled, by their origin: a group is the
    segments of one page.
    """
    parts = read_records(spark, path)
    segment = F.struct("number", "total", "block")
    of_page = ("type", "page_id", "url", "digest", "refers_to")
    whole = parts.where("number is null").select(*of_page, F.array(segment).alias("segments"))
    first = F.min_by(F.struct(*of_page), "number").alias("first")
    cut_up = parts.where("number is not null").groupBy("origin").agg(first, F.collect_list(segment).alias("segments"))
    pages = whole.unionByName(cut_up.select("first.*", "segments"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _PAGE.split(", ")]
        types = [_KINDS[x.split()[1]] for x in _PAGE.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for row in batch.slice(at, 256).to_pylist():
                    segments = [(s["number"] or 1, s["total"], s["block"]) for s in row["segments"]]
                    rows.append(_page(row, reassemble(segments)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return pages.mapInArrow(run, _PAGE)


def round_trip(pages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """What is read back of the archives that ``pages`` (page_id, url, html) are written to.

    Null html is an empty payload, and null urls and page_ids come back null.
    Payloads of any length are archived whole, in segments. Repeated rows are
    archived each; those with the largest page_id of their payload are
    responses. No rows give no rows. Other columns are ignored, whatever their names.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages.select(F.col("page_id").cast("long"), "url", "html"), path, segment)
    remove_at_exit(spark, path)
    return read(spark, path)


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), o AS (
  SELECT html, max(page_id) AS original FROM p WHERE n >= 1000 GROUP BY html
)
SELECT p.page_id, p.n::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN p.page_id < o.original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id < o.original THEN o.original END AS refers_to
FROM p LEFT JOIN o ON p.html = o.html
"""
