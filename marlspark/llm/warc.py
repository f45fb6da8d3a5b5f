"""WARC archives: segmented writer, and a reader that reassembles the segments.

Writing: each page is one record; equal payloads are stored once, at the largest
page_id, and the others become revisit records that refer to it. The HTTP body
is framed as chunked transfer coding. A block longer than ``segment_bytes`` is
cut: the first record has WARC-Segment-Number 1, the rest are continuation
records that name the first as WARC-Segment-Origin-ID; the last one states
WARC-Segment-Total-Length. Archives are written by Spark's own text sink, one
record a row, so commits survive lost tasks and any Hadoop file system will do:
every record ends with CRLF CRLF, of which the sink adds the second as the line
separator.

Reading: archives are parsed record by record by their Content-Length. Records
of several segments are grouped by origin, ordered by segment number, checked to
be complete and of the stated total length, joined, and dechunked.

Defined cases: a null html is the empty payload, and equals other empty ones.
Repeated page rows (same page_id) give a record each; if their payloads are
equal too, all of them count as that payload's response. An empty table writes
and returns nothing. A null page_id is kept as null and is never the response
unless no equal payload has an identifier.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import delete, scratch, written

CRLF = b"\r\n"
VERSION = b"WARC/1.1"
DIGEST = b"sha1:"
#: Up to so many repeated payloads (about 8 MB) their tags are broadcast; beyond, they are joined by a shuffle.
BROADCAST_TAGS = 100_000


def record_id(page_id: int | None, sha1: bytes) -> bytes:
    """Names page and payload, so that a revisit can name its response without a look at it."""
    return b"<urn:page:%s:%s>" % (b"null" if page_id is None else b"%d" % page_id, sha1.hex()[:16].encode())


def page_of(identifier: bytes) -> int | None:
    inner = identifier.removeprefix(b"<urn:page:").partition(b":")[0]
    return None if inner == b"null" else int(inner)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = 8192) -> bytes:
    """The payload in chunked transfer framing."""
    out = [b"%x\r\n%s\r\n" % (len(part := payload[i : i + size]), part) for i in range(0, len(payload), size)]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """Undoes ``chunked``; chunk extensions and trailers are allowed. Raises ValueError on bad framing."""
    out, at = [], 0
    while True:
        end = body.index(CRLF, at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != CRLF:
            raise ValueError("chunk without its end")
        out.append(body[at : at + size])
        at += size + 2


def _record(headers: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    """The record's bytes but for the last CRLF, which the sink writes."""
    lines = [VERSION, *(b"%s: %s" % h for h in headers), b"Content-Length: %d" % len(block)]
    return CRLF.join([*lines, b"", block]) + CRLF


def records(page_id: int | None, url: str | None, payload: bytes, keep: int | None, revisit: bool, segment_bytes: int) -> Iterator[bytes]:
    """The WARC records of one page: one, or its segments in order."""
    sha1 = hashlib.sha1(payload).digest()
    own, digest = record_id(page_id, sha1), DIGEST + base64.b32encode(sha1)
    target = (url or "").encode().replace(b"\r", b"%0D").replace(b"\n", b"%0A")
    common = [(b"WARC-Target-URI", target), (b"WARC-Date", b"2000-01-01T00:00:00Z"), (b"WARC-Payload-Digest", digest), (b"Content-Type", b"application/http;msgtype=response")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if revisit:
        profile = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield _record([(b"WARC-Type", b"revisit"), (b"WARC-Record-ID", own), (b"WARC-Refers-To", record_id(keep, sha1)), (b"WARC-Profile", profile), *common], head)
        return
    block = head + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        yield _record([(b"WARC-Type", b"response"), (b"WARC-Record-ID", own), *common], block)
        return
    yield _record([(b"WARC-Type", b"response"), (b"WARC-Record-ID", own), (b"WARC-Segment-Number", b"1"), *common], parts[0])
    for n, part in enumerate(parts[1:], 2):
        total = [(b"WARC-Segment-Total-Length", b"%d" % len(block))] if n == len(parts) else []
        yield _record([(b"WARC-Type", b"continuation"), (b"WARC-Record-ID", own[:-1] + b":%d>" % n), (b"WARC-Segment-Origin-ID", own), (b"WARC-Segment-Number", b"%d" % n), *total], part)


def inflated(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The archive's bytes in parts of ``step`` at most, through all members if it is compressed. Raises ValueError if a member breaks off."""
    if content[:2] != b"\x1f\x8b":
        yield from (content[i : i + step] for i in range(0, len(content), step))
        return
    inflater = zlib.decompressobj(31)
    for i in range(0, len(content), 1 << 16):
        data = content[i : i + (1 << 16)]
        while data:
            if inflater.eof:
                data = data.lstrip(b"\0")
                if not data:
                    break
                inflater = zlib.decompressobj(31)
            if out := inflater.decompress(data, step):
                yield out
            data = inflater.unused_data if inflater.eof else inflater.unconsumed_tail
    if out := inflater.flush():
        yield out
    if not inflater.eof:
        raise ValueError("the compressed archive breaks off")


def parse(parts: Iterable[bytes]) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """(headers by lower-case name, block) of each record of an archive that comes in parts; one record is held at a time. Raises ValueError if the bytes are no archive."""
    held, source, ended = bytearray(), iter(parts), False

    def more() -> bool:
        nonlocal ended
        part = next(source, None)
        ended = part is None
        held.extend(part or b"")
        return not ended

    while held or more():
        at = 0
        while (end := held.find(CRLF + CRLF, max(0, at - 3))) < 0:
            at = len(held)
            if not more():
                raise ValueError("a record's headers do not end")
        first, *lines = bytes(held[:end]).split(CRLF)
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record where {bytes(first[:40])!r} stands")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines)}
        size = int(headers[b"content-length"])
        begin = end + 4
        while len(held) < begin + size + 4 and more():
            pass
        if held[begin + size : begin + size + 4] != CRLF + CRLF:
            raise ValueError(f"record of {size} bytes without its end")
        yield headers, bytes(held[begin : begin + size])
        del held[: begin + size + 4]


def write(pages: DataFrame, path: str, segment_bytes: int = 32 << 10) -> None:
    """Writes ``pages(page_id, url, html)`` as gzip-compressed archives below ``path``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html")).withColumn("digest", F.sha2("html", 256))
    # pre-aggregated by payload before the shuffle; only payloads that occur again need a tag
    again = rows.groupBy("digest").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "keep")
    again = written(again, "warc-tags")
    again = F.broadcast(again) if again.limit(BROADCAST_TAGS + 1).count() <= BROADCAST_TAGS else again
    tagged = rows.join(again, "digest", "left").select("page_id", "url", "html", "keep", F.coalesce(~F.col("page_id").eqNullSafe(F.col("keep")) & F.col("keep").isNotNull(), F.lit(False)).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [r for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True) for r in records(*row, segment_bytes)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    # the sink writes the string's bytes as they are
    tagged.mapInArrow(run, "record binary").select(F.col("record").cast("string")).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", 4096).mode("overwrite").text(path)


def payload_of(block: bytes) -> bytes:
    """The HTTP response's body, dechunked if it is framed so."""
    head, _, body = block.partition(CRLF + CRLF)
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def distinct(segments: list[tuple[int, int | None, bytes]], origin: str = "") -> list[tuple[int, int | None, bytes]]:
    """The segments without equal copies. Raises ValueError if two that differ have one number."""
    found: dict[int, tuple] = {}
    for s in segments:
        if found.setdefault(s[0], s) != s:
            raise ValueError(f"{origin}: two different segments {s[0]}")
    return list(found.values())


def joined(segments: list[tuple[int, int | None, bytes]], origin: str = "") -> bytes:
    """The block of (segment number, total length, part) rows in any order. Raises ValueError unless all are there."""
    ordered = sorted(segments, key=lambda s: s[0])
    if [s[0] for s in ordered] != list(range(1, len(ordered) + 1)):
        raise ValueError(f"{origin}: segments {[s[0] for s in ordered]}")
    block = b"".join(s[2] for s in ordered)
    if ordered[-1][1] is None or ordered[-1][1] != len(block):
        raise ValueError(f"{origin}: {len(block)} bytes of {ordered[-1][1]}")
    return block


_RECORD = "page_id long, url string, record_type string, refers_to long, declared string, payload binary"
_PART = f"{_RECORD}, origin string, segment int, total long"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True) if rows else [[]] * len(fields), fields, strict=True)], schema=pa.schema(fields))


def _checked(declared: str | None, payload: bytes, origin: str) -> bytes:
    if declared is not None and declared != digest_of(payload):
        raise ValueError(f"{origin}: the payload differs from its digest")
    return payload


def _parts(spark: SparkSession, path: str) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                out, held = [], 0
                for h, block in parse(inflated(content)):
                    kind, number = h[b"warc-type"].decode(), h.get(b"warc-segment-number")
                    origin = h.get(b"warc-segment-origin-id", h[b"warc-record-id"])
                    refers = page_of(h[b"warc-refers-to"]) if b"warc-refers-to" in h else None
                    declared = h.get(b"warc-payload-digest", b"").removeprefix(DIGEST).decode() or None
                    total = h.get(b"warc-segment-total-length")
                    body = None if kind == "revisit" else block if number else _checked(declared, payload_of(block), origin.decode())
                    out.append((page_of(origin), h.get(b"warc-target-uri", b"").decode(), kind, refers, declared, body, origin.decode(), number and int(number), total and int(total)))
                    held += len(block)
                    if held > 16 << 20:
                        yield _batch(out, _PART)
                        out, held = [], 0
                if out:
                    yield _batch(out, _PART)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, _PART)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Each record of the archives below ``path``, reassembled: page_id, url, record_type, refers_to, declared digest, payload.

    A revisit has a null payload. Raises ValueError in the tasks if a segment is
    missing, a length is wrong or a payload differs from its declared digest.
    Equal copies of a segmented record come back as that many rows.
    """
    found = _parts(spark, path)
    # only the segments are shuffled; a group is one record
    parts = found.filter("segment is not null").groupBy("origin").agg(F.collect_list(F.struct("page_id", "url", "record_type", "declared", "segment", "total", "payload")).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for origin, rows in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                heads = [r for r in rows if r["segment"] == 1]
                if not heads:
                    raise ValueError(f"{origin}: its first segment is missing")
                block = joined(distinct([(r["segment"], r["total"], r["payload"]) for r in rows], origin), origin)
                payload = _checked(heads[0]["declared"], payload_of(block), origin)
                out += [(r["page_id"], r["url"], r["record_type"], None, r["declared"], payload) for r in heads]
            yield _batch(out, _RECORD)

    return found.filter("segment is null").drop("origin", "segment", "total").unionByName(parts.mapInArrow(join, _RECORD))


def round_trip(pages: DataFrame, segment_bytes: int = 32 << 10) -> DataFrame:
    """Writes ``pages`` as archives, reads them back, and describes each page's record.

    Columns: page_id, payload_bytes, payload_digest (bare base32 SHA-1),
    record_type, refers_to. A revisit gets both payload columns from the response
    it refers to, whose digest must be the one that the revisit declares.
    """
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write(pages, path, segment_bytes)
    # without the payloads the records are small: one pass over the archives
    found = written(read(spark, path).select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.col("declared").alias("payload_digest"), "record_type", "refers_to"), "warc-index")
    delete(spark, path)
    response = found.filter("record_type = 'response'")
    kept = response.select(F.col("page_id").alias("to"), F.col("payload_digest").alias("of"), F.col("payload_bytes").alias("bytes")).distinct()
    revisit = found.filter("record_type = 'revisit'").join(kept, (F.col("refers_to") == F.col("to")) & (F.col("payload_digest") == F.col("of")), "left")
    lost = F.raise_error(F.concat(F.lit("no response for the revisit of page "), F.col("page_id").cast("string"))).cast("long")
    return response.unionByName(revisit.select("page_id", F.coalesce("bytes", lost).alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))


#: ``round_trip`` for DuckDB over ``pages``: base32 from the hexadecimal digest, five digits (four letters) at a time.
SQL = """
with p as (select page_id, coalesce(html, '') h from pages),
k as (select h, max(page_id) keep from p group by h),
d as (select page_id, octet_length(encode(p.h))::bigint payload_bytes, sha1(p.h) x, keep from p join k using (h))
select page_id, payload_bytes,
  list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, 1 + 5 * i::int, 5))::int >> s::int) & 31) + 1, 1)), 'string_agg', '')), 'string_agg', '') payload_digest,
  case when page_id = keep or keep is null then 'response' else 'revisit' end record_type,
  case when page_id <> keep or (page_id is null and keep is not null) then keep end refers_to
from d"""
