"""WARC archives: a writer through Spark's text sink and a salvage reader.

The writer makes one record per row: a ``response`` for the largest id of each payload, a
``revisit`` (headers only) for every other row with an equal payload of at least ``LEAST`` bytes.
Every record is one value of a text file whose line separator is the CRLF that ends a record,
so the archives go through Spark's committer to any store.

The reader takes whole archive files, plain or in gzip members of any number of records.  A record counts
only if its version line, headers (of any length), length, end mark and digests hold.  After a failed check it
searches for the next valid member (gzip magic) or version line, goes on there, and logs the bytes
between as a quarantined gap; inside a member, also on what one that fails yields before, it searches
the content.

Defined results: null payloads are empty; null ids are written as ``null`` and read back null; rows that
share the winning id and payload are all responses; control characters in urls are percent-encoded
and a null url has no header; an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillroll.llm.common import field, on_workers, packed, shared_path, staged

LEAST = 0
ARCHIVE_RECORDS = 1000
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_EOL = "\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_GZIP = b"\x1f\x8b\x08"
_START = re.compile(_VERSION.pattern + rb"|" + re.escape(_GZIP))
_NEED = 1 << 16  # compressed bytes that are taken at once


def base32(hexadecimal: Column) -> Column:
    """Bare upper-case base32 of a SHA-1 in hex: each five hex digits are four letters."""
    chunks = F.array(*[F.substring(hexadecimal, 5 * c + 1, 5) for c in range(8)])

    def letters(chunk: Column) -> Column:
        bits = F.conv(chunk, 16, 10).cast("int")
        return F.concat(*[F.substring(F.lit(_ALPHABET), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1))
                          for s in (15, 10, 5, 0)])

    return F.array_join(F.transform(chunks, letters), "")


def _url(url: Column) -> Column:
    for c in ("\r", "\n", "\t", " "):
        url = F.replace(url, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return url


def plan_records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """id, url, payload, payload_bytes, payload_digest, refers_to (null: a response).

    Winners of repeated payloads are found by partial aggregation on the digest and written, so that
    their size is known: a small table is broadcast by Spark's own threshold and the payloads stay
    where they lie; beyond it they are shuffled, and a payload that a third of all rows share is
    split by the adaptive skew join.
    """
    rows = packed(pages).select(field("page_id").cast("long").alias("id"), field("url").cast("string").alias("url"),
                                F.coalesce(field("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn(
        "digest", F.sha1(F.col("payload").cast("binary")))
    shared = (rows.where(F.col("payload_bytes") >= least).groupBy("digest")
              .agg(F.max("id").alias("winner"), F.count("*").alias("n")).where("n > 1"))
    joined = rows.join(staged(shared.select("digest", "winner"), "payload-winners"), "digest", "left")
    revisit = F.col("winner").isNotNull() & (F.col("payload_bytes") >= least) & ~F.col("id").eqNullSafe(F.col("winner"))
    return joined.select("id", "url", "payload", "payload_bytes",
                         base32(F.col("digest")).alias("payload_digest"),
                         F.when(revisit, F.col("winner")).alias("refers_to"))


def write_warc(pages: DataFrame, path: str, least: int = LEAST, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write the archives of ``pages`` (page_id, url, html) under ``path``, in files of at most
    ``ARCHIVE_RECORDS`` records.  ``date``: when the pages were fetched."""
    records = plan_records(pages, least)
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    response = F.col("refers_to").isNull()
    block = F.when(response, F.concat(F.lit(_HTTP), "payload")).otherwise(F.lit(_HTTP))
    header = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit(_EOL))
    maybe = lambda key, value: F.coalesce(header(key, value), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1" + _EOL),
        header("WARC-Type", F.when(response, "response").otherwise("revisit")),
        header("WARC-Record-ID", name(F.col("id"))),
        F.lit(f"WARC-Date: {date}{_EOL}"),
        maybe("WARC-Target-URI", _url(F.col("url"))),
        maybe("WARC-Refers-To", F.when(~response, name(F.col("refers_to")))),
        F.when(~response, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + _EOL))
        .otherwise(""),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        header("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32(F.col("block_sha1")))),
        header("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.lit("Content-Type: application/http;msgtype=response" + _EOL),
        header("Content-Length", F.octet_length("block").cast("string")), F.lit(_EOL))
    (records.withColumn("block", block).withColumn("block_sha1", F.sha1(F.col("block").cast("binary"))).select(F.concat(head, "block", F.lit(_EOL)).alias("value"))
     .write.option("lineSep", _EOL).option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path))


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _header_block(data: bytes, place: int) -> tuple[int, str, dict]:
    """Where the header lines from ``place`` on stop (at an empty line, or at a line that is none and
    why it is none), and key -> (place, value) of the last line with each key."""
    last = {}
    while (stop := data.find(b"\r\n", place)) != place:
        if stop < 0:
            return place, "headers do not end", last
        if (colon := data.find(b":", place, stop)) < 0:
            return place, "bad header line", last
        key, value = data[place:colon], data[colon + 1:stop]
        last[key.strip().lower().decode("latin-1")] = place, value.strip().decode("utf-8", "replace")
        place = stop + 2
    return place, "", last


def parse_record(data: bytes, at: int, blocks: list | None = None) -> tuple[dict, int] | str:
    """(headers with ``payload``, end) of the record at ``at``, or why it is not valid.

    ``blocks`` keeps the latest header block of ``data`` between calls: a version line found inside it
    has the rest of its lines, so no line is read twice however many version lines it holds."""
    version = _VERSION.match(data, at)
    if not version:
        return "no version line"
    blocks = [] if blocks is None else blocks
    if not (blocks and blocks[0][0] <= version.end() <= blocks[0][1][0]):
        blocks[:] = [(version.end(), _header_block(data, version.end()))]
    top, reason, last = blocks[0][1]
    if reason:
        return reason
    if any(last.get(key, (-1,))[0] < at for key in ("warc-type", "warc-record-id")):
        return "no type or id"
    headers = {key: value for key, (place, value) in last.items() if place > at}
    if not headers.get("warc-type") or not headers.get("warc-record-id"):
        return "no type or id"
    if not headers.get("content-length", "").isdecimal():
        return "bad length"
    begin = top + 2
    end = begin + int(headers["content-length"])
    if data[end:end + 4] != b"\r\n\r\n":
        return "no end mark where the length says"
    block = data[begin:end]
    if headers.get("warc-block-digest", "sha1:").removeprefix("sha1:") not in ("", _digest(block)):
        return "block digest differs"
    _, _, payload = block.partition(b"\r\n\r\n")
    if headers.get("warc-type") == "response":
        if headers.get("warc-payload-digest", "sha1:").removeprefix("sha1:") not in ("", _digest(payload)):
            return "payload digest differs"
        headers["payload"] = payload
    return headers, end + 4


def _member(data: bytes, at: int) -> tuple[bytes, int, str]:
    """Content and end of the gzip member at ``at``; of one that fails its CRC or length, or does not
    end, what it yields before, how far it was read, and why it fails."""
    unzip, out, place = zlib.decompressobj(31), [], at
    try:
        while place < len(data) and not unzip.eof:
            out.append(unzip.decompress(data[place:place + _NEED]))
            place += _NEED
    except zlib.error as e:
        unzip = zlib.decompressobj(31)  # again, and the last bytes one by one
        out = [unzip.decompress(data[at:place])]
        try:
            for i in range(place, place + _NEED):
                out.append(unzip.decompress(data[i:i + 1]))
        except zlib.error:
            pass
        return b"".join(out), min(place + _NEED, len(data)), f"bad member: {e}"
    end = min(place, len(data)) - len(unzip.unused_data)
    return b"".join(out), end, "" if unzip.eof else "member does not end"


def _inside(content: bytes):
    """('record', headers) and ('gap', reason with its range) of a member's content in order."""
    at, gap, reason, blocks = 0, None, "", []
    while at < len(content):
        one = parse_record(content, at, blocks)
        if isinstance(one, str):
            if gap is None:
                gap, reason = at, one
            ahead = _VERSION.search(content, at + 1)
            at = ahead.start() if ahead else len(content)
            continue
        if gap is not None:
            yield "gap", f"{reason}, in member, bytes {gap} to {at} of its content"
            gap = None
        yield "record", one[0]
        at = one[1]
    if gap is not None:
        yield "gap", f"{reason}, in member, bytes {gap} to {at} of its content"


def _try(data: bytes, at: int, blocks: list) -> tuple[list, int, str]:
    """What starts at ``at`` (see ``_inside``), its end, and, if it is not valid, the reason."""
    if data.startswith(_GZIP, at):
        content, end, reason = _member(data, at)
        found = list(_inside(content))
        if reason:
            return [x for x in found if x[0] == "record"], end, reason
        return found, end, "" if not found or any(x[0] == "record" for x in found) else found[0][1]
    one = parse_record(data, at, blocks)
    return ([], at, one) if isinstance(one, str) else ([("record", one[0])], one[1], "")


def salvage(data: bytes):
    """Yield ('record', start, end, headers) and ('gap', start, end, reason) in file order,
    covering every byte once.  What a member holds has the range of the member; the records of a
    member that fails end where they start, as its bytes are a gap: their digests hold, but nothing
    vouches for their headers any more, as in a plain archive."""
    at, gap, reason, blocks = 0, None, "", []
    told, reach = [], 0  # records of a member that failed; stored ones are met again in its bytes
    while at < len(data):
        found, end, why = _try(data, at, blocks)
        if at < reach and not data.startswith(_GZIP, at) and found and found[0] in told:
            at = end
            continue
        records = [x for x in found if x[0] == "record"]
        if gap is not None and (records or not why):
            yield "gap", gap, at, reason
            gap = None
        if why:
            for kind, what in records:
                yield kind, at, at, what
            if records:
                told, reach = records, end
            if gap is None:
                gap, reason = at, why
            ahead = _START.search(data, at + 1)
            at = ahead.start() if ahead else len(data)
            continue
        for kind, what in found:
            yield kind, at, end, what
        at = end
    if gap is not None:
        yield "gap", gap, len(data), reason


_SCHEMA = ("archive string, kind string, first long, last long, reason string, record_type string, record_id string, "
           "uri string, refers_to string, payload_digest string, payload_bytes long, payload binary")
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]
_BATCH = 16 << 20


def _read(batches):
    def batch(rows):
        types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        kinds = [types[c.split()[1]] for c in _SCHEMA.split(", ")]
        columns = list(zip(*rows)) if rows else [[] for _ in _NAMES]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _NAMES)

    for archives in batches:
        for path, content in zip(archives.column(0).to_pylist(), archives.column(1)):
            rows, size = [], 0
            for kind, first, last, what in salvage(content.as_py()):
                if kind == "gap":
                    rows.append((path, kind, first, last, what, *[None] * 7))
                    continue
                payload = what.get("payload")
                length = what.get("x-payload-length", "")
                rows.append((path, kind, first, last, None, what.get("warc-type"), what.get("warc-record-id"),
                             what.get("warc-target-uri"), what.get("warc-refers-to"),
                             what.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                             len(payload) if payload is not None else int(length) if length.isdecimal() else None, payload))
                size += len(payload or b"")
                if size >= _BATCH:
                    yield batch(rows)
                    rows, size = [], 0
            yield batch(rows)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record and per quarantined gap (``kind``), with the byte range in its archive."""
    on_workers(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0")
    return files.select("path", "content").mapInArrow(_read, _SCHEMA)


def archive_round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write the archives of ``pages`` to the shared folder and read them back."""
    path = shared_path(pages, "warc")
    write_warc(pages, path, least)
    return read_warc(pages.sparkSession, path)


def page_of(record_id: Column) -> Column:
    """The page id in a record id; null for ``null``."""
    return F.regexp_extract(record_id, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
