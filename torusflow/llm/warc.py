"""Legacy archive converter: ARC records become WARC records (operator 9).

``parse_arc`` reads ARC files of version 1 and 2 by the field line of their version
block and by declared lengths. ``to_warc`` makes an equivalent WARC record: identifier,
timestamp, type and digests; the version block itself becomes a ``warcinfo`` record.
``arc_records`` does so for a folder of ARC files. Blocks are bytes throughout.

``convert`` does this for a table of pages: each page as an ARC record, converted,
written to WARC files in the shared folder through Spark's own writer (which commits
whole files only), then read back record by record. Every record is a gzip member of its
own. Between members stands an empty one, valid gzip by itself, at which Spark's reader
splits the files, so that reading back is dealt out by bytes and holds one record at a
time. Of pages with equal payloads of at least 1000 bytes the one with the largest id is
the response and the others are revisits that refer to its record.

Edge cases: null html is an empty payload; a null url is written as ``unknown:``; blanks
and control characters in a url are percent-encoded; a page without an id has a record
like any other, a response unless a page with an id has its payload; rows that repeat a
page id are all written, and those that share the kept id are all responses; pages may be
of any length that Spark holds in a row; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import folder

#: Fixed values of the ARC format: the fields of a record's header line by version.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
MINIMUM = 1000
#: After a record of a WARC file, and between its gzip members: an empty one (fixed, from the format).
END = b"\r\n\r\n"
SPLIT = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
#: Fields of records made here, beside the standard's own, that name the page.
PAGE, REFERS_PAGE = "X-Page", "X-Refers-To-Page"


def plain_url(url: str | None) -> str:
    """A url that fits a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "unknown:"


def write_arc(records, version: int = 1, name: str = "pages.arc") -> bytes:
    """An ARC file of (url, ip, 14-digit date, content type, block) records."""
    block = f"{version} 0 torusflow\n{ARC_FIELDS[version]}\n\n".encode()
    lead = ["filedesc://" + name, "0.0.0.0", "19960101000000", "text/plain"]
    out = []
    for url, ip, date, kind, body in [(*lead, block), *records]:
        more = ["200", "-", "-", "0", name] if version == 2 else []
        out.append(" ".join([url, ip, date, kind, *more, str(len(body))]).encode() + b"\n" + body + b"\n")
    return b"".join(out)


def parse_arc(data: bytes, versions: bool = False):
    """The records of an ARC file as dicts of header fields and the block; the version block
    gives the fields, and is a record itself if versions are asked for."""
    at, fields = 0, ARC_FIELDS[1].split(" ")
    while at < len(data):
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        if not line:  # between records
            at = end + 1
            continue
        size = int(line.rsplit(" ", 1)[1])
        block = data[end + 1 : end + 1 + size]
        if len(block) < size:
            raise ValueError("an ARC record is cut short")
        at = end + 1 + size
        if line.startswith("filedesc://"):
            info = {"URL": line.rsplit(" ", 4)[0], "IP-address": "0.0.0.0", "Archive-date": line.rsplit(" ", 3)[1], "Content-type": "text/plain", "block": block}
            lines = block.decode("utf-8", "replace").split("\n")
            version = int(lines[0].split(" ")[0])
            fields = lines[1].strip().split(" ")
            if version not in ARC_FIELDS or len(fields) < 5:
                raise ValueError(f"ARC version {lines[0]!r} isn't known")
            if versions:
                yield info
            continue
        values = line.rsplit(" ", len(fields) - 1)  # only a url can hold a blank
        if len(values) != len(fields):
            raise ValueError(f"an ARC header with {len(values)} of {len(fields)} fields")
        yield dict(zip(fields, values)) | {"block": block}


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP header."""
    head, found, body = block.partition(b"\r\n\r\n")
    return body if found and head.startswith(b"HTTP/") else block


def iso_date(digits: str) -> str:
    """A WARC date of ARC's 14 digits; shorter ones are filled up."""
    d = digits + "00000101000000"[len(digits) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, digest: str, extra: str = "") -> str:
    """The same identifier each time the same record is converted."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join([url, date, digest, extra]))}>"


def to_warc(arc: dict, page: int | None = None, refers_to: tuple | None = None) -> bytes:
    """A WARC record with what ends it. refers_to: the page, identifier, url and date that it revisits."""
    block = arc["block"]
    date = iso_date(arc["Archive-date"])
    base32 = lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode()
    if arc["URL"].startswith("filedesc://"):
        head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(arc["URL"], date, base32(block))), ("WARC-Date", date), ("WARC-Filename", arc["URL"][11:]), ("Content-Type", "text/plain")]
    else:
        payload = payload_of(block)
        digest = hashlib.sha1(payload).hexdigest()
        head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(arc["URL"], date, digest, str(page))), ("WARC-Date", date), ("WARC-Target-URI", arc["URL"]), ("WARC-IP-Address", arc["IP-address"]), ("WARC-Payload-Digest", f"sha1:{base32(payload)}")]
        if not block.startswith(b"HTTP/"):
            head[0] = ("WARC-Type", "resource")  # no protocol's response is in the block
        if page is not None:
            head += [(PAGE, str(page))]
        head += [("X-Payload-Length", str(len(payload)))]
        if refers_to is not None:
            head += [("WARC-Profile", REVISIT), ("WARC-Refers-To", refers_to[1]), ("WARC-Refers-To-Target-URI", refers_to[2]), ("WARC-Refers-To-Date", refers_to[3]), (REFERS_PAGE, str(refers_to[0]))]
            block = block[: len(block) - len(payload)]
        head += [("Content-Type", "application/http; msgtype=response" if block.startswith(b"HTTP/") else arc["Content-type"])]
    head += [("WARC-Block-Digest", f"sha1:{base32(block)}"), ("Content-Length", str(len(block)))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head), "\r\n"]).encode() + block + END


def member(record: bytes) -> bytes:
    """The record as one gzip member that doesn't hold what splits files."""
    for level in (6, 1, 9, 0):
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        out = packer.compress(record) + packer.flush()
        if SPLIT not in out:
            return out
    raise ValueError("a record that can't be packed")


def unpacked(data: bytes) -> bytes:
    """The bytes of all members of a gzip file."""
    parts = []
    while data:
        one = zlib.decompressobj(31)
        parts.append(one.decompress(data) + one.flush())
        data = one.unused_data
    return b"".join(parts)


def read_warc(data: bytes):
    """The records of a WARC file as (headers by lower-case name, block)."""
    if data[:2] == b"\x1f\x8b":
        data = unpacked(data)
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/1.", at):
            raise ValueError("a WARC record doesn't begin where the last one ended")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(head["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError("a WARC record is cut short")
        yield head, block
        at = end + 4 + size + 4


def page_arc(page: int | None, url: str | None) -> tuple[str, str]:
    """The url and date of a page's ARC record."""
    n = page or 0
    return plain_url(url), f"2000{n % 12 + 1:02d}{n % 28 + 1:02d}{n % 24:02d}{n % 60:02d}00"


def kinds(pages: DataFrame, *, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page_id, url, html, digest, and keep: page_id and url of the page with the same payload that stays, or null.

    Only digests that occur more than once are joined back, and Spark can split that join;
    small pages have a key of their own each.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    large = F.octet_length("html") >= MINIMUM
    found = rows.where(large & F.col("page_id").isNotNull()).groupBy(F.sha1("html").alias("digest")).agg(F.max(F.struct("page_id", "url")).alias("keep"))
    again = rows.where(large).groupBy(F.sha1("html").alias("digest")).agg(F.count("*").alias("n")).where("n > 1").select("digest")
    named = rows.withColumn("digest", F.when(large, F.sha1("html")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))))
    return named.join(found.join(again, "digest", "left_semi"), "digest", "left")


def archived(pages: DataFrame, *, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """A WARC record for each page, packed, and first of each task's the warcinfo of its ARC file."""
    rows = kinds(pages, id_col=id_col, url_col=url_col, html_col=html_col).select("page_id", "url", "html", "keep.page_id", F.col("keep.url").alias("keep_url")).toDF("page_id", "url", "html", "keep", "keep_url")

    def archive(batches):
        first = True
        for batch in batches:
            out = []
            for page, url, html, keep, keep_url in zip(*(batch.column(i) for i in range(5))):
                page, keep = page.as_py(), keep.as_py()
                body = HTTP + html.as_py().encode()
                at, date = page_arc(page, url.as_py())
                refers = None
                if keep is not None and (page is None or keep > page):
                    there, then = page_arc(keep, keep_url.as_py())
                    digest = hashlib.sha1(payload_of(body)).hexdigest()
                    refers = keep, record_id(there, iso_date(then), digest, str(keep)), there, iso_date(then)
                # ARC has no ids: the page's number is carried beside the record.
                arc = write_arc([(at, "192.0.2.1", date, "text/html", body)], version=1 + (page or 0) % 2)
                for record in parse_arc(arc, versions=first):
                    out.append(member(to_warc(record, page, refers)))
                first = False
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    return rows.mapInArrow(archive, "value binary")


def write(records: DataFrame, path: str) -> None:
    """Packed records (value) as WARC files. Bytes pass Spark's text writer as they are."""
    records.select(F.col("value").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", SPLIT.decode("latin-1")).text(path)


def convert(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, refers_to_id, date, uri; read from the archives."""
    spark = pages.sparkSession
    path = folder(spark, "warc")
    write(archived(pages, id_col=id_col, url_col=url_col, html_col=html_col), path)
    return read(spark, path).where("record_type <> 'warcinfo'")


def read(spark, path: str) -> DataFrame:
    """The records of all WARC files under a path that ``write`` made, their digests checked."""
    packed = spark.read.option("encoding", "ISO-8859-1").option("lineSep", SPLIT.decode("latin-1")).text(path).select(F.col("value").cast("binary"))
    sha = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    number = lambda x: None if x is None else int(x)

    def back(batches):
        for batch in batches:
            rows = []
            for value in batch.column(0):
                for head, block in read_warc(value.as_py()):
                    if sha(block) != head["warc-block-digest"]:
                        raise ValueError("a block differs from its digest")
                    if head["warc-type"] in ("response", "resource"):
                        payload = payload_of(block)
                        if sha(payload) != head["warc-payload-digest"] or len(payload) != int(head["x-payload-length"]):
                            raise ValueError("a payload differs from its digest")
                    digest = head.get("warc-payload-digest")
                    digest = digest and base64.b32decode(digest.partition(":")[2]).hex()
                    rows.append((number(head.get(PAGE.lower())), number(head.get("x-payload-length")), digest, head["warc-type"], number(head.get(REFERS_PAGE.lower())), head["warc-record-id"], head.get("warc-refers-to"), head["warc-date"], head.get("warc-target-uri")))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(FIELDS)], [n for n, _ in FIELDS])

    return packed.mapInArrow(back, ", ".join(f"{n} {'long' if k == pa.int64() else 'string'}" for n, k in FIELDS))


FIELDS = [(n, pa.int64() if n in ("page_id", "payload_bytes", "refers_to") else pa.string()) for n in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "refers_to_id", "date", "uri")]


def arc_records(spark, path: str) -> DataFrame:
    """The records of a folder of ARC files, converted and packed as ``write`` takes them. A
    task holds one ARC file (these are cut at some 100 MB as a rule; Spark's reader takes 2 GB)."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def work(batches):
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                if data[:2] == b"\x1f\x8b":
                    data = unpacked(data)
                for record in parse_arc(data, versions=True):
                    yield pa.RecordBatch.from_arrays([pa.array([member(to_warc(record))], pa.binary())], ["value"])

    return files.mapInArrow(work, "value binary")


def op9(spark, sf_dir: str) -> DataFrame:
    return convert(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), k AS (
  SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
         CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS keep
  FROM p
), r AS (SELECT *, keep IS NOT NULL AND (page_id IS NULL OR keep > page_id) AS again FROM k)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN keep END AS refers_to
FROM r
"""
