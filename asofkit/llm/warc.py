"""Conversion of legacy ARC archives to WARC.

An ARC file starts with a version block, whose second line tells the version and whose third names the fields
of the header lines; each record is a header line with a declared length, and as many bytes of network document.
Version 1 lines have five fields, version 2 lines ten. The converter parses them and synthesises WARC
records: ids as name-based UUIDs, dates from the 14 digits, types from schemes and content types, SHA-1 digests of
blocks and payloads. Records whose payload equals that of another become revisits of the one with the largest key.

Archives are written by Spark's text writer with the record separator of the format as its line separator, so
that they are committed like any Spark output, to any file system, and read as whole files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofkit.llm.common import bounded_batches, releasing, saved, small

V1_FIELDS = "URL IP-address Archive-date Content-type Archive-length"
V2_FIELDS = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
KEY_HEADER = b"X-Archive-Key"
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:x-arc-to-warc")
#: Digests that repeat, with at most so many rows, are broadcast; beyond, records are joined with them by a shuffle.
BROADCAST_DIGESTS = 200_000
_unsafe = re.compile(r"[\x00-\x20\x7f]")


class ArcRecord(NamedTuple):
    version: int
    fields: dict[str, str]
    block: bytes


class WarcRecord(NamedTuple):
    headers: dict[str, str]
    block: bytes


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _unzipped(data: bytes) -> io.BufferedIOBase:
    return gzip.open(io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)


# ---------------------------------------------------------------- ARC


def arc_head(name: str, date: str, version: int) -> bytes:
    """The version block that starts a file, without the line feed after it."""
    body = f"{version} 0 converter\n{V1_FIELDS if version == 1 else V2_FIELDS}\n".encode()
    extra = "" if version == 1 else "200 - - 0 "
    tail = f"{name} " if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {extra}{tail}{len(body)}\n".encode() + body


def arc_record(version: int, url: str, ip: str, date: str, kind: str, block: bytes, code: int = 200, offset: int = 0, name: str = "-") -> bytes:
    """A record, without the line feed after it."""
    middle = "" if version == 1 else f"{code} - - {offset} {name} "
    return f"{url} {ip} {date} {kind} {middle}{len(block)}\n".encode() + block


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, the version block not among them; one record is held at a time.

    Raises ValueError for a header line that doesn't fit the version, and for a declared length beyond the file.
    """
    stream, version, names = _unzipped(data), 0, []
    while line := stream.readline():
        if line in (b"\n", b"\r\n"):
            continue
        parts = line.decode("utf-8", "surrogateescape").rstrip("\r\n").split(" ")
        if not parts[-1].isdigit():
            raise ValueError(f"not an ARC header line: {line[:200]!r}")
        body = stream.read(int(parts[-1]))
        if len(body) < int(parts[-1]):
            raise ValueError(f"the file ends inside a record: {line[:200]!r}")
        if parts[0].startswith("filedesc:"):
            first, second = body.decode().split("\n")[:2]
            version, names = int(first.split()[0]), second.split()
            if version not in (1, 2):
                raise ValueError(f"unknown ARC version {version}")
            continue
        if not version or len(parts) != len(names):
            raise ValueError(f"{len(parts)} fields where version {version} has {len(names)}: {line[:200]!r}")
        yield ArcRecord(version, dict(zip(names, parts)), body)


def http_payload(block: bytes) -> tuple[bytes, bytes]:
    """The head of an HTTP response, with the empty line that ends it, and its body."""
    at = block.find(b"\r\n\r\n")
    return (block[: at + 4], block[at + 4 :]) if block.startswith(b"HTTP/") and at >= 0 else (b"", block)


def head_field(head: bytes, name: bytes) -> str | None:
    m = re.search(rb"(?mi)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode() if m else None


# ---------------------------------------------------------------- WARC


def warc_record(headers: dict[str, str], block: bytes) -> bytes:
    """A record, without the two line ends after it."""
    return "".join(["WARC/1.0\r\n", *(f"{k}: {v}\r\n" for k, v in headers.items()), f"Content-Length: {len(block)}\r\n\r\n"]).encode("utf-8", "surrogateescape") + block


def read_warc(data: bytes) -> Iterator[WarcRecord]:
    stream = _unzipped(data)
    while line := stream.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a WARC record: {line[:100]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            headers[name] = value.strip()
        block = stream.read(int(headers["Content-Length"]))
        if len(block) < int(headers["Content-Length"]):
            raise ValueError("the file ends inside a record")
        yield WarcRecord(headers, block)


def warc_date(date: str) -> str:
    """ISO 8601 for the digits of an ARC date, of which 14 are the full form; missing ones are filled from the start of the era."""
    d = (date + "19700101000000"[len(date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_type(url: str, kind: str, block: bytes) -> str:
    if url.startswith("dns:") or kind == "text/dns":
        return "resource"
    return "response" if block.startswith(b"HTTP/") else "resource"


def record_id(url: str, date: str, key: str | None, sha: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{url} {date} {key} {sha}')}>"


def convert(record: ArcRecord, refers: tuple[str, str, str] | None = None) -> bytes:
    """The WARC record for *record*; with *refers*, the id, key and date of an equal one, a revisit that keeps only the HTTP head."""
    f = record.fields
    head, body = http_payload(record.block)
    sha, key, url, date = digest(body), head_field(head, KEY_HEADER), f["URL"], f["Archive-date"]
    headers = {"WARC-Type": warc_type(url, f["Content-type"], record.block), "WARC-Record-ID": record_id(url, date, key, sha), "WARC-Date": warc_date(date), "WARC-Target-URI": url}
    if f["IP-address"] not in ("-", "0.0.0.0"):
        headers["WARC-IP-Address"] = f["IP-address"]
    headers["WARC-Payload-Digest"] = f"sha1:{sha}"
    block = record.block
    if refers:
        headers |= {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", "WARC-Refers-To": refers[0], "WARC-Refers-To-Date": refers[2], "WARC-Truncated": "length", "X-Refers-To-Key": refers[1]}
        block = head
    headers["WARC-Block-Digest"] = f"sha1:{digest(block)}"
    headers["X-Payload-Length"] = str(len(body))
    headers["Content-Type"] = "application/http; msgtype=response" if head else f["Content-type"]
    return warc_record(headers, block)


# ---------------------------------------------------------------- over Spark


def _write(df: DataFrame, path: str, separator: str, compression: str) -> None:
    df.select(F.col("record").cast("string").alias("value")).write.option("lineSep", separator).option("compression", compression).option("zlib.compress.level", "BEST_SPEED").text(path)


def write_arc(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", html: str = "html", date: str = "20240101000000", compression: str = "gzip") -> None:
    """Writes pages as ARC files, one for each task, versions 1 and 2 in turn.

    A block is an HTTP response whose head names the key; a null html is an empty body, a null url and white space in one
    are made safe. Rows with a null key have none in the head.
    """

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, started, at = TaskContext.get().partitionId(), False, 0
        version, name = 1 + task % 2, f"pages-{task:06d}.arc"
        for batch in batches:
            out = []
            if not started and len(batch):
                out.append(arc_head(name, date, version))
                at, started = len(out[0]) + 1, True
            for k, u, h in zip(batch["k"], batch["u"], batch["h"]):
                body = (h or "").encode()
                field = b"" if k is None else KEY_HEADER + f": {k}\r\n".encode()
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + field + f"Content-Length: {len(body)}\r\n\r\n".encode() + body
                where = _unsafe.sub(lambda m: f"%{ord(m[0]):02X}", u or "") or "urn:x-no-url"
                out.append(arc_record(version, where, "0.0.0.0", date, "text/html", block, offset=at, name=name))
                at += len(out[-1]) + 1
            yield pd.DataFrame({"record": out})

    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(key).cast("string").alias("k"), F.col(url).cast("string").alias("u"), F.col(html).alias("h"))
    _write(rows.mapInPandas(releasing(records), "record binary"), path, "\n", compression)


def arc_to_warc(spark: SparkSession, arc: str, warc: str, *, least_bytes: int = 0, compression: str = "gzip") -> None:
    """Converts the ARC files under *arc* into WARC files under *warc*, a file for each task.

    Of records with equal payloads of at least *least_bytes* bytes, that with the largest key (then the largest id and place) is the
    response and others are revisits that refer to it. Only digests that repeat are gathered.
    """
    bounded_batches(spark)
    files = spark.read.format("binaryFile").load(arc).select("path", "content")

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"]):
                out = []
                for n, r in enumerate(read_arc(bytes(data))):
                    head, body = http_payload(r.block)
                    if len(body) >= least_bytes:
                        k, sha, date = head_field(head, KEY_HEADER), digest(body), r.fields["Archive-date"]
                        out.append((sha, k, record_id(r.fields["URL"], date, k, sha), date, path, n))
                yield pd.DataFrame(out, columns=["sha", "k", "id", "date", "path", "n"])

    seen = files.mapInPandas(releasing(digests), "sha string, k string, id string, date string, path string, n bigint")
    best = F.max(F.struct(F.col("k").cast("decimal(38,0)").alias("number"), "id", "path", "n", "k", "date"))
    repeats = seen.groupBy("sha").agg(best.alias("b"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    repeats = saved(repeats.select("sha", "b.id", "b.k", "b.date", F.col("b.path").alias("of_path"), F.col("b.n").alias("of_n")), "repeats")

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"]):
                rows, size = [], 0
                for n, r in enumerate(read_arc(bytes(data))):
                    body = http_payload(r.block)[1]
                    rows.append((digest(body) if len(body) >= least_bytes else None, path, n, r.version, list(r.fields.values()), r.block))
                    size += len(r.block)
                    if size > 8_000_000:
                        yield pd.DataFrame(rows, columns=["sha", "path", "n", "version", "fields", "block"])
                        rows, size = [], 0
                yield pd.DataFrame(rows, columns=["sha", "path", "n", "version", "fields", "block"])

    def converted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for version, fields, block, id_, k, date in zip(batch["version"], batch["fields"], batch["block"], batch["id"], batch["k"], batch["date"]):
                r = ArcRecord(version, dict(zip((V1_FIELDS if version == 1 else V2_FIELDS).split(), fields)), bytes(block))
                out.append(convert(r, (id_, k or "", warc_date(date)) if id_ is not None else None))
            yield pd.DataFrame({"record": out})

    records = files.mapInPandas(releasing(parsed), "sha string, path string, n bigint, version int, fields array<string>, block binary")
    hint = F.broadcast(repeats) if small(repeats, BROADCAST_DIGESTS) else repeats
    joined = records.join(hint, "sha", "left").withColumn("id", F.when((F.col("path") != F.col("of_path")) | (F.col("n") != F.col("of_n")), F.col("id")))
    _write(joined.select("version", "fields", "block", "id", "k", "date").mapInPandas(releasing(converted), "record binary"), warc, "\r\n\r\n", compression)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the WARC files under *path*: page_id, record_id, target_uri, date, payload_bytes, payload_digest, record_type, refers_to, payload.

    Blocks and payloads of full records are checked against their digests and lengths; a revisit has a null payload.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["page_id", "record_id", "target_uri", "date", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        for batch in batches:
            for data in batch["content"]:
                out, size = [], 0
                for headers, block in read_warc(bytes(data)):
                    head, body = http_payload(block)
                    sha, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                    if digest(block) != headers["WARC-Block-Digest"].removeprefix("sha1:") or kind != "revisit" and (digest(body) != sha or str(len(body)) != headers["X-Payload-Length"]):
                        raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
                    key = head_field(head, KEY_HEADER)
                    out.append((None if key is None else int(key), headers["WARC-Record-ID"], headers["WARC-Target-URI"], headers["WARC-Date"], int(headers["X-Payload-Length"]), sha, kind, int(k) if (k := headers.get("X-Refers-To-Key")) else None, None if kind == "revisit" else body))
                    size += len(block)
                    if size > 8_000_000:
                        yield _whole(pd.DataFrame(out, columns=columns))
                        out, size = [], 0
                yield _whole(pd.DataFrame(out, columns=columns))

    schema = "page_id bigint, record_id string, target_uri string, date string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(releasing(rows), schema)


def _whole(df: pd.DataFrame) -> pd.DataFrame:
    return df.assign(**{c: pd.array([None if pd.isna(v) else int(v) for v in df[c].astype(object)], dtype="Int64") for c in ("page_id", "refers_to")})
