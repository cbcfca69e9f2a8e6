"""WARC: converter for legacy ARC archives.

An ARC file begins with a version block, whose second line names the version:
version 1 records have the header fields URL, IP, date, type and length,
version 2 records add result code, checksum, location, offset and file name.
The declared length says where a record's block ends. Each record becomes a
WARC record with a synthesised identifier (a name-based UUID), an ISO 8601
timestamp, a type, and block and payload digests (SHA-1 in base 32): the
version block gives warcinfo, an HTTP answer a response, anything else a
resource. Of the responses with equal payloads, the one of least page id stays
a response and the others become revisits that refer to it.

Archives are written by Spark's own writers and read by its binary file source,
so they can live in any store. A file is rolled over when it reaches ``ROLL``
bytes before compression, so what a task holds of one doesn't grow with its
input. Who is a revisit is decided on digests alone. The records that aren't
revisits, by far the most, are written where they are read; a bitmap of fixed
size tells them from those that may be. Only the latter move, to meet what was
decided about them. (A full bitmap would just send all of them that way.)

What can't be read is reported and not passed over in silence: a damaged gzip
member, a header line that doesn't parse, a length that runs past the end each
give a row of ``conversion_errors``; reading goes on at the next gzip member, or
at the next line that is a header whose record fits.

Cases: a null or empty html is an empty payload; a null url is written as
``unknown:``, blanks in a url are percent-encoded; a null page_id stays null and
comes last in the order; equal rows each get their record, the first in file
order being the response; blanks within a content type belong to it; a file
without a version block can't be read at all; an empty table gives archives without records and an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glanage.llm.common import bitmap, mapped, marked, saved, scratch

#: The header fields of each version, as fixed values.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length".split(),
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length".split(),
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_EPOCH = datetime.datetime(2000, 1, 1)
_ID = re.compile(rb"(?i)\r?\nX-Page-Id: (-?[0-9]+)")
#: Bytes of rows that workers hand back at a time.
_BATCH = 4_000_000
#: Uncompressed bytes from which on an archive is closed and the next one begun.
ROLL = 16_000_000


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def unpacked(data: bytes) -> tuple[bytes, list[int]]:
    """The content of a file of one or more gzip members (or the file as it is), and where in it members are damaged."""
    if data[:2] != b"\x1f\x8b":
        return data, []
    out, size, bad, at, step = [], 0, [], 0, 1 << 16
    while 0 <= at < len(data) and data[at : at + 2] == b"\x1f\x8b":
        one, start = zlib.decompressobj(31), at
        try:
            while not one.eof and at < len(data):
                part = one.decompress(data[at : at + step])
                at += min(step, len(data) - at)
                out.append(part)
                size += len(part)
            at -= len(one.unused_data)
            whole = one.eof
        except zlib.error:
            whole = False
        if not whole:
            bad.append(size)
            at = data.find(b"\x1f\x8b\x08", start + 1)
    return b"".join(out), bad


# --- ARC ---------------------------------------------------------------------------------------------------------


def arc_header(version: int, url: str, ip: str, date: str, mime: str, length: int) -> str:
    given = {"URL": url, "IP-address": ip, "Archive-date": date, "Content-type": mime, "Archive-length": str(length), "Result-code": "200", "Offset": "0"}
    return " ".join(given.get(f, "-") for f in ARC_FIELDS[version])


def arc_version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 glanage\n{' '.join(ARC_FIELDS[version])}\n".encode()
    return arc_header(version, f"filedesc://{name}", "0.0.0.0", f"{_EPOCH:%Y%m%d%H%M%S}", "text/plain", len(body)).encode() + b"\n" + body


def arc_record(version: int, page_id: int | None, url: str | None, html: str | None) -> bytes:
    payload = (html or "").encode("utf-8", "surrogatepass")
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    date = _EPOCH + datetime.timedelta(seconds=(page_id or 0) % 10**9)
    clean = re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url or "unknown:") or "unknown:"
    return arc_header(version, clean, "0.0.0.0", f"{date:%Y%m%d%H%M%S}", "text/html", len(block)).encode("utf-8", "surrogatepass") + b"\n" + block


def _header(line: bytes, fields: list[str]) -> list[str] | None:
    """The fields of a header line; blanks too many belong to the content type."""
    parts = line.rstrip(b"\r").decode("utf-8", "replace").split(" ")
    if len(parts) > len(fields):
        rest = len(fields) - 4
        parts = [*parts[:3], " ".join(parts[3 : len(parts) - rest]), *parts[len(parts) - rest :]]
    return parts if len(parts) == len(fields) and parts[-1].isdigit() and parts[2].isdigit() else None


def parse_arc(data: bytes) -> Iterator[dict]:
    """The records of an ARC file: offset, the header fields by name, block, and error where one can't be read."""
    at, fields, lost = 0, None, False
    while at < len(data):
        if data[at : at + 1] == b"\n":  # between records
            at += 1
            continue
        eol = data.find(b"\n", at)
        line = data[at : eol if eol >= 0 else len(data)]
        if fields is None:
            second = data[eol + 1 : data.find(b"\n", eol + 1)].split(b" ") if eol >= 0 else [b""]
            version = int(second[0]) if second[0] in (b"1", b"2") and line.startswith(b"filedesc:") else None
            if version is None:
                yield {"offset": at, "error": "no version block"}
                return
            fields = ARC_FIELDS[version]
            parts = _header(line, fields)
            if parts is None and (short := _header(line, ARC_FIELDS[1])):  # version blocks of either version may have the short header
                parts = short[:4] + ["-"] * (len(fields) - 5) + short[4:]
        else:
            parts = _header(line, fields)
        stop = eol + 1 + int(parts[-1]) if parts else 0
        if eol < 0 or parts is None or stop > len(data):
            if not lost:
                yield {"offset": at, "error": "declared length runs past the end" if parts and eol >= 0 else "bad header line"}
            lost, at = True, eol + 1 if eol >= 0 else len(data)
            continue
        lost = False
        yield {"offset": at, "error": None, "block": data[eol + 1 : stop]} | dict(zip(fields, parts, strict=True))
        at = stop


def timestamp(date: str) -> str:
    """ARC's 14 (or 12) digits as ISO 8601; the epoch if they are no time."""
    try:
        return f"{datetime.datetime.strptime(date.ljust(14, '0')[:14], '%Y%m%d%H%M%S'):%Y-%m-%dT%H:%M:%SZ}"
    except ValueError:
        return "1970-01-01T00:00:00Z"


def converted(record: dict) -> dict:
    """What the equivalent WARC record has: type, id, date, content type, head and payload, digests."""
    block, url = record["block"], record["URL"]
    head, payload = b"", block
    if url.startswith("filedesc:"):
        kind, mime = "warcinfo", "application/warc-fields"
    elif block[:5] == b"HTTP/" and (end := re.search(rb"\r?\n\r?\n", block)):
        kind, mime, head, payload = "response", "application/http; msgtype=response", block[: end.end()], block[end.end() :]
    else:
        kind, mime = "resource", record["Content-type"]
    name = f"{record['offset']} {record['Archive-date']} {url} {sha1(block)}"
    page = _ID.search(head)
    return {
        "type": kind,
        "id": f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}",
        "date": timestamp(record["Archive-date"]),
        "url": url,
        "mime": mime,
        "ip": record["IP-address"],
        "page_id": int(page[1]) if page else None,
        "head": head,
        "payload": payload,
        "digest": sha1(payload),
    }


# --- WARC --------------------------------------------------------------------------------------------------------


def warc_record(r: dict, refers_id: str | None, refers_to: int | None) -> bytes:
    """A record without its last line end, which the writer of lines adds."""
    revisit = refers_id is not None
    block = r["head"] if revisit else r["head"] + r["payload"]
    lines = [
        "WARC/1.0",
        f"WARC-Type: {'revisit' if revisit else r['type']}",
        f"WARC-Record-ID: <{r['id']}>",
        f"WARC-Date: {r['date']}",
        f"Content-Type: {r['mime']}",
        f"Content-Length: {len(block)}",
        f"WARC-Block-Digest: sha1:{sha1(block)}",
    ]
    if r["type"] != "warcinfo":
        lines += [f"WARC-Target-URI: {r['url']}", f"WARC-IP-Address: {r['ip']}", f"WARC-Payload-Digest: sha1:{r['digest']}", f"X-Payload-Length: {len(r['payload'])}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_id}>"] + ([] if refers_to is None else [f"X-Refers-To-Page: {refers_to}"])
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        stop = end + 4 + int(headers["content-length"])
        yield headers, data[end + 4 : stop]
        at = stop


def _write_lines(records: DataFrame, path: str, end: str, level: str) -> str:
    """One binary column as gzip files, one for each row; the bytes go through unchanged."""
    lines = records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", end)
    lines.option("compression", "gzip").option("zlib.compress.level", level).option("maxRecordsPerFile", 1).text(path)
    return path


def _rolled(records: Iterator[bytes], end: bytes, head: Callable[[int], bytes] | None = None) -> Iterator[pd.DataFrame]:
    """Archives of at least ROLL bytes (but the last), each one value of the column record; ``head`` begins the nth."""
    held, size, n = [], 0, 0
    for record in records:
        if not held and head:
            held.append(head(n))
        held.append(record)
        size += len(record)
        if size >= ROLL:
            yield pd.DataFrame({"record": [end.join(held)]})
            held, size, n = [], 0, n + 1
    if held:
        yield pd.DataFrame({"record": [end.join(held)]})


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "content")


def _batched(rows: Iterator[tuple], names: list[str], sized: str) -> Iterator[pd.DataFrame]:
    """Data frames of at most about _BATCH bytes in the column ``sized``."""
    held, total = [], 0
    where = names.index(sized)
    for row in rows:
        held.append(row)
        total += len(row[where] or b"") + 200
        if total >= _BATCH:
            yield pd.DataFrame(held, columns=names, dtype=object)
            held, total = [], 0
    if held:
        yield pd.DataFrame(held, columns=names, dtype=object)


def write_arc(pages: DataFrame, path: str) -> str:
    """Pages as ARC files of version 1 and 2 by turns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        version = 1 + part % 2

        def records() -> Iterator[bytes]:
            for b in batches:
                ids = [None if pd.isna(x) else int(x) for x in b["page_id"]]
                for i, u, h in zip(ids, b["url"], b["html"], strict=True):
                    yield arc_record(version, i, u, h)

        return _rolled(records(), b"\n", lambda n: arc_version_block(version, f"part-{part}-{n}.arc"))

    columns = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"], pages["html"])
    return _write_lines(mapped(columns, run, "record binary"), path, "\n", "BEST_SPEED")


_DECIDED = "file string, offset long, error string, type string, id string, page_id long, size long, digest string"


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, dict]]:
    """File and record of all archives, damaged members among them."""
    for b in batches:
        for file, content in zip(b["file"], b["content"], strict=True):
            data, bad = unpacked(content)
            yield from ((file, {"offset": at, "error": "damaged gzip member"}) for at in bad)
            yield from ((file, record) for record in parse_arc(data))


def _place(file: str, offset: int) -> str:
    return hashlib.sha256(f"{file}:{offset}".encode()).hexdigest()


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """What decides about each record of the ARC files, and the errors."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for file, record in _records(batches):
            if record["error"]:
                yield (file, record["offset"], record["error"], None, None, None, None, None)
            else:
                r = converted(record)
                yield (file, record["offset"], None, r["type"], r["id"], r["page_id"], len(r["payload"]), r["digest"])

    names = [x.split()[0] for x in _DECIDED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in _batched(rows(batches), names, "digest"):
            yield out.astype({"offset": "Int64", "page_id": "Int64", "size": "Int64"})

    return mapped(_files(spark, path), run, _DECIDED)


def conversion_errors(spark: SparkSession, path: str) -> DataFrame:
    """file, offset and error of what can't be read in a folder of ARC files."""
    return read_arc(spark, path).where("error is not null").select("file", "offset", "error")


_FULL = "file string, offset long, type string, id string, date string, url string, mime string, ip string, head binary, payload binary, digest string"


def convert(spark: SparkSession, arc: str, warc: str, least: int = 0) -> str:
    """WARC files for the ARC files in a folder; payloads of at least ``least`` bytes are written once.

    What can't be read is left out here and listed by ``conversion_errors``.
    """
    known = read_arc(spark, arc).where("error is null and type = 'response'").where(F.col("size") >= least)
    last = F.coalesce("page_id", F.lit((1 << 63) - 1))
    kept = known.groupBy("digest", "size").agg(F.min(F.struct(last.alias("order"), "file", "offset", "id", "page_id")).alias("kept"), F.count("*").alias("n")).where("n > 1")
    # Kept apart, so that Spark can split the copies of one payload in the join.
    kept = saved(kept, "kept")
    revisits = (
        saved(known.select("file", "offset", "digest", "size"), "known")
        .join(kept, ["digest", "size"])
        .where((F.col("kept.file") != F.col("file")) | (F.col("kept.offset") != F.col("offset")))
        .select("file", "offset", F.col("kept.id").alias("refers_id"), F.col("kept.page_id").alias("refers_to"))
    )
    revisits = saved(revisits, "revisits")
    bits = bitmap(revisits.select(F.sha2(F.concat("file", F.lit(":"), F.col("offset").cast("string")), 256).alias("d")))
    names = [x.split()[0] for x in _FULL.split(", ")]

    def plain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _rolled((warc_record(converted(r), None, None) for file, r in _records(batches) if not r["error"] and not marked(bits, _place(file, r["offset"]))), b"\r\n")

    def moving(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for file, record in _records(batches):
                if not record["error"] and marked(bits, _place(file, record["offset"])):
                    r = converted(record)
                    yield (file, record["offset"], *(r[k] for k in names[2:]))

        for out in _batched(rows(), names, "payload"):
            yield out.astype({"offset": "Int64"})

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        records = (
            warc_record(r, r["refers_id"] if isinstance(r["refers_id"], str) else None, None if pd.isna(r["refers_to"]) else int(r["refers_to"]))
            for b in batches for r in b.to_dict("records")
        )
        return _rolled(records, b"\r\n")

    moved = mapped(_files(spark, arc), moving, _FULL).join(revisits, ["file", "offset"], "left")
    archives = mapped(_files(spark, arc), plain, "record binary").unionByName(mapped(moved, met, "record binary"))
    return _write_lines(archives, warc, "\r\n", "THREE")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, target, date and record_id of the responses and revisits in a folder of WARC files.

    A response's size and digest come from its stored bytes and must equal its headers.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for b in batches:
            for content in b["content"]:
                data, bad = unpacked(content)
                if bad:
                    raise ValueError("damaged archive")
                for h, block in parse_warc(data):
                    kind = h["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    if "sha1:" + sha1(block) != h["warc-block-digest"]:
                        raise ValueError(f"damaged record {h['warc-record-id']}")
                    end = re.search(rb"\r?\n\r?\n", block)
                    size, digest = int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response":
                        payload = block[end.end() :]
                        if (len(payload), sha1(payload)) != (size, digest):
                            raise ValueError(f"damaged payload {h['warc-record-id']}")
                    page = _ID.search(block[: end.end()])
                    refers = h.get("x-refers-to-page")
                    yield (int(page[1]) if page else None, size, digest, kind, None if refers is None else int(refers), h["warc-target-uri"], h["warc-date"], h["warc-record-id"])

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target", "date", "record_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in _batched(rows(batches), names, "target"):
            yield out.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target string, date string, record_id string"
    return mapped(_files(spark, path), run, schema)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through ARC files, the converter and WARC files, as read back from these."""
    folder = f"{scratch(spark)}/archives-{uuid.uuid4().hex}"
    arc = write_arc(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{folder}/arc")
    return read_warc(spark, convert(spark, arc, f"{folder}/warc"))
