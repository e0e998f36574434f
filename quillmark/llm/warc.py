"""Legacy web archives: ARC records in, WARC archives out, and both read back.

ARC version 1 heads a record with ``URL IP date type length``; version 2 with
``URL IP date type status checksum location offset filename length``. The version
block at an archive's start says which. The converter walks an archive by the
declared lengths alone, so a payload may hold anything, header lines included.

WARC archives are written with Spark's text writer, whose line separator is the
empty line pair that ends a record, and are read as streams with the text source;
both work on any file system that Spark knows. No task ever holds a whole archive:
writing starts a new one after so many records, reading holds one record and a batch.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import store

END = "\r\n\r\n"
#: Equal payloads below this many bytes are stored again rather than referred to.
LEAST = 1000
SALTS = 16
#: An archive ends after so many records.
RECORDS = 20_000
_NAMESPACE = uuid.UUID("6f1d3c52-6a52-5d0c-9d53-8c3a2f0b7e11")
_FIELDS = {1: ("url", "ip", "date", "mime", "length"), 2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length")}


@dataclass
class ArcRecord:
    version: int
    url: str
    ip: str
    date: str
    mime: str
    payload: bytes
    checksum: str = "-"
    status: str = "-"


def arc_bytes(records: list[tuple[str, str, bytes]], version: int, name: str, date: str = "20240101000000") -> bytes:
    """One ARC archive of (url, checksum, payload); blanks in a url are percent-coded, an empty one is ``-``."""
    told = " ".join({"url": "URL", "ip": "IP-address", "date": "Archive-date", "mime": "Content-type", "status": "Result-code", "checksum": "Checksum", "location": "Location", "offset": "Offset", "filename": "Filename", "length": "Archive-length"}[f] for f in _FIELDS[version])
    block = f"{version} {0 if version == 1 else 1} quillmark\n{told}\n".encode()
    first = {"url": f"filedesc://{name}", "ip": "0.0.0.0", "date": date, "mime": "text/plain", "status": "200", "checksum": "-", "location": "-", "offset": "0", "filename": name, "length": str(len(block))}
    out = [" ".join(first[f] for f in _FIELDS[version]).encode() + b"\n" + block + b"\n"]
    at = len(out[0])
    for url, checksum, payload in records:
        head = {"url": _coded(url), "ip": "0.0.0.0", "date": date, "mime": "text/html", "status": "200", "checksum": checksum, "location": "-", "offset": str(at), "filename": name, "length": str(len(payload))}
        out.append(" ".join(head[f] for f in _FIELDS[version]).encode() + b"\n" + payload + b"\n")
        at += len(out[-1])
    return b"".join(out)


def _coded(url: str) -> str:
    return "".join("%%%02X" % ord(c) if c in " \t\r\n\x0b\x0c" else c for c in url) or "-"


def arc_records(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC archive, by their declared lengths; ValueError where it is not one.

    Fields are taken from both ends of a header line: the url may then hold blanks.
    """
    at, version = 0, 0
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"no header line at byte {at}")
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        if not version:
            if not line.startswith("filedesc://"):
                raise ValueError("an ARC archive starts with its version block")
            version = 2 if data[end + 1 : end + 2] == b"2" else 1
        names = _FIELDS[version]
        parts = line.rsplit(" ", len(names) - 1)
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"bad version-{version} header at byte {at}: {line[:200]}")
        got = dict(zip(names, parts, strict=True))
        stop = end + 1 + int(got["length"])
        if stop > len(data):
            raise ValueError(f"record at byte {at} is cut short")
        if not got["url"].startswith("filedesc://"):
            yield ArcRecord(version, got["url"], got["ip"], got["date"], got["mime"], data[end + 1 : stop], got.get("checksum", "-"), got.get("status", "-"))
        at = stop


def record_id(key: int) -> str:
    """A WARC-Record-ID that carries a 64-bit key in its last eight bytes."""
    return f"<urn:uuid:{uuid.UUID(bytes=_NAMESPACE.bytes[:8] + (key & (2**64 - 1)).to_bytes(8, 'big'))}>"


def record_key(text: str) -> int:
    return int.from_bytes(uuid.UUID(text.strip("<>").removeprefix("urn:uuid:")).bytes[8:], "big", signed=True)


def warc_record(arc: ArcRecord, key: int, refers_to: int | None) -> str:
    """The WARC record of an ARC record, without its closing empty lines; a revisit keeps no payload."""
    digest = hashlib.sha1(arc.payload).hexdigest()
    when = f"{arc.date[:4]}-{arc.date[4:6]}-{arc.date[6:8]}T{arc.date[8:10]}:{arc.date[10:12]}:{arc.date[12:14]}Z"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(key)}", f"WARC-Date: {when}", f"WARC-Target-URI: {arc.url}", f"WARC-IP-Address: {arc.ip}", f"WARC-Payload-Digest: sha1:{digest}", f"X-ARC-Version: {arc.version}", f"X-Payload-Length: {len(arc.payload)}", f"Content-Type: {arc.mime}"]
    body = ""
    if refers_to is None:
        body = arc.payload.decode("utf-8")
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    head.append(f"Content-Length: {len(arc.payload) if refers_to is None else 0}")
    return "\r\n".join(head) + END + body


def warc_records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of WARC archives read one after the other, by Content-Length.

    ``pieces`` are the bytes between empty line pairs, wherever those stand; put
    together again they are the archives, of which one record is held at a time.
    """
    mark, source, held = END.encode(), iter(pieces), bytearray()

    def until(size: int) -> None:
        while len(held) < size:
            if (piece := next(source, None)) is None:
                raise ValueError("the last record is cut short")
            held.extend(piece + mark)

    for piece in source:
        held += piece + mark
        while start := held.lstrip(b"\r\n"):  # a block that ends in a line end leaves one at the archive's end
            held = start
            end = held.find(mark)
            lines = held[: max(end, 0)].decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no WARC record at {bytes(held[:80])!r}")
            head = dict(x.split(": ", 1) for x in lines[1:])
            stop = end + 4 + int(head["Content-Length"])
            until(stop + 4)
            if held[stop : stop + 4] != mark:
                raise ValueError(f"record {head.get('WARC-Record-ID')} does not end where it says")
            yield head, bytes(held[end + 4 : stop])
            del held[: stop + 4]
        held.clear()


def archived(pages: DataFrame, key: str, url: str, payload: str, least: int = LEAST) -> DataFrame:
    """Write one WARC record for each row, by way of ARC, then read the archives back.

    ``key`` is a unique long; ``payload`` text counts as empty where null, ``url``
    as ``-``. Of records with equal payloads of ``least`` bytes or more, the one
    with the largest key is the response and the others are revisits of it.
    Rows with a null key carry no identifier and are left out; rows repeated with
    one key are each archived, and a repeat of the largest key is a revisit of
    nothing, so it stays a response. Returns (key, url, payload_bytes,
    payload_digest, record_type, refers_to, payload); a revisit's payload is null.
    """
    rows = pages.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.encode("payload", "utf-8")))
    big = rows.select("key", "digest", F.octet_length("payload").alias("n")).where(F.col("n") >= least)
    # One row for each digest that occurs twice, repeated for each salt: a third of all rows may share one.
    first = big.groupBy("digest").agg(F.max("key").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    first = first.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    marks = big.select("key", "digest", F.pmod("key", F.lit(SALTS)).cast("int").alias("salt")).join(first, ["digest", "salt"]).where(F.col("key") != F.col("first")).select("key", "first").dropDuplicates(["key"])
    ready = rows.select("key", "url", "payload").join(marks, "key", "left")

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = batch.to_pydict()
            out: list[str | None] = [None] * batch.num_rows
            for version in (1, 2):  # both header forms occur; which one a key gets is its parity
                own = [i for i, k in enumerate(got["key"]) if k % 2 == version - 1]
                data = arc_bytes([(got["url"][i], hashlib.md5(got["payload"][i].encode()).hexdigest(), got["payload"][i].encode()) for i in own], version, f"v{version}.arc")
                for i, arc in zip(own, arc_records(data), strict=True):
                    out[i] = warc_record(arc, got["key"][i], got["first"][i])
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})

    path = store.scratch(pages.sparkSession, "warc")
    ready.mapInArrow(convert, "value string").write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for head, block in warc_records(x.as_py() for batch in batches for x in batch.column(0)):
            whole = head["WARC-Type"] == "response"
            refers = head.get("WARC-Refers-To")
            rows.append((record_key(head["WARC-Record-ID"]), head["WARC-Target-URI"], int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"], refers and record_key(refers), block.decode() if whole else None))
            held += len(block)
            if whole and hashlib.sha1(block).hexdigest() != rows[-1][3]:
                raise ValueError(f"digest of {rows[-1][0]} does not fit its payload")
            if held > 8 << 20 or len(rows) >= 8192:
                yield _rows(rows)
                rows, held = [], 0
        yield _rows(rows)

    # Compressed text is never split, so a task reads whole archives, in order.
    lines = pages.sparkSession.read.option("lineSep", END).text(path).select(F.col("value").cast("binary"))
    return lines.mapInArrow(parse, "key long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = ["key", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
