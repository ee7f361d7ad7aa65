"""Legacy archive converter: ARC records become WARC records, which are written and read back.

An ARC file opens with a version block whose second line is ``version-number
reserved origin`` and whose third names the fields of the record headers. Version
1 headers are ``URL IP-address Archive-date Content-type Archive-length``; version 2
adds ``Result-code Checksum Location Offset Filename`` before the length. A record's
length alone says where it ends: payloads may hold anything, header lines of other
records included. After a line that isn't a header, or a length that passes the
file's end, reading goes on at the next line that is a header.

Conversion synthesises a WARC identifier (a UUID of the source row's id and the
payload digest), an ISO timestamp, the record type and SHA-256 digests. Of records with equal
payloads of at least ``MIN_REVISIT`` bytes, that with the smallest id is a response
and the others are revisits, which name its identifier in WARC-Refers-To and carry no
payload but its HTTP headers, the payload's length among them. Rows that repeat id and
payload are alike and share an identifier; null ids come last. A null payload is empty.
Empty tables give empty results; further columns are not looked at.

Archives are written by Spark, to any store it knows: a file holds ``ARCHIVE_RECORDS``
records at most and is gzipped whole, where other writers make a member of each record;
``parse_warc`` reads both.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.blocks import map_arrow, parts
from quarry.llm.shared import materialise, scratch_path, ship

ship(__name__)

MIN_REVISIT = 100
#: Records of one archive file, so that a file can be read by one task.
ARCHIVE_RECORDS = 4_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 4122
#: The header fields of the two ARC versions.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}


def arc_header(version: int, filename: str, date: str) -> bytes:
    """The version block of an ARC file."""
    body = f"{version} 0 quarry\n{' '.join(ARC_FIELDS[version])}\n".encode()
    told = ["filedesc://" + filename, "0.0.0.0", date, "text/plain"]
    told += ["200", "-", "-", "0", filename] if version == 2 else []
    return f"{' '.join([*told, str(len(body))])}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, date: str, content: bytes, status: int = 200, mime: str = "text/html", ip: str = "0.0.0.0") -> bytes:
    """One record; spaces in the URL are escaped, as they separate the fields."""
    told = [_field(url), ip, date, mime]
    told += [str(status), hashlib.md5(content).hexdigest(), "-", "0", "-"] if version == 2 else []
    return f"{' '.join([*told, str(len(content))])}\n".encode() + content + b"\n"


def _field(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if c <= " " else c for c in value) or "-"


def _arc_fields(line: bytes, version: int | None) -> list[str] | None:
    """The fields of a header line of this version (None: of the version block); None if it isn't one."""
    parts = line.decode("utf-8", "replace").rstrip("\r").split(" ")
    if version is None:
        return parts if line.startswith(b"filedesc:") and parts[-1].isascii() and parts[-1].isdigit() else None
    names = ARC_FIELDS[version]
    extra = len(parts) - len(names)  # a legacy URL may hold bare spaces
    if extra < 0 or not (parts[-1].isascii() and parts[-1].isdigit()):
        return None
    parts = [" ".join(parts[: extra + 1]), *parts[extra + 1 :]]
    date = parts[names.index("Archive-date")]
    return parts if parts[0] and date.isascii() and date.isdigit() else None


def parse_arc(data: bytes) -> Iterator[dict]:
    """Fields and ``content`` of each record after the version block, of a plain or gzipped file."""
    if data[:2] == b"\x1f\x8b":
        data = _Inflated(data).rest()
    at, version = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        parts = _arc_fields(data[at:end], version)
        if parts is None or end + 1 + int(parts[-1]) > len(data):
            at = end + 1  # a blank or broken line
            continue
        content = data[end + 1 : end + 1 + int(parts[-1])]
        at = end + 1 + int(parts[-1])
        if version is None:
            told = content.split(b" ", 1)[0]
            if told not in (b"1", b"2"):
                raise ValueError(f"ARC version {told!r}")
            version = int(told)
            continue
        yield dict(zip(ARC_FIELDS[version], parts)) | {"content": content}


def http_payload(content: bytes) -> bytes:
    """What follows the HTTP headers; the whole content where there are none."""
    if not content.startswith(b"HTTP/"):
        return content
    return content.partition(b"\r\n\r\n")[2]


def iso_date(arc_date: str) -> str:
    """14 digits, or the 12 or fewer of early archives, padded with the earliest values."""
    digits = arc_date[:14] + "00000101000000"[len(arc_date) :] if arc_date.isdigit() else "19700101000000"
    return datetime.strptime(digits, "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(key: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{key} {digest}')}>"


def warc_record(record: dict, key: str, digest: str, refers_to: str | None) -> bytes:
    """The WARC form of a parsed ARC record, without the blank lines after it.

    ``key`` is the source row's id, ``refers_to`` that of the response with the
    same payload, if this is a revisit; both are kept as extension fields.
    """
    payload = http_payload(record["content"])
    head = record["content"][: len(record["content"]) - len(payload)]
    block = record["content"] if refers_to is None else head
    told = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(key, digest)),
        ("WARC-Date", iso_date(record["Archive-date"])),
        ("WARC-Target-URI", record["URL"]),
        ("WARC-IP-Address", record["IP-address"]),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("X-Source-Id", key),
    ]
    if refers_to is not None:
        told += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Source-Id", refers_to)]
    told += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in told).encode() + b"\r\n" + block


class _Inflated:
    """Bytes of a plain or gzip file as they are asked for, member after member."""

    def __init__(self, data: bytes):
        self.data, self.at, self.out = data, 0, b""
        self.engine = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.at >= len(self.data):
            return False
        piece = self.data[self.at : self.at + (1 << 18)]
        self.at += len(piece)
        self.out += self.engine.decompress(piece) if self.engine else piece
        if self.engine and self.engine.eof:
            self.at -= len(self.engine.unused_data)
            self.engine = zlib.decompressobj(31)
        return True

    def rest(self) -> bytes:
        held, self.out = [self.out], b""
        while self._more():
            held.append(self.out)
            self.out = b""
        return b"".join(held)

    def until(self, mark: bytes) -> bytes | None:
        while (end := self.out.find(mark)) < 0:
            if not self._more():
                return None
        found, self.out = self.out[:end], self.out[end + len(mark) :]
        return found

    def take(self, size: int) -> bytes:
        while len(self.out) < size and self._more():
            pass
        found, self.out = self.out[:size], self.out[size:]
        return found


def parse_warc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(fields, block) of each record of an archive, by declared lengths."""
    source = _Inflated(data)
    while (head := source.until(b"\r\n\r\n")) is not None:
        lines = head.lstrip(b"\r\n").decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            return
        fields = dict(x.split(": ", 1) for x in lines[1:])
        yield fields, source.take(int(fields["Content-Length"]))
        source.take(4)


def _http_response(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload


def arc_to_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", version: int = 2, date: str = "20080430204825") -> DataFrame:
    """Rows (record): the WARC record of each page, converted from its ARC record.

    Digests are computed and grouped as narrow rows first; a payload meets the
    group of its copies by its digest, and a group that many rows share is split
    by the adaptive join, as the group itself is one row.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("string").alias("key"), F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    copies = rows.filter(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    copies = materialise(copies, "copies")
    refers = F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id")), F.col("first").cast("string"))
    known = rows.join(copies, "digest", "left").select("key", "url", "payload", "digest", refers.alias("refers_to"))

    def run(batches):
        for batch in batches:
            for part in parts(batch, "payload"):
                keys, urls, bodies, digests, refer = (part.column(n).to_pylist() for n in ("key", "url", "payload", "digest", "refers_to"))
                archive = arc_header(version, "pages.arc", date) + b"".join(arc_record(version, u, date, _http_response(b)) for u, b in zip(urls, bodies))
                done = [warc_record(r, k if k is not None else "-", d, f) for r, k, d, f in zip(parse_arc(archive), keys, digests, refer)]
                yield pa.RecordBatch.from_arrays([pa.array(done, pa.binary())], names=["record"])

    return map_arrow(known, run, "record binary")


def write_warc(records: DataFrame, path: str) -> str:
    """Write records as gzipped WARC files through Spark's own writer, so to any store it knows."""
    text = records.select(F.col("record").cast("string").alias("value"))
    text.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)
    return path


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the archives in a folder: source_id, uri, date, record_type, payload_bytes,
    payload_digest (bare hex), refers_to, payload (null for revisits)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    names = ["source_id", "uri", "date", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.string(), pa.binary()]

    def told(fields: dict, block: bytes) -> tuple:
        payload = http_payload(block)
        if fields["WARC-Type"] == "response":
            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
            if fields["WARC-Payload-Digest"] != f"sha256:{digest}":
                raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
        else:
            lines = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if ": " in x)
            size, digest, payload = int(lines["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:"), None
        return fields["X-Source-Id"], fields["WARC-Target-URI"], fields["WARC-Date"], fields["WARC-Type"], size, digest, fields.get("X-Refers-To-Source-Id"), payload

    def run(batches):
        for batch in batches:
            for data in batch.column("content"):
                held: list = []
                weight = 0
                for fields, block in parse_warc(data.as_py()):
                    held.append(told(fields, block))
                    weight += len(block)
                    if weight > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], k) for i, k in enumerate(kinds)], names=names)
                        held, weight = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], k) for i, k in enumerate(kinds)], names=names)

    return map_arrow(files, run, "source_id string, uri string, date string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary")


def read_arc(spark: SparkSession, path: str, name_glob: str = "*.arc*") -> DataFrame:
    """Records of legacy ARC files (plain or gzipped) in a folder: key (file name and place in it), url, date, payload.

    A file is read whole by one task, so it may have 2 GB at most, Spark's bound of a binary column.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", name_glob).load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                for i, r in enumerate(parse_arc(data.as_py())):
                    told = [[f"{name.rsplit('/', 1)[-1]}:{i}"], [r["URL"]], [r["Archive-date"]], [http_payload(r["content"])]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(told, [pa.string()] * 3 + [pa.binary()])], names=["key", "url", "date", "payload"])

    return map_arrow(files, run, "key string, url string, date string, payload binary")


def convert(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", version: int = 2, path: str | None = None) -> DataFrame:
    """Convert, write the archives (to the shared folder unless ``path`` is given) and read them back."""
    spark = pages.sparkSession
    return read_warc(spark, write_warc(arc_to_warc(pages, id_col, url_col, payload_col, version), path or scratch_path(spark, "warc")))
