"""WARC archives in seekable Zstandard bundles.

A task appends its records to bundles. Records are grouped into frames of about
``FRAME`` bytes, each compressed on its own; a bundle ends with a seek table in a
skippable frame, as the seekable format describes it, so that any frame can be found
and read alone and any Zstandard tool still reads the whole. What the task gives back
is the index: record id, bundle, frame, offset and length inside the frame. Spark
writes it as a table with its own commit, so the index alone says which bundles count;
a bundle of a lost or repeated attempt is in no index row.

Of equal payloads the record with the largest id is a response, the others are
revisits of it. Only payloads that occur more than once are joined to the rows, so
where few do, the pages are never shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.common import cut, trim

#: Bytes of records after which a frame ends, and compressed bytes after which a bundle ends.
FRAME, BUNDLE = 1 << 20, 256 << 20
#: Fixed values of the seekable format: skippable frame and footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Fixed value of WARC 1.1: the profile of a revisit with an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
LEVEL = 3

INDEX = "id string, bundle string, frame int, offset long, length long"
_INDEX = pa.schema([("id", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
RECORD = "id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes long"
_RECORD = pa.schema([*[(c, pa.string()) for c in ("id", "url", "record_type", "refers_to", "payload_digest")], ("payload_bytes", pa.int64())])


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(record: str | None) -> bytes:
    """An id as a URI in angle brackets; a null id has no last part."""
    return b"<urn:record" + (b":" + _safe(record) if record is not None else b"") + b">"


def _safe(text: str) -> bytes:
    """Percent signs and what would break a header line, percent-encoded."""
    return re.sub(rb"[\x00-\x20%<>\x7F]", lambda m: b"%%%02X" % m[0][0], text.encode())


def _plain(field: str) -> str:
    return re.sub(rb"%([0-9A-F]{2})", lambda m: bytes([int(m[1], 16)]), field.encode()).decode()


def _record_of(uri: str) -> str | None:
    head, colon, rest = uri[len("<urn:record"):-1].partition(":")
    return _plain(rest) if colon else None


def record(id: str | None, url: str | None, payload: bytes | None, refers_to: str | None, revisit: bool, payload_digest: str, payload_bytes: int, date: str) -> bytes:
    """One WARC record; a revisit has the HTTP head of its payload alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % payload_bytes
    block = http if revisit else http + payload
    head = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: " + _uri(id), b"WARC-Date: " + date.encode(),
            b"WARC-Payload-Digest: sha1:" + payload_digest.encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + _safe(url))
    if revisit:
        head += [b"WARC-Refers-To: " + _uri(refers_to), b"WARC-Profile: " + PROFILE.encode()]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes | memoryview, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header, HTTP body and end of the record that starts at ``at``; a wrong digest is an error."""
    data = bytes(data) if at == 0 and not isinstance(data, bytes) else data
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    head = dict(line.split(": ", 1) for line in lines[1:])
    start = stop + 4
    end = start + int(head["Content-Length"])
    body = data.index(b"\r\n\r\n", start, end) + 4
    head["HTTP-Length"] = re.search(rb"Content-Length: (\d+)", data[start:body])[1].decode()
    payload = data[body:end]
    if head["WARC-Type"] == "response" and "sha1:" + digest(payload) != head["WARC-Payload-Digest"]:
        raise ValueError(f"payload of {head['WARC-Record-ID']} differs from its digest")
    return head, payload, end + 4


def _filesystem(folder: str):
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder)) if re.match(r"\w+:", folder) else (pyarrow.fs.LocalFileSystem(), folder)


class Bundle:
    """A bundle that is being written: frames, then the seek table."""

    def __init__(self, folder: str, frame: int):
        self.fs, root = _filesystem(folder)
        self.name, self.frame, self.records, self.size, self.frames, self.written = f"{uuid.uuid4().hex}.warc.zst", frame, [], 0, [], 0
        self.fs.create_dir(root, recursive=True)
        self.out = self.fs.open_output_stream(f"{root}/{self.name}", compression=None)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def add(self, data: bytes) -> tuple[int, int, int]:
        """Frame, offset and length of the record in it; a record is never parted."""
        if self.records and self.size + len(data) > self.frame:
            self.end_frame()
        place = len(self.frames), self.size, len(data)
        self.records.append(data)
        self.size += len(data)
        return place

    def end_frame(self) -> None:
        packed = self.packer.compress(b"".join(self.records))
        self.out.write(packed)
        self.frames.append((len(packed), self.size))
        self.written += len(packed)
        self.records, self.size = [], 0

    def close(self) -> None:
        if self.records:
            self.end_frame()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class Opened:
    """A bundle to read frames from, found by its seek table."""

    def __init__(self, folder: str, name: str):
        fs, root = _filesystem(folder)
        self.file = fs.open_input_file(f"{root}/{name}")
        size = self.file.size()
        n, kind, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{name} has no seek table")
        width = 12 if kind & 0x80 else 8
        table = self.file.read_at(n * width, size - 9 - n * width)
        self.frames, at = [], 0
        for i in range(n):
            packed, plain = struct.unpack_from("<II", table, i * width)
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.frames[number]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=plain)


def _written(folder: str, frame: int, bundle: int, date: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows = None, []
        for b in batches:
            for i in range(b.num_rows):
                r = {n: b.column(k)[i].as_py() for k, n in enumerate(b.schema.names)}
                if out is None:
                    out = Bundle(folder, frame)
                place = out.add(record(r["id"], r["url"], r["payload"], r["refers_to"], r["revisit"], base64.b32encode(r["sha1"]).decode(), r["payload_bytes"], date))
                rows.append((r["id"], out.name, *place))
                if out.written >= bundle:
                    out.close()
                    out = None
            if len(rows) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _INDEX)], schema=_INDEX)
                rows = []
        if out is not None:
            out.close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _INDEX)], schema=_INDEX)
        trim()
    return run


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0,
          frame: int = FRAME, bundle: int = BUNDLE, date: str = DATE) -> DataFrame:
    """Write a record a row into bundles in ``folder`` and return the index, which is a table in ``folder``/index.

    Payloads are UTF-8 bytes; null is an empty payload, a null url has no header line,
    a null id a URI without last part. Of equal payloads of ``least`` bytes or more the
    rows with the largest id are responses (several if a row is repeated), the others
    revisits; null ids revisit any other. An empty table gives an empty index. Other
    columns are not read. ``folder`` must be seen by every executor; Python tasks
    write to it through pyarrow, which must know its scheme.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b"").cast("binary"))
    rows = pages.select(F.col(key).alias("id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "same": F.sha2("payload", 256)})
    equal = rows.where(F.col("payload_bytes") >= least).groupBy("same").agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").select("same", "refers_to")
    joined = rows.join(cut(equal, "equal"), "same", "left")
    revisit = F.col("refers_to").isNotNull() & ~F.col("id").eqNullSafe(F.col("refers_to"))
    shown = joined.select(F.col("id").cast("string").alias("id"), "url", F.when(~revisit, F.col("payload")).alias("payload"), F.when(revisit, F.col("refers_to").cast("string")).alias("refers_to"),
                          revisit.alias("revisit"), F.unhex(F.sha1("payload")).alias("sha1"), "payload_bytes")
    shown.mapInArrow(_written(f"{folder}/bundles", frame, bundle, date), INDEX).write.mode("errorifexists").parquet(f"{folder}/index")
    return index(spark, folder)


def index(spark, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def _fields(head: dict[str, str]) -> tuple:
    refers = head.get("WARC-Refers-To")
    url = head.get("WARC-Target-URI")
    return (_record_of(head["WARC-Record-ID"]), None if url is None else _plain(url), head["WARC-Type"], None if refers is None else _record_of(refers),
            head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["HTTP-Length"]))


def _read(folder: str, payloads: bool, places: bool):
    """(bundle, frame[, offset]) -> records: of whole frames, or of the places alone."""
    schema = pa.schema([*_RECORD, *([("payload", pa.binary())] if payloads else [])])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, opened, number, data = None, None, None, b""
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0] != name:
                    name, opened, number = row[0], Opened(folder, row[0]), None
                if row[1] != number:
                    number, data = row[1], opened.frame(row[1])
                at, out = (row[2] if places else 0), []
                while at < len(data):
                    head, payload, at = parsed(data, at)
                    out.append((*_fields(head), *([payload if head["WARC-Type"] == "response" else None] if payloads else [])))
                    if places:
                        break
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        trim()
    return run


def _frames(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows in the order of their frames; neighbouring frames meet in a task."""
    return rows.repartition("bundle", F.floor(F.col("frame") / 16)).sortWithinPartitions("bundle", "frame", *columns).select("bundle", "frame", *columns)


def read(spark, folder: str, payloads: bool = True) -> DataFrame:
    """All records of the bundles that the index names; a response's payload is held against its digest."""
    frames = index(spark, folder).groupBy("bundle", "frame").agg(F.count(F.lit(1)).alias("n"))
    return _frames(frames).mapInArrow(_read(f"{folder}/bundles", payloads, False), RECORD + (", payload binary" if payloads else ""))


def fetch(records: DataFrame, folder: str, key: str = "id") -> DataFrame:
    """The records whose ids ``records`` lists, each read from its own frame alone; unknown ids give no row, repeated ones one."""
    wanted = records.select(F.col(key).cast("string").alias("id")).distinct()
    places = index(records.sparkSession, folder).join(wanted, "id", "leftsemi")
    return _frames(places, "offset").mapInArrow(_read(f"{folder}/bundles", True, True), RECORD + ", payload binary")


def resolved(rows: DataFrame) -> DataFrame:
    """Records of ``read`` with the payload of the response put in for every revisit."""
    found = rows.where("record_type = 'response'").select(F.col("id").alias("refers_to"), F.col("payload").alias("found")).dropDuplicates(["refers_to"])
    revisits = rows.where("record_type = 'revisit'").join(found, "refers_to", "left").withColumn("payload", F.col("found")).select(*rows.columns)
    return rows.where("record_type = 'response'").unionByName(revisits)
