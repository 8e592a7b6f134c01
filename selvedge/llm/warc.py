"""WARC archives: records written as whole-file gzip streams, normalised to one member a record, indexed, read back.

``write_monolithic`` writes each task's records into archives that are one gzip stream each.
``normalise`` inflates such a stream once, whatever its number of members, writes every record as a
gzip member of its own into a new archive, and an offset index beside it. ``read_records`` fetches
records by offset. Archives go to the shared folder through the file system that its address
names; a file's name is new for every attempt and only names in a finished manifest are read, so a lost
executor leaves an orphan file and no wrong row. Records are streamed: memory is bounded by one
payload when writing and by a chunk when normalising. Archives are dealt to tasks one by one when they are
normalised, and by archive and offset when they are read, whatever the size of the rows that name them. A stream
that breaks off, or holds another number of records than were written, is an error.

Defined results: a null payload is empty; of records with equal payloads of at least ``least`` bytes that
with the largest id is the response and the others revisit it (rows that share this id are all responses);
a null id never is revisited, nor revisits; a null address is written empty; repeated rows repeat; ids are
whole numbers. An empty table writes no archive and gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selvedge.session import run_dir, stage

ROLL_BYTES = 64 << 20
CHUNK = 1 << 18
LEVEL = 3
TASKS = 10_000  # of one job at most; beyond that a task works on several archives
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_revisits(pages: DataFrame, key: str, url: str, payload: str, least: int = 0) -> DataFrame:
    """id, url, payload (binary), refers_to: what each record is written from."""
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload"))
    narrow = rows.filter(F.col("bytes") >= least).select("id", "digest", "bytes")
    owners = narrow.groupBy("digest", "bytes").agg(F.max("id").alias("owner"), F.min("id").alias("other"))
    owners = owners.filter("other < owner").select("digest", "bytes", "owner")
    # Digests travel without their payloads; what is joined to those is a row for each revisit.
    revisits = narrow.join(owners, ["digest", "bytes"]).filter("id < owner")
    revisits = stage(revisits.select("id", "digest", F.col("owner").alias("refers_to")).distinct(), "revisits")
    return rows.join(revisits, ["id", "digest"], "left").select("id", "url", "payload", "refers_to")


def _name(key: int | None) -> str:
    return f"<urn:x-record:{'' if key is None else key}>"


def record_bytes(key: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit that keeps the response's header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_name(key)}",
        f"WARC-Target-URI: {urllib.parse.quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def write_monolithic(records: DataFrame, folder: str) -> DataFrame:
    """(path, records) of the archives written, each one gzip stream over all its records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        path, out, squeeze, count, size = "", None, None, 0, 0

        def closed() -> pa.RecordBatch:
            out.write(squeeze.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64())], ["path", "records"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path = f"{root}/whole-{uuid.uuid4().hex}.warc.gz"
                    out, squeeze, count, size = system.open_output_stream(path, compression=None), zlib.compressobj(LEVEL, wbits=31), 0, 0
                data = record_bytes(*row)
                out.write(squeeze.compress(data))
                count, size = count + 1, size + len(data)
                if size >= ROLL_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    rows = records.select("id", "url", "payload", "refers_to")
    return stage(rows.mapInArrow(run, "path string, records bigint"), "archives")


def inflate(source: BinaryIO) -> Iterator[bytes]:
    """The bytes of a gzip file of any number of members, a chunk at a time."""
    expand, begun = zlib.decompressobj(wbits=31), False
    while data := source.read(CHUNK):
        while data:
            begun = True
            part = expand.decompress(data, CHUNK)
            if part:
                yield part
            data = expand.unconsumed_tail
            if expand.eof:
                data, expand, begun = expand.unused_data, zlib.decompressobj(wbits=31), False
    if part := expand.flush():
        yield part
    if begun and not expand.eof:
        raise ValueError("the gzip stream breaks off")


class Reader:
    """Pulls lines and counted bytes from a stream of chunks."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.held = parts, bytearray()

    def _more(self) -> bool:
        part = next(self.parts, b"")
        self.held += part
        return bool(part)

    def header(self) -> bytes:
        """Up to and with the next empty line; b"" at the end."""
        at = 0
        while (end := self.held.find(b"\r\n\r\n", at)) < 0:
            at = max(0, len(self.held) - 3)
            if not self._more():
                if self.held.strip():
                    raise ValueError("a record breaks off in its header")
                return b""
        head = bytes(self.held[: end + 4])
        del self.held[: end + 4]
        return head

    def take(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.held and not self._more():
                raise ValueError("a record breaks off")
            part = bytes(self.held[:size])
            del self.held[: len(part)]
            size -= len(part)
            yield part


_FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)\r$", re.M)


def fields(head: bytes) -> dict[str, str]:
    return {name.decode().lower(): value.decode() for name, value in _FIELD.findall(head)}


INDEX = "path string, offset bigint, length bigint, type string, record string, digest string, uri string"


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """The offset index of new archives with a member for every record; also written beside each as lines of JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in INDEX.split(", ")]
        for batch in batches:
            for path, written in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, root = fs.FileSystem.from_uri(folder)
                system.create_dir(root, recursive=True)
                new = f"{root}/members-{uuid.uuid4().hex}.warc.gz"
                rows, offset, count = [], 0, 0
                with (
                    system.open_input_stream(path, compression=None) as source,
                    system.open_output_stream(new, compression=None) as out,
                    system.open_output_stream(new.removesuffix(".warc.gz") + ".index.jsonl", compression=None) as index,
                ):
                    reader = Reader(inflate(source))
                    while head := reader.header():
                        about, length = fields(head), 0
                        squeeze = zlib.compressobj(LEVEL, wbits=31)
                        length += out.write(squeeze.compress(head))
                        for part in reader.take(int(about["content-length"])):
                            length += out.write(squeeze.compress(part))
                        if b"".join(reader.take(4)) != b"\r\n\r\n":
                            raise ValueError("a record's length is wrong")
                        length += out.write(squeeze.compress(b"\r\n\r\n") + squeeze.flush())
                        row = (new, offset, length, about["warc-type"], about["warc-record-id"], about["warc-payload-digest"], about["warc-target-uri"])
                        index.write((json.dumps(dict(zip(names, row, strict=True))) + "\n").encode())
                        rows.append(row)
                        offset, count = offset + length, count + 1
                        if len(rows) >= 4096:
                            yield _index_batch(rows, names)
                            rows = []
                if count != written:
                    raise ValueError(f"{path} holds {count} records of {written}")
                if rows:
                    yield _index_batch(rows, names)

    tasks = min(TASKS, max(1, archives.count()))
    spread = archives.select("path", "records").repartitionByRange(tasks, "path")
    return stage(spread.mapInArrow(run, INDEX), "index")


def _index_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64() if name in ("offset", "length") else pa.string() for name in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _key(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:x-record:").removesuffix(">")
    return int(digits) if digits else None


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """id, type, refers_to, payload_bytes, payload_digest of every indexed record, each fetched by its offset.

    A response's payload is hashed again and must agree with its header; a revisit has the length and the
    digest of the payload it stands for in its headers.
    """
    schema = "id bigint, type string, refers_to bigint, payload_bytes bigint, payload_digest string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(folder)
        opened, source = None, None
        for batch in batches:
            out = []
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != opened:
                    if source is not None:
                        source.close()
                    opened, source = path, system.open_input_file(path)
                source.seek(offset)
                record = zlib.decompress(source.read(length), wbits=31)
                head, _, rest = record.partition(b"\r\n\r\n")
                about = fields(head + b"\r\n")
                block = rest[: int(about["content-length"])]
                http, _, payload = block.partition(b"\r\n\r\n")
                size, digest = int(fields(http + b"\r\n")["content-length"]), about["warc-payload-digest"].removeprefix("sha1:")
                if about["warc-type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                    raise ValueError(f"{path} at {offset}: the payload does not agree with its header")
                out.append((_key(about["warc-record-id"]), about["warc-type"], _key(about.get("warc-refers-to")), size, digest))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])
        if source is not None:
            source.close()

    tasks = min(TASKS, max(1, index.select("path").distinct().count()))
    rows = index.select("path", "offset", "length").repartitionByRange(tasks, "path", "offset").sortWithinPartitions("path", "offset")
    return rows.mapInArrow(run, schema)


def archive_pages(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """Write ``pages`` as archives, normalise them, and read every record back."""
    folder = run_dir(pages.sparkSession, "warc")
    if "://" not in folder and not folder.startswith(("file:", "/")):
        raise ValueError("the shared folder needs an absolute address")
    folder = re.sub(r"^file:/(?!/)", "file:///", folder)
    whole = write_monolithic(with_revisits(pages, key, url, payload, least), f"{folder}/whole")
    return read_records(normalise(whole, f"{folder}/members"), folder)
