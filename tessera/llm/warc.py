"""WARC archives as a PySpark Python data source.

Writing: one gzip member per record, with its compressed and whole length in the header's ``sl`` extra field, so a
reader can step over members without inflating them. Files are cut at ``max_bytes``; each file is written under a
temporary name and gets its own name on commit.
Reading: plain ``.warc`` files and ``.warc.gz`` files, of one gzip member per record, of any number of records, or of
members with the ``sl`` field; one partition per file. ``record_type`` and header predicates are pushed down. Headers
are parsed first; the payload of a record that does not pass, or of any record where payloads are not asked for, is
stepped over: without reading it in plain files and ``sl`` members, without keeping it in others. Payloads are those of
the HTTP messages where a block is one, else whole blocks; ``http_length`` is the HTTP header's length, else the bytes
that follow the HTTP head. A gzip member that is read to its end is held against its checksum.

Cases: an empty payload is a record of length 0, a null one too; rows that repeat are records of their own; records of
unknown types are read like others; a folder without archives has no partitions; extra columns are not written; a
truncated file and bytes that are no record raise ``ValueError``. A very long record is held whole by one task.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, payload_digest string, refers_to string, http_length long, payload binary"
#: Columns of SCHEMA that come from a named header, for predicates.
HEADERS = {"record_type": "warc-type", "target_uri": "warc-target-uri", "warc_date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "record_id": "warc-record-id"}
GZIP = b"\x1f\x8b\x08\x04"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(record: bytes, level: int = 1) -> bytes:
    """A gzip member with the ``sl`` field: length of the whole member and of the record."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = GZIP + b"\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(kind: str, record_id: str, uri: str, date: str, digest: str, length: int, payload: bytes | None, refers_to: str | None) -> bytes:
    """A response (HTTP header and payload) or a revisit (HTTP header alone, with the full payload's length)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Target-URI: {uri}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class FilePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    """Rows (record_type, record_id, target_uri, warc_date, payload_digest, refers_to, http_length, payload)."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.max_bytes = options["path"], int(options.get("max_bytes", 64 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, root = _open(self.path)
        files: list[str] = []
        out, size = None, 0
        for batch in iterator:
            for r in batch.to_pylist():
                if out is None:
                    where.create_dir(root, recursive=True)
                    files.append(f"{root}/part-{uuid.uuid4().hex}.warc.gz")
                    out, size = where.open_output_stream(files[-1] + ".tmp", compression=None), 0
                m = member(record(r["record_type"], r["record_id"], r["target_uri"] or "", r["warc_date"] or "", r["payload_digest"] or "", r["http_length"] or 0, r["payload"], r["refers_to"]))
                out.write(m)
                size += len(m)
                if size >= self.max_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        where, _ = _open(self.path)
        for m in messages:
            for f in m.files if m else []:
                where.move(f + ".tmp", f)

    def abort(self, messages: list) -> None:
        where, _ = _open(self.path)
        for m in messages:
            for f in m.files if m else []:
                where.delete_file(f + ".tmp")


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payloads = options["path"], options.get("payloads", "true") == "true"
        self.where: list[tuple[str, tuple | None]] = []

    def pushFilters(self, filters):
        """Equality, membership and not-null predicates on header columns are taken; the rest stay with Spark."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In | IsNotNull) and len(f.attribute) == 1 else None
            if name not in HEADERS:
                yield f
            elif isinstance(f, IsNotNull):
                self.where.append((name, None))
            else:
                self.where.append((name, (f.value,) if isinstance(f, EqualTo) else tuple(f.value)))

    def partitions(self) -> list[FilePartition]:
        where, root = _open(self.path)
        info = where.get_file_info(root)
        found = [info] if info.type == pafs.FileType.File else where.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        prefix = self.path[: -len(root)] if self.path.endswith(root) else ""
        return [FilePartition(prefix + x.path) for x in sorted(found, key=lambda x: x.path) if x.path.endswith((".warc", ".warc.gz"))] or [FilePartition("")]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        where, name = _open(partition.path)
        types = [pa.string()] * 6 + [pa.int64(), pa.binary()]
        names = [*["record_id", "record_type", "target_uri", "warc_date", "payload_digest", "refers_to"], "http_length", "payload"]
        rows: list[tuple] = []
        held = 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*rows, strict=True)), types, strict=True)], names=names)

        with where.open_input_file(name) as f:
            for row in self._rows(f, name):
                rows.append(row)
                held += len(row[-1] or b"") + 200
                if held > 4 << 20:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()

    def _rows(self, f, name: str) -> Iterator[tuple]:
        at, end = 0, f.size()
        while at < end:
            head = f.read_at(24, at)
            if head[:4] == GZIP and head[12:14] == b"sl":
                size = struct.unpack("<I", head[16:20])[0]
                if at + size > end:
                    raise ValueError(f"{name}: truncated record at byte {at}")
                row = self._record(Member(f, at, size, name))
                at += size
                if row is not None:
                    yield row
                continue
            source = Inflated(f, at, name) if head[:2] == b"\x1f\x8b" else Plain(f, at, name)
            # Other members and plain bytes are one stream of records, up to the next member with a length.
            while source.more():
                row = self._record(source)
                if row is not None:
                    yield row
            at = source.at

    def _record(self, source: Source) -> tuple | None:
        head = source.until(b"\r\n\r\n").lstrip(b"\r\n")
        if not head.startswith(b"WARC/"):
            raise ValueError(f"{source.name}: no record at byte {source.start}")
        h: dict[str, str] = {}
        key = ""
        for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
            if line[:1] in (" ", "\t") and key:
                h[key] += " " + line.strip()
                continue
            key, _, v = line.partition(":")
            key = key.strip().lower()
            h[key] = v.strip()
        for k in ("warc-record-id", "warc-refers-to"):
            if k in h:
                h[k] = h[k].strip("<>")
        if "warc-payload-digest" in h:
            h["warc-payload-digest"] = h["warc-payload-digest"].removeprefix("sha1:")
        size = int(h["content-length"])
        for name, allowed in self.where:
            v = h.get(HEADERS[name])
            if v is None or (allowed is not None and v not in allowed):
                source.skip(size)
                source.close()
                return None
        http, length, taken = b"", None, 0
        start = source.peek(min(size, 5))
        if start == b"HTTP/":
            http = source.until(b"\r\n\r\n", size)
            taken = len(http)
            length = next((int(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), size - taken)
        payload = None
        if self.payloads and h.get("warc-type") != "revisit":
            payload = source.take(size - taken)
        else:
            source.skip(size - taken)
        source.close()
        return (*(h.get(HEADERS[c]) for c in ("record_id", "record_type", "target_uri", "warc_date", "payload_digest", "refers_to")), length if length is not None else size, payload)


class Source:
    """Bytes of records, read in order: ``until`` a mark, ``take`` or ``skip`` so many, ``more`` of them or none."""

    def __init__(self, f, at: int, name: str):
        self.f, self.at, self.name, self.start, self.got, self.size = f, at, name, at, b"", f.size()

    def feed(self, n: int) -> bool:
        """Append about ``n`` bytes to ``got``; whether there were any."""
        raise NotImplementedError

    def _need(self, n: int) -> None:
        parts = [self.got]
        have = len(self.got)
        while have < n:
            self.got = b""
            if not self.feed(max(n - have, 1 << 16)):
                raise ValueError(f"{self.name}: truncated record at byte {self.start}")
            parts.append(self.got)
            have += len(self.got)
        self.got = b"".join(parts)

    def peek(self, n: int) -> bytes:
        self._need(n)
        return self.got[:n]

    def until(self, mark: bytes, most: int = 1 << 24) -> bytes:
        seen = 0
        while (stop := self.got.find(mark, max(seen - len(mark), 0))) < 0 and len(self.got) < most:
            seen = len(self.got)
            if not self.feed(1 << 10):
                raise ValueError(f"{self.name}: truncated record at byte {self.start}")
        stop = min(stop + len(mark) if stop >= 0 else most, most, len(self.got))
        out, self.got = self.got[:stop], self.got[stop:]
        return out

    def take(self, n: int) -> bytes:
        self._need(n)
        out, self.got = self.got[:n], self.got[n:]
        return out

    def skip(self, n: int) -> None:
        while n > 0:
            step = min(n, 1 << 20)
            self.take(step)
            n -= step

    def more(self) -> bool:
        """Whether another record begins; the line ends between records are passed."""
        while True:
            self.got = self.got.lstrip(b"\r\n")
            if self.got:
                return True
            if not self.feed(1 << 16):
                return False

    def close(self) -> None:
        """The record has been read."""


class Plain(Source):
    def feed(self, n: int) -> bool:
        part = self.f.read_at(min(n, self.size - self.at), self.at) if self.at < self.size else b""
        self.at += len(part)
        self.got += part
        return bool(part)

    def skip(self, n: int) -> None:
        kept = min(n, len(self.got))
        self.got = self.got[kept:]
        self.at += n - kept
        if self.at > self.size:
            raise ValueError(f"{self.name}: truncated record at byte {self.start}")


class Inflated(Source):
    """Gzip members one after another, up to the first with an ``sl`` field; ``zlib`` holds each against its checksum."""

    def __init__(self, f, at: int, name: str):
        super().__init__(f, at, name)
        self.z, self.raw = zlib.decompressobj(31), b""

    def feed(self, n: int) -> bool:
        while True:
            if self.z.eof:
                rest = self.z.unused_data
                self.at -= len(rest)
                head = self.f.read_at(min(24, self.size - self.at), self.at) if self.at < self.size else b""
                if head[:2] != b"\x1f\x8b" or (head[:4] == GZIP and head[12:14] == b"sl"):
                    if head and head[:2] != b"\x1f\x8b" and head.strip(b"\0"):
                        raise ValueError(f"{self.name}: no record at byte {self.at}")
                    self.at = self.at if head[:4] == GZIP else self.size
                    return False
                self.z = zlib.decompressobj(31)
                self.raw = b""
            if not self.raw:
                self.raw = self.f.read_at(min(1 << 16, self.size - self.at), self.at) if self.at < self.size else b""
                self.at += len(self.raw)
                if not self.raw:
                    raise ValueError(f"{self.name}: truncated record at byte {self.start}")
            try:
                part = self.z.decompress(self.raw, max(n, 1))
            except zlib.error as e:
                raise ValueError(f"{self.name}: damaged record at byte {self.start}: {e}") from e
            self.raw = self.z.unconsumed_tail
            if part:
                self.got += part
                return True


class Member(Source):
    """One member with an ``sl`` field, of ``size`` bytes."""

    def __init__(self, f, at: int, size: int, name: str):
        super().__init__(f, at + 24, name)
        self.start, self.stop, self.z, self.raw = at, at + size - 8, zlib.decompressobj(-15), b""
        self.crc = self.long = 0

    def feed(self, n: int) -> bool:
        while True:
            if not self.raw:
                self.raw = self.f.read_at(min(max(n, 1 << 10), self.stop - self.at), self.at) if self.at < self.stop else b""
                self.at += len(self.raw)
            if not self.raw or self.z.eof:
                return False
            try:
                part = self.z.decompress(self.raw, max(n, 1))
            except zlib.error as e:
                raise ValueError(f"{self.name}: damaged record at byte {self.start}: {e}") from e
            self.raw = self.z.unconsumed_tail
            if part:
                self.got += part
                self.crc, self.long = zlib.crc32(part, self.crc), self.long + len(part)
                return True

    def skip(self, n: int) -> None:
        """The rest of a member is never looked at."""
        self.got = b""
        self.long = -1 << 62

    def close(self) -> None:
        if self.long < 0:
            return
        while self.feed(1 << 16):
            pass
        if struct.unpack("<II", self.f.read_at(8, self.stop)) != (self.crc, self.long & 0xFFFFFFFF):
            raise ValueError(f"{self.name}: damaged record at byte {self.start}: wrong checksum")


class WarcSource(DataSource):
    """``spark.read.format("warc").option("payloads", "false").load(path)`` and ``df.write.format("warc").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make ``warc`` a format of the session; predicates only reach Python sources where the session allows it."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
