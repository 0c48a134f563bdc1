"""WARC and WET archives as a data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

An archive is a row of gzip members, as a rule one for each record. A file is cut into byte ranges, and a range owns the
members that start in it: its reader looks for the first bytes that are a member's header and inflate to ``WARC/``,
and reads on until a member starts in the next range. A damaged member costs itself: it becomes a row of type ``damaged``
that says why, and reading goes on at the next member. Which members are found doesn't depend on the ranges: whoever reads
the member before a gap reports the gap.

Archives that are one gzip member, or plain, are read by one task each, as a stream.
"""

from __future__ import annotations

import gzip
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from quillmill.operators.batches import slices

DAMAGED = "damaged"
SCHEMA = "path string, record_type string, url string, payload binary, position long"
SPLIT_BYTES = 64 << 20
_MAGIC = b"\x1f\x8b\x08"
_BLOCK = 1 << 20
_BATCH_BYTES = 1 << 20
_ARROW = pa.schema([("path", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("payload", pa.binary()), ("position", pa.int64())])
_BROKEN = (EOFError, OSError, zlib.error, ValueError)


def reachable(path: str) -> bool:
    """Whether tasks can open the path themselves: local paths, and stores that Arrow has a file system for."""
    scheme = path.split("://", 1)[0] if "://" in path else "file"
    return scheme.split(":")[0] in ("file", "s3", "gs", "gcs", "hdfs", "abfs", "abfss")


def _opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


def records(stream: io.BufferedIOBase) -> Iterator[tuple[str, str | None, bytes]]:
    """(type, target, payload) of every record. A record says its length, so payloads may hold anything.

    Each is given once what follows it has been read, so a single one comes only if its member's checksum is right.
    """
    held = None
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        if held:
            yield held
            held = None
        headers: dict[bytes, bytes] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.partition(b":")
            headers[name.strip().lower()] = value.strip()
        if not line:
            raise EOFError("a header is cut off")
        length = int(headers.get(b"content-length", b"0") or 0)
        body = stream.read(length)
        if len(body) < length:
            raise EOFError("a record is cut off")
        target = headers.get(b"warc-target-uri")
        held = headers.get(b"warc-type", b"").decode("latin-1"), target and target.decode("utf-8", "replace"), body
    if held:
        yield held


class _Member(io.RawIOBase):
    """What a gzip member holds, inflated as it is read; ``end`` is set to the byte after the member once it is through."""

    def __init__(self, file: pa.NativeFile, start: int) -> None:
        self.file, self.at, self.end, self.pending = file, start, 0, b""
        self.inflate = zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        while not self.end:
            if not self.pending:
                self.pending = self.file.read_at(_BLOCK, self.at)
                self.at += len(self.pending)
                if not self.pending:
                    raise EOFError("a member is cut off")
            out = self.inflate.decompress(self.pending, len(target))
            self.pending = self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.end = self.at - len(self.inflate.unused_data)
            if out:
                target[: len(out)] = out
                return len(out)
        return 0


def _starts(head: bytes) -> bool:
    """Whether these bytes are the beginning of a member that holds records."""
    if head[:3] != _MAGIC:
        return False
    try:
        return zlib.decompressobj(31).decompress(head, 5) == b"WARC/"
    except zlib.error:
        return False


def _next_start(file: pa.NativeFile, at: int, stop: int) -> int | None:
    """The first member that starts in [at, stop)."""
    while at < stop:
        block = file.read_at(_BLOCK + 2, at)
        found = block.find(_MAGIC)
        while found >= 0 and at + found < stop:
            if _starts(file.read_at(1 << 12, at + found)):
                return at + found
            found = block.find(_MAGIC, found + 1)
        if len(block) <= _BLOCK:
            return None
        at += _BLOCK
    return None


def members(file: pa.NativeFile, low: int, high: int) -> Iterator[tuple[int, str, str | None, bytes]]:
    """(start of the member, type, target, payload) of the records of all members that start in [low, high), and of damage there."""
    size = file.size()
    at: int | None = low
    if low or not _starts(file.read_at(1 << 12, 0)):
        if not low and size:
            yield 0, DAMAGED, None, b"no member starts here"
        at = _next_start(file, low, min(high, size))
    while at is not None and at < high:
        member = _Member(file, at)
        try:
            for record in records(io.BufferedReader(member, _BLOCK)):
                yield at, *record
        except _BROKEN as error:
            yield at, DAMAGED, None, str(error).encode()
            at = _next_start(file, at + 1, min(high, size))
            continue
        if member.end >= size:
            return
        if _starts(file.read_at(1 << 12, member.end)):
            at = member.end
        else:
            yield member.end, DAMAGED, None, b"no member starts here"
            at = _next_start(file, member.end + 1, min(high, size))


def plain(file: io.RawIOBase) -> Iterator[tuple[int, str, str | None, bytes]]:
    try:
        for record in records(io.BufferedReader(file, _BLOCK)):
            yield 0, *record
    except _BROKEN as error:
        yield 0, DAMAGED, None, str(error).encode()


@dataclass
class Split(InputPartition):
    path: str
    low: int
    high: int


class ArchiveReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.kind = options.get("type")
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))
        if self.split_bytes < 1:
            raise ValueError("splitBytes has to be positive")

    def partitions(self) -> list[Split]:
        store, path = _opened(self.path)
        found = store.get_file_info(path)
        if found.type == pa.fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [found] if found.is_file else store.get_file_info(pa.fs.FileSelector(path, recursive=True))
        splits = []
        for file in files:
            inside = file.path[len(path) :].split("/")
            if not file.is_file or any(part[:1] in ("_", ".") for part in inside if part):
                continue
            step = self.split_bytes if file.path.endswith(".gz") else max(1, file.size)
            splits += [Split(file.path, low, min(low + step, file.size)) for low in range(0, file.size, step)]
        return splits or [Split("", 0, 0)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if not split.path:
            return
        store, _ = _opened(self.path)
        held: list[tuple] = []
        size = 0
        with store.open_input_file(split.path) as file:
            zipped = file.read_at(2, 0) == _MAGIC[:2]
            file.seek(0)
            for position, kind, url, body in members(file, split.low, split.high) if zipped or split.low or split.path.endswith(".gz") else plain(file):
                if kind != DAMAGED and self.kind not in (None, kind):
                    continue
                held.append((split.path, kind, url, body, position))
                size += len(body) + 64
                if size > _BATCH_BYTES:
                    yield batch_of(held)
                    held, size = [], 0
        if held:
            yield batch_of(held)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def record_bytes(kind: str | None, url: str | None, payload: bytes | None) -> bytes:
    """A record with its header and the two empty lines that end it."""
    body = payload or b""
    target = f"WARC-Target-URI: {' '.join(url.split())}\r\n" if url else ""
    return f"WARC/1.0\r\nWARC-Type: {kind or 'resource'}\r\n{target}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def member_bytes(kind: str | None, url: str | None, payload: bytes | None, level: int = 6) -> bytes:
    return gzip.compress(record_bytes(kind, url, payload), level, mtime=0)


@dataclass
class Written(WriterCommitMessage):
    hidden: str
    final: str


class ArchiveWriter(DataSourceArrowWriter):
    """A file for each task, written under a hidden name and given its own once all tasks are through.

    Columns ``record_type``, ``url`` and ``payload`` (text or bytes); with the option ``verbatim`` the payloads are members
    already.
    """

    def __init__(self, options, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.verbatim = options.get("verbatim", "false").lower() == "true"
        self.level = int(options.get("level", 6))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, path = _opened(self.path)
        store.create_dir(path, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        with store.open_output_stream(f"{path}/_{name}", compression=None) as out:
            for batch in slices(iterator, max_bytes=_BATCH_BYTES):
                names = batch.schema.names
                payloads = batch.column("payload").cast(pa.binary()).to_pylist()
                if self.verbatim:
                    out.write(b"".join(p or b"" for p in payloads))
                    continue
                kinds, urls = (batch.column(c).to_pylist() if c in names else [None] * len(payloads) for c in ("record_type", "url"))
                for kind, url, payload in zip(kinds, urls, payloads, strict=True):
                    out.write(member_bytes(kind, url, payload, self.level))
        return Written(f"{path}/_{name}", f"{path}/{name}")

    def commit(self, messages) -> None:
        store, path = _opened(self.path)
        done = [m for m in messages if m]
        if self.overwrite and store.get_file_info(path).type == pa.fs.FileType.Directory:
            keep = {m.hidden for m in done}
            for old in store.get_file_info(pa.fs.FileSelector(path)):
                if old.is_file and old.path not in keep:
                    store.delete_file(old.path)
        for message in done:
            store.move(message.hidden, message.final)
        store.open_output_stream(f"{path}/_SUCCESS").close()

    def abort(self, messages) -> None:
        store, _ = _opened(self.path)
        for message in messages:
            if message:
                store.delete_file(message.hidden)


class ArchiveSource(DataSource):
    """Options: ``path``; reading: ``type`` (of records; damage is always told), ``splitBytes``; writing: ``level``, ``verbatim``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    spark.dataSource.register(ArchiveSource)
