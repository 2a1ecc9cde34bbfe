"""Texts of files and of what archives hold, however deeply: gzip, zip, tar (of any compression) and notebooks.

A task opens one file and streams what is in it, an archive's members one after another; kinds are told by their first
bytes, so names don't matter. Texts come in chunks that overlap by `overlap` bytes, so that what is looked for is in one
of them whole. A zip file inside another archive needs to be read out of order: it is kept in a temporary file of the
task for as long as it is read.

    register(spark)
    spark.read.format("archive_texts").option("path", "/data/deposit").load()

Options: path (folders and files after commas), chunk, overlap, max_bytes (of one member), max_depth. Nothing is
dropped silently: a member's last row says in `status` whether it is whole (`ok`), was read up to max_bytes only
(`too large`), lies deeper than max_depth (`too deep`), couldn't be read to its end (`damaged`), or is a symbolic
link that isn't followed (`link`).

Edge cases: an empty file has one row with an empty text; bytes that are no UTF-8 are replaced; a folder without files
has no rows; encrypted zip members are `damaged`; folders named .git are left out; of a notebook the strings of its JSON
are taken, each on a line, but for those under media types; a notebook that is no JSON is read as a text.
"""

from __future__ import annotations

import gzip
import io
import json
import os
import re
import tarfile
import tempfile
import zipfile
import zlib
from collections.abc import Iterator
from typing import IO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .blocks import _system

MEDIA = re.compile(r"^(image|audio|video)/|^application/pdf$")
NAMES = ["path", "member", "chunk", "text", "n_bytes", "status"]
_BROKEN = (OSError, EOFError, RuntimeError, NotImplementedError, ValueError, zlib.error, zipfile.BadZipFile, tarfile.TarError)


class ArchiveTexts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive_texts"

    def schema(self) -> str:
        return "path string, member string, chunk int, text string, n_bytes long, status string"

    def reader(self, schema) -> ArchiveReader:
        number = lambda n, default: int(self.options.get(n, default))
        return ArchiveReader(self.options["path"], number("chunk", 1 << 20), number("overlap", 4096), number("max_bytes", 1 << 32), number("max_depth", 8))


class OneFile(InputPartition):
    def __init__(self, path: str, link: bool = False):
        self.path, self.link = path, link


class ArchiveReader(DataSourceReader):
    def __init__(self, paths: str, chunk: int, overlap: int, max_bytes: int, max_depth: int):
        if not 0 <= overlap < chunk:
            raise ValueError("overlap must be less than chunk")
        self.paths, self.chunk, self.overlap, self.max_bytes, self.max_depth = paths, chunk, overlap, max_bytes, max_depth

    def partitions(self) -> list[OneFile]:
        out = []
        for path in filter(None, (p.strip() for p in self.paths.split(","))):
            system, at = _system(path)
            local = isinstance(system, fs.LocalFileSystem)
            prefix = "" if local else path[: len(path) - len(at)]
            if system.get_file_info(at).type == fs.FileType.File:
                out.append(OneFile(prefix + at))
                continue
            found = [f for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if ".git" not in f.path.split("/")]
            links = {f.path for f in found if local and os.path.islink(f.path)}
            inside = lambda p: any(p.startswith(f"{x}/") for x in links)  # noqa: E731, B023
            out += [OneFile(prefix + f.path, f.path in links) for f in found if (f.type == fs.FileType.File or f.path in links) and not inside(f.path)]
        return sorted(out, key=lambda f: f.path) or [OneFile("")]

    def read(self, part: OneFile) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        rows = iter([("", 0, "", 0, "link")]) if part.link else self._file(part.path)
        for member, chunk, text, n, status in rows:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part.path, member, chunk, text, n, status), (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string()))], NAMES)

    def _file(self, path: str) -> Iterator[tuple]:
        system, at = _system(path)
        with system.open_input_file(at) as f:
            yield from self._walk(io.BufferedReader(f, 1 << 16) if not isinstance(f, io.BufferedIOBase) else f, "", 0, os.path.basename(path))

    def _walk(self, f: IO[bytes], member: str, depth: int, name: str) -> Iterator[tuple]:
        """Rows (member, chunk, text, bytes so far, status) of a stream; member is the way from the file to it."""
        try:
            head = _peeked(f, 512)
            kind = _kind(head, name)
            if kind in ("gzip", "zip", "tar") and depth >= self.max_depth:
                yield member, 0, "", 0, "too deep"
            elif kind == "gzip":
                inner = gzip.GzipFile(fileobj=f)
                yield from self._walk(io.BufferedReader(inner), f"{member}!gz", depth + 1, name.removesuffix(".gz"))
            elif kind == "tar":
                with tarfile.open(fileobj=f, mode="r|*") as tar:
                    for entry in tar:
                        if entry.isfile():
                            yield from self._walk(io.BufferedReader(tar.extractfile(entry)), f"{member}!{entry.name}", depth + 1, entry.name)
                        elif entry.issym() or entry.islnk():
                            yield f"{member}!{entry.name}", 0, "", 0, "link"
            elif kind == "zip":
                yield from self._zip(f, member, depth)
            else:
                yield from self._texts(_notebook(f, self.max_bytes) if kind == "notebook" else f, member)
        except _BROKEN:
            yield member, 0, "", 0, "damaged"

    def _zip(self, f: IO[bytes], member: str, depth: int) -> Iterator[tuple]:
        with tempfile.TemporaryFile() as kept:
            size = 0
            while data := f.read(1 << 20):
                size += len(data)
                if size > self.max_bytes:
                    yield member, 0, "", size, "too large"
                    return
                kept.write(data)
            with zipfile.ZipFile(kept) as archive:
                for entry in archive.infolist():
                    if not entry.is_dir():
                        where = f"{member}!{entry.filename}"
                        try:
                            inner = archive.open(entry)
                        except _BROKEN:
                            yield where, 0, "", 0, "damaged"
                            continue
                        with inner:
                            yield from self._walk(io.BufferedReader(inner), where, depth + 1, entry.filename)

    def _texts(self, f: IO[bytes], member: str) -> Iterator[tuple]:
        chunk, seen, tail, status = 0, 0, b"", "ok"
        waiting: tuple | None = None
        while True:
            try:
                data = f.read(min(self.chunk - len(tail), self.max_bytes - seen))
                more = not data and seen >= self.max_bytes and bool(f.read(1))
            except _BROKEN:
                data, more, status = b"", False, "damaged"
            if not data:
                status = "too large" if more else status
                yield (*waiting[:4], status) if waiting else (member, 0, "", 0, status)
                return
            if waiting:
                yield waiting
            seen += len(data)
            whole = tail + data
            waiting = (member, chunk, whole.decode("utf-8", "replace"), seen, None)
            chunk, tail = chunk + 1, whole[-self.overlap :] if self.overlap else b""


def _peeked(f: IO[bytes], n: int) -> bytes:
    if hasattr(f, "peek"):
        return f.peek(n)[:n]
    head = f.read(n)
    f.seek(0)
    return head


def _kind(head: bytes, name: str) -> str:
    if head[:2] == b"\x1f\x8b":
        return "gzip"
    if head[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        return "zip"
    if head[257:262] == b"ustar" or head[:3] == b"BZh" or head[:6] == b"\xfd7zXZ\x00":
        return "tar"
    return "notebook" if name.endswith(".ipynb") else "text"


def _notebook(f: IO[bytes], most: int) -> IO[bytes]:
    """The strings of a notebook's JSON, each on a line; the bytes as they are where it is too large or no JSON."""
    raw = f.read(most + 1)
    try:
        found, todo = [], [json.loads(raw)] if len(raw) <= most else None
    except (ValueError, RecursionError):
        todo = None
    if todo is None:
        return io.BytesIO(raw)
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            found.append(x)
        elif isinstance(x, list):
            todo += reversed(x)
        elif isinstance(x, dict):
            todo += [v for k, v in reversed(x.items()) if not MEDIA.match(k)]
    return io.BytesIO("\n".join(found).encode("utf-8", "replace"))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session; executors need this package on their path."""
    spark.dataSource.register(ArchiveTexts)


def archive_texts(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """(path, member, chunk, text, n_bytes, status): all texts under a path; n_bytes is how many were read so far."""
    register(spark)
    reader = spark.read.format("archive_texts")
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load(path)
