"""Block-compressed VCF (BGZF): read by many tasks, read by region through tabix indexes, written in indexed parts.

A BGZF file is a row of small gzip members, each of which says how long it is, so a task can begin at any of them. The
reader cuts files into stretches of bytes; a task starts at the first block border in its stretch, leaves the line
that is under way there to the stretch before it, and goes on past its end until the line that is under way there is
complete. A region is read by the virtual offsets (block's place in the file, place in the block) that a tabix index
has for it: only these blocks are opened. The formats are those of the public SAM and tabix specifications.

    register(spark)
    spark.read.format("blocked_vcf").option("region", "chr2:1,000-2,000").option("samples", "a,b").load(path)

Options of the reader: path (a file, a folder of *.gz, a pattern on local disk, several after commas), split_bytes
(compressed bytes of a stretch), region (chromosome, or chromosome:from-to, 1-based and closed; records whose REF reaches into it
count), samples (their columns, found by each file's header). Files are opened by pyarrow's file systems, so a path may
name a store that pyarrow knows.

Edge cases: an ordinary gzip file is read whole by one task, by region too; a file without an index is read whole and
filtered; empty files and files of headers only have no rows; header lines may stand anywhere; a line of any length,
over any number of blocks, is one row; a last line without a line feed counts; missing fields at a line's end are null;
a block that is damaged or cut off ends the job with an error that names file and place. A region on a chromosome
that isn't there has no rows; one that isn't understood is an error.
"""

from __future__ import annotations

import glob
import os
import re
import struct
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Fixed values of the format: the empty block that ends a file, the most bytes a block may hold, index geometry.
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
MOST = 0xFF00
LINEAR = 14
LEVELS = [(0, 29), (1, 26), (9, 23), (73, 20), (585, 17), (4681, 14)]

COLUMNS = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info"]
BATCH = 4_000_000  # bytes of lines in a record batch


# --- blocks -------------------------------------------------------------------------------------------------


def _system(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = re.sub(r"^file:/*", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files_of(paths: str) -> list[str]:
    """The files that a list of paths names, in order."""
    out = []
    for path in filter(None, (p.strip() for p in paths.split(","))):
        system, at = _system(path)
        if any(c in at for c in "*?["):
            out += sorted(glob.glob(at))
            continue
        info = system.get_file_info(at)
        if info.type == fs.FileType.Directory:
            prefix = "" if isinstance(system, fs.LocalFileSystem) else path[: len(path) - len(at)]
            out += sorted(prefix + f.path for f in system.get_file_info(fs.FileSelector(at)) if f.path.endswith(".gz") and not os.path.basename(f.path).startswith(("_", ".")))
        elif info.type == fs.FileType.File:
            out.append(path)
        else:
            raise FileNotFoundError(path)
    return out


def block(data: bytes) -> bytes:
    """One BGZF block of at most MOST bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = packer.compress(data) + packer.flush()
    head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(packed) + 25)
    return head + packed + struct.pack("<II", zlib.crc32(data), len(data))


def _size_of(head: bytes) -> int | None:
    """Bytes of the block that begins here; None if none does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    extra, at = struct.unpack_from("<H", head, 10)[0], 12
    while at + 4 <= min(12 + extra, len(head)):
        kind, length = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if kind == b"BC" and length == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + length
    return None


class Blocks:
    """Blocks of one open file."""

    def __init__(self, path: str):
        system, at = _system(path)
        self.path, self.file = path, system.open_input_file(at)
        self.size = self.file.size()

    def blocked(self) -> bool:
        return self.size == 0 or _size_of(self.file.read_at(min(self.size, 4096), 0)) is not None

    def border(self, start: int) -> int:
        """Place of the first block at or after start: one that others follow up to the file's end or three of them."""
        if start <= 0:
            return 0
        window = self.file.read_at(min(1 << 18, max(self.size - start, 0)), start) if start < self.size else b""
        at = window.find(b"\x1f\x8b\x08\x04")
        while at >= 0:
            place = start + at
            for _ in range(3):
                size = _size_of(self.file.read_at(min(4096, self.size - place), place)) if place < self.size else None
                if size is None:
                    break
                place += size
            if place == self.size or size is not None:
                return start + at
            at = window.find(b"\x1f\x8b\x08\x04", at + 1)
        return self.size

    def data(self, place: int, end: int | None = None) -> Iterator[tuple[int, bytes]]:
        """(place of the next block, bytes) of every block from place on, to end or the file's end."""
        end = self.size if end is None else min(end, self.size)
        while place < end:
            head = self.file.read_at(min(1 << 16, self.size - place), place)
            size = _size_of(head)
            if size is None or place + size > self.size:
                raise ValueError(f"{self.path}: no whole block at {place}")
            raw = head if size <= len(head) else self.file.read_at(size, place)
            extra = struct.unpack_from("<H", raw, 10)[0]
            crc, length = struct.unpack_from("<II", raw, size - 8)
            try:
                out = zlib.decompress(raw[12 + extra : size - 8], -15)
            except zlib.error:
                out = b""
            if len(out) != length or zlib.crc32(out) != crc:
                raise ValueError(f"{self.path}: damaged block at {place}")
            place += size
            yield place, out

    def plain(self) -> Iterator[bytes]:
        """The bytes of an ordinary gzip file of any number of members, piece by piece."""
        at, packer, begun = 0, zlib.decompressobj(31), False
        while at < self.size:
            raw = self.file.read_at(min(1 << 20, self.size - at), at)
            at += len(raw)
            while raw:
                try:
                    yield packer.decompress(raw)
                except zlib.error as e:
                    raise ValueError(f"{self.path}: damaged before {at}") from e
                begun, raw = not packer.eof, packer.unused_data
                if packer.eof:
                    packer = zlib.decompressobj(31)
        if begun:
            raise ValueError(f"{self.path}: cut off at {at}")


def _lines_between(blocks: Blocks, start: int, end: int) -> Iterator[bytes]:
    """Whole lines, many at a time, of the stretch [start, end) of a file."""
    begin, skip, held = blocks.border(start), start > 0, []
    stop = blocks.border(end) if end < blocks.size else blocks.size
    if begin >= stop:
        return
    size, inside = 0, True
    for following, data in blocks.data(begin):
        inside = following <= stop
        if skip:
            cut = data.find(b"\n")
            if cut < 0 and inside:
                continue
            if not inside:
                return  # no line begins in this stretch
            skip, data = False, data[cut + 1 :]
        if not inside:
            cut = data.find(b"\n")
            held.append(data if cut < 0 else data[: cut + 1])
            if cut >= 0:
                break
            continue
        held.append(data)
        size += len(data)
        if size >= BATCH:
            whole, rest = _cut(b"".join(held))
            held, size = [rest], len(rest)
            if whole:
                yield whole
    yield b"".join(held)


def _cut(data: bytes) -> tuple[bytes, bytes]:
    at = data.rfind(b"\n") + 1
    return data[:at], data[at:]


def _lines_of(pieces: Iterator[bytes]) -> Iterator[bytes]:
    held: list[bytes] = []
    size = 0
    for piece in pieces:
        held.append(piece)
        size += len(piece)
        if size >= BATCH:
            whole, rest = _cut(b"".join(held))
            held, size = [rest], len(rest)
            if whole:
                yield whole
    yield b"".join(held)


# --- index --------------------------------------------------------------------------------------------------


def _bin_of(begin: int, end: int) -> int:
    """The smallest bin that holds [begin, end)."""
    for first, shift in reversed(LEVELS):
        if begin >> shift == (end - 1) >> shift:
            return first + (begin >> shift)
    return 0


def _bins_over(begin: int, end: int) -> set[int]:
    return {b for first, shift in LEVELS for b in range(first + (begin >> shift), first + ((end - 1) >> shift) + 1)}


class IndexBuilder:
    """A tabix index of records that come in order of chromosome and position."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.bins: list[dict[int, list[list[int]]]] = []
        self.linear: list[dict[int, int]] = []

    def add(self, chrom: str, begin: int, end: int, first: int, last: int) -> None:
        """A record over [begin, end) between two virtual offsets."""
        if not self.names or self.names[-1] != chrom:
            if chrom in self.names:
                raise ValueError(f"records of {chrom} don't stand together")
            self.names.append(chrom)
            self.bins.append(defaultdict(list))
            self.linear.append({})
        end = max(end, begin + 1)
        chunks = self.bins[-1][_bin_of(begin, end)]
        if chunks and chunks[-1][1] == first:
            chunks[-1][1] = last
        else:
            chunks.append([first, last])
        for window in range(begin >> LINEAR, ((end - 1) >> LINEAR) + 1):
            self.linear[-1].setdefault(window, first)

    def bytes(self) -> bytes:
        names = b"".join(n.encode() + b"\0" for n in self.names)
        out = [b"TBI\1", struct.pack("<8i", len(self.names), 2, 1, 2, 0, ord("#"), 0, len(names)), names]
        for bins, linear in zip(self.bins, self.linear):
            out.append(struct.pack("<i", len(bins)))
            for number, chunks in sorted(bins.items()):
                out.append(struct.pack("<Ii", number, len(chunks)))
                out += [struct.pack("<QQ", *c) for c in chunks]
            offsets, last = [], 0
            for window in range(max(linear) + 1):
                last = linear.get(window, last)
                offsets.append(last)
            out.append(struct.pack(f"<i{len(offsets)}Q", len(offsets), *offsets))
        raw = b"".join(out)
        return b"".join(block(raw[i : i + MOST]) for i in range(0, len(raw), MOST)) + END


def region_chunks(index: bytes, chrom: str, begin: int, end: int) -> list[tuple[int, int]]:
    """Virtual offsets (from, to) of the stretches that may hold records over [begin, end), merged and in order."""
    count, *_, length = struct.unpack_from("<8i", index, 4)
    names, at = index[36 : 36 + length].split(b"\0"), 36 + length
    for i in range(count):
        wanted, found = names[i].decode() == chrom, []
        over = _bins_over(max(begin, 0), min(max(end, begin + 1), 1 << 29)) if wanted else set()
        (bins,), at = struct.unpack_from("<i", index, at), at + 4
        for _ in range(bins):
            number, chunks = struct.unpack_from("<Ii", index, at)
            if number in over:
                found += [struct.unpack_from("<QQ", index, at + 8 + 16 * k) for k in range(chunks)]
            at += 8 + 16 * chunks
        (windows,), at = struct.unpack_from("<i", index, at), at + 4
        if wanted:
            window = min(max(begin, 0) >> LINEAR, windows - 1)
            least = struct.unpack_from("<Q", index, at + 8 * window)[0] if windows else 0
            merged: list[list[int]] = []
            for first, last in sorted(c for c in found if c[1] > least):
                if merged and first >> 16 <= merged[-1][1] >> 16:
                    merged[-1][1] = max(merged[-1][1], last)
                else:
                    merged.append([first, last])
            return [(a, b) for a, b in merged]
        at += 8 * windows
    return []


def _lines_by_offsets(blocks: Blocks, first: int, last: int) -> Iterator[bytes]:
    """Whole lines between two virtual offsets, both of which are line borders."""

    def pieces() -> Iterator[bytes]:
        place, skip = first >> 16, first & 0xFFFF
        for following, data in blocks.data(place, (last >> 16) + 1):
            upto = last & 0xFFFF if place == last >> 16 else len(data)
            yield data[skip if place == first >> 16 else 0 : upto]
            place = following

    yield from _lines_of(pieces())


# --- data source --------------------------------------------------------------------------------------------


class Stretch(InputPartition):
    """Part of a file: bytes [start, end), the whole of an ordinary gzip file (end -1), or with `virtual` the lines
    between two virtual offsets."""

    def __init__(self, path: str, start: int, end: int, virtual: bool = False):
        self.path, self.start, self.end, self.virtual = path, start, end, virtual


def parse_region(region: str) -> tuple[str, int, int]:
    """(chromosome, begin, end): 0-based and half open."""
    m = re.fullmatch(r"([^:\s]+)(?::([\d,]+)(?:-([\d,]+))?)?", region.strip())
    number = lambda t: int(t.replace(",", ""))
    begin, end = (number(m[2]) - 1 if m[2] else 0, number(m[3]) if m[3] else 1 << 29) if m else (0, 0)
    if begin < 0 or end <= begin:
        raise ValueError(f"not a region: {region!r}")
    return m[1], begin, end


class BlockedVcf(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blocked_vcf"

    def _samples(self) -> list[str]:
        return [s for s in self.options.get("samples", "").split(",") if s]

    def schema(self) -> str:
        more = "".join(f", `{s}` string" for s in ["format", *self._samples()]) if self._samples() else ""
        return "chrom string, pos long, id string, ref string, alt string, qual string, filter string, info string" + more

    def reader(self, schema) -> BlockedReader:
        return BlockedReader(self.options["path"], int(self.options.get("split_bytes", 32_000_000)), self.options.get("region"), self._samples())

    def writer(self, schema, overwrite: bool) -> PartsWriter:
        return PartsWriter(self.options["path"], self.options.get("header", ""), overwrite, schema.fieldNames())


class BlockedReader(DataSourceReader):
    def __init__(self, paths: str, split: int, region: str | None, samples: list[str]):
        self.paths, self.split, self.samples = paths, max(split, 1), samples
        self.region = parse_region(region) if region else None

    def partitions(self) -> list[Stretch]:
        out = []
        for path in files_of(self.paths):
            blocks = Blocks(path)
            index = f"{path}.tbi"
            system, at = _system(index)
            if not blocks.blocked():
                out.append(Stretch(path, 0, -1))
            elif self.region and system.get_file_info(at).type == fs.FileType.File:
                raw = b"".join(data for _, data in Blocks(index).data(0))
                out += [Stretch(path, a, b, True) for a, b in region_chunks(raw, *self.region)]
            else:
                out += [Stretch(path, a, min(a + self.split, blocks.size)) for a in range(0, blocks.size, self.split)]
        return out or [Stretch("", 0, 0)]

    def _sample_columns(self, path: str) -> list[int]:
        """Where the samples' columns are, by the file's header."""
        blocks = Blocks(path)
        pieces = (data for _, data in blocks.data(0)) if blocks.blocked() else blocks.plain()
        for lines in _header(pieces):
            if lines.startswith(b"#CHROM"):
                names = lines.decode().rstrip("\r\n").split("\t")
                missing = [s for s in self.samples if s not in names[9:]]
                if missing:
                    raise ValueError(f"{path}: no samples {', '.join(missing)}")
                return [names.index(s, 9) for s in self.samples]
        raise ValueError(f"{path}: no line with the samples' names")

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        blocks = Blocks(part.path)
        columns = self._sample_columns(part.path) if self.samples else []
        if part.end < 0:
            pieces = _lines_of(blocks.plain())
        elif part.virtual:
            pieces = _lines_by_offsets(blocks, part.start, part.end)
        else:
            pieces = _lines_between(blocks, part.start, part.end)
        for lines in pieces:
            batch = self._batch(lines, columns)
            if batch.num_rows:
                yield batch

    def _batch(self, lines: bytes, columns: list[int]) -> pa.RecordBatch:
        rows = [line.rstrip("\r").split("\t") if columns else line.rstrip("\r").split("\t", 8) for line in lines.decode().split("\n") if line.strip() and line[0] != "#"]
        if self.region:
            chrom, begin, end = self.region
            rows = [r for r in rows if r[0] == chrom and len(r) > 3 and int(r[1]) - 1 < end and int(r[1]) - 1 + max(len(r[3]), 1) > begin]
        field = lambda i: [r[i] if i < len(r) else None for r in rows]
        arrays = [pa.array(field(i), pa.string()) if i != 1 else pa.array([int(r[1]) if len(r) > 1 else None for r in rows], pa.int64()) for i in range(8)]
        names = [*COLUMNS]
        if columns:
            arrays += [pa.array(field(i), pa.string()) for i in (8, *columns)]
            names += ["format", *self.samples]
        return pa.RecordBatch.from_arrays(arrays, names)


def _header(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Header lines one by one, up to the first other line."""
    rest = b""
    for piece in pieces:
        *lines, rest = (rest + piece).split(b"\n")
        for line in lines:
            if not line.startswith(b"#"):
                return
            yield line
    if rest.startswith(b"#"):
        yield rest


class _Written(WriterCommitMessage):
    def __init__(self, number: int, temporary: str):
        self.number, self.temporary = number, temporary


class PartsWriter(DataSourceArrowWriter):
    """Writes each partition of rows (chrom, pos, ref, line) as part-<n>.vcf.gz with its index.

    A task writes under a name of its own; the names become the parts' when all tasks are done, so a repeated or lost
    task leaves nothing behind that a reader sees.
    """

    def __init__(self, path: str, header: str, overwrite: bool, names: list[str]):
        self.path, self.header, self.overwrite, self.names = path, header, overwrite, names
        if missing := {"chrom", "pos", "ref", "line"} - set(names):
            raise ValueError(f"blocked_vcf: missing columns {', '.join(sorted(missing))}")
        system, at = _system(path)
        if not overwrite and system.get_file_info(at).type != fs.FileType.NotFound:
            raise FileExistsError(path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        system, at = _system(self.path)
        system.create_dir(at, recursive=True)
        name = f"{at}/_{uuid.uuid4().hex}"
        index, held, place = IndexBuilder(), bytearray(), 0
        with system.open_output_stream(f"{name}.gz", compression=None) as out:

            def put(data: bytes) -> None:
                nonlocal place
                held.extend(data)
                while len(held) >= MOST:
                    packed = block(bytes(held[:MOST]))
                    out.write(packed)
                    place += len(packed)
                    del held[:MOST]

            put(self.header.encode())
            for batch in iterator:
                rows = zip(*(batch.column(c).to_pylist() for c in ("chrom", "pos", "ref", "line")))
                for chrom, pos, ref, line in rows:
                    first = place << 16 | len(held)
                    put(f"{line}\n".encode())
                    index.add(chrom, pos - 1, pos - 1 + len(ref or ""), first, place << 16 | len(held))
            if held:
                out.write(block(bytes(held)))
            out.write(END)
        with system.open_output_stream(f"{name}.tbi", compression=None) as out:
            out.write(index.bytes())
        return _Written(TaskContext.get().partitionId(), name)

    def commit(self, messages: list[_Written | None]) -> None:
        system, at = _system(self.path)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(at)):
                if os.path.basename(f.path).startswith("part-"):
                    system.delete_file(f.path)
        for m in messages:
            if m is not None:
                system.move(f"{m.temporary}.tbi", f"{at}/part-{m.number:05d}.vcf.gz.tbi")
                system.move(f"{m.temporary}.gz", f"{at}/part-{m.number:05d}.vcf.gz")

    def abort(self, messages: list[_Written | None]) -> None:
        system, _ = _system(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(f"{m.temporary}.gz")
                system.delete_file(f"{m.temporary}.tbi")


def register(spark: SparkSession) -> None:
    """Makes the format known to a session; executors need this package on their path."""
    spark.dataSource.register(BlockedVcf)


def read_vcf_blocks(spark: SparkSession, path: str, region: str | None = None, samples: list[str] = (), split_bytes: int = 32_000_000) -> DataFrame:
    """Records of block-compressed VCF files, all or those that reach into a region."""
    register(spark)
    reader = spark.read.format("blocked_vcf").option("split_bytes", split_bytes)
    reader = reader.option("region", region) if region else reader
    return (reader.option("samples", ",".join(samples)) if samples else reader).load(path)


def write_vcf_blocks(df: DataFrame, path: str, info: dict[str, Column], header: list[str], rank: Column | None = None, parts: int | None = None, samples: dict[str, Column] | None = None) -> None:
    """A folder of parts in order of chromosome and position, each a VCF with the header, sorted body and an index.

    rank: the order of chromosomes, their natural one unless given; (chrom, pos, id, ref, alt, qual, filter) and INFO
    columns as writers.vcf_lines takes them. A chromosome may reach over several parts.
    """
    from seqlume.functions.sequence import chromosome_rank

    from .writers import vcf_lines

    register(df.sparkSession)
    lines = vcf_lines(df, info, samples).select((rank if rank is not None else chromosome_rank("chrom")).alias("_rank"), "chrom", F.col("pos").cast("long").alias("pos"), "ref", "alt", "line")
    order = ["_rank", "chrom", "pos", "ref", "alt", "line"]
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.repartitionByRange(parts, *order[:5]).sortWithinPartitions(*order)
    dealt.select("chrom", "pos", "ref", "line").write.format("blocked_vcf").option("header", "".join(f"{h}\n" for h in header)).mode("append").save(path)
