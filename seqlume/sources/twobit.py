"""The .2bit format by range: an index pass, then a task for each run of pieces, read at its offset.

Planning reads a file's list of sequences and each one's length. A task reads the sequence's N blocks and the packed
bases of its own run, so a file or a chromosome may be larger than any machine's memory.

Edge cases: an empty sequence is one piece without letters; bases in N blocks are N; soft masks are left out, all
letters are upper case; both byte orders are read; a file that is none of the format is an error that names it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .blocks import _system, files_of

SIGN = 0x1A412743
LETTERS = np.frombuffer(b"TCAG", np.uint8)


class TwoBit(DataSource):
    @classmethod
    def name(cls) -> str:
        return "two_bit"

    def schema(self) -> str:
        return "chrom string, chunk_start long, seq string"

    def reader(self, schema) -> TwoBitReader:
        number = lambda n, default: int(self.options.get(n, default))
        return TwoBitReader(self.options["path"], number("size", 100_000), number("overlap", 1_000), number("bases", 50_000_000))


class Run(InputPartition):
    """Pieces of one sequence that begin in [begin, end)."""

    def __init__(self, path: str, chrom: str, place: int, begin: int, end: int):
        self.path, self.chrom, self.place, self.begin, self.end = path, chrom, place, begin, end


class _File:
    def __init__(self, path: str):
        system, at = _system(path)
        self.file = system.open_input_file(at)
        sign = self.file.read_at(4, 0)
        self.order = next((o for o in "<>" if len(sign) == 4 and struct.unpack(f"{o}I", sign)[0] == SIGN), "")
        if not self.order:
            raise ValueError(f"{path} is no .2bit file")

    def words(self, at: int, n: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at(4 * n, at), f"{self.order}u4").astype(np.int64)

    def index(self) -> Iterator[tuple[str, int]]:
        """(name, place) of every sequence."""
        at = 16
        for _ in range(int(self.words(8, 1)[0])):
            n = self.file.read_at(1, at)[0]
            yield self.file.read_at(n, at + 1).decode(), int(self.words(at + 1 + n, 1)[0])
            at += 5 + n


class TwoBitReader(DataSourceReader):
    def __init__(self, paths: str, size: int, overlap: int, bases: int):
        if size < 1 or overlap < 0:
            raise ValueError("pieces must have letters")
        self.paths, self.size, self.overlap = paths, size, overlap
        self.step = max(bases // size, 1) * size

    def partitions(self) -> list[Run]:
        out = []
        for path in files_of(self.paths):
            file = _File(path)
            for chrom, place in file.index():
                length = int(file.words(place, 1)[0])
                out += [Run(path, chrom, place, a, min(a + self.step, max(length, 1))) for a in range(0, max(length, 1), self.step)]
        return out or [Run("", "", 0, 0, 0)]

    def read(self, run: Run) -> Iterator[pa.RecordBatch]:
        if not run.path:
            return
        file = _File(run.path)
        length, blocks = file.words(run.place, 2).tolist()
        starts, sizes = file.words(run.place + 8, 2 * blocks).reshape(2, blocks) if blocks else np.empty((2, 0), np.int64)
        masks = run.place + 8 + 8 * blocks
        packed = masks + 4 + 8 * int(file.words(masks, 1)[0]) + 4
        for begin in range(run.begin, run.end, self.size):
            end = min(begin + self.size + self.overlap, length)
            raw = np.frombuffer(file.file.read_at(max(-(-end // 4) - begin // 4, 0), packed + begin // 4), np.uint8)
            bases = LETTERS[(raw[:, None] >> np.array([6, 4, 2, 0])) & 3].reshape(-1)[begin % 4 : begin % 4 + max(end - begin, 0)].copy()
            for i in np.flatnonzero((starts < end) & (starts + sizes > begin)).tolist():
                bases[max(starts[i] - begin, 0) : max(starts[i] + sizes[i] - begin, 0)] = ord("N")
            yield pa.RecordBatch.from_arrays([pa.array([run.chrom]), pa.array([begin], pa.int64()), pa.array([bases.tobytes().decode()])], ["chrom", "chunk_start", "seq"])
