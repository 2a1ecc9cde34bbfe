"""Shared pieces of the training-data operators: staging, byte-level words, tokenizer memo."""

from __future__ import annotations

import contextlib
import gc
import hashlib
import json
import os
import re
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_SHIPPED: set[str] = set()
_STAGED: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Local mode, as in tests, gets an own one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset; it has to name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="seqlume-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Makes this package importable by Python workers that do not have it on their path."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.join(tempfile.mkdtemp(prefix="seqlume-ship-"), "seqlume.zip")
    with zipfile.ZipFile(name, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(name)
    _SHIPPED.add(app)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bounds the bytes of Arrow batches that are sent to Python, unless the session does so already: by default, the
    texts of a whole task may be one batch, which the task holds as it holds all that it makes of them."""
    if spark.conf.get(_BATCH_BYTES, None) is not None:
        yield
        return
    spark.conf.set(_BATCH_BYTES, "4m")
    try:
        yield
    finally:
        spark.conf.unset(_BATCH_BYTES)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    _STAGED[read] = path
    return read


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in tables:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_STAGED.pop(df))
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of tables that nothing refers to any more, between the steps of a long job."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(rows: DataFrame, parts: int) -> DataFrame:
    """rows in as many partitions, each row in that of its number `part`."""
    return rows.repartitionById(parts, F.col("part"))


def crc_mod(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string")) % F.lit(n)


# --- words as bytes ---------------------------------------------------------------------------------------

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def arrow_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows of a string column, one newline after each row, and each row's end. Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if len(column) == 0:
        return np.empty(0, np.uint8), np.empty(0, np.int64)
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    ends = offsets[1:] - offsets[0]
    out = np.insert(raw, ends, 10) if len(raw) else np.full(len(ends), 10, np.uint8)
    return out, ends + np.arange(1, len(ends) + 1)


def sliced(batch: pa.RecordBatch, column: str = "text", most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in even slices of about `most` bytes of text, so that arrays made from a slice stay small."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    each = -(-int(upto[-1]) // (round(int(upto[-1]) / most) or 1)) + 1 if len(upto) else 1
    ends = np.flatnonzero(np.diff(upto // each, append=-1))
    begin = 0
    for end in (ends + 1).tolist():
        yield batch.slice(begin, end - begin)
        begin = end


#: Everything but ASCII letters, digits and non-ASCII bytes separates words.
PUNCTUATED = ~_ASCII_LETTER
PUNCTUATED[48:58] = PUNCTUATED[128:] = False


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LONG = 512


def _lanes(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the end."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))


def piece_hashes(raw: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the pieces raw[first : first + size].

    Eight bytes at a time go into a state through a mixing step that is one to one, so pieces of one size that differ
    in one lane only never share a hash, and no arithmetic pattern of the bytes carries over to the hash; any two
    other pieces share one with a chance of 2**-64. Pieces beyond _LONG bytes are hashed by BLAKE2b.
    """
    lanes = _lanes(raw)
    h = mix64(size.astype(np.uint64) * _STEP + np.uint64(1))
    todo, at, left = np.arange(len(size)), first, size
    if len(size) and size.max() > _LONG:
        for i in np.flatnonzero(size > _LONG).tolist():
            digest = hashlib.blake2b(raw[first[i] : first[i] + size[i]].tobytes(), digest_size=8).digest()
            h[i] = np.frombuffer(digest, "<u8")[0]
        todo = np.flatnonzero(size <= _LONG)
        at, left = first[todo], size[todo]
    while len(todo):
        part = lanes[at] & _MASK[np.minimum(left, 8)]
        h[todo] = mix64((h[todo] ^ part) * _STEP)
        more = np.flatnonzero(left > 8)
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    return h


def word_hashes(column: pa.Array | pa.ChunkedArray, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+, A-Z in lower case, of all rows, and each row's word count.

    separators: another table of the bytes that end a word."""
    raw, ends = arrow_bytes(column)
    none = np.empty(0, np.uint64), np.zeros(len(ends), np.int64)
    if not len(raw):
        return none
    space = separators[raw]
    before = np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    first = np.flatnonzero(~space & before)
    if not len(first):
        return none
    size = np.flatnonzero(space & ~before) - first
    hashes = piece_hashes(_LOWER[raw], first, size)
    upto = np.searchsorted(first, ends)
    return hashes, np.diff(upto, prepend=0)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of every row (a row with 1 to n-1 words: the whole sequence as one) and their row numbers.

    Rows are not deduplicated here.
    """
    row = np.repeat(np.arange(len(counts)), counts)
    short = (counts > 0) & (counts < n)
    parts_h, parts_r = [], []
    if len(words) >= n:
        h = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            h *= _STEP
            h += words[k : len(words) - n + 1 + k]
        same = row[: len(words) - n + 1] == row[n - 1 :]
        parts_h.append(mix64(h[same]))
        parts_r.append(row[: len(words) - n + 1][same])
    ends = np.cumsum(counts)
    for size in range(1, n):
        at = np.flatnonzero(short & (counts == size))
        if len(at):
            s = ends[at] - size
            h = words[s].copy()
            for k in range(1, size):
                h *= _STEP
                h += words[s + k]
            parts_h.append(mix64(h + np.uint64(size)))
            parts_r.append(at)
    if not parts_h:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h, r = np.concatenate(parts_h), np.concatenate(parts_r)
    if short.any():
        order = np.argsort(r, kind="stable")
        h, r = h[order], r[order]
    return h, r


# --- tokenizer memo ---------------------------------------------------------------------------------------

#: Added tokens aside, texts with these go to the library whole: white space that only some pre-tokenizers know.
_ODD_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1(?:\x9a\x80|\xa0\x8e)|\xe2(?:\x80[\x80-\x8b\xa8\xa9\xaf]|\x81\x9f)|\xe3\x80\x80|\xef\xbb\xbf")
_ODD_FIRST = np.zeros(256, bool)
_ODD_FIRST[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
_WORD = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+\Z")
_ENCODERS: dict[tuple[str, int], "Encoder"] = {}

#: The kinds of vocabularies (normalizer, pre-tokenizer) whose cuts are known to hold, and whether they lower-case.
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
_KINDS = [
    (None, _BYTE_LEVEL | {"use_regex": True}, False),
    (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _WORD_SPLIT}, "behavior": "Removed", "invert": True}, _BYTE_LEVEL | {"use_regex": False}]},
        True,
    ),
]


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stay, the rest follow from U+0100."""
    stay = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in stay else chr(next(rest)) for b in range(256)]


def _odd_places(raw: np.ndarray, buffer: bytes) -> list[int]:
    """Where _ODD_SPACE matches; it is tried only at bytes that begin a match."""
    return [i for i in np.flatnonzero(_ODD_FIRST[raw]).tolist() if _ODD_SPACE.match(buffer, i)]


class Encoder:
    """Ids of whole texts by the tokenizers library, without encoding the same piece twice.

    A text is cut where the vocabulary's pre-tokenizer always cuts: where a run of white space begins, between a
    Latin word and a stop or comma at its end, and after a lone line feed. Each distinct piece is encoded by the
    library, and the ids are put together. Texts that hold an added token's string or rare white space go to the
    library whole. The memo is a table of `slots` places probed by the piece's 64-bit hash, so its memory is bounded.
    It keeps each piece's bytes, and every piece of a text is compared with them; a text with a piece that shares its
    hash with another one goes to the library whole. So do all texts where the vocabulary's normalizer or pre-tokenizer
    is none of those that these cuts are known for (_KINDS).
    """

    WAYS = 3
    BYTES = 1 << 26  # bytes of pieces that the memo keeps before it begins anew

    def __init__(self, path: str, slots: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.slots = slots
        self.letters = _byte_letters()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [lower for normalizer, cutter, lower in _KINDS if (spec["normalizer"], spec["pre_tokenizer"]) == (normalizer, cutter)]
        self.known = bool(kinds) and spec["model"].get("type", "BPE") == "BPE" and not spec["model"].get("dropout")
        self.lower = any(kinds)
        names = [re.escape(t.content.encode()) for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(names)) if names else None
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)
        self.at = np.full(self.slots, -1, np.int32)
        self.offset, self.length = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.n, self.used = np.zeros(8192, np.uint32), 0, 0
        self.begin, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.bytes, self.kept = np.zeros(65536, np.uint8), 0

    def _same(self, raw: np.ndarray, first: np.ndarray, size: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Whether each piece of raw is the very piece that was found for it."""
        same = self.size[found] == size
        todo = np.flatnonzero(same)
        text, memo = _lanes(raw), np.ndarray(len(self.bytes) - 7, "<u8", self.bytes, strides=(1,))
        at, other, left = first[todo], self.begin[found[todo]], size[todo]
        while len(todo):
            if left.max() > _LONG:
                for i in np.flatnonzero(left > _LONG).tolist():
                    same[todo[i]] = np.array_equal(raw[at[i] : at[i] + left[i]], self.bytes[other[i] : other[i] + left[i]])
                short = np.flatnonzero(left <= _LONG)
            else:
                same[todo[(text[at] ^ memo[other]) & _MASK[np.minimum(left, 8)] != 0]] = False
                short = np.flatnonzero(left > 8)
                at, other, left = at + 8, other + 8, left - 8
            todo, at, other, left = todo[short], at[short], other[short], left[short]
        return same

    def _places(self, h: np.ndarray) -> list[np.ndarray]:
        return [((h >> np.uint64(20 * w)) & np.uint64(self.slots - 1)).astype(np.int64) for w in range(self.WAYS)]

    def _find(self, h: np.ndarray) -> np.ndarray:
        found = np.full(len(h), -1, np.int32)
        todo = np.arange(len(h))
        for w in range(self.WAYS):
            slot = ((h[todo] >> np.uint64(20 * w)) & np.uint64(self.slots - 1)).astype(np.int64)
            hit = (self.keys[slot] == h[todo]) & (self.at[slot] >= 0)
            found[todo[hit]] = self.at[slot[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
        return found

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, h: np.ndarray, pieces: list[bytes]) -> None:
        letters, tokenize = self.letters, self.tok.model.tokenize
        ids: list[list[int]] = [[]] * len(pieces)
        rest = []
        for i, raw in enumerate(pieces):
            p = raw.decode("utf-8", "replace")
            if _WORD.match(p):
                w = p.lstrip(" ").lower() if self.lower else p
                w = w.replace(" ", letters[32]) if w.isascii() else "".join([letters[b] for b in w.encode()])
                ids[i] = [t.id for t in tokenize(w)]
            else:
                rest.append(i)
        for i, x in zip(rest, self._whole([pieces[i].decode("utf-8", "replace") for i in rest])):
            ids[i] = x
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for one in ids for x in one), np.uint32, int(size.sum()))
        while self.n + len(ids) > len(self.offset):
            self.offset, self.length = np.resize(self.offset, 2 * len(self.offset)), np.resize(self.length, 2 * len(self.length))
            self.begin, self.size = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        new = np.arange(self.n, self.n + len(ids))
        self.offset[new], self.length[new] = self.used + np.cumsum(size) - size, size
        self.flat[self.used : self.used + len(flat)] = flat
        self.n, self.used = self.n + len(ids), self.used + len(flat)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        while self.kept + len(data) + 8 > len(self.bytes):
            self.bytes = np.resize(self.bytes, 2 * len(self.bytes))
        long = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.begin[new], self.size[new] = self.kept + np.cumsum(long) - long, long
        self.bytes[self.kept : self.kept + len(data)] = data
        self.kept += len(data)
        todo = np.arange(len(h))
        for slot in self._places(h):
            s = slot[todo]
            free = self.at[s] < 0
            self.keys[s[free]], self.at[s[free]] = h[todo[free]], new[todo[free]]
            todo = todo[self.keys[s] != h[todo]]  # also those that another new piece took the place of
        if len(todo):
            s = self._places(h[todo])[0]
            self.keys[s], self.at[s] = h[todo], new[todo]

    def encode(self, column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows one after another, and how many each row has. Null: no ids."""
        if not self.known:
            whole = self._whole([x or "" for x in column.to_pylist()])
            counts = np.fromiter(map(len, whole), np.int64, len(whole))
            return np.fromiter((x for one in whole for x in one), np.uint32, int(counts.sum())), counts
        raw, ends = arrow_bytes(column)
        if not len(ends):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        buffer = raw.tobytes()
        places = _odd_places(raw, buffer) + [m.start() for m in (self.special.finditer(buffer) if self.special else ())]
        odd = set(np.searchsorted(ends, places, "right").tolist())
        space = _SPACE[raw]
        cut = np.zeros(len(raw) + 1, bool)
        cut[0] = cut[starts] = cut[ends - 1] = cut[-1] = True
        cut[1:-1] |= space[1:] & ~space[:-1]
        if len(raw) > 2:
            letter = _ASCII_LETTER[raw]
            letter[1:] |= (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
            stop = (raw == 46) | (raw == 44)
            cut[1:-2] |= stop[1:-1] & letter[:-2] & space[2:]
            cut[2:-1] |= (raw[1:-1] == 10) & ~space[:-2] & ~space[2:]
        first = np.flatnonzero(cut[:-1])
        size = np.diff(first, append=len(raw))
        row = np.repeat(np.arange(len(ends)), np.diff(np.searchsorted(first, ends), prepend=0))
        keep = first != ends[row] - 1
        if odd:
            keep &= ~np.isin(row, sorted(odd))
        first, size, row = first[keep], size[keep], row[keep]
        h = piece_hashes(raw, first, size)
        found = self._find(h)
        miss = np.flatnonzero(found < 0)
        if len(miss):
            new, at = np.unique(h[miss], return_index=True)
            if self.n + len(new) > 2 * self.slots or self.kept > self.BYTES:
                self._clear()
                miss = np.arange(len(h))
                new, at = np.unique(h, return_index=True)
            before = self.n
            self._learn(new, [buffer[first[i] : first[i] + size[i]] for i in miss[at].tolist()])
            found[miss] = before + np.searchsorted(new, h[miss])
        same = self._same(raw, first, size, found)
        if not same.all():
            apart = np.unique(row[~same])
            odd |= set(apart.tolist())
            keep = ~np.isin(row, apart)
            row, found = row[keep], found[keep]
        length = self.length[found]
        counts = np.bincount(row, weights=length, minlength=len(ends)).astype(np.int64)
        total = int(length.sum())
        begins = np.cumsum(length) - length
        ids = self.flat[np.repeat(self.offset[found] - begins, length) + np.arange(total)]
        if odd:
            rows = sorted(odd)
            whole = self._whole([buffer[starts[r] : ends[r] - 1].decode("utf-8", "replace") for r in rows])
            put = np.cumsum(counts) - counts
            ids = np.insert(ids, np.repeat(put[rows], [len(x) for x in whole]), np.fromiter((x for one in whole for x in one), np.uint32))
            for r, x in zip(rows, whole):
                counts[r] = len(x)
        return ids, counts


def encoder(path: str, slots: int = 1 << 20) -> Encoder:
    """One encoder for each worker process and file."""
    key = (path, slots)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, slots)
    return _ENCODERS[key]
