"""Byte-level BPE by ranks, encoding and decoding, with a two-tier lookup.

Texts are cut into pre-tokens as the pattern of public_tokenizers.PATTERN cuts them: contractions, runs of letters,
numbers or other signs with at most one blank before them, and white space. The first tier is a minimal perfect hash
of the vocabulary (levels of bit arrays, each key in the first level where nothing shares its place; a key's number is
the count of bits before its own): a pre-token that is a vocabulary entry gets its id at once. What the hash says is
held against the entry's bytes, so an answer is never a guess. The second tier is for misses: the lowest-ranked pair of
neighbours, the first of several, is merged until none is left, by a heap over a linked list of bytes. Each distinct
miss is merged once for a batch, and a bounded memo keeps results from batch to batch.

Both tiers give what the pair merging of a rank file defines; no ids are special. Decoding puts the entries' bytes
together; bytes are kept as bytes, as ids from elsewhere need not give valid text.

Edge cases: a null text is an empty one, and an empty text has no ids; very long texts and pre-tokens are encoded
whole; equal texts have equal ids; repeated rows and null ids stay; an empty table gives an empty result; further
columns are ignored, whatever their names. Decoding null ids gives null; an id outside the vocabulary ends the job
with an error.
"""

from __future__ import annotations

import base64
import functools
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SLICE = 2_000_000  # bytes of text that are cut and looked up at once
PLANES = 0x40000  # code points from here on are no letters, numbers or white space in any version so far
MEMO = 1 << 19  # distinct misses that a worker keeps before it begins anew

_LETTER, _NUMBER, _SIGN, _WHITE = range(4)
_ENCODERS: dict[str, "Encoder"] = {}


def read_ranks(path: str) -> list[bytes]:
    """The entries of a rank file by id. Ids must be 0, 1, ... without a gap, entries distinct and all 256 bytes there."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    entries = [base64.b64decode(entry) for entry, _ in sorted(pairs, key=lambda p: int(p[1]))]
    if sorted(int(rank) for _, rank in pairs) != list(range(len(pairs))) or len(set(entries)) != len(entries) or not {bytes([b]) for b in range(256)} <= set(entries):
        raise ValueError(f"{path} has no ranks from 0 on without a gap, or lacks a byte")
    return entries


class PerfectHash:
    """Numbers 0 to n - 1 for n distinct 64-bit keys, in about three bits a key."""

    def __init__(self, keys: np.ndarray, room: float = 2.0):
        self.bits: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        left, level, placed = np.asarray(keys, np.uint64), 0, 0
        if len(np.unique(left)) < len(left):
            raise ValueError("keys are not distinct")
        while len(left):
            place = self._places(left, level, max(int(room * len(left)), 64))
            alone = np.bincount(place, minlength=max(int(room * len(left)), 64)) == 1
            self.bits.append(alone)
            self.before.append(placed + np.cumsum(alone) - alone)
            placed, left, level = placed + int(alone.sum()), left[~alone[place]], level + 1

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (common.mix64(keys + np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1))) % np.uint64(size)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """A key's number; of other keys some number, or -1."""
        found, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, before) in enumerate(zip(self.bits, self.before)):
            place = self._places(keys[todo], level, len(bits))
            hit = bits[place]
            found[todo[hit]] = before[place[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
        return found


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: neighbours of the lowest rank, the first of several, are merged until no pair is an entry."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at a place; end 0: merged away
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or ranks.get(piece[i : end[j]]) != rank:
            continue  # one of the two has changed since
        k = end[i] = end[j]
        end[j] = 0
        if k < n:
            before[k] = i
            if (r := ranks.get(piece[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:k])) is not None:
            heapq.heappush(heap, (r, h))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


@functools.cache
def classes() -> bytes:
    """Letter, number, white space or other sign for every code point, a byte each, compressed.

    They depend on the Unicode version that the tokenizer library knows, so it is asked: with a vocabulary of single
    bytes, and of a known letter, number or sign with any byte after it, the two are one token exactly where the
    pattern leaves the code point in the known one's run.
    """
    import tiktoken

    known = {_LETTER: b"x", _NUMBER: b"1", _SIGN: b"!"}
    singles = [bytes([b]) for b in range(256)]
    ranks = {e: i for i, e in enumerate([*singles, *(k + b for k in known.values() for b in singles)])}
    probe = tiktoken.Encoding("classes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    kinds = np.full(0x110000, _WHITE, np.uint8)
    kinds[PLANES:] = _SIGN
    left = np.concatenate([np.arange(0xD800), np.arange(0xE000, PLANES)])
    for kind, k in known.items():
        chars = list(map(chr, left.tolist()))
        length = 1 + (np.array(probe.encode_ordinary("".join([f"\n{k.decode()}{c}" for c in chars]))) >= 256)
        begin = np.cumsum([0, *(2 + len(c.encode()) for c in chars[:-1])]) + 1
        joined = length[np.searchsorted(np.cumsum(length) - length, begin)] == 2
        kinds[left[joined]] = kind
        left = left[~joined]
    return zlib.compress(kinds.tobytes())


def _code_points(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points that begin at these places of UTF-8."""
    lead = raw[at].astype(np.int64)
    point, size = lead.copy(), np.ones(len(at), np.int64)
    for bound, keep, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        longer = np.flatnonzero(lead >= bound)
        point[longer], size[longer] = lead[longer] & keep, 1 + more
    for k in (1, 2, 3):
        longer = np.flatnonzero(size > k)
        point[longer] = (point[longer] << 6) | (raw[np.minimum(at[longer] + k, len(raw) - 1)] & 0x3F)
    return np.minimum(point, 0x10FFFF)


def pre_tokens(raw: np.ndarray, ends: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every pre-token of some texts put together, and the number of pre-tokens of each text."""
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    kind = kinds[raw[at]]
    wide = np.flatnonzero(raw[at] >= 0x80)
    kind[wide] = kinds[_code_points(raw, at[wide])]
    text_begins = np.unique(np.concatenate([[0], ends[:-1]]))
    begins = np.searchsorted(at, text_begins[text_begins < len(raw)])
    new_text = np.zeros(len(at), bool)
    new_text[begins] = True
    new_run = new_text.copy()
    new_run[1:] |= kind[1:] != kind[:-1]
    first = np.flatnonzero(new_run)  # of each run of one class, as all that follows
    last = np.append(first[1:], len(at)) - 1
    what, opens = kind[first], new_text[first]
    closes = np.append(opens[1:], True)  # the text ends with this run
    white = what == _WHITE
    blank = white & ~closes & (raw[at[last]] == 0x20)  # a run of white space whose last blank goes to the next pre-token
    after_blank = np.concatenate([[False], blank[:-1]])
    start = np.zeros(len(at), bool)
    start[first[white | ~after_blank]] = True
    start[last[white & ~closes]] = True
    quote = np.flatnonzero((what == _SIGN) & (first == last) & (raw[at[first]] == 0x27) & ~after_blank & ~closes)
    quote = quote[what[quote + 1] == _LETTER]
    letters, run_ends = first[quote + 1], last[quote + 1]
    one = raw[at[letters]]
    two = np.where(letters < run_ends, raw[at[np.minimum(letters + 1, len(at) - 1)]], 0)
    long = ((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)  # re, ve, ll
    short = np.isin(one, [0x73, 0x74, 0x6D, 0x64])  # s, t, m, d
    taken = np.where(long, 2, 1)
    joined = long | short
    start[letters[joined]] = False
    rest = joined & (letters + taken <= run_ends)
    start[(letters + taken)[rest]] = True
    begin = at[start]
    return begin, np.diff(np.searchsorted(begin, ends), prepend=0)


class Encoder:
    """Ids of texts by one rank file. kinds: classes of code points as `classes` gives them."""

    def __init__(self, path: str, kinds: bytes):
        self.entries = read_ranks(path)
        self.ranks = {e: i for i, e in enumerate(self.entries)}
        self.kinds = np.frombuffer(zlib.decompress(kinds), np.uint8)
        size = np.fromiter(map(len, self.entries), np.int64, len(self.entries))
        raw = np.frombuffer(b"".join(self.entries), np.uint8)
        begin = np.cumsum(size) - size
        keys = common.piece_hashes(raw, begin, size)
        self.hash = PerfectHash(keys)
        number = self.hash.find(keys)
        self.id = np.empty(len(number), np.int64)
        self.id[number] = np.arange(len(number))
        self.begin, self.size, self.longest = begin[self.id], size[self.id], int(size.max())
        self.lanes = common._lanes(raw)
        self.memo: dict[bytes, list[int]] = {}

    def _looked_up(self, raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Ids of the pieces that are entries, -1 for others."""
        short = np.flatnonzero(size <= self.longest)
        number = self.hash.find(common.piece_hashes(raw, begin[short], size[short]))
        short, number = short[number >= 0], number[number >= 0]
        equal = self.size[number] == size[short]
        short, number = short[equal], number[equal]
        lanes, todo = common._lanes(raw), np.arange(len(short))
        same, left, offset = np.ones(len(short), bool), size[short], 0
        while len(todo):
            part = np.minimum(left[todo] - offset, 8)
            differs = (lanes[begin[short[todo]] + offset] ^ self.lanes[self.begin[number[todo]] + offset]) & common._MASK[part] != 0
            same[todo[differs]] = False
            offset += 8
            todo = todo[~differs & (left[todo] > offset)]
        ids = np.full(len(begin), -1, np.int64)
        ids[short[same]] = self.id[number[same]]
        return ids

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows one after another, and how many each row has. Null: none."""
        texts = column.cast(pa.large_binary()).fill_null(b"")
        if not len(texts):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if offsets[-1] == offsets[0]:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        raw, ends = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]
        begin, pieces = pre_tokens(raw, ends, self.kinds)
        size = np.diff(begin, append=len(raw))
        ids = self._looked_up(raw, begin, size)
        miss = np.flatnonzero(ids < 0)
        if not len(miss):
            return ids.astype(np.int32), pieces
        coded, more = self._merged(raw, begin[miss], size[miss])
        length = np.ones(len(ids), np.int64)
        length[miss] = more[0][coded]
        to = np.cumsum(length) - length
        out = np.empty(int(length.sum()), np.int32)
        out[to[ids >= 0]] = ids[ids >= 0]
        wide = length[miss]
        inside = np.arange(int(wide.sum())) - np.repeat(np.cumsum(wide) - wide, wide)
        out[np.repeat(to[miss], wide) + inside] = more[2][np.repeat(more[1][coded], wide) + inside]
        return out, np.diff(np.append(to, len(out))[np.cumsum(pieces)], prepend=0)

    def _merged(self, raw: np.ndarray, begin: np.ndarray, size: np.ndarray):
        """For pieces that are no entries: each one's number among the distinct ones; their lengths, places and ids."""
        offsets = np.concatenate([[0], np.cumsum(size)])
        data = raw[np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])]
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        memo, ranks, found = self.memo, self.ranks, []
        if len(memo) + len(coded.dictionary) > MEMO:
            memo.clear()
        for piece in coded.dictionary.to_pylist():
            got = memo.get(piece)
            if got is None:
                got = merged(piece, ranks)
                if len(piece) <= 64:
                    memo[piece] = got
            found.append(got)
        length = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((x for one in found for x in one), np.int32, int(length.sum()))
        return coded.indices.to_numpy(), (length, np.cumsum(length) - length, flat)


def encoder(path: str, kinds: bytes) -> Encoder:
    """One encoder for each worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, kinds)
    return _ENCODERS[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids array<int>) for every row of docs."""
    common.ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = classes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in common.sliced(whole, most=SLICE)):
            ids, counts = encoder(path, kinds).encode(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def _parts(batch: pa.RecordBatch, ids_col: str) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about SLICE / 4 ids."""
    size = pc.fill_null(pc.list_value_length(batch.column(ids_col)), 0).to_numpy(zero_copy_only=False)
    begin = 0
    for end in (np.flatnonzero(np.diff(np.cumsum(size) // (SLICE // 4), append=-1)) + 1).tolist():
        yield batch.slice(begin, end - begin)
        begin = end


def decode(rows: DataFrame, path: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """rows with the bytes that its ids stand for."""
    common.ship(rows.sparkSession)
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = None
        for batch in (part for whole in batches for part in _parts(whole, ids_col)):
            entries = pa.array(read_ranks(path), pa.large_binary()) if entries is None else entries
            column = batch.column(ids_col)
            length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            data = entries.take(column.flatten())
            ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
            at = ends[np.concatenate([[0], np.cumsum(length)])] - ends[0]
            whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(at), pa.py_buffer(data.buffers()[2])])
            none = column.is_null()
            whole = pc.if_else(none, None, whole) if none.true_count else whole
            yield pa.RecordBatch.from_arrays([*batch.columns, whole.cast(pa.binary())], [*batch.schema.names, name])

    return rows.mapInArrow(run, schema)
