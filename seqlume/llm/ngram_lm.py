"""Interpolated modified Kneser-Ney n-gram scores (trigrams or bigrams over unigrams over a uniform base).

Words are runs of anything but \\x20 and \\x09-\\x0D, A-Z in lower case, as 64-bit hashes; every text ends in one end
token and begins after a start symbol. Distinct words are dealt out by hash, counted, and numbered. N-grams then travel
as word numbers, sorted, in byte planes under zstd, a few bytes each; the middle word deals trigrams out (its pair with
the first word if it is frequent), so that the followers of a pair meet in one task, which hands on how many first
words each pair of the last two has. Bigrams are made of these continuation counts, or of their own counts in a model
of order 2, and are dealt out by their first word; words that are more frequent than a fair share of a partition are
spread over all partitions by their second word instead, and their statistics are added up afterwards.

Each task writes what it has merged as sorted hash arrays (.npy) into a folder that all machines mount; a file is
written under another name and then renamed, so a repeated task leaves the same file. N-grams that occur once are kept
without a count. Scoring reads texts once more and looks words and n-grams up in the memory-mapped arrays by vectorised
binary search, without a shuffle. How many partitions there are grows with the tokens.

Two different words share a hash with a chance of about 3e-6 in 1e7 distinct ones. Of an n-gram's hash 32 bits beyond
those that tell its place within about 16 entries are stored, so one that training has not seen is taken for one that
it has with a chance of about 4e-9.

Edge cases: a null text is an empty one and has its end token only; very long texts are counted and scored whole;
without training rows every token has the uniform probability 1 / (V + 1) with V = 0; repeated rows count as often as
they stand; an empty table gives an empty result; further columns are ignored. A row whose training flag is null does
not train. Words of equal frequency need no order.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

END = np.uint64(0xFEDCBA9876543210)
HELD = 3_000_000  # distinct entries that a task holds before it hands them on
TASK_TOKENS = 4_000_000  # tokens whose n-grams a merging task gets on average, at most


def mounted(folder: str) -> str:
    """The path of a folder that driver and executors mount; memory mapping needs one."""
    u = urlparse(folder)
    if u.scheme not in ("", "file"):
        raise ValueError(f"{folder} is not a mounted folder; its arrays can't be memory-mapped")
    return u.path


def _save(folder: str, name: str, array: np.ndarray) -> None:
    own = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
    with open(own, "wb") as f:
        np.save(f, array)
    os.replace(own, os.path.join(folder, f"{name}.npy"))


def _least_kind(counts: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them all."""
    return counts.astype(np.min_scalar_type(int(counts.max()) if counts.size else 0))


def _save_keys(folder: str, name: str, keys: np.ndarray) -> None:
    """Sorted keys in about 4.3 bytes each: where the keys of each value of the uppermost bits begin, about 16 keys on
    average, and the 32 bits of each key that follow."""
    bits = max(len(keys).bit_length() - 4, 1)
    begin = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    kind, part = name.rsplit("-", 1)
    _save(folder, f"{kind}-begin-{part}", begin.astype(np.uint32))
    _save(folder, f"{kind}-low-{part}", (keys >> np.uint64(32 - bits)).astype(np.uint32))


def find_short(begin: np.ndarray, low: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Where each asked key stands among keys that _save_keys has written; -1 where it doesn't."""
    if not len(low):
        return np.full(len(asked), -1, np.int64)
    bits = (len(begin) - 1).bit_length() - 1
    group = (asked >> np.uint64(64 - bits)).astype(np.int64)
    rest = (asked >> np.uint64(32 - bits)).astype(np.uint32)
    lo, end = begin[group].astype(np.int64), begin[group + 1].astype(np.int64)
    step = 1 << int((end - lo).max()).bit_length() if len(lo) else 0
    while step := step >> 1:  # what stands before lo is less than what is asked for
        last = lo + (step - 1)
        lo += step * ((last < end) & (low[np.minimum(last, len(low) - 1)] < rest))
    return np.where((lo < end) & (low[np.minimum(lo, len(low) - 1)] == rest), lo, -1)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all rows' words with each row's end token, and the number of tokens of each row."""
    words, counts = common.word_hashes(column)
    return np.insert(words, np.cumsum(counts), END), counts + 1


def bigram_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return common.mix64(v * common._STEP + w)


def word_part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def bigram_part(v: np.ndarray, w: np.ndarray, parts: int, hot: np.ndarray) -> np.ndarray:
    part = word_part(v, parts)
    if len(hot):
        spread = np.isin(v, hot)
        part[spread] = word_part(common.mix64(v[spread] + common.mix64(w[spread])), parts)
    return part


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in ascending order, a place of each, and each key's number among them."""
    order, first = _groups(keys)
    first = first[: len(keys)]  # none of none
    number = np.empty(len(keys), np.int64)
    number[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
    return keys[order[first]], order[first], number


def find(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Where each asked key stands in the sorted keys; -1 where it doesn't."""
    if not len(keys):
        return np.full(len(asked), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, at, -1)


def _training(batch: pa.RecordBatch) -> pa.Array:
    return batch.filter(batch.column("train")).column("text")


def _blobs(part: np.ndarray, parts: int, *arrays: np.ndarray) -> pa.RecordBatch:
    """A row (part, blob) for each partition that has entries; arrays are dealt out by part and put one after another."""
    order = np.argsort(part, kind="stable")
    arrays = tuple(a[order] for a in arrays)
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    full = np.flatnonzero(np.diff(cuts))
    blobs = [b"".join(a[cuts[k] : cuts[k + 1]].tobytes() for a in arrays) for k in full]
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "blob"])


def _count_words(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, n = [], [], 0

        def flush():
            k, c = merged(np.concatenate(keys), np.concatenate(counts))
            return _blobs(word_part(k, parts), parts, k, c.astype(np.uint32))

        for batch in (part for whole in batches for part in common.sliced(whole)):
            toks, _ = tokens(_training(batch))
            k, c = np.unique(toks, return_counts=True)
            keys.append(k)
            counts.append(c)
            n += len(k)
            if n > HELD:
                yield flush()
                keys, counts, n = [], [], 0
        if keys:
            yield flush()

    return run


def _read(batches: Iterator[pa.RecordBatch], *kinds: str) -> dict[int, list[list[np.ndarray]]]:
    got: dict[int, list[list[np.ndarray]]] = {}
    width = sum(np.dtype(k).itemsize for k in kinds)
    for batch in batches:
        for part, x in zip(batch.column("part").to_pylist(), batch.column("blob")):
            raw = x.as_buffer()
            n, at = raw.size // width, 0
            for k, held in zip(kinds, got.setdefault(part, [[] for _ in kinds])):
                held.append(np.frombuffer(raw, k, n, at))
                at += n * np.dtype(k).itemsize
    return got


STATS = "part int, name string, key long, a long, b long, c long, d long"


def _stats(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    columns = list(zip(*rows)) if rows else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], ["part", "name", "key", "a", "b", "c", "d"])


def _merge_words(folder: str, share: int):
    """Writes word-<part> (hashes, counts). Rows: how many tokens and distinct words, and the `share` most frequent words.

    A partition of P can't hold more than a few words with over 1 / (4 P) of all tokens, unless they hold most of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for part, (k, c) in _read(batches, "<u8", "<u4").items():
            keys, counts = merged(np.concatenate(k), np.concatenate(c).astype(np.int64))
            _save(folder, f"word-key-{part}", keys)
            _save(folder, f"word-count-{part}", _least_kind(counts))
            rows.append((part, "words", 0, int(counts.sum()), len(keys), 0, 0))
            for i in np.argsort(-counts)[:share].tolist():
                rows.append((part, "top", int(keys[i : i + 1].view(np.int64)[0]), int(counts[i]), 0, 0, 0))
        yield _stats(rows)

    return run


class Arrays:
    """The memory-mapped arrays of a folder."""

    def __init__(self, folder: str):
        self.folder = folder
        self.held: dict[tuple[str, int], np.ndarray] = {}

    def __getstate__(self):
        return {"folder": self.folder, "held": {}}

    def array(self, name: str, part: int) -> np.ndarray:
        if (name, part) not in self.held:
            path = os.path.join(self.folder, f"{name}-{part}.npy")
            empty = np.empty((0, 4) if name.endswith("stats") else 0, np.uint64)
            self.held[name, part] = np.asarray(np.load(path, mmap_mode="r")) if os.path.exists(path) else empty
        return self.held[name, part]

    def places(self, kind: str, keys: np.ndarray, part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each partition: its number, the indices of the keys that it holds, and where it holds them."""
        short = kind.startswith(("bigram", "pair", "trigram"))
        order = np.argsort(part.astype(np.min_scalar_type(parts)), kind="stable")  # small types are sorted by radix
        cuts = np.append(0, np.cumsum(np.bincount(part, minlength=parts)))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            mine = order[cuts[k] : cuts[k + 1]]
            if short:
                at = find_short(self.array(f"{kind}-begin", k), self.array(f"{kind}-low", k), keys[mine])
            else:
                at = find(self.array(f"{kind}-key", k), keys[mine])
            yield k, mine[at >= 0], at[at >= 0]


@dataclass
class Words:
    """Numbers of words: the partition's first number and the place in its sorted array."""

    arrays: Arrays
    parts: int
    first: np.ndarray
    total: int

    @property
    def kind(self) -> str:
        """The type of word numbers; the start symbol has the number `total`."""
        return "<u4" if self.total < 2**32 - 1 else "<u8"

    def codes(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of distinct words (-1: unknown), and their codes, as which n-gram arrays know them."""
        numbers = np.full(len(words), -1, np.int64)
        for k, mine, at in self.arrays.places("word", words, word_part(words, self.parts), self.parts):
            numbers[mine] = self.first[k] + at
        return numbers, np.where(numbers >= 0, code(numbers), words)

    def numbered(self, toks: np.ndarray) -> np.ndarray:
        """Numbers of the tokens of training rows."""
        words, back = np.unique(toks, return_inverse=True)
        return self.codes(words)[0].astype(self.kind)[back]


def code(numbers: np.ndarray) -> np.ndarray:
    """A word's number spread over 64 bits, one to one."""
    return common.mix64(numbers.astype(np.uint64) + np.uint64(1))


def _planes(a: np.ndarray) -> bytes:
    """The numbers' lowest bytes, then their second ones, and so on."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _number_blobs(part: np.ndarray, parts: int, counts: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """A row (part, blob) for each partition that has entries. Entries stand in the columns' order; all columns but the
    last go as differences from one entry to the next."""
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    full = np.flatnonzero(np.diff(cuts))
    codec, blobs = pa.Codec("zstd", 1), []
    for k in full.tolist():
        mine = order[cuts[k] : cuts[k + 1]]
        steps = [np.diff(c[mine], prepend=c.dtype.type(0)) for c in columns[:-1]]
        raw = b"".join(map(_planes, (counts[mine].astype("<u4"), *steps, columns[-1][mine])))
        blobs.append(np.array([len(mine), len(raw)], "<i8").tobytes() + codec.compress(raw, asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "blob"])


def _read_numbers(batches: Iterator[pa.RecordBatch], kind: str, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(part, [counts, columns...]) of the blobs of each part."""
    got: dict[int, list[list[np.ndarray]]] = {}
    codec = pa.Codec("zstd")
    for batch in batches:
        for part, x in zip(batch.column("part").to_pylist(), batch.column("blob")):
            blob = x.as_buffer()
            n, size = (int(v) for v in np.frombuffer(blob, "<i8", 2))
            raw, at = codec.decompress(blob[16:], size), 0
            for i, (k, held) in enumerate(zip(("<u4", *[kind] * width), got.setdefault(part, [[] for _ in range(width + 1)]))):
                each = np.dtype(k).itemsize
                a = np.frombuffer(raw, np.uint8, n * each, at).reshape(each, n).T.copy().view(k).ravel()
                held.append(np.cumsum(a, dtype=k) if 0 < i < width else a)
                at += n * each
    while got:
        part, columns = got.popitem()
        yield part, [np.concatenate(x) for x in columns]


def _count_ngrams(words: Words, order: int, parts: int, hot: np.ndarray):
    """Rows (part, blob) of the counts of all training n-grams of this order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def merged_rows() -> pa.RecordBatch:
            *gram, c = (np.concatenate(x) for x in zip(*held))
            rank, first = _groups(_gram_key(gram))
            c = np.add.reduceat(c[rank], first)
            gram = [x[rank[first]] for x in gram]
            rank = np.lexsort((gram[-1], *gram[:-2], gram[-2]))  # by the last but one word, in which they are dealt out
            gram, c = [x[rank] for x in gram], c[rank]
            v = code(gram[-2])
            spread = bigram_key(code(gram[0]), v) if order == 3 else code(gram[1])
            return _number_blobs(bigram_part(v, spread, parts, hot), parts, c, *gram[-2::-1], gram[-1])

        for batch in (part for whole in batches for part in common.sliced(whole)):
            toks, counts = tokens(_training(batch))
            if not len(toks):
                continue
            gram = [words.numbered(toks)]
            while len(gram) < order:
                gram.insert(0, _before(gram[0], counts, words.total))
            rank, first = _groups(_gram_key(gram))
            at = rank[first]
            held.append((*(x[at] for x in gram), np.diff(np.append(first, len(rank)))))
            n += len(at)
            if n > HELD:
                yield merged_rows()
                held, n = [], 0
        if n:
            yield merged_rows()

    return run


def _before(ids: np.ndarray, counts: np.ndarray, start: int) -> np.ndarray:
    """The number before each one; the start symbol's for a row's first."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.cumsum(counts) - counts] = start
    return before


def _gram_key(gram: list[np.ndarray]) -> np.ndarray:
    """Hash of each n-gram of word numbers."""
    key = code(gram[0])
    for x in gram[1:]:
        key = bigram_key(key, code(x))
    return key


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts key, and where in it each distinct key begins."""
    order = np.argsort(key)
    sorted_key = key[order]
    return order, np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]))


def _merge_trigrams(folder: str, parts: int, hot: np.ndarray, kind: str):
    """Writes trigram-<part> and pair-<part> as _merge_bigrams does, without counts of 1 (trigram1, pair1). Rows: continuation counts of bigrams, statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats = []
        for part, (c, v, u, w) in _read_numbers(batches, kind, 3):
            pair = bigram_key(code(u), code(v))
            del u
            key = bigram_key(pair, code(w))
            order, first = _groups(key)
            c = np.add.reduceat(c[order].astype(np.int64), first)
            key, pair, v, w = (x[order[first]] for x in (key, pair, v, w))
            _save_keys(folder, f"trigram1-{part}", key[c == 1])
            _save_keys(folder, f"trigram-{part}", key[c > 1])
            _save(folder, f"trigram-count-{part}", _least_kind(c[c > 1]))
            stats.append((part, "counts", 0, *((c == n).sum() for n in (1, 2, 3, 4))))
            ctx, back = np.unique(pair, return_inverse=True)
            table = np.stack([np.bincount(back, weights=x, minlength=len(ctx)) for x in (c, c == 1, c == 2, c >= 3)], 1)
            once = table[:, 0] == 1
            _save_keys(folder, f"pair1-{part}", ctx[once])
            _save_keys(folder, f"pair-{part}", ctx[~once])
            _save(folder, f"pair-stats-{part}", _least_kind(table[~once]))
            order = np.lexsort((w, v))
            v, w = v[order], w[order]
            first = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])]))
            n = np.diff(np.append(first, len(v)))
            v, w = v[first], w[first]
            yield _with_stats(_number_blobs(bigram_part(code(v), code(w), parts, hot), parts, n, v, w))
        if stats:
            yield _only_stats(stats)

    return run


MIXED = "part int, blob binary, name string, key long, a long, b long, c long, d long"
_NAMES = [x.split()[0] for x in MIXED.split(", ")]


def _with_stats(blobs: pa.RecordBatch) -> pa.RecordBatch:
    m = blobs.num_rows
    return pa.RecordBatch.from_arrays([blobs.column(0), blobs.column(1), pa.nulls(m, pa.string()), *[pa.nulls(m, pa.int64())] * 5], _NAMES)


def _only_stats(rows: list[tuple]) -> pa.RecordBatch:
    s = _stats(rows)
    return pa.RecordBatch.from_arrays([s.column("part"), pa.nulls(s.num_rows, pa.binary()), *(s.column(x) for x in _NAMES[2:])], _NAMES)


def _merge_bigrams(folder: str, parts: int, hot: np.ndarray, kind: str):
    """Writes bigram-<part> (keys, counts) and context-<part> (hashes; followers, and how many of them once, twice, more).

    Rows of blobs: continuation counts of second words, dealt out by word; rows of statistics under part -1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats = []
        for part, (c, v, w) in _read_numbers(batches, kind, 2):
            key = bigram_key(code(v), code(w))
            order, first = _groups(key)
            c = np.add.reduceat(c[order].astype(np.int64), first)
            key, v, w = (x[order[first]] for x in (key, v, w))
            _save_keys(folder, f"bigram1-{part}", key[c == 1])
            _save_keys(folder, f"bigram-{part}", key[c > 1])
            _save(folder, f"bigram-count-{part}", _least_kind(c[c > 1]))
            stats.append((part, "counts", 0, *((c == n).sum() for n in (1, 2, 3, 4))))
            ctx, back = np.unique(code(v), return_inverse=True)
            table = np.stack([np.bincount(back, weights=x, minlength=len(ctx)) for x in (c, c == 1, c == 2, c >= 3)], 1).astype(np.int64)
            known = np.isin(ctx, hot)
            _save(folder, f"context-key-{part}", ctx[~known])
            _save(folder, f"context-stats-{part}", _least_kind(table[~known]))
            stats += [(part, "hot", int(k), *t) for k, t in zip(ctx[known].view(np.int64).tolist(), table[known].tolist())]
            words, n = np.unique(w, return_counts=True)
            yield _with_stats(_number_blobs(word_part(code(words), parts), parts, n, words))
        if stats:
            yield _only_stats(stats)

    return run


def _merge_continuations(folder: str, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for part, (c, w) in _read_numbers(batches, kind, 1):
            keys, counts = merged(code(w), c.astype(np.int64))
            _save(folder, f"follow-key-{part}", keys)
            _save(folder, f"follow-count-{part}", _least_kind(counts))
            rows.append((part, "follow", 0, *((counts == n).sum() for n in (1, 2, 3, 4))))
            rows.append((part, "follow-total", 0, int(counts.sum()), len(keys), int((counts >= 3).sum()), 0))
        yield _stats(rows)

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts for counts of one, two, and three or more; absolute discounts where counts of counts are missing."""
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d3 = 3 - 4 * y * n4 / n3 if n3 else 1.5
    return max(1 - 2 * y * n2 / n1, 0.1), min(max(2 - 3 * y * n3 / n2, 0.1), 1.9), min(max(d3, 0.1), 2.9)


@dataclass
class Model:
    arrays: Arrays
    words: Words
    parts: int
    tokens: int
    hot_keys: np.ndarray
    hot_stats: np.ndarray
    bigram_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    follow_total: int
    follow_types: tuple[int, int, int]
    order: int = 3
    trigram_discounts: tuple[float, float, float] = (0.5, 0.5, 0.5)

    def look_up(self, kind: str, values: str, keys: np.ndarray, part: np.ndarray, parts: int | None = None) -> np.ndarray:
        """Values of keys, partition by partition; zeros for keys that are not there."""
        out = np.zeros((len(keys), 4) if values == "stats" else len(keys), np.int64)
        for k, mine, at in self.arrays.places(kind, keys, part, parts or self.parts):
            out[mine] = self.arrays.array(f"{kind}-{values}", k)[at]
        return out

    def once(self, kind: str, keys: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Which keys are among those that stand for one occurrence."""
        out = np.zeros(len(keys), bool)
        for _, mine, _ in self.arrays.places(f"{kind}1", keys, part, self.parts):
            out[mine] = True
        return out

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each row: tokens, known tokens, base score, score."""
        toks, counts = tokens(column)
        row = np.repeat(np.arange(len(counts)), counts)
        words, at = np.unique(toks, return_inverse=True)
        count = self.look_up("word", "count", words, word_part(words, self.words.parts), self.words.parts)
        base = np.log10((count + 1) / (self.tokens + self.words.total + 1))
        words = self.words.codes(words)[1]
        follow = self.look_up("follow", "count", words, word_part(words, self.parts))
        uniform = 1 / (self.words.total + 1)
        if self.follow_total:
            d = np.array([0, *self.word_discounts])
            back_off = sum(x * n for x, n in zip(self.word_discounts, self.follow_types)) / self.follow_total
            p1 = (follow - d[np.minimum(follow, 3)]) / self.follow_total + back_off * uniform
        else:
            p1 = np.full(len(words), uniform)
        start = code(np.array([self.words.total]))[0]
        ctx, ctx_at = np.append(words, start), _before(at, counts, len(words))
        stats = self.look_up("context", "stats", ctx, word_part(ctx, self.parts))
        if len(self.hot_keys):
            i = find(self.hot_keys, ctx)
            stats[i >= 0] = self.hot_stats[i[i >= 0]]
        total = np.maximum(stats[:, 0], 1)
        gamma = np.where(stats[:, 0] > 0, stats[:, 1:] @ np.array(self.bigram_discounts) / total, 1.0)
        keys, first, back = distinct(bigram_key(ctx[ctx_at], words[at]))
        ends = words[at[first]]
        part = bigram_part(ctx[ctx_at[first]], ends, self.parts, self.hot_keys)
        c = self.look_up("bigram", "count", keys, part) + self.once("bigram", keys, part)
        d = np.array([0, *self.bigram_discounts])
        seen = (c - d[np.minimum(c, 3)])[back] / total[ctx_at]
        p = seen + gamma[ctx_at] * p1[at]
        if self.order == 3:
            pairs = np.append(keys, bigram_key(np.array([start]), np.array([start])))
            p = self.trigram(pairs, np.append(ends, start), _before(back, counts, len(keys)), words[at], p)
        add = lambda x: np.bincount(row, weights=x, minlength=len(counts))
        return counts, add(count[at] > 0).astype(np.int64), add(base[at]), add(np.log10(p))

    def trigram(self, ctx: np.ndarray, v: np.ndarray, ctx_at: np.ndarray, w: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Probability of each w after the pair of words that ctx_at gives, from that after the pair's second word.

        ctx: hashes of distinct pairs, v: their second words."""
        part = bigram_part(v, ctx, self.parts, self.hot_keys)
        stats = self.look_up("pair", "stats", ctx, part)
        stats[self.once("pair", ctx, part)] = (1, 1, 0, 0)
        total = np.maximum(stats[:, 0], 1)
        gamma = np.where(stats[:, 0] > 0, stats[:, 1:] @ np.array(self.trigram_discounts) / total, 1.0)
        keys, first, back = distinct(bigram_key(ctx[ctx_at], w))
        part = part[ctx_at[first]]
        c = self.look_up("trigram", "count", keys, part) + self.once("trigram", keys, part)
        d = np.array([0, *self.trigram_discounts])
        return (c - d[np.minimum(c, 3)])[back] / total[ctx_at] + gamma[ctx_at] * lower


def fit(docs: DataFrame, order: int = 3) -> Model:
    """docs: (text, train). Counts over all rows whose train is true. order: 2 or 3."""
    if order not in (2, 3):
        raise ValueError(f"order {order} is neither 2 nor 3")
    spark = docs.sparkSession
    common.ship(spark)
    folder = mounted(common.new_folder(spark, "ngram-lm"))
    os.makedirs(folder)
    arrays = Arrays(folder)
    docs = docs.select("text", F.coalesce("train", F.lit(False)).alias("train"))
    parts = common.partitions(spark)
    counted = common.dealt(docs.mapInArrow(_count_words(parts), "part int, blob binary"), parts).mapInArrow(_merge_words(folder, 16), STATS).collect()
    sizes = {r["part"]: r["b"] for r in counted if r["name"] == "words"}
    total = sum(r["a"] for r in counted if r["name"] == "words")
    first = np.concatenate([[0], np.cumsum([sizes.get(k, 0) for k in range(parts)])]).astype(np.int64)
    words = Words(arrays, parts, first[:-1], int(first[-1]))

    parts = max(parts, -(-total // TASK_TOKENS))
    often = np.array([r["key"] for r in counted if r["name"] == "top" and r["a"] * 4 * parts > total], np.int64).view(np.uint64)
    hot = np.sort(np.append(words.codes(often)[1], code(np.array([words.total]))))  # every row begins with the start symbol
    grams = common.dealt(docs.mapInArrow(_count_ngrams(words, order, parts, hot), "part int, blob binary"), parts)
    tri = (0, 0, 0, 0)
    triples = None
    if order == 3:
        triples = common.staged(grams.mapInArrow(_merge_trigrams(folder, parts, hot, words.kind), MIXED), "ngram-triples")
        del grams
        common.release(spark)
        tri = tuple(triples.where("blob is null").agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in "abcd")).first())
        grams = common.dealt(triples.where("blob is not null").select("part", "blob"), parts)
    pairs = common.staged(grams.mapInArrow(_merge_bigrams(folder, parts, hot, words.kind), MIXED), "ngram-pairs")
    del grams
    sums = pairs.where("blob is null").groupBy("name", "key").agg(*(F.sum(x).alias(x) for x in "abcd")).collect()
    again = common.dealt(pairs.where("blob is not null").select("part", "blob"), parts)
    follow = again.mapInArrow(_merge_continuations(folder, words.kind), STATS).groupBy("name").agg(*(F.sum(x).alias(x) for x in "abcd")).collect()
    del again
    common.discard(pairs, *([triples] if triples is not None else []))
    common.release(spark)
    bi = next((tuple(r[x] for x in "abcd") for r in sums if r["name"] == "counts"), (0, 0, 0, 0))
    uni = next((tuple(r[x] for x in "abcd") for r in follow if r["name"] == "follow"), (0, 0, 0, 0))
    whole = next(((r["a"], r["b"], r["c"]) for r in follow if r["name"] == "follow-total"), (0, 0, 0))
    stats = np.zeros((len(hot), 4), np.int64)
    for r in sums:
        if r["name"] == "hot":
            stats[np.searchsorted(hot, np.int64(r["key"]).view(np.uint64))] = [r[x] for x in "abcd"]
    return Model(arrays, words, parts, total, hot, stats, discounts(*bi), discounts(*uni), whole[0], (uni[0], uni[1], whole[2]), order, discounts(*tri))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in common.sliced(whole)):
            n, known, base, score = model.score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array([model.tokens] * len(n), pa.int64()), pa.array(base), pa.array(score)], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row; log10 probabilities."""
    common.ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_score(model), f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
