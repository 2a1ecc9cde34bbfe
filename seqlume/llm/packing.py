"""Packing of tokenised documents into sequences of a fixed length, by local search.

Documents longer than a sequence are cut into full pieces, the first of which may be shorter; everything else stays
whole. Each piece, in the order in which they come, goes into the fullest bin that has room; then a local search moves
pieces, swaps one for one and exchanges two for one, either way, between underfull bins. Each change raises the sum of
squared fills, so space gathers in few bins until they empty; the search ends when no change of these kinds is left. An
index of all underfull bins by the room that they have, or would have without one or two of their pieces, finds the
change that leaves the least room.

Every task packs the pieces of its own input and holds at most about `window_tokens` ids at a time. At the end of a
window, bins with less than 1/64 of room are done, others are carried on to the next one. What a task has in underfull
bins at its end, or when they hold half a window, goes to a second stage, in which pieces from all tasks are mixed and
packed alike; there, each task (one for each `window_tokens` ids that are left) closes its underfull bins at its end, or
when they hold half a window. So the order of the input decides little: lengths that only come in different
partitions meet in the second stage.

Edge cases: a null text is an empty document, that is its end id alone; very long texts are cut, as stated; of changes
that leave equal room, moves go first and then what moves most; equal ids keep all their rows; an empty table gives no
rows; ids are cast to long; further columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PIECES = "doc_id long, piece int, start long, length long, sequence_id long, offset long, ids binary"


SLICE_BYTES = 500_000  # of text are encoded at a time, as a task holds a window of ids beside it
SECOND = 1 << 55  # numbers of the second stage's sequences begin here


class Bins:
    """Bins of items with whole-number sizes."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.items: list[list[tuple[int, int]]] = []  # (size, item)
        self.fill: list[int] = []

    def add(self, sizes: list[tuple[int, int]]) -> None:
        """Puts each item, in their order, into the fullest bin that has room, or into a new one."""
        open_bins = [(self.capacity - f, b) for b, f in enumerate(self.fill) if f < self.capacity]
        open_bins.sort()
        for size, item in sizes:
            k = bisect_left(open_bins, (size, -1))
            if k < len(open_bins):
                _, b = open_bins.pop(k)
            else:
                b = len(self.fill)
                self.items.append([])
                self.fill.append(0)
            self.items[b].append((size, item))
            self.fill[b] += size
            if self.fill[b] < self.capacity:
                insort(open_bins, (self.capacity - self.fill[b], b))

    def improve(self) -> int:
        """Local search between underfull bins until no change is left; returns the number of changes. Empty bins are
        dropped.

        Takes the emptiest bin and, for each of its items, the change with another underfull bin that leaves that one
        the least room: the item moves there, or comes in exchange for one or two that are smaller together. Where no
        item of a bin can change, pairs of its items are tried against one smaller item of another bin.
        """
        room_of = _Places(self.capacity)
        fill, items, changes = self.fill, self.items, 0

        def show(b: int) -> None:
            if 0 < fill[b] < self.capacity:
                room_of.show(b, self.capacity - fill[b], [s for s, _ in items[b]])
            else:
                room_of.hide(b)

        def exchange(b: int, given: list[tuple[int, int]], x: int, back: tuple[int, ...]) -> None:
            for one in given:
                items[b].remove(one)
            for s in back:
                items[b].append(items[x].pop(next(i for i, one in enumerate(items[x]) if one[0] == s)))
            items[x] += given
            moved = sum(s for s, _ in given) - sum(back)
            fill[x] += moved
            fill[b] -= moved
            show(x)
            if fill[x] < self.capacity:
                heappush(waiting, (fill[x], x))

        def pair_of(b: int) -> tuple[list[tuple[int, int]], int, tuple[int, ...]] | None:
            """Two items of b for one of another bin."""
            tried: set[int] = set()
            own = sorted(items[b], reverse=True)
            for i, one in enumerate(own):
                for other in own[i + 1 :]:
                    total = one[0] + other[0]
                    if total not in tried and (found := room_of.best(total, fill[b], (1,))) is not None:
                        return [one, other], *found
                    tried.add(total)
            return None

        for b in range(len(fill)):
            show(b)
        waiting = [(f, b) for b, f in enumerate(fill) if 0 < f < self.capacity]
        heapify(waiting)
        stuck: dict[int, int] = {}  # bins that nothing could be taken from, and how many changes had been made then
        while True:
            if not waiting:
                waiting = [(fill[x], x) for x, at in stuck.items() if 0 < fill[x] < self.capacity and at != changes]
                heapify(waiting)
                if not waiting:
                    break
            f, b = heappop(waiting)
            if f != fill[b] or stuck.get(b) == changes or not 0 < f < self.capacity:
                continue
            before = changes
            room_of.hide(b)
            for one in sorted(items[b], reverse=True):
                found = room_of.best(one[0], fill[b])
                if found is not None:
                    exchange(b, [one], *found)
                    changes += 1
                    if not fill[b]:
                        break
            if changes == before and (found := pair_of(b)) is not None:
                exchange(b, *found)
                changes += 1
            show(b)
            if changes > before:
                heappush(waiting, (fill[b], b))
            else:
                stuck[b] = changes
        kept = [b for b in range(len(fill)) if fill[b]]
        self.items, self.fill = [items[b] for b in kept], [fill[b] for b in kept]
        return changes


class _Places:
    """Underfull bins by the room they have, or would have without one or two of their items.

    Each list is a heap by the bins' own room, the largest first, as that bin takes in most. Entries may be outdated
    until they are met; an entry counts if its bin is as it was when it was shown.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.lists: list[list[list[tuple]]] = [[[] for _ in range(capacity + 1)] for _ in range(3)]
        self.full = [0, 0, 0]  # bit k: list k may have entries
        self.state: dict[int, int] = {}
        self.count = 0

    def hide(self, b: int) -> None:
        self.state.pop(b, None)

    def show(self, b: int, room: int, sizes: list[int]) -> None:
        self.count += 1
        self.state[b] = self.count
        self._put(0, room, (-room, b, self.count))
        each = sorted(set(sizes))
        for i, s in enumerate(each):
            self._put(1, room + s, (-room, b, self.count, s))
            if sizes.count(s) > 1:
                self._put(2, room + 2 * s, (-room, b, self.count, s, s))
            for t in each[i + 1 :]:
                self._put(2, room + s + t, (-room, b, self.count, s, t))

    def _put(self, kind: int, room: int, entry: tuple) -> None:
        heappush(self.lists[kind][room], entry)
        self.full[kind] |= 1 << room

    def best(self, size: int, own: int, kinds: tuple[int, ...] = (0, 1, 2)) -> tuple[int, tuple[int, ...]] | None:
        """(bin, sizes to give back) of the change that leaves that bin least room; own: fill of the giving bin; kinds:
        how many may come back.

        What leaves as much room as the giving bin has now, or the taking bin, raises no sum of squares.
        """
        best = None
        end = min(size + self.capacity - own, self.capacity + 1)
        for kind in kinds:
            rest = (self.full[kind] & (1 << end) - 1) >> size
            room = size
            while rest:
                step = (rest & -rest).bit_length() - 1
                room += step
                entry = self._top(kind, room)
                if entry is not None and -entry[0] > room - size:
                    best, end = entry, room
                    break
                rest >>= step + 1
                room += 1
        return (best[1], best[3:]) if best else None

    def _top(self, kind: int, room: int) -> tuple | None:
        entries = self.lists[kind][room]
        while entries and self.state.get(entries[0][1]) != entries[0][2]:
            heappop(entries)
        if not entries:
            self.full[kind] &= ~(1 << room)
            return None
        return entries[0]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    for k in range(0, len(rows), 2000):
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[k : k + 2000]), kinds)], ["doc_id", "piece", "start", "length", "sequence_id", "offset", "ids"])


class _Windows:
    """Pieces of one task in bins, window by window; hand_on: underfull bins' pieces get no sequence in the end."""

    def __init__(self, capacity: int, window_tokens: int, number: int, hand_on: bool):
        self.capacity, self.window, self.number, self.hand_on = capacity, window_tokens, number, hand_on
        self.bins, self.pending = Bins(capacity), []
        self.pieces: dict[int, tuple] = {}
        self.count = self.held = 0

    def put(self, doc: int, piece: int, start: int, size: int, ids: bytes) -> None:
        self.pieces[self.count] = (doc, piece, start, size, ids)
        self.pending.append((size, self.count))
        self.count += 1
        self.held += size

    def due(self) -> list[tuple]:
        """Rows of bins that are done, once a window is full."""
        if self.held < self.window:
            return []
        rows = self.close(False)
        return rows + self.close(True) if self.held >= self.window // 2 else rows

    def close(self, last: bool) -> list[tuple]:
        self.bins.add(self.pending)
        self.bins.improve()
        self.pending, rows, left = [], [], Bins(self.capacity)
        for items, fill in zip(self.bins.items, self.bins.fill):
            done = fill >= self.capacity - self.capacity // 64
            if not done and not last:
                left.items.append(items)
                left.fill.append(fill)
                continue
            sequence, offset = (None, 0) if self.hand_on and not done else (self.number, 0)
            for size, item in items:
                doc, piece, start, size, ids = self.pieces.pop(item)
                rows.append((doc, piece, start, size, sequence, offset if sequence is not None else None, ids))
                offset += size
            self.number += sequence is not None
        self.bins, self.held = left, sum(left.fill)
        return rows


def _pack(tokenizer_path: str, end_id: int, capacity: int, window_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _Windows(capacity, window_tokens, TaskContext.get().partitionId() << 32, True)
        for batch in (part for whole in batches for part in common.sliced(whole, most=SLICE_BYTES)):
            ids, counts = common.encoder(tokenizer_path).encode(batch.column("text"))
            data = np.insert(ids, np.cumsum(counts), end_id).astype("<u4").tobytes()
            begin, full = 0, []
            for doc, n in zip(batch.column("doc_id").to_pylist(), (counts + 1).tolist()):
                for k, (s, size) in enumerate(cut(n, capacity)):
                    mine = data[4 * (begin + s) : 4 * (begin + s + size)]
                    if size == capacity:
                        full.append((doc, k, s, size, windows.number, 0, mine))
                        windows.number += 1
                    else:
                        windows.put(doc, k, s, size, mine)
                begin += n
            yield from _batches(full)
            yield from _batches(windows.due())
        yield from _batches(windows.close(True))

    return run


def _pack_rest(capacity: int, window_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _Windows(capacity, window_tokens, SECOND + (TaskContext.get().partitionId() << 32), False)
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "piece", "start", "length", "ids"))):
                windows.put(*row)
            yield from _batches(windows.due())
        yield from _batches(windows.close(True))

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 2048, window_tokens: int = 16_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, piece, start, length, sequence_id, offset, ids) for each piece; ids are little-endian unsigned 32-bit."""
    common.ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    first = common.staged(rows.mapInArrow(_pack(tokenizer_path, end_id, capacity, window_tokens), PIECES), "packed")
    rest = first.where("sequence_id is null").select("doc_id", "piece", "start", "length", "ids")
    left = rest.agg(F.sum("length")).first()[0] or 0
    mixed = rest.repartition(-(-left // window_tokens) or 1, "doc_id", "piece", "length")
    second = common.staged(mixed.mapInArrow(_pack_rest(capacity, window_tokens), PIECES), "packed-rest")  # written here, as its batches are bounded then
    return first.where("sequence_id is not null").union(second)


def with_digest(packed: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids in place of the ids."""
    return packed.withColumn("ids_crc32", F.crc32("ids").cast("long")).drop("ids")
