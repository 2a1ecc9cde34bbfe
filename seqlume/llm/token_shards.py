"""Token ids in grammar-compressed binary shards (Re-Pair).

Every shard holds the ids of consecutive documents. Frequent pairs of neighbouring symbols are replaced by new
symbols, again and again; the shard stores the rules, each symbol's expansion length and the remaining sequence, so
any range of ids can be decoded without the rest.

Shard layout, all integers little-endian unsigned 32-bit:
    magic 0x52504731, first rule symbol, number of rules, length of the sequence,
    rules (left, right) in order of creation, expansion length of each rule, sequence.

Shards are rows of a Parquet data set written by Spark, so a lost or repeated task leaves no partial shard:
part (range partition), seq (order within it), n_tokens, doc_ids, doc_tokens (ids of each document), payload.

Edge cases: null texts are empty; very long texts stay whole, so a shard may be longer than asked for; a null id sorts
first; equal ids keep all their rows, in the order of their texts; an empty table gives no shards; ids are cast to
long; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

MAGIC = 0x52504731
SHARD_SCHEMA = "part int, seq int, n_tokens long, doc_ids array<long>, doc_tokens array<long>, payload binary"
_BITS = 20
BROADCAST_ROWS = 1_000_000  # of 16 bytes


def _buckets(keys: np.ndarray) -> np.ndarray:
    return ((keys * common._STEP) >> np.uint64(64 - _BITS)).view(np.int64)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in ascending order and how often each one occurs."""
    keys = np.sort(keys)
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[start], np.diff(start, append=len(keys))


def _ranks(keys: np.ndarray, bucket: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The place of each key among the pairs, the greatest int32 for the others.

    A table leads from a bucket to one of its pairs, which is compared; pairs of a bucket that is taken go to one more
    table, until all pairs are placed.
    """
    out = np.full(len(keys), np.iinfo(np.int32).max, np.int32)
    where = _buckets(pairs)
    left = np.arange(len(pairs), dtype=np.int32)
    while len(left):
        table = np.full(1 << _BITS, -1, np.int32)
        table[where[left]] = left
        found = table[bucket]
        hit = np.flatnonzero(found >= 0)
        hit = hit[pairs[found[hit]] == keys[hit]]
        out[hit] = found[hit]
        left = left[table[where[left]] != left]
    return out


def _every_second(again: np.ndarray) -> np.ndarray:
    """Of places, ascending, where a pair overlaps an equal one before it: the first, third, ... of each run."""
    opens = np.diff(again, prepend=-2) != 1
    return again[(np.arange(len(again)) - np.flatnonzero(opens)[np.cumsum(opens) - 1]) % 2 == 0]


def _rest(seq: np.ndarray, following: int, least: int, rules: list[np.ndarray]) -> np.ndarray:
    """Goes on with compress's rounds, without a limit of pairs, and adds to the rules; following: the next new symbol.

    A new pair holds a symbol of the round before, so all its places are among those that changed, and other pairs only
    lose places. So symbols are linked and stay where they are, and a round takes the places of pairs that may still
    be frequent, each with its pair's number.
    """
    end, none = len(seq), np.iinfo(np.int32).max
    after, before = np.arange(1, end + 1), np.arange(-1, end - 1)
    gone, stale = np.zeros(end, bool), np.zeros(end + 1, bool)
    rank, number = np.full(end + 1, none, np.int32), np.zeros(end, np.int64)
    pairs, places, changed = np.empty(0, np.uint64), np.empty(0, np.int64), np.arange(end - 1)
    while True:
        key = (seq[changed] << np.uint64(32)) | seq[after[changed]]
        bucket = _buckets(key)
        some = np.flatnonzero((np.bincount(bucket, minlength=1 << _BITS) >= least)[bucket])
        fresh, n = _counted(key[some])
        fresh = fresh[n >= least]
        found = _ranks(key[some], bucket[some], fresh)
        some, found = changed[some[found != none]], found[found != none]
        number[some] = len(pairs) + found
        pairs, places = np.concatenate([pairs, fresh]), np.sort(np.concatenate([places, some]))
        pair = number[places]
        overlaps = np.flatnonzero((pair[1:] == pair[:-1]) & (after[places[:-1]] == places[1:])) + 1
        asked = np.ones(len(places), bool)
        if len(overlaps):
            asked[_every_second(overlaps)] = False
        n = np.bincount(pair[asked], minlength=len(pairs))
        order = np.flatnonzero(n >= least)
        if not len(order):
            break
        order = order[np.lexsort((pairs[order], -n[order]))]
        place = np.full(len(pairs), none, np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        lasting = n[pair] >= least
        at = places[asked & lasting]
        mine = place[number[at]]
        rank[at] = mine
        wins = (mine < rank[before[at]]) & (mine < rank[after[at]])
        rank[at] = none
        win, chosen = at[wins], mine[wins]
        used = np.bincount(chosen, minlength=len(order))
        kept = np.flatnonzero(used >= 2)
        if not len(kept):
            break
        win, chosen = win[used[chosen] >= 2], chosen[used[chosen] >= 2]
        new = np.zeros(len(order), np.uint64)
        new[kept] = following + np.arange(len(kept), dtype=np.uint64)
        following += len(kept)
        p = pairs[order[kept]]
        rules.append(np.stack([p >> np.uint64(32), p & np.uint64(0xFFFFFFFF)], 1))
        seq[win] = new[chosen]
        second = after[win]
        lost = np.concatenate([win, second, before[win]])
        after[win] = after[second]
        gone[second] = True
        inner = after[win] < end
        before[after[win[inner]]] = win[inner]
        stale[lost] = True
        places = places[lasting & ~stale[places]]
        stale[lost] = False
        changed = np.concatenate([win, before[win]])
        changed = changed[changed >= 0]
        changed = np.unique(changed[after[changed] < end])
    return seq[~gone]


def compress(ids: np.ndarray, first: int | None = None, top: int = 1 << 14, least: int = 4) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(first rule symbol, rules, expansion lengths, sequence).

    Each round counts all pairs of neighbours and replaces about `top` of the most frequent ones that occur `least`
    times or more; where two overlap, the more frequent one wins (of equally frequent ones that with the smaller
    symbols), and the other may be replaced in a later round. Rounds follow until no pair occurs `least` times or none
    can be replaced twice. Once fewer than `top` pairs can occur more than `least` times, a round looks only at what the
    one before it changed.
    """
    seq = np.asarray(ids, np.uint64)
    first = int(first if first is not None else (seq.max() + np.uint64(1) if len(seq) else 0))
    rules: list[np.ndarray] = []
    made = 0
    while len(seq) > 1:
        key = (seq[:-1] << np.uint64(32)) | seq[1:]
        again = np.flatnonzero(key[1:] == key[:-1]) + 1
        if len(again):  # of a run of one symbol: every second pair
            again = _every_second(again)
        bucket = _buckets(key)
        counts = np.bincount(bucket, minlength=1 << _BITS) - np.bincount(bucket[again], minlength=1 << _BITS)
        above = counts[counts > least]
        if len(above) < top:
            break
        most = int(np.partition(above, -top)[-top])
        for limit in sorted({most, least}, reverse=True):
            frequent = (counts >= limit)[bucket]
            frequent[again] = False
            at = np.flatnonzero(frequent)
            asked = key[at]
            pairs, n = _counted(asked)
            if len(n) and n.max() >= least:
                break
        else:
            break
        limit = min(limit, int(n.max()))
        order = np.flatnonzero(n >= limit)
        order = order[np.argsort(-n[order], kind="stable")]
        here = np.full(len(seq) + 1, np.iinfo(np.int32).max, np.int32)
        here[at + 1] = _ranks(asked, bucket[at], pairs[order])
        mine = here[1:-1]
        win = np.flatnonzero((mine < here[:-2]) & (mine < here[2:]))
        chosen = here[win + 1]
        used = np.bincount(chosen, minlength=len(order))
        kept = np.flatnonzero(used >= 2)
        new = np.zeros(len(order), np.uint64)
        new[kept] = first + made + np.arange(len(kept), dtype=np.uint64)
        win = win[used[chosen] >= 2]
        if not len(win):
            break
        chosen = here[win + 1]
        p = pairs[order[kept]]
        rules.append(np.stack([p >> np.uint64(32), p & np.uint64(0xFFFFFFFF)], 1))
        made += len(kept)
        seq[win] = new[chosen]
        left = np.ones(len(seq), bool)
        left[win + 1] = False
        seq = seq[left]
    seq = _rest(seq, first + made, least, rules)
    table = np.concatenate(rules).astype(np.uint32) if rules else np.empty((0, 2), np.uint32)
    length = np.ones(len(table), np.uint32)
    done = 0
    for r in rules:  # a round's rules only use symbols of earlier rounds
        part = np.zeros(len(r), np.uint32)
        for side in (0, 1):
            s = r[:, side].astype(np.int64) - first
            part += np.where(s >= 0, length[np.maximum(s, 0)] if len(length) else 1, 1).astype(np.uint32)
        length[done : done + len(r)] = part
        done += len(r)
    return first, table, length, seq.astype(np.uint32)


def pack(ids: np.ndarray, **how) -> bytes:
    first, rules, length, seq = compress(ids, **how)
    head = np.array([MAGIC, first, len(rules), len(seq)], "<u4")
    return b"".join(x.astype("<u4").tobytes() for x in (head, rules, length, seq))


class Shard:
    """Random access to a packed shard."""

    def __init__(self, payload: bytes):
        a = np.frombuffer(payload, "<u4")
        if len(a) < 4 or a[0] != MAGIC:
            raise ValueError("not a shard")
        self.first, n, m = int(a[1]), int(a[2]), int(a[3])
        self.rules, self.length, self.seq = a[4 : 4 + 2 * n].reshape(n, 2), a[4 + 2 * n : 4 + 3 * n], a[4 + 3 * n : 4 + 3 * n + m]
        size = np.ones(m, np.int64)
        new = self.seq >= self.first
        size[new] = self.length[self.seq[new].astype(np.int64) - self.first]
        self.ends = np.cumsum(size)

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        while True:
            new = seq >= self.first
            if not new.any():
                return seq
            at = np.cumsum(1 + new) - (1 + new)
            out = np.repeat(seq, 1 + new)
            rule = self.rules[seq[new].astype(np.int64) - self.first]
            out[at[new]], out[at[new] + 1] = rule[:, 0], rule[:, 1]
            seq = out

    def decode(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop, expanding only the symbols that cover them."""
        stop = len(self) if stop is None else min(stop, len(self))
        if start >= stop:
            return np.empty(0, np.uint32)
        a, b = np.searchsorted(self.ends, start, "right"), np.searchsorted(self.ends, stop, "left") + 1
        skip = start - (int(self.ends[a - 1]) if a else 0)
        part = self.seq[a:b]
        new = part >= self.first
        rule = part[new].astype(np.int64) - self.first
        size = np.ones(len(part), np.int64)
        size[new] = self.length[rule]
        asked = np.zeros(len(self.rules), bool)
        asked[rule] = True
        asked = np.flatnonzero(asked)  # each rule that is asked for is expanded once, which is no longer than the output
        flat = self._expand((asked + self.first).astype(np.uint32))
        begin = np.zeros(len(self.rules), np.int64)
        begin[asked] = np.cumsum(self.length[asked], dtype=np.int64) - self.length[asked]
        out = np.repeat(part, size)
        into = np.flatnonzero(np.repeat(new, size))
        each = size[new]
        out[into] = flat[np.arange(len(into)) + np.repeat(begin[rule] - (np.cumsum(each) - each), each)]
        return out[skip : skip + stop - start]


def _write(tokenizer_path: str, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, total, seq
            docs = [x for d, _, _ in held for x in d]
            counts, ids = np.concatenate([c for _, c, _ in held]), np.concatenate([i for _, _, i in held])
            row = [[part], [seq], [len(ids)], [docs], [counts.tolist()], [pack(ids)]]
            held, total, seq = [], 0, seq + 1
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], ["part", "seq", "n_tokens", "doc_ids", "doc_tokens", "payload"])

        for batch in (part for whole in batches for part in common.sliced(whole)):
            ids, counts = common.encoder(tokenizer_path).encode(batch.column("text"))
            ids = np.insert(ids, np.cumsum(counts), end_id)
            held.append((batch.column("doc_id").to_pylist(), counts + 1, ids.astype(np.uint32)))
            total += len(ids)
            if total >= shard_tokens:
                yield flush()
        if held:
            yield flush()

    return run


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, shard_tokens: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text, appends end_id, and writes shards in ascending order of id.

    A range partition's rows are cut into shards of about shard_tokens ids, which bounds a task's memory.
    """
    spark = docs.sparkSession
    common.ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(common.partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(_write(tokenizer_path, end_id, shard_tokens), SHARD_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_shards(df_path: str, spark) -> DataFrame:
    return spark.read.schema(SHARD_SCHEMA).parquet(df_path)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            shard, counts = Shard(row["payload"]), np.asarray(row["doc_tokens"], np.int64)
            ends = np.cumsum(counts)
            data = memoryview(shard.decode().astype("<u4").tobytes())
            crc = [zlib.crc32(data[4 * (e - c) : 4 * e]) for c, e in zip(counts.tolist(), ends.tolist())]
            n = len(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(row["base"] + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64()), pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32())],
                ["doc_id", "start", "n_tokens", "ids_crc32", "part", "seq"],
            )


def document_digests(spark, path: str) -> DataFrame:
    """Reads the shards back: (doc_id, start, n_tokens, ids_crc32, part, seq) for each document.

    Two numbers of each range partition go through the driver: its ids and its shards. The ids before each shard are
    broadcast if there are few enough shards, and joined by shuffle if not.
    """
    shards = read_shards(path, spark)
    each = shards.select("part", "seq", "n_tokens")
    sums = each.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("shards")).collect()
    before = {r["part"]: r["n"] for r in sums}
    total, starts = 0, []
    for part in sorted(before):
        starts.append((part, total))
        total += before[part]
    offsets = spark.createDataFrame(starts, "part int, part_start long")
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    base = each.join(F.broadcast(offsets), "part").select("part", "seq", (F.col("part_start") + F.coalesce(inside, F.lit(0))).alias("base"))
    rows = shards.select("part", "seq", "doc_ids", "doc_tokens", "payload").join(F.broadcast(base) if sum(r["shards"] for r in sums) <= BROADCAST_ROWS else base, ["part", "seq"])
    return rows.mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long, part int, seq int")
