"""Jaccard self-join of documents on word shingles, by prefix filters under several token orders.

If two sets reach the threshold, each order of all tokens puts a common token among the first |x| - ceil(t|x|) + 1
tokens of both. Three orders are used: rare tokens first (by a sketch of document frequencies of fixed size, the same
for all tasks, so any error in it only costs speed) with one and with another hash among equals, and a plain hash order.

 1. Documents with equal sets form a class, and one document stands for it.
 2. Prefix tokens under the first order are dealt out by token, with sizes and positions; classes that share none with
    another class are done.
 3. Every class is held against the centre of each of its tokens: the class there whose tokens are the most frequent
    on average. A text that others were copied from has no rare tokens of its own, so it is the centre of its copies.
    The links found give first components.
 4. Of every token that classes of different components share, pairs across components are candidates, if sizes and
    positions allow the threshold. What lies in one component already needs no pair, so no link between components
    is missed.
 5. In both steps, a pair must pass the prefix filters of the other two orders as well, which lists of 4 bytes a token
    tell: the prefixes have to share a token, and not to lack so many of each other's tokens that the threshold is out
    of reach. Only for pairs that pass all filters whole sets are made, joined and compared.
 6. Components of all links; each takes its smallest document id.

Words are runs of anything but \\x20 and \\x09-\\x0D, A-Z in lower case. Tokens are 64-bit hashes of shingles, classes
64-bit sums over them with the size, and neither is held against the texts again: in a corpus of 1e9 distinct shingles
two of them share a hash with a chance of a few per cent, and then count as one.

Edge cases: a document of 1 to n-1 words has its whole sequence as one shingle; one without words or with a null text
has an empty set and links to nothing; very long texts count whole; repeated rows form one class; a pair that just
reaches the threshold links; a row with a null id belongs to the component of the rows linked to it and never names one
(without any other, its component is null); an empty table gives an empty result; ids are cast to long; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SKETCH_BITS = 22
SLICES = 16
_SEEDS = [np.uint64(x) for x in (0, 0x5851F42D4C957F2D, 0x14057B7EF767814F, 0xD1342543DE82EF95)]
OTHER_ORDERS = ((2, True), (3, False))  # (seed, rare tokens first)
PREFIXES = ["second", "third"]  # under these orders
BROADCAST_ROWS = 1_000_000  # ids of 8 bytes, pairs of 20
TASK_TOKENS = 1_000_000  # postings that a task gathers, about 15 bytes each
DEALT_TOKENS = 250_000  # postings that a task holds before it deals them out, about 24 bytes each
_TOKEN, _HOT = np.uint64((1 << 39) - 1), np.uint64(1 << 39)  # bits of a token within its partition; very frequent ones


def document_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row in ascending order, one row after another, and each row's number."""
    words, counts = common.word_hashes(column)
    h, row = common.shingle_hashes(words, counts, n)
    ends = np.cumsum(np.bincount(row, minlength=len(column)))
    begin = 0
    for end in ends.tolist():
        if end - begin > 1:
            h[begin:end].sort()
        begin = end
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[keep], np.bincount(row[keep], minlength=len(column))


def _fingerprints(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        total[full] = np.add.reduceat(common.mix64(h + _SEEDS[1]), (np.cumsum(sizes) - sizes)[full])
    return common.mix64(total + sizes.astype(np.uint64)).view(np.int64)


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n - -(-percent * n // 100) + 1, 0)


def order_keys(h: np.ndarray, classes: np.ndarray | None, seed: int) -> np.ndarray:
    """Where a token stands in an order: by frequency class, then by hash."""
    x = h if seed == 0 else common.mix64(h ^ _SEEDS[seed])
    if classes is None:
        return x
    level = classes[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
    return (level << np.uint64(58)) | (x >> np.uint64(6))


def prefixes(h: np.ndarray, sizes: np.ndarray, classes: np.ndarray | None, seed: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, row numbers, positions) of every row's prefix."""
    key = order_keys(h, classes, seed)
    if key is h:
        key = h.copy()
    begin = 0
    for size in sizes.tolist():
        if size > 1:
            key[begin : begin + size].sort()
        begin += size
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first = place < prefix_size(sizes, percent)[row]
    return key[first], row[first], place[first]


def _classes(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "fp", "slice", "counts"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        seen = None
        for batch in (part for whole in batches for part in common.sliced(whole)):
            h, sizes = document_sets(batch.column("text"), n)
            fp = _fingerprints(h, sizes)
            seen = np.zeros(1 << SKETCH_BITS, np.uint32) if seen is None else seen
            np.add(seen, np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS), out=seen, casting="unsafe")
            m = len(sizes)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((batch.column("doc_id"), sizes, fp, [None] * m, [None] * m), kinds)], names)
        if seen is not None:
            for k, part in enumerate(np.split(seen, SLICES)):
                counts = pa.compress(np.minimum(part, 255).astype(np.uint8).tobytes(), "zstd", asbytes=True)  # an order needs no exact counts
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((None, None, None, k, counts), kinds)], names)

    return run


def _add_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, x in zip(batch.column("slice").to_pylist(), batch.column("counts")):
            a = np.frombuffer(pa.decompress(x.as_buffer(), (1 << SKETCH_BITS) // SLICES, "zstd"), np.uint8).astype(np.uint64)
            total[k] = total[k] + a if k in total else a
    if total:
        levels = [np.floor(np.log2(x.astype(np.float64) + 1)).clip(0, 63).astype(np.uint8).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(levels, pa.binary())], ["slice", "levels"])


def _sketch(rows: DataFrame) -> np.ndarray:
    """Frequency class of every bucket: a table of 2**SKETCH_BITS bytes, whatever the input's size."""
    parts = rows.where("slice is not null").select("slice", "counts").repartition(SLICES, "slice").mapInArrow(_add_slices, "slice int, levels binary").collect()
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    width = (1 << SKETCH_BITS) // SLICES
    for r in parts:
        out[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["levels"], np.uint8)
    return out


def _small(x: np.ndarray) -> bytes:
    """Small whole numbers: their width in bytes, then the numbers."""
    width = 1 if not len(x) or x.max() < 256 else 2 if x.max() < 65536 else 4
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _read_small(raw, n: int, at: int) -> tuple[np.ndarray, int]:
    width = int(np.frombuffer(raw, np.uint8, 1, at)[0])
    return np.frombuffer(raw, f"<u{width}", n, at + 1).astype(np.int64), at + 1 + width * n


def _scores(h: np.ndarray, sizes: np.ndarray, level: np.ndarray) -> np.ndarray:
    """How frequent each set's tokens are on average, in thousandths of a frequency class."""
    total = np.zeros(len(sizes))
    full = np.flatnonzero(sizes)
    if len(full):
        total[full] = np.add.reduceat(level[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.float64), (np.cumsum(sizes) - sizes)[full])
    return (1000 * total / np.maximum(sizes, 1)).astype(np.uint16)


def _blobs(held: list[tuple[np.ndarray, ...]], parts: int, edges: np.ndarray) -> pa.RecordBatch:
    """One blob for each partition of the postings held: a class once, and its postings there one after another."""
    starts = np.cumsum([0, *(len(fp) for fp, *_ in held)])
    fp, score, size = (np.concatenate([x[k] for x in held]) for k in range(3))
    token, spread, place = (np.concatenate([x[k] for x in held]) for k in range(3, 6))
    row = np.concatenate([x[6] + n for x, n in zip(held, starts.tolist())])
    first = np.zeros(len(fp), bool)
    first[np.unique(fp, return_index=True)[1]] = True  # equal sets count once
    part = np.searchsorted(edges, spread, "right").astype(np.min_scalar_type(parts))
    order = np.flatnonzero(first[row])
    order = order[np.argsort(part[order], kind="stable")]  # rows ascend within a partition
    token, place, row = token[order], place[order], row[order]
    cuts = np.searchsorted(part[order], np.arange(parts + 1)).tolist()
    blobs = []
    for a, b in zip(cuts, cuts[1:]):
        new = np.flatnonzero(np.append(True, row[a + 1 : b] != row[a : b - 1])) if b > a else np.empty(0, np.int64)
        mine, each, t = row[a:b][new], np.diff(new, append=b - a), token[a:b]
        head = np.array([b - a, len(mine)], "<i8").tobytes()
        blobs.append(b"".join((head, t.astype("<u4").tobytes(), (t >> np.uint64(32)).astype("<u1").tobytes(), fp[mine].astype("<i8").tobytes(), score[mine].astype("<u2").tobytes(), *map(_small, (size[mine], place[a:b], each)))))
    return pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])


def _postings(classes, n: int, percent: int, parts: int, hot_level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(classes.value, np.uint8)
        edges = (np.arange(parts + 1, dtype=np.float64) / parts * 2.0**64).clip(0, 2.0**64 - 2048).astype(np.uint64)[1:-1]
        held: list[tuple[np.ndarray, ...]] = []
        count = 0
        for batch in (part for whole in batches for part in common.sliced(whole)):
            h, sizes = document_sets(batch.column("text"), n)
            fp = _fingerprints(h, sizes)
            score = _scores(h, sizes, level)
            key, row, place = prefixes(h, sizes, level, 0, percent)
            spread = common.mix64(key)  # deals tokens out evenly, whatever their frequency class
            token = spread & _TOKEN
            hot = (key >> np.uint64(58)) >= hot_level  # a very frequent token goes to all partitions, by class
            token[hot] |= _HOT
            spread[hot] = common.mix64(key[hot] + fp[row[hot]].view(np.uint64))
            held.append((fp, score, sizes, token, spread, place.astype(np.int32), row.astype(np.int32)))
            count += len(token)
            if count >= DEALT_TOKENS:
                yield _blobs(held, parts, edges)
                held, count = [], 0
        if held:
            yield _blobs(held, parts, edges)

    return run


def _shared_tokens(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _shared(batches, percent)

    return run


def _possible(token: np.ndarray, n: np.ndarray, place: np.ndarray, percent: int, near: int = 16) -> np.ndarray:
    """Which postings (sorted by token) have another one of their token that sizes and positions allow to link.

    Up to `near` neighbours are looked at one by one; in longer lists, the smallest size stands for all others, which
    may keep a posting too many.
    """
    out = np.zeros(len(token), bool)
    rest = n - place
    for d in range(1, near + 1):
        same = np.flatnonzero(token[d:] == token[:-d])
        if not len(same):
            break
        x, y = n[same], n[same + d]
        fits = (100 * np.minimum(x, y) >= percent * np.maximum(x, y)) & (np.minimum(rest[same], rest[same + d]) >= -(-percent * (x + y) // (100 + percent)))
        out[same[fits]] = out[same[fits] + d] = True
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.empty(0, np.int64)
    length = np.diff(np.append(first, len(token)))
    if len(first) and length.max() > near + 1:
        small = np.repeat(np.minimum.reduceat(n, first), length)
        many = np.repeat(length > near + 1, length)
        out |= many & (rest >= -(-percent * (n + np.maximum(small, -(-percent * n // 100))) // (100 + percent)))
    return out


def _shared(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of one partition's postings, those whose token another class has that may link; those of hot tokens all stay."""
    columns: list[list[np.ndarray]] = [[] for _ in range(5)]
    for batch in batches:
        for part, x in zip(batch.column("part").to_pylist(), batch.column("blob")):
            raw = x.as_buffer()
            m, d = (int(v) for v in np.frombuffer(raw, "<i8", 2))
            at = 16
            token = np.frombuffer(raw, "<u4", m, at).astype(np.int64)
            token |= np.frombuffer(raw, "<u1", m, at := at + 4 * m).astype(np.int64) << 32
            token |= np.where(token & int(_HOT), 0, part << 40)  # a token of one partition is not that of another one
            fp = np.frombuffer(raw, "<i8", d, at := at + m)
            score = np.frombuffer(raw, "<u2", d, at := at + 8 * d)
            size, at = _read_small(raw, d, at + 2 * d)
            place, at = _read_small(raw, m, at)
            each, _ = _read_small(raw, d, at)
            local = np.repeat(np.arange(d), each)
            for held, a in zip(columns, (token, fp[local], size[local].astype(np.int32), place.astype(np.int32), score[local].astype(np.int32))):
                held.append(a)
    if not columns[0]:
        return
    token, fp, size, place, score = (np.concatenate(x) for x in columns)
    columns.clear()
    order = np.argsort(token)
    token = token[order]
    again = (token & int(_HOT)) != 0
    same = token[1:] == token[:-1]
    again[1:] |= same
    again[:-1] |= same
    order, token = order[again], token[again]
    by = np.lexsort((fp[order], token))
    order, token = order[by], token[by]
    fp, size, place, score = fp[order], size[order], place[order], score[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (fp[1:] != fp[:-1])
    token, fp, size, place, score = (x[new] for x in (token, fp, size, place, score))
    stay = _possible(token, size.astype(np.int64), place.astype(np.int64), percent) | ((token & int(_HOT)) != 0)
    token, fp, size, place, score = (x[stay] for x in (token, fp, size, place, score))
    for a in range(0, len(token), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 100_000]) for x in (token, fp, size, place, score)], ["token", "fp", "n", "place", "score"])


def _short(h: np.ndarray, sizes: np.ndarray, classes: np.ndarray | None, seed: int, percent: int) -> list[bytes]:
    """Each row's size and prefix under an order, in that order, as numbers of 4 bytes: the upper halves of its keys.
    Two tokens may share one, which only lets a pair pass."""
    key, row, _ = prefixes(h, sizes, classes, seed, percent)
    high = (key >> np.uint64(32)).astype("<u4")
    each = np.split(high, np.cumsum(np.bincount(row, minlength=len(sizes)))[:-1])
    return [np.array([n], "<u4").tobytes() + x.tobytes() for n, x in zip(sizes.tolist(), each)]


def _prefix_sets(n: int, percent: int, sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(sketch.value, np.uint8)
        for batch in (part for whole in batches for part in common.sliced(whole)):
            h, sizes = document_sets(batch.column("text"), n)
            fp = _fingerprints(h, sizes)
            one = np.unique(fp, return_index=True)[1].tolist()
            columns = [[p[i] for i in one] for p in (_short(h, sizes, level if rare else None, seed, percent) for seed, rare in OTHER_ORDERS)]
            yield pa.RecordBatch.from_arrays([pa.array(fp[one]), *(pa.array(c, pa.binary()) for c in columns)], ["fp", *PREFIXES])

    return run


def _whole_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in common.sliced(whole)):
            h, sizes = document_sets(batch.column("text"), n)
            fp = _fingerprints(h, sizes)
            one = np.unique(fp, return_index=True)[1]
            starts = np.cumsum(sizes) - sizes
            data = h.astype("<u8").tobytes()
            blobs = [data[8 * a : 8 * (a + b)] for a, b in zip(starts[one].tolist(), sizes[one].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(fp[one]), pa.array(blobs, pa.binary())], ["fp", "tokens"])

    return run


def class_sets(docs: DataFrame, classes: DataFrame, pairs: DataFrame, made, columns: list[str]) -> DataFrame:
    """(fp, columns) that `made` makes of the text of one document of each class in pairs. Classes that only rows
    without an id have are found among those rows."""
    wanted = common.staged(pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct(), "wanted")
    chosen = common.staged(classes.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min("doc_id").alias("_id")).select("_id").distinct(), "chosen")
    nameless = not chosen.where("_id is null").isEmpty()
    few = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    sets = docs.join(few, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").mapInArrow(made, "fp long, " + ", ".join(f"{c} binary" for c in columns))
    if nameless:
        sets = sets.join(wanted, "fp", "left_semi")
    sets = common.staged(sets, "class-sets")
    common.discard(wanted, chosen)
    return sets


def _meet(percent: int):
    """Whether prefixes under each of the other orders share a token and leave room for the threshold.

    A token of one prefix that comes before the other prefix's last one, and is not in it, is not in that set at all.
    """

    def test(row: list[np.ndarray]) -> bool:
        half = len(row) // 2
        for a, b in zip(row[:half], row[half:]):
            n, m, p, q = int(a[0]), int(b[0]), a[1:], b[1:]
            need = -(-percent * (n + m) // (100 + percent))
            here, there = np.isin(p, q), np.isin(q, p)
            if not here.any() or n - int((~here & (p < q[-1])).sum()) < need or m - int((~there & (q < p[-1])).sum()) < need:
                return False
        return True

    return test


def _reach(percent: int):
    """Whether two whole sets reach the threshold."""

    def test(row: list[np.ndarray]) -> bool:
        p, q = sorted(row, key=len)
        at = np.searchsorted(q, p)
        both = int((q[np.minimum(at, len(q) - 1)] == p).sum())
        return 100 * both >= percent * (len(p) + len(q) - both)

    return test


def _passing(names: list[str], kind: str, test):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(x) for x in names]
            mask = pa.array([test([np.frombuffer(x.as_buffer(), kind) for x in row]) for row in zip(*columns)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return run


def compared(pairs: DataFrame, sets: DataFrame, columns: list[str], kind: str, test, stretch: int = 2000) -> DataFrame:
    """The pairs (a, b) whose columns of sets pass the test. A class in many pairs is dealt out in stretches.

    Few enough pairs are broadcast to the sets, so that a set is only shuffled to where it is compared.
    """
    small = F.broadcast if pairs.count() <= BROADCAST_ROWS else lambda df: df
    side = lambda x: sets.select(F.col("fp").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns))
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(stretch)).cast("int").alias("k"))
    left = side("a").join(small(many), "a").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).drop("k")
    right = pairs.join(many.where("k > 1"), "a", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("b"), F.col("k")), F.lit(0)).cast("int")).drop("k")
    names = [f"{c}_{x}" for x in "ab" for c in columns]
    return side("b").join(small(right), "b").join(left, ["a", "salt"]).select("a", "b", *names).mapInArrow(_passing(names, kind, test), "a long, b long")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(fp, label) of every class that has a link; label: the least class that links lead to.

    Every round takes the least label around each class and then the label of that label; each round's table is
    written, so a lost executor repeats one round at most.
    """
    edges = common.staged(links.union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = common.staged(edges.groupBy(F.col("a").alias("fp")).agg(F.least(F.col("fp"), F.min("b")).alias("label")), "labels")
    for _ in range(rounds):
        around = edges.join(labels.select(F.col("fp").alias("b"), "label"), "b").groupBy(F.col("a").alias("fp")).agg(F.min("label").alias("near"))
        least = labels.select("fp", "label").join(around, "fp").select("fp", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("fp").alias("label"), F.col("label").alias("top"))
        new = common.staged(least.join(up, "label").select("fp", "old", F.least("label", "top").alias("label")), "labels")
        common.discard(labels)
        labels = new
        if new.where("old != label").isEmpty():
            common.discard(edges)
            return new.select("fp", "label")
    raise RuntimeError("components did not settle")


def _need(percent: int, n, m):
    """Common tokens that sets of n and m tokens need at least."""
    return F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent))


def _fits(percent: int):
    """Whether sizes and positions of a shared token (columns of x and y) allow the threshold."""
    n, m = F.col("x.n"), F.col("y.n")
    rest = F.least(n - F.col("x.place"), m - F.col("y.place"))
    return (F.col("x.token") == F.col("y.token")) & (F.col("x.label") != F.col("y.label")) & (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (rest >= _need(percent, n, m))


def centre_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each token's centre a with the token's other classes; lists: (token, fp, n, place, score, label)."""
    best = lists.groupBy("token").agg(F.max(F.struct("score", "fp", "n", "place", "label")).alias("c"), F.count("*").alias("size")).where("size > 1")
    best = common.staged(best.select("token", "c.*"), "centres")
    found = best.alias("x").join(lists.alias("y"), _fits(percent)).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    return found.distinct()


def candidates(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes with different labels that share a token; lists: (token, fp, n, place, label).

    Postings that no partner of their token is near enough in size for are left out first. A token's most frequent
    label is not paired with itself, nor is any other label with itself, so what one component holds already costs
    nothing.
    """
    mixed = lists.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("n").alias("small")).where("lo != hi").select("token", "small")
    smallest = F.greatest(F.col("small"), F.ceil(F.lit(percent) * F.col("n") / 100))
    rows = lists.join(mixed, "token").where(F.col("n") - F.col("place") >= _need(percent, F.col("n"), smallest)).drop("small")
    rows = common.staged(rows, "mixed-tokens")
    each = rows.groupBy("token", "label").count()
    main = each.groupBy("token").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1")
    rows = common.staged(rows.join(main, "token").withColumn("minor", F.col("label") != F.col("main")).drop("main", "labels"), "minor-tokens")
    once = ~F.col("y.minor") | (F.col("x.fp") < F.col("y.fp"))
    pairs = rows.where("minor").alias("x").join(rows.alias("y"), _fits(percent) & once)
    return pairs.select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, shingle: int = 5, hot_level: int = 14, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id) for every row of docs.

    Two documents link when 100 * |x & y| >= percent * |x | y| over their distinct shingles; component_id is the
    smallest id that links lead to, the document's own included. Tokens that the sketch counts 2**hot_level times or more
    are dealt out by class as well, so that no task has to hold such a token's documents.
    """
    spark = docs.sparkSession
    common.ship(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    read = common.staged(docs.mapInArrow(_classes(shingle), "doc_id long, n long, fp long, slice int, counts binary"), "classes")
    classes = read.where("slice is null").select("doc_id", "n", "fp")
    sketch = spark.sparkContext.broadcast(_sketch(read).tobytes())
    common.release(spark)
    tokens = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(2, -(-tokens * (100 - percent) // (100 * TASK_TOKENS)))

    posted = docs.mapInArrow(_postings(sketch, shingle, percent, parts, hot_level), "part int, blob binary")
    shared = common.dealt(posted, parts).mapInArrow(_shared_tokens(percent), "token long, fp long, n int, place int, score int")
    lists = common.staged(shared, "shared-tokens")
    common.release(spark)

    def verified(pairs: DataFrame) -> DataFrame:
        sets = class_sets(docs, classes, pairs, _prefix_sets(shingle, percent, sketch), PREFIXES)
        near = common.staged(compared(pairs, sets, PREFIXES, "<u4", _meet(percent)), "filtered")
        common.discard(sets, pairs)
        common.release(spark)
        sets = class_sets(docs, classes, near, _whole_sets(shingle), ["tokens"])
        links = common.staged(compared(near, sets, ["tokens"], "<u8", _reach(percent)), "links")
        common.discard(sets, near)
        common.release(spark)
        return links

    links = verified(common.staged(centre_pairs(lists.withColumn("label", F.col("fp")), percent), "centre-pairs"))
    labels = components(links)
    pairs = common.staged(candidates(lists.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp")), percent), "candidates")
    common.discard(lists)
    if not pairs.isEmpty():
        labels = components(links.union(verified(pairs)))
    own = classes.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("own"))
    least = labels.join(own, "fp").groupBy("label").agg(F.min("own").alias("least"))
    named = own.join(labels.join(least, "label").select("fp", "least"), "fp", "left")
    named = common.staged(named.select("fp", F.coalesce("least", "own").alias("component_id")), "components")  # written, so that Spark can split a class of many rows
    some = classes.where("n > 0").join(named, "fp").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return some.unionByName(classes.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
