"""Benchmark decontamination by latent semantic retrieval.

 1. Words (runs of letters and digits, A-Z in lower case) are hashed to 2**TERM_BITS terms. Passage frequencies of the
    terms are counted over all passages of PASSAGE words of all documents and give the idf weights.
 2. A randomised SVD of the TF-IDF passage matrix gives `rank` right singular vectors: Spark tasks add up A'(A X) for a
    random X, the driver orthogonalises that fixed-size matrix, and a second pass gives the small problem. The index is
    fitted on at most `fit_passages` passages (documents by hash of id); only the basis comes from that sample.
 3. Every window of every document is searched: a document is cut into blocks of STEP words, and sums of neighbouring
    blocks are projected. An item is asked for with windows of its own words, as many blocks long as lie inside it
    at any alignment, at every second shift. Windows whose cosine reaches `cosine` are candidates; no other filter
    drops any. A document of fewer blocks than an item's windows, but of `lcs` of the item's words or more, is one
    window and is held against the whole item and stretches as long as itself.
 4. A candidate is a match if the longest common subsequence of the item's words and the words around the window has
    `lcs` of the item's words or more, and that of its answer (its last sentence) `answer` of the answer's words. The
    subsequences of all candidates of a batch are found together, bit-parallel over the item, where
    enough words of the span are the item's, first in whole blocks (running sums tell), then in the span itself, and
    enough of the item's words occur in the span.

Recall against the comparison of every item with every window (tests/llm/test_learned.py), at the default cosine: 0.96
to 0.99 with 36 and 39 % of the words replaced by rare ones, which is as many as `lcs` still takes for a match (0.92 to
0.98 at a cosine of 0.55), every sixth word replaced 1.0, unchanged passages 1.0.

Items are asked for in blocks of `block_items`, so their number is not limited. Edge cases: null and empty texts match
nothing; very long texts are searched whole; items without words are skipped; of several places in a document that
match one item, the one with the highest LCS and then the first one is given; repeated documents each match; a null
doc_id stays null; no items or no documents give an empty result; ids are cast to long; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TERM_BITS = 16
PASSAGE = 64
STEP = 8
SLICES = 64
CHUNK = 256  # items whose words in each block are counted at once
WAITING = 500_000  # candidates of a batch that are held against their spans at once
MATCHES = "doc_id long, item_id long, cosine double, lcs_ratio double, answer_ratio double, word_start long"


def _terms(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - TERM_BITS)).astype(np.int64)


def _blocks(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of blocks of `size` words of every row, and each block's row."""
    n = -(-counts // size)
    row = np.repeat(np.arange(len(counts)), n)
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return (np.cumsum(counts) - counts)[row] + inside * size, row


def _by_block(counts: np.ndarray, starts: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The words' places by block of STEP words, with the number of all words where a row ends before its last block does."""
    place = starts[:, None] + np.arange(STEP)
    return np.where(place < np.cumsum(counts)[row][:, None], place, counts.sum())


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In slices: passages that have each term, and at last the number of passages."""
    total = np.zeros((1 << TERM_BITS) + SLICES, np.int64)
    for batch in (part for whole in batches for part in common.sliced(whole)):
        words, counts = common.word_hashes(batch.column("text"), common.PUNCTUATED)
        starts, _ = _blocks(counts, PASSAGE)
        if not len(words):
            continue
        passage = np.zeros(len(words), np.int64)
        passage[starts[1:]] = 1
        pairs = np.sort((np.cumsum(passage) << TERM_BITS) | _terms(words))
        new = np.ones(len(pairs), bool)
        new[1:] = pairs[1:] != pairs[:-1]
        total[: 1 << TERM_BITS] += np.bincount(pairs[new] & ((1 << TERM_BITS) - 1), minlength=1 << TERM_BITS)
        total[1 << TERM_BITS] += len(starts)
    yield from _emit(total)


def _emit(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    flat = total.reshape(SLICES, -1)
    yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in flat], pa.binary())], ["slice", "data"])


def _added(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column("slice").to_pylist(), batch.column("data")):
                a = np.frombuffer(x.as_buffer(), kind)
                total[k] = total[k] + a if k in total else a
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slice", "data"])

    return run


def _total(rows: DataFrame, kind: str, size: int) -> np.ndarray:
    """Sum of the tasks' arrays, a fixed size whatever the input; each slice is added up by one task."""
    out = np.zeros((SLICES, size // SLICES), kind)
    for r in rows.repartition(SLICES, "slice").mapInArrow(_added(kind), "slice int, data binary").collect():
        out[r["slice"]] = np.frombuffer(r["data"], kind)
    return out.reshape(-1)


def _passage_vectors(column: pa.Array, idf: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms of all words, their passages, and the passages' unit TF-IDF vectors times the basis (with the norm)."""
    words, counts = common.word_hashes(column, common.PUNCTUATED)
    term = _terms(words)
    starts, _ = _blocks(counts, PASSAGE)
    if not len(term):
        return term, term, np.zeros((0, basis.shape[1]))
    passage = np.zeros(len(term), np.int64)
    passage[starts[1:]] = 1
    passage = np.cumsum(passage)
    y = np.add.reduceat(basis[term] * idf[term, None], starts, axis=0)
    pairs, n = np.unique((passage << TERM_BITS) | term, return_counts=True)
    norm = np.sqrt(np.bincount(pairs >> TERM_BITS, weights=(n * idf[pairs & ((1 << TERM_BITS) - 1)]) ** 2, minlength=len(starts)))
    return term, passage, y / np.maximum(norm, 1e-9)[:, None] ** 2


def _range(idf, basis):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, x = idf.value, basis.value
        total = np.zeros(x.shape)
        for batch in (part for whole in batches for part in common.sliced(whole, most=1_000_000)):
            term, passage, y = _passage_vectors(batch.column("text"), w, x)
            if len(term):
                for j in range(x.shape[1]):
                    total[:, j] += np.bincount(term, weights=w[term] * y[passage, j], minlength=len(x))
        yield from _emit(total.astype(np.float32))

    return run


def _small(idf, basis):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, x = idf.value, basis.value
        total = np.zeros((x.shape[1], x.shape[1]))
        for batch in (part for whole in batches for part in common.sliced(whole, most=1_000_000)):
            words, counts = common.word_hashes(batch.column("text"), common.PUNCTUATED)
            starts, _ = _blocks(counts, PASSAGE)
            if len(starts):
                term = _terms(words)
                y = np.add.reduceat(x[term] * w[term, None], starts, axis=0)
                total += y.T.astype(np.float64) @ y
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slice", "data"])

    return run


def fit_index(docs: DataFrame, rank: int = 32, fit_passages: int = 100_000, seed: int = 5) -> np.ndarray:
    """A row for each term: idf times the term's place in the latent space (2**TERM_BITS x rank, float32).

    docs: (doc_id, text). Idf covers all passages; the basis is fitted on at most about fit_passages of them.
    """
    spark = docs.sparkSession
    width = 1 << TERM_BITS
    counted = _total(docs.mapInArrow(_frequencies, "slice int, data binary"), "<i8", width + SLICES)
    passages = int(counted[width])
    idf = np.log((passages + 1) / (counted[:width] + 1)) + 0.1
    share = min(1.0, fit_passages / max(passages, 1))
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))) if share < 1 else docs
    sample = common.staged(sample.select("text").repartition(1 + min(passages, fit_passages) // 25_000), "index-sample")  # few tasks: each sends a matrix
    x = np.random.default_rng(seed).standard_normal((width, rank)).astype(np.float32)
    w = spark.sparkContext.broadcast(idf)
    y = _total(sample.mapInArrow(_range(w, spark.sparkContext.broadcast(x)), "slice int, data binary"), "<f4", width * rank).reshape(width, rank)
    q = np.linalg.qr(y.astype(np.float64))[0].astype(np.float32)
    small = sample.mapInArrow(_small(w, spark.sparkContext.broadcast(q)), "slice int, data binary")
    gram = sum((np.frombuffer(r["data"]).reshape(rank, rank) for r in small.repartition(1).mapInArrow(_added("<f8"), "slice int, data binary").collect()), np.zeros((rank, rank)))
    _, turn = np.linalg.eigh(gram)
    # white: all directions count alike, as the strongest ones only tell languages and frequent words apart
    values = np.maximum(np.einsum("ij,jk,ki->i", turn.T, gram, turn), 1e-9)
    latent = (q @ turn) / np.sqrt(values)[None, :] * np.sqrt(values.max())
    common.release(spark)
    return (latent * idf[:, None]).astype(np.float32)


def _unit(a: np.ndarray) -> np.ndarray:
    a = a.astype(np.float32)
    return a / np.maximum(np.sqrt(np.einsum("ij,ij->i", a, a)), 1e-9)[:, None]


def lcs_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    place: dict[int, int] = {}
    for i, x in enumerate(a):
        place[x] = place.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        m = place.get(x)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


class Masks:
    """Where each item has each of its words, as bits of 64-bit lanes, for the LCS of many spans at once.

    Every item has a small hash table of its own in which its words do not collide.
    """

    LANES = 8  # items of more than 64 * LANES words go through lcs_length one by one
    CELLS = 2_000_000  # words of spans that are looked at together
    NONE = -2  # number of words that no item has; no place of the tables holds it

    def __init__(self, items: list[np.ndarray], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.items = items
        self.n = np.array([len(w) for w in items], np.int64)
        self.words = np.unique(np.concatenate([np.empty(0, np.uint64), *items]))
        self.fits = self.n <= 64 * self.LANES
        lanes = int(-(-self.n[self.fits].max() // 64)) if self.fits.any() else 1
        self.base, self.shift, self.turn = (np.zeros(len(items), np.uint32) for _ in range(3))
        keys, masks, used = [np.full(1, -1, np.int32)], [np.zeros((lanes, 1), np.uint64)], 1
        for o in np.flatnonzero(self.fits).tolist():
            ids, back = np.unique(np.searchsorted(self.words, items[o]).astype(np.uint32), return_inverse=True)
            bits, tries = max((2 * len(ids) - 1).bit_length(), 1), 0
            while True:
                turn = np.uint32(rng.integers(1 << 31) * 2 + 1)
                slot = (ids * turn) >> np.uint32(32 - bits)
                if len(np.unique(slot)) == len(ids):
                    break
                tries += 1
                bits += tries % 8 == 0
            key, mask = np.full(1 << bits, -1, np.int32), np.zeros((lanes, 1 << bits), np.uint64)
            key[slot] = ids
            at = np.arange(len(back))
            np.bitwise_or.at(mask, (at // 64, slot[back]), np.uint64(1) << (at % 64).astype(np.uint64))
            self.base[o], self.shift[o], self.turn[o] = used, 32 - bits, turn
            keys.append(key)
            masks.append(mask)
            used += 1 << bits
        self.keys, self.masks = np.concatenate(keys), np.concatenate(masks, axis=1)

    def number(self, words: np.ndarray) -> np.ndarray:
        """The items' number of each word; NONE for words that no item has."""
        if not len(self.words):
            return np.full(len(words), self.NONE, np.int32)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at, self.NONE).astype(np.int32)

    def lcs(self, o: np.ndarray, lo: np.ndarray, hi: np.ndarray, words: np.ndarray, ids: np.ndarray, share: float) -> np.ndarray:
        """LCS of item o and words lo to hi of each candidate; 0 where the span has less than `share` of its words."""
        out = np.zeros(len(o), np.int64)
        for c in np.flatnonzero(~self.fits[o]).tolist():
            out[c] = lcs_length(self.items[o[c]].tolist(), words[lo[c] : hi[c]].tolist())
        todo = np.flatnonzero(self.fits[o])
        todo = todo[np.argsort(hi[todo] - lo[todo], kind="stable")]
        begin = 0
        longest = hi[todo] - lo[todo]
        while begin < len(todo):
            end = begin + max(int(np.searchsorted(longest[begin:] * np.arange(1, len(todo) - begin + 1), self.CELLS, "right")), 1)
            mine = todo[begin:end]
            out[mine] = self._lcs(o[mine], lo[mine], hi[mine], ids, share)
            begin = end
        return out

    def _lcs(self, o: np.ndarray, lo: np.ndarray, hi: np.ndarray, ids: np.ndarray, share: float) -> np.ndarray:
        out = np.zeros(len(o), np.int64)
        longest = int((hi - lo).max())
        padded = np.concatenate([ids, np.full(longest, self.NONE, np.int32)])
        v = np.lib.stride_tricks.sliding_window_view(padded, longest)[lo]
        v[np.arange(longest) >= (hi - lo)[:, None]] = self.NONE
        slot = v.astype(np.uint32)
        slot *= self.turn[o][:, None]
        slot >>= self.shift[o][:, None]
        slot += self.base[o][:, None]
        hit = self.keys[slot] == v
        some = np.flatnonzero(np.count_nonzero(hit, axis=1) >= share * self.n[o])
        slot = np.where(hit[some], slot[some], 0)  # place 0 has an empty mask
        there = sum((np.bitwise_count(np.bitwise_or.reduce(m[slot], axis=1)).astype(np.int64) for m in self.masks), np.zeros(len(some), np.int64))
        more = np.flatnonzero(there >= share * self.n[o[some]])
        some, slot = some[more], slot[more].T.copy()
        if not len(some):
            return out
        rows = np.full((len(self.masks), len(some)), ~np.uint64(0))
        for at in slot:
            carry = np.zeros(len(some), np.uint64)
            for lane, row in enumerate(rows):
                m = self.masks[lane][at]
                u = row & m
                total = row + u
                over = total < row
                total += carry
                carry = (over | (total < carry)).astype(np.uint64)
                rows[lane] = total | (row & ~m)
        n = self.n[o[some]]
        for lane, row in enumerate(rows):
            used = np.clip(n - 64 * lane, 0, 64)
            mask = np.where(used == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(used, 63).astype(np.uint64)) - np.uint64(1))
            out[some] += used - np.bitwise_count(row & mask)
        return out


class Shared:
    """How many words of stretches of blocks an item may share, from running sums over the blocks.

    Words of which a span is likely to have more than the item does are taken to be there as often as in the item, so
    only the others are counted. Which these are costs or saves time; the counts are never too small.
    """

    def __init__(self, masks: Masks, ids: np.ndarray):
        """ids: numbers of some words of documents, for how frequent they are."""
        self.masks = masks
        self.rate = np.bincount(ids[ids >= 0], minlength=len(masks.words)) / max(len(ids), 1)
        self.chunks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _table(self, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The row of each of the items' words, 0 for those that none of the chunk's items has (Masks.NONE too), which items
        have it as one that is counted, and how many other words each item has."""
        if chunk not in self.chunks:
            items = self.masks.items[chunk * CHUNK : (chunk + 1) * CHUNK]
            n = np.array([len(w) for w in items], np.int64)
            number = self.masks.number(np.concatenate(items)).astype(np.int64)
            pair, times = np.unique(np.repeat(np.arange(len(items)), n) << 32 | number, return_counts=True)
            item, number = pair >> 32, pair & 0xFFFFFFFF
            counted = self.rate[number] * 3 * n[item] <= times
            used, at = np.unique(number, return_inverse=True)
            place = np.zeros(len(self.masks.words) + 2, np.int64)
            place[used] = np.arange(1, len(used) + 1)
            has = np.zeros((len(used) + 1, len(items)), np.uint8)
            has[at + 1, item] = counted
            self.chunks[chunk] = place, has, np.bincount(item, weights=times * ~counted, minlength=len(items)).astype(np.int64)
        return self.chunks[chunk]

    def most(self, ids: np.ndarray, o: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many words blocks begin to end and item o may share; ids: numbers of the words of each block."""
        out = np.zeros(len(o), np.int64)
        for chunk in np.unique(o // CHUNK).tolist():
            place, has, others = self._table(chunk)
            at = place[ids]
            each = has[at[:, 0]]
            for k in range(1, STEP):
                each += has[at[:, k]]
            upto = np.zeros((len(ids) + 1, has.shape[1]), np.int32)
            upto[1:] = each
            np.cumsum(upto, axis=0, out=upto)
            mine = np.flatnonzero(o // CHUNK == chunk)
            item = o[mine] - chunk * CHUNK
            out[mine] = upto[end[mine], item] - upto[begin[mine], item] + others[item]
        return out


class Items:
    """A block of benchmark items with their words, answers and query windows."""

    def __init__(self, rows: list[tuple[int, str]], index: np.ndarray, lcs: float):
        self.ids, self.words, self.answers = [], [], []
        queries: dict[int, list[np.ndarray]] = {}
        owners: dict[int, list[int]] = {}
        short: dict[int, list[np.ndarray]] = {}
        short_owners: dict[int, list[int]] = {}
        for item, text in rows:
            words, _ = common.word_hashes(pa.array([text], pa.string()), common.PUNCTUATED)
            if not len(words):
                continue
            last = [s for s in re.split(r"(?<=[.!?])\s+|\n", text or "") if re.search(r"\w", s)]
            answer, _ = common.word_hashes(pa.array(last[-1:], pa.string()), common.PUNCTUATED)
            n = len(words)
            size = max((n - STEP + 1) // STEP, 1)
            vectors = index[_terms(words)]
            for shift in range(0, STEP, 2):
                part = vectors[shift : shift + size * STEP] if n >= shift + size * STEP else vectors
                queries.setdefault(size, []).append(part.sum(axis=0))
                owners.setdefault(size, []).append(len(self.ids))
            sums = np.concatenate([np.zeros((1, vectors.shape[1])), np.cumsum(vectors, axis=0, dtype=np.float64)])
            for blocks in range(max(int(lcs * n / STEP), 1), size):
                width = blocks * STEP
                begin = np.append(np.arange(0, n - width, max(STEP // 2, width // 16)), n - width)
                parts = np.concatenate([sums[-1:], sums[begin + width] - sums[begin]])
                short.setdefault(blocks, []).append(parts)
                short_owners.setdefault(blocks, []).extend([len(self.ids)] * len(parts))
            self.ids.append(item)
            self.words.append(words)
            self.answers.append(answer.tolist() if len(answer) else words.tolist())
        self.masks = Masks(self.words)
        self.queries = {s: _layers(_unit(np.stack(q)), np.array(owners[s])) for s, q in queries.items()}
        self.short = {s: _layers(_unit(np.concatenate(q)), np.array(short_owners[s])) for s, q in short.items()}


def _layers(queries: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each item's first queries, its second ones and so on (its first once more where it has no further one), and the items.

    owners: each query's item, in ascending order."""
    items, first, n = np.unique(owners, return_index=True, return_counts=True)
    k = np.arange(int(n.max()))[:, None]
    return queries[first + np.where(k < n, k, 0)], items


def _near(v: np.ndarray, layers: np.ndarray, items: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of v, item, cosine) of all rows that reach the cosine with one of an item's queries, each pair once."""
    cos = v @ layers[0].T
    for queries in layers[1:]:
        np.maximum(cos, v @ queries.T, out=cos)
    flat = np.flatnonzero(cos.ravel() >= cosine)
    at, k = np.divmod(flat, len(items))
    return at, items[k], cos.ravel()[flat]


def _search(index, items: Items, cosine: float, lcs: float, answer: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = index.value
        lengths, shared = items.masks.n, None
        table = np.concatenate([table, np.zeros((1, table.shape[1]), table.dtype)])
        for batch in (part for whole in batches for part in common.sliced(whole, most=1_000_000)):
            words, counts = common.word_hashes(batch.column("text"), common.PUNCTUATED)
            if not len(words):
                continue
            ids = items.masks.number(words)
            starts, row = _blocks(counts, STEP)
            begins = np.cumsum(counts) - counts
            ends = begins + counts
            shared = shared or Shared(items.masks, ids)
            n_blocks = -(-counts // STEP)
            first = np.cumsum(n_blocks) - n_blocks
            place = _by_block(counts, starts, row)
            block_ids = np.append(ids, np.int32(Masks.NONE))[place]
            term = np.append(_terms(words), len(table) - 1)[place]
            each = table[term[:, 0]]
            for k in range(1, STEP):
                each += table[term[:, k]]
            sums = np.zeros((len(starts) + 1, table.shape[1]))
            sums[1:] = each
            np.cumsum(sums, axis=0, out=sums)
            matches: list[tuple] = []
            waiting: list[tuple] = []

            def compare() -> None:
                if not waiting:
                    return
                o, r, lo, hi, at, cos = (np.concatenate(x) for x in zip(*waiting))
                waiting.clear()
                begin, end = first[r] + (lo - begins[r]) // STEP, first[r] - (begins[r] - hi) // STEP
                k = np.flatnonzero(shared.most(block_ids, o, begin, end) >= lcs * lengths[o])
                o, r, lo, hi, at, cos = (x[k] for x in (o, r, lo, hi, at, cos))
                ratio = items.masks.lcs(o, lo, hi, words, ids, lcs) / lengths[o]
                k = np.flatnonzero(ratio >= lcs)
                matches.extend(zip(*(x[k].tolist() for x in (r, o, -ratio, at, lo, hi, cos))))

            def wait(*candidates: np.ndarray) -> None:
                waiting.append(candidates)
                if sum(len(x[0]) for x in waiting) >= WAITING:
                    compare()

            for size, (layers, owners) in items.queries.items():
                if len(starts) < size:
                    continue
                inside = np.flatnonzero(row[size - 1 :] == row[: len(row) - size + 1])
                most = max(250_000 // len(owners), 1)
                for k in range(0, len(inside), most):
                    here = inside[k : k + most]
                    p, o, cos = _near(_unit(sums[here + size] - sums[here]), layers, owners, cosine)
                    i = here[p]
                    r = row[i]
                    wait(o, r, np.maximum(begins[r], starts[i] - lengths[o]), np.minimum(ends[r], starts[i] + size * STEP + lengths[o]), starts[i] - begins[r], cos)
            for size, (layers, owners) in items.short.items():
                whole = np.flatnonzero(n_blocks == size)
                most = max(250_000 // len(owners), 1)
                for k in range(0, len(whole), most):
                    here = whole[k : k + most]
                    p, o, cos = _near(_unit(sums[first[here] + size] - sums[first[here]]), layers, owners, cosine)
                    r = here[p]
                    wait(o, r, begins[r], ends[r], np.zeros(len(r), np.int64), cos)
            compare()
            best: dict[tuple[int, int], tuple] = {}
            for r, o, ratio, at, lo, hi, cos in sorted(matches):
                if (r, o) not in best:
                    end = items.answers[o]
                    told = lcs_length(end, words[lo:hi].tolist()) / len(end)
                    if told >= answer:
                        best[r, o] = (-ratio, told, cos, at)
            if best:
                docs = batch.column("doc_id")
                rows = [(docs[r].as_py(), items.ids[o], c, ratio, told, s) for (r, o), (ratio, told, c, s) in best.items()]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], [x.split()[0] for x in MATCHES.split(", ")])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.5, lcs: float = 0.6, answer: float = 0.5, block_items: int = 5000, index: np.ndarray | None = None) -> DataFrame:
    """One row for each (document, item) that matches; docs: (doc_id, text), benchmark: (item_id, text)."""
    spark = docs.sparkSession
    common.ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    index = fit_index(docs) if index is None else index
    table = spark.sparkContext.broadcast(index)
    found = None
    block: list[tuple[int, str]] = []
    rows = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null").toLocalIterator()

    def search() -> DataFrame:
        return docs.mapInArrow(_search(table, Items(block, index, lcs), cosine, lcs, answer), MATCHES)

    for r in rows:
        block.append((r[0], r[1]))
        if len(block) == block_items:
            found = search() if found is None else found.unionByName(search())
            block = []
    if block or found is None:
        found = search() if found is None else found.unionByName(search())
    return found
