"""Source divergence audit: how far the word use of a language's sources lies apart.

Terms are runs of ASCII letters (A-Z lower-cased) and of all characters beyond ASCII. A language keeps the terms that
at least `min_docs` of its documents hold. A group (language, source), and a language as a whole, gives each kept term
the share p = 1 + floor(1e9 (count + 5) / (N + 5 V)): count its occurrences there, N their sum over the V kept terms.
Two groups differ by the sum of |p - q| over all kept terms; a group's own terms are those whose share exceeds that in
the language. All of it is exact: whole numbers and decimals of 38 digits.

Joint count histograms: for two sources a term matters only through its two counts, so terms are tallied by (count,
count) and |p - q| is worked out once for each combination, times its multiplicity. Terms that both sources have are
tallied where they stand: kept terms are dealt out by range of (language, occurrences), so combinations repeat within
a task rather than across tasks, and a task tallies them block by block. Combinations with a zero are implied: those of
(a, 0) are the source's terms with count a less those it shares with the other one, and (0, 0) is what V leaves.

Every source of a language is compared with every other, which is what is asked for; what is sent grows with the
distinct combinations, not with terms, occurrences or documents.

Edge cases: null text, language and source count as ''. Repeated rows are documents of their own. Very long texts are
read whole. A group whose texts are empty, or keep no term, has a row for each other source all the same (0 where its
language keeps no term). Ties in value are ranked by the item's bytes. An empty table gives an empty result. Further
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

BROADCAST_ROWS = 1_000_000  # groups with their sums
SLICE = 8_000_000  # bytes of text whose terms are counted at once
BLOCK = 1 << 20  # rows (term, source) that are tallied at once
CELLS = 1 << 20  # (term, source) places of the matrix of a block

_NO_LETTER = np.ones(256, bool)
_NO_LETTER[65:91] = _NO_LETTER[97:123] = _NO_LETTER[128:] = False

_COUNTED = "lang string, source string, term string, n long, docs long"
_CELL = "lang string, a string, b string, na long, nb long, m long"


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and number of the term of every occurrence, and the terms by number."""
    raw, ends = common.arrow_bytes(texts)
    out = _NO_LETTER[raw]
    first = np.flatnonzero(~out & np.concatenate([[True], out[:-1]]))
    size = np.flatnonzero(out & ~np.concatenate([[True], out[:-1]])) - first
    offsets = np.concatenate([[0], np.cumsum(size)])
    words = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(common._LOWER[raw[~out]]))
    coded = words.dictionary_encode()
    return np.repeat(np.arange(len(ends)), np.diff(np.searchsorted(first, ends), prepend=0)), coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term) of a slice; a row without a term for each (lang, source)."""
    for batch in (part for whole in batches for part in common.sliced(whole, most=SLICE)):
        group: dict[tuple[str, str], int] = {}
        of = np.array([group.setdefault(g, len(group)) for g in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())], np.int64)
        row, term, names = _terms(batch.column("text"))
        distinct = max(len(names), 1)
        in_doc, n = np.unique(row * distinct + term, return_counts=True)
        key, at = np.unique(of[in_doc // distinct] * distinct + in_doc % distinct, return_inverse=True)
        docs = np.bincount(at, minlength=len(key))
        total = np.bincount(at, weights=n, minlength=len(key)).astype(np.int64)
        lang, source = (pa.array([g[i] for g in group], pa.string()) for i in (0, 1))
        none = pa.array(np.zeros(len(group), np.int64))
        yield pa.RecordBatch.from_arrays([lang, source, pa.array([""] * len(group), pa.string()), none, none], ["lang", "source", "term", "n", "docs"])
        at = pa.array(key // distinct)
        yield pa.RecordBatch.from_arrays([lang.take(at), source.take(at), names.take(pa.array(key % distinct)).cast(pa.string()), pa.array(total), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])


def kept_terms(docs: DataFrame, min_docs: int = 30, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows (lang, source, term, n, total, first) of the kept terms that a source has: its occurrences, those of the
    language, and whether this row is the term's first; each group also has a row with the term ''. Written to the
    shared folder."""
    common.ship(docs.sparkSession)
    blank = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    rows = docs.select(blank(text_col, "text"), blank(lang_col, "lang"), blank(source_col, "source"))
    counts = rows.mapInArrow(_count, _COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    summed = counts.withColumns({"total": F.sum("n").over(term), "in_docs": F.sum("docs").over(term), "least": F.min("source").over(term)})
    kept = summed.where((F.col("in_docs") >= min_docs) | (F.col("term") == ""))
    return common.staged(kept.select("lang", "source", "term", "n", "total", (F.col("source") == F.col("least")).alias("first")), "kept-terms")


def _block_cells(lang: str, term: np.ndarray, source: np.ndarray, n: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Combinations of counts of every two sources over some terms of one language.

    term and source are numbers, those of sources in the order of their names. For two sources that share terms: their
    combinations (na, nb) with multiplicities, and what these take away from (na, 0) and (0, nb).
    """
    counts = np.zeros((int(term.max()) + 1, len(names)), np.int64)
    counts[term, source] = n
    levels, code = np.unique(counts, return_inverse=True)
    code, many = code.reshape(counts.shape), len(levels)
    text = pa.array(names, pa.string())
    for a in range(len(names) - 1):
        mine = np.flatnonzero(counts[:, a])
        at, b = np.nonzero(counts[mine, a + 1 :])
        if not len(at):
            continue
        b += a + 1
        both, m = np.unique((b * many + code[mine[at], a]) * many + code[mine[at], b], return_counts=True)
        b, x, y = both // many // many, both // many % many, both % many
        left, of_left = np.unique(b * many + x, return_inverse=True)
        right, of_right = np.unique(b * many + y, return_inverse=True)
        b = np.concatenate([b, left // many, right // many])
        x = np.concatenate([levels[x], levels[left % many], np.zeros(len(right), np.int64)])
        y = np.concatenate([levels[y], np.zeros(len(left), np.int64), levels[right % many]])
        m = np.concatenate([m, -np.bincount(of_left, weights=m).astype(np.int64), -np.bincount(of_right, weights=m).astype(np.int64)])
        pair = [pa.array([lang], pa.string()).take(pa.array(np.zeros(len(m), np.int64))), text.take(pa.array(np.full(len(m), a))), text.take(pa.array(b))]
        yield pa.RecordBatch.from_arrays([*pair, pa.array(x), pa.array(y), pa.array(m, pa.int64())], ["lang", "a", "b", "na", "nb", "m"])


def _blocks(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The cells of whole terms, rows of a term standing together, sources of a term in order of their names."""
    coded = lambda c: rows.column(c).combine_chunks().dictionary_encode()
    lang, source = coded("lang"), coded("source")
    names = source.dictionary.to_pylist()
    language, code, n = lang.indices.to_numpy(), source.indices.to_numpy(), rows.column("n").to_numpy()
    begins = np.flatnonzero(rows.column("first").to_numpy())
    ends = np.append(begins[1:], len(n))
    change = np.flatnonzero(np.diff(language[begins], prepend=-1, append=-1))
    for low, high in zip(change[:-1].tolist(), change[1:].tolist()):
        used, local = np.unique(code[begins[low] : ends[high - 1]], return_inverse=True)
        used_names = sorted(names[u] for u in used)
        local = np.searchsorted(np.array(used_names, object), np.array([names[u] for u in used], object))[local]
        step = max(CELLS // len(used), 1)
        for at in range(low, high, step):
            stop = min(at + step, high)
            here = slice(begins[at], ends[stop - 1])
            term = np.repeat(np.arange(stop - at), ends[at:stop] - begins[at:stop])
            yield from _block_cells(lang.dictionary[int(language[begins[at]])].as_py(), term, local[begins[at] - begins[low] :][: len(term)], n[here], used_names)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tallies terms block by block; a block's last term waits for the rows that may follow."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BLOCK:
            rows = pa.Table.from_batches(held)
            last = int(np.flatnonzero(rows.column("first").to_numpy())[-1])
            if last:
                yield from _blocks(rows.slice(0, last))
                held = rows.slice(last).to_batches()
    if sum(b.num_rows for b in held):
        yield from _blocks(pa.Table.from_batches(held))


def _share(n: str, total: str, terms: str) -> str:
    """1 + floor(1e9 (n + 5) / (total + 5 terms)) as SQL."""
    number = "CAST({} AS DECIMAL(18, 0))".format
    return f"(1 + (({number(n)} + 5) * 1000000000BD) div greatest({number(total)} + 5 * {number(terms)}, 1BD))"


def _ranked(rows: DataFrame, part: str, top: int | None = None) -> DataFrame:
    """Rows (lang, source, item, value) with their rank, of every group the first `top` or all."""
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = rows.select("lang", "source", F.lit(part).alias("part"), "item", "value").withColumn("rank", rank)
    return ranked.where(F.col("rank") <= top) if top else ranked


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows (lang, source, part, item, value, rank).

    part pair: item is another source of the language, value their difference, every one ranked from the largest.
    part term: item is a term that the source uses more than its language does, value by how much, the first `top`.
    """
    spark = docs.sparkSession
    kept = kept_terms(docs, min_docs, text_col, lang_col, source_col)
    languages = kept.groupBy("lang").agg(F.sum("n").alias("in_lang"), F.count_if(F.expr("first and term <> ''")).alias("terms"))
    groups = common.staged(kept.groupBy("lang", "source").agg(F.sum("n").alias("in_group")).join(languages, "lang"), "term-groups")
    few = (lambda df: F.broadcast(df)) if groups.count() <= BROADCAST_ROWS else (lambda df: df)

    used = kept.where("term <> ''")
    own = used.join(few(groups), ["lang", "source"]).withColumn("value", F.expr(f"{_share('n', 'in_group', 'terms')} - {_share('total', 'in_lang', 'terms')}"))
    best = _ranked(own.where("value > 0").withColumnRenamed("term", "item"), "term", top)

    left = groups.select("lang", F.col("source").alias("a"), F.col("in_group").alias("in_a"), "terms")
    right = groups.select("lang", F.col("source").alias("b"), F.col("in_group").alias("in_b"))
    pairs = left.join(few(right), "lang").where("a < b")
    order = ["lang", "total", "term", "source"]
    dealt = used.select("lang", "total", "term", "source", "n", "first").repartitionByRange(common.partitions(spark), "lang", "total", "term").sortWithinPartitions(*order)
    shared = dealt.mapInArrow(_cells, _CELL)
    marginal = used.groupBy("lang", "source", "n").agg(F.count("*").alias("m"))
    zero = F.lit(0).cast("long")
    one = pairs.join(marginal.withColumnRenamed("source", "a"), ["lang", "a"]).select("lang", "a", "b", F.col("n").alias("na"), zero.alias("nb"), "m")
    other = pairs.join(marginal.withColumnRenamed("source", "b"), ["lang", "b"]).select("lang", "a", "b", zero.alias("na"), F.col("n").alias("nb"), "m")
    none = pairs.select("lang", "a", "b", zero.alias("na"), zero.alias("nb"), zero.alias("m"))
    histogram = shared.union(one).union(other).union(none).groupBy("lang", "a", "b", "na", "nb").agg(F.sum("m").alias("m"))

    apart = lambda x, y: f"abs({_share(x, 'in_a', 'terms')} - {_share(y, 'in_b', 'terms')})"
    cells = histogram.where("m <> 0 or na + nb = 0").join(pairs, ["lang", "a", "b"])
    seen = cells.groupBy("lang", "a", "b").agg(F.sum(F.expr(f"m * {apart('na', 'nb')}")).alias("seen"), F.sum("m").alias("m"), F.max("terms").alias("terms"), F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    value = seen.withColumn("value", F.expr(f"seen + (terms - m) * {apart('0', '0')}"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    far = _ranked(value.select("lang", both.alias("g"), "value").select("lang", "g.*", "value"), "pair")
    return far.union(best)
