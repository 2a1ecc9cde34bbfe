"""Scans along a sequence in many tasks: a greedy choice without overlaps, and a genome's chunks with all variants.

Greedy choice: rows of a group in order of their start are kept if they don't begin before the end of the last one
kept. What a stretch of rows does depends on that end only, and as choices that begin apart soon meet, it is a short
step function of it: (starts up to p: the last end is then e). Stretches are numbered by row, so each is bounded, and holds
many small groups or part of a large one; the functions of groups that reach over borders are worked out in parallel
by jump pointers (to the next row that can be kept, with doubling reach), walked in order of the stretches, which
gives each its incoming end, and then each stretch marks its rows. Only the walk is one after another for a group, over
steps and not rows, and it holds one number.

Edge cases: rows without start or end are never kept; null keys are a group; repeated rows: the first is kept, and the
others too only if they have no length; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlume.sources.staging import staged

from .groups import carried_sums, numbered

STRETCH = 100_000
BEFORE_ALL = -(1 << 62)


class Stretch:
    """Rows of one or more groups, each group's together and in order of start; groups by number, in order."""

    def __init__(self, group: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.group, self.start, self.end, n = group, start, end, len(start)
        level = np.unique(np.concatenate([start, end]))
        place = lambda x: group * (len(level) + 1) + np.searchsorted(level, x)
        self.begins = np.flatnonzero(np.diff(group, prepend=-1))
        self.stops = np.append(self.begins[1:], n)
        #: for each row the next one of its group that can be kept after it; its group's end where there is none
        self.following = np.maximum(np.searchsorted(place(start), place(end), "left"), np.arange(1, n + 1))

    def last_ends(self) -> np.ndarray:
        """For each row the end of the last row kept if it is the first one, by pointers that double their reach."""
        own = np.arange(len(self.start))
        at = np.where(self.following < self.stops[self.group], self.following, own)
        while not np.array_equal(further := at[at], at):
            at = further
        return self.end[at]

    def steps(self, group: int) -> tuple[np.ndarray, np.ndarray]:
        """The step function of a group: for an incoming end up to upto[i], the first that is so, the last end is last[i]."""
        rows = slice(self.begins[group], self.stops[group])
        start, last = self.start[rows], self.last_ends()[rows]
        first = np.flatnonzero(np.diff(start, prepend=start[0] - 1))  # of equal starts the first row is met
        turn = np.flatnonzero(np.append(last[first][1:] != last[first][:-1], True))
        return start[first][turn], last[first][turn]

    def kept(self, incoming: int) -> list[int]:
        """Rows that are kept if the first group comes in with this end and the others begin here."""
        following, stops, out = self.following.tolist(), self.stops.tolist(), []
        for g, i in enumerate(self.begins.tolist()):
            if g == 0:
                i += int(np.searchsorted(self.start[: stops[0]], incoming, "left"))
            while i < stops[g]:
                out.append(i)
                i = following[i]
        return out


def _in_order(table: pa.Table) -> tuple[pa.Table, Stretch]:
    """A stretch's rows by number; groups begin where any of the key's columns changes."""
    table = table.sort_by("_id").combine_chunks()
    key = table.column("_key").combine_chunks()
    new = np.zeros(len(table), bool)
    new[0] = True
    for c in key.flatten():
        same = pc.fill_null(pc.equal(c[1:], c[:-1]), False)
        both = pc.and_(c[1:].is_null(), c[:-1].is_null())
        new[1:] |= ~pc.or_(same, both).to_numpy(zero_copy_only=False)
    return table, Stretch(np.cumsum(new) - 1, table.column("_low").to_numpy(), table.column("_high").to_numpy())


def greedy_without_overlaps(df: DataFrame, keys: list[str], start: str, end: str, order: list[str] = (), stretch: int = STRETCH) -> DataFrame:
    """The rows of df (start, end half open) that a greedy choice keeps in each group of keys; order breaks ties of start."""
    usable = df.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    rows = numbered(usable.select(F.struct(*keys).alias("_key"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), F.col(start).cast("long").alias("_low"), F.col(end).cast("long").alias("_high"), F.struct(*order, F.lit(0)).alias("_order")), [F.col("_key"), F.col("_low"), F.col("_order")], "_id")
    rows = staged(rows.withColumn("_stretch", F.floor(F.col("_id") / stretch)).drop("_order"), "ordered")
    key, long = rows.schema["_key"].dataType, T.LongType()
    spans = rows.select("_stretch", "_id", "_key", "_low", "_high")

    def steps(table: pa.Table) -> pa.Table:
        """Of the groups that may reach over a stretch's borders: its first one's function, and how its last one ends."""
        table, here = _in_order(table)
        groups = len(here.begins)
        found = [(0, True, *here.steps(0)), *([(groups - 1, False, *(x[:1] for x in here.steps(groups - 1)))] if groups > 1 else [])]
        at = pa.array(np.repeat([here.begins[g] for g, *_ in found], [len(f[2]) for f in found]))
        columns = [table.column("_key").take(at), table.column("_stretch").take(at), pa.array(np.repeat([f[1] for f in found], [len(f[2]) for f in found])), *(pa.array(np.concatenate([f[i] for f in found])) for i in (2, 3))]
        return pa.table(columns, ["_key", "_stretch", "head", "upto", "last"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at, incoming, outgoing, met = None, None, BEFORE_ALL, BEFORE_ALL, False
        for batch in batches:
            out = []
            for k, s, head, upto, last in zip(*(batch.column(c).to_pylist() for c in ("_key", "_stretch", "head", "upto", "last"))):
                if at is None or k != group:
                    group, at, outgoing = k, None, BEFORE_ALL
                if s != at:
                    at, incoming, met = s, outgoing, False
                    out += [(s, incoming)] if head else []
                if not met and upto >= incoming:
                    outgoing, met = last, True
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["_stretch", "_incoming"])

    def kept(table: pa.Table) -> pa.Table:
        table, here = _in_order(table)
        return pa.table([table.column("_id").take(pa.array(here.kept(table.column("_incoming")[0].as_py()), pa.int64()))], ["_id"])

    step_type = T.StructType([T.StructField("_key", key), T.StructField("_stretch", long), T.StructField("head", T.BooleanType()), T.StructField("upto", long), T.StructField("last", long)])
    functions = spans.groupBy("_stretch").applyInArrow(steps, step_type)
    incoming = functions.repartition(F.col("_key")).sortWithinPartitions("_key", "_stretch", "upto").mapInArrow(walk, "_stretch long, _incoming long")
    chosen = spans.join(incoming, "_stretch").groupBy("_stretch").applyInArrow(kept, "_id long")
    return rows.join(chosen, "_id", "left_semi").select("_row.*")


def consensus(chunks: DataFrame, variants: DataFrame, check: bool = True, stretch: int = STRETCH) -> DataFrame:
    """(sample, chrom, chunk_start, out_start, mutated): every chunk of a genome with each sample's variants.

    chunks: (chrom, chunk_start, seq), pieces that follow each other without gap or overlap, all but a chromosome's
    last of one length; variants: (sample, chrom, pos 0-based, ref, alt), of several alternatives the first. A variant
    that begins before the end of the last one kept is left out. One that reaches over the border of chunks puts its
    alternative where it begins, and each chunk loses its own part of REF, so it is applied once. out_start is the
    chunk's place in the sample's sequence. With check, a REF that isn't there is an error. Variants past the end of
    their chromosome count as not there; samples have the chromosomes on which they have variants.
    """
    first = F.get(F.split("alt", ","), F.lit(0))
    asked = variants.select("sample", "chrom", F.col("pos").cast("long").alias("pos"), "ref", first.alias("alt")).where("ref <> ''").distinct()
    asked = staged(asked, "asked-variants")  # dealing out by range reads its input twice
    kept = staged(greedy_without_overlaps(asked.withColumn("_stop", F.col("pos") + F.length("ref")), ["sample", "chrom"], "pos", "_stop", ["ref", "alt"], stretch), "kept-variants")
    step = chunks.agg(F.max(F.length("seq"))).first()[0] or 1
    parts = kept.withColumn("chunk_start", F.explode(F.sequence(F.floor(F.col("pos") / step) * step, F.floor((F.col("_stop") - 1) / step) * step, F.lit(step).cast("long"))))
    low, high = F.greatest(F.col("pos"), F.col("chunk_start")), F.least(F.col("_stop"), F.col("chunk_start") + step)
    edit = F.struct((low - F.col("chunk_start")).cast("int").alias("a"), (high - F.col("chunk_start")).cast("int").alias("b"), F.substring("ref", (low - F.col("pos") + 1).cast("int"), (high - low).cast("int")).alias("ref"), F.when(F.col("pos") >= F.col("chunk_start"), F.col("alt")).otherwise("").alias("alt"))
    edits = parts.groupBy("sample", "chrom", "chunk_start").agg(F.array_sort(F.collect_list(edit)).alias("e"))
    every = chunks.join(kept.select("sample", "chrom").distinct(), "chrom")
    rows = every.join(edits, ["sample", "chrom", "chunk_start"], "left").withColumn("e", F.coalesce("e", F.array().cast(edits.schema["e"].dataType)))
    there = lambda v: F.substring(F.col("seq"), v["a"] + 1, v["b"] - v["a"]) == v["ref"]
    wrong = F.filter("e", lambda v: ~there(v))
    told = F.raise_error(F.concat_ws(" ", F.lit("reference allele mismatch in"), "sample", "chrom", F.lit("at"), F.col("chunk_start") + F.get(wrong, F.lit(0))["a"]))
    before = lambda i: F.when(i > 0, F.get("e", i - 1)["b"]).otherwise(F.lit(0))
    pieces = F.transform("e", lambda v, i: F.concat(F.substring(F.col("seq"), before(i) + 1, v["a"] - before(i)), v["alt"]))
    end = F.coalesce(F.get("e", F.size("e") - 1)["b"], F.lit(0))
    mutated = F.concat(F.array_join(pieces, ""), F.substring(F.col("seq"), end + 1, F.length("seq")))
    done = rows.select("sample", "chrom", "chunk_start", (F.when(F.size(wrong) == 0, mutated).otherwise(told) if check else mutated).alias("mutated")).withColumn("_n", F.length("mutated").cast("long"))
    return carried_sums(staged(done, "consensus"), ["sample", "chrom"], ["chunk_start"], {"out_start": "_n"}).select("sample", "chrom", "chunk_start", "out_start", "mutated")
