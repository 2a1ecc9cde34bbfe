"""Features of splicing events: lengths, composition, motif profiles, matrix scans, branch points."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlume.functions import scores, sequence

#: Motifs of RNA-binding proteins.
RBP_MOTIFS = {"nova": ["YCAY"], "celf": ["YGCTYK"], "star": ["YTAAY"], "srrm4": ["TGC"], "srsf11": ["TCTCT", "CTCTC"]}


def event_windows(events: DataFrame, width: int) -> DataFrame:
    """(event, strand, region, start, end): half-open windows beside and in the exon; 0-based introns."""
    plus = F.col("strand") == "+"
    span = lambda region, p, m: F.struct(F.lit(region).alias("region"), F.when(plus, p[0]).otherwise(m[0]).alias("start"), F.when(plus, p[1]).otherwise(m[1]).alias("end"))
    ua, ub, da, db = (F.col(c) for c in ("upIntStart", "upIntEnd", "dnIntStart", "dnIntEnd"))
    spans = F.array(
        span("up", (ub - width, ub), (ua, ua + width)),
        span("exon", (ub, da), (db, ua)),
        span("dn", (da, da + width), (db - width, db)),
    )
    return events.select("event", "chrom", "strand", F.explode(spans).alias("w")).select("event", "chrom", "strand", "w.*")


def with_sequence(windows: DataFrame, pieces: DataFrame, size: int) -> DataFrame:
    """Adds seq in transcript direction; pieces: chunks that overlap by the longest window; N where there is none."""
    at = F.floor(F.greatest(F.col("start"), F.lit(0)) / size) * size
    p = pieces.select(F.col("chrom").alias("_c"), F.col("chunk_start").alias("_s"), F.col("seq").alias("_q"))
    rows = windows.join(p, (F.col("chrom") == F.col("_c")) & (at == F.col("_s")), "left")
    forward = F.upper(sequence.padded_window(F.coalesce("_q", F.lit("")), F.coalesce("_s", F.col("start")), "start", "end"))
    return rows.withColumn("seq", F.when(F.col("strand") == "-", sequence.reverse_complement(forward)).otherwise(forward)).drop("_c", "_s", "_q")


def lengths(events: DataFrame, moments: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """log10 lengths of introns and exon, as z-scores where (mean, deviation) is given."""
    span = {"up_length": F.abs(F.col("upIntEnd") - F.col("upIntStart")), "dn_length": F.abs(F.col("dnIntEnd") - F.col("dnIntStart")), "exon_length": F.abs(F.when(F.col("strand") == "+", F.col("dnIntStart") - F.col("upIntEnd")).otherwise(F.col("upIntStart") - F.col("dnIntEnd")))}
    value = lambda n, c: scores.zscore_log10(c, *moments[n]) if moments and n in moments else F.log10(c)
    return events.select("event", *(value(n, c).alias(n) for n, c in span.items()))


def composition(windows: DataFrame) -> DataFrame:
    """GC and pyrimidine shares, one column for each region."""
    rows = windows.select("event", "region", sequence.fraction_of("seq", "GC").alias("gc"), sequence.fraction_of("seq", "CT").alias("py"))
    return rows.groupBy("event").pivot("region", ["up", "exon", "dn"]).agg(F.max("gc").alias("gc"), F.max("py").alias("py"))


def rbp_counts(windows: DataFrame, motifs: dict[str, list[str]] = RBP_MOTIFS) -> DataFrame:
    """Overlapping motif counts, one column for each protein and region."""
    counts = [sum((sequence.motif_count("seq", m) for m in ms), F.lit(0)).alias(n) for n, ms in motifs.items()]
    rows = windows.select("event", "region", *counts)
    return rows.groupBy("event").pivot("region", ["up", "exon", "dn"]).agg(*(F.max(n).alias(n) for n in motifs))


def best_hits(hits: DataFrame, columns: list[str]) -> DataFrame:
    """The greatest score of each event by motif and region: (event, <motif>_<region>...); hits: (sequence_name
    "<event>_<region>", motif, score)."""
    region = F.substring_index("sequence_name", "_", -1)
    event = F.regexp_extract("sequence_name", "^(.*)_[^_]*$", 1)
    rows = hits.select(event.alias("event"), F.concat_ws("_", "motif", region).alias("feature"), F.col("score").cast("double").alias("score"))
    return rows.groupBy("event").pivot("feature", columns).agg(F.max("score"))


def matrix_scan(sequences: DataFrame, matrices: dict[str, np.ndarray], least: float = 0.0, background: float = 0.25) -> DataFrame:
    """Forward hits of letter-probability matrices: (name, motif, start, score), score = sum of log2 odds >= least.

    sequences: (name, seq). Letters other than A, C, G and T end a hit. All starts of a sequence are scored at once.
    """
    weights = {m: np.log2(np.maximum(np.asarray(p, float), 1e-9) / background) for m, p in matrices.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = np.full(256, 4, np.int64)
        code[[65, 67, 71, 84, 97, 99, 103, 116]] = [0, 1, 2, 3] * 2
        for b in batches:
            rows = []
            for name, seq in zip(b["name"], b["seq"]):
                x = code[np.frombuffer((seq or "").encode("latin-1", "replace"), np.uint8)]
                for motif, w in weights.items():
                    n = len(x) - len(w) + 1
                    if n < 1:
                        continue
                    full = np.concatenate([w, np.full((len(w), 1), -np.inf)], axis=1)
                    s = sum(full[k, x[k : k + n]] for k in range(len(w)))
                    rows += [(name, motif, int(i), float(s[i])) for i in np.flatnonzero(s >= least)]
            yield pd.DataFrame(rows, columns=["name", "motif", "start", "score"])

    return sequences.select("name", "seq").mapInPandas(run, "name string, motif string, start int, score double")


def matrix_odds(word: str, position_model: dict, background: dict, orders: list[int]) -> float:
    """log2 odds of a word under two matrices of word probabilities by position; order k looks back k letters."""

    def probability(m: dict) -> float:
        p = 1.0
        for i, k in enumerate(orders):
            over = m.get(word[i - k : i + 1], [0.0] * len(orders))[i]
            under = m.get(word[i - k : i], [0.0] * len(orders))[i - 1] if k else 1.0
            p *= over / under if over and under else 0.0
        return p

    a, b = probability(position_model), probability(background)
    return math.log2(a / b) if a and b else float("nan")


def exclusion_zone(intron: str) -> int:
    """Bases after the last AG before the final twelve, those twelve included."""
    return 12 + len(intron[:-12].rpartition("ag")[2] if "ag" in intron[:-12] else intron[:-12])


def pyrimidine_tract(tail: str) -> tuple[int, int, int]:
    """(start from 1, length, score) of the first qualifying pyrimidine tract; (len, 0, 0) without one.

    A tract begins with a pyrimidine and goes on over pyrimidines. A run of at most two purines is bridged while it is
    no longer than a quarter of the pyrimidine runs around it together, nor than either of them; so is the G of
    T-G-T-G-T. It qualifies with nine letters or five T.
    """
    value = {"a": -2, "c": 2, "t": 3, "g": -2, "n": -2}
    kind = ["y" if x in "ct" else "r" for x in tail]
    n = len(tail)

    def run_from(i: int, k: str) -> int:
        j = i
        while j < n and kind[j] == k and tail[j] != "n":
            j += 1
        return j - i

    at = 0
    while at < n:
        if kind[at] == "r":
            at += 1
            continue
        end = at
        before = 0
        while end < n:
            if kind[end] == "y":
                before = before + 1 if end > at and kind[end - 1] == "y" else 1
                end += 1
                continue
            first = end
            while first > 0 and kind[first - 1] == "r":
                first -= 1
            run = (end - first) + max(run_from(end, "r"), 1)
            after = run_from(first + run, "y")
            bridged = run <= 2 and run <= before and run <= after and run <= (before + after) / 4
            repeat = tail[end] == "g" and 0 < end < n - 1 and (tail[end - 1 : end + 4] == "tgtgt" or (end >= 3 and tail[end - 3 : end + 2] == "tgtgt"))
            if not bridged and not repeat:
                break
            end += 1
        tract = tail[at:end]
        if len(tract) >= 9 or tract.count("t") >= 5:
            return at + 1, len(tract), sum(value[x] for x in tract)
        at = end + 1
    return n, 0, 0


def branch_points(introns: DataFrame, position_model: dict, background: dict, longest: int = 100, nearest: int = 10) -> DataFrame:
    """Candidate branch points of introns (name, seq), farthest first: (name, agez, ss_dist, bp_seq, bp_scr, y_cont,
    ppt_off, ppt_len, ppt_scr)."""
    orders = [0, 1, 1, 0, 2, 0, 2, 1, 1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, seq in zip(b["name"], b["seq"]):
                s = (seq or "").lower()[-longest:]
                zone = exclusion_zone(s) if s else 0
                for x in range(5, len(s) - nearest):
                    word, distance = s[x - 5 : x + 4], len(s) - x
                    if len(word) < 9 or word[3] != "t" or word[5] != "a" or "n" in word:
                        continue
                    tail = s[len(s) - (distance - 1) : -4]
                    share = (tail.count("c") + tail.count("t")) / len(tail) if tail else 0.0
                    rows.append((name, zone, distance, word, matrix_odds(word, position_model, background, orders), share, *pyrimidine_tract(tail)))
            yield pd.DataFrame(rows, columns=["name", "agez", "ss_dist", "bp_seq", "bp_scr", "y_cont", "ppt_off", "ppt_len", "ppt_scr"])

    return introns.select("name", "seq").mapInPandas(run, "name string, agez int, ss_dist int, bp_seq string, bp_scr double, y_cont double, ppt_off int, ppt_len int, ppt_scr int")


def best_branch_point(candidates: DataFrame) -> DataFrame:
    """The candidate with the greatest score of each intron, of several the farthest."""
    return candidates.groupBy("name").agg(F.max_by(F.struct(*(c for c in candidates.columns if c != "name")), F.struct("bp_scr", "ss_dist")).alias("x")).select("name", "x.*")


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value of an array without nulls differs from the one before it; structs by their fields."""
    if pa.types.is_struct(column.type):
        return np.logical_or.reduce([_changes(c) for c in column.flatten()])
    return np.append(True, pc.fill_null(pc.not_equal(column[1:], column[:-1]), True).to_numpy(zero_copy_only=False))


def _words(text: str, k: int) -> pa.Array:
    """Every word of k letters of a text, one for each start."""
    n = len(text) - k + 1
    if not text.isascii():
        return pa.array([text[i : i + k] for i in range(n)], pa.string())
    data = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(np.frombuffer(text.encode(), np.uint8), k))
    return pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * k, k, dtype=np.int32)), pa.py_buffer(data)])


def occurrences(effects: DataFrame, sequences: DataFrame, k: int, stretch: int = 500) -> DataFrame:
    """(event, region, pos, kmer, delta): each k-mer of the sequences with the mean effect of the positions it covers.

    effects and sequences as motif_heatmap takes them. A k-mer without effects is left out, one whose effects are null
    has a null; one that stands in several sequences of an event at one position is there once. Positions travel as
    packed stretches of `stretch` places, so a group is bounded however long a sequence is; a place that k-mers of the
    stretch before reach goes to that one as well.
    """
    stretch, keys = max(stretch, 2 * k), ["event", "region", "_c"]
    named = {f.name: f.dataType for f in effects.schema}
    place = sequences.select((F.col("first_pos") + F.lit(0)).alias("pos")).schema["pos"].dataType
    key_type = [T.StructField("event", named["event"]), T.StructField("region", named["region"])]
    packed_type = T.StructType([*key_type, T.StructField("_c", T.LongType()), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            at = b.column("rel_pos").to_numpy(zero_copy_only=False)
            both = np.flatnonzero((at - k + 1) // stretch != at // stretch)
            rows = np.concatenate([np.arange(len(at)), both])
            c = np.concatenate([at // stretch, at[both] // stretch - 1])
            event, region, x = (b.column(n).take(pa.array(rows)) for n in ("event", "region", "delta"))
            first = np.flatnonzero(_changes(event) | _changes(region) | (np.diff(c, prepend=c[0] - 1) != 0))
            offsets = pa.array(np.append(first, len(rows)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, v) for v in (pa.array((at[rows] - c * stretch).astype(np.int32)), x)]
            take = pa.array(first)
            yield pa.RecordBatch.from_arrays([event.take(take), region.take(take), pa.array(c[first]), *lists], ["event", "region", "_c", "at", "x"])

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = stretch + k - 1
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                b = batch.slice(low, 200)
                row, pos, words, means = [], [], [], []
                for i, (c, e, s) in enumerate(zip(b.column("_c").to_pylist(), b.column("e"), b.column("s"))):
                    at = np.concatenate([v.values.to_numpy(zero_copy_only=False) for v in e.values.field("at")])
                    x = np.concatenate([v.values.to_numpy(zero_copy_only=False) for v in e.values.field("x")])
                    given = np.concatenate([v.values.is_valid().to_numpy(zero_copy_only=False) for v in e.values.field("x")])
                    there, count = np.bincount(at, minlength=n) > 0, np.bincount(at[given], minlength=n)
                    mean = np.bincount(at[given], x[given], n) / np.maximum(count, 1)
                    has = (count > 0).astype(np.int64)
                    slide = lambda v: sum(v[j : j + stretch] for j in range(k))
                    near, known, total = slide(there.astype(np.int64)), slide(has), slide(mean)
                    seen = set()
                    for start, text in zip(s.values.field("start").to_pylist(), s.values.field("text").to_pylist()):
                        p = start - c * stretch + np.arange(len(text) - k + 1)
                        word, keep = _words(text, k), near[p] > 0
                        if len(s.values) > 1:
                            told = list(zip(p.tolist(), word.to_pylist()))
                            keep &= np.array([t not in seen for t in told])
                            seen.update(told)
                        q = p[keep]
                        row.append(np.full(len(q), i))
                        pos.append(c * stretch + q)
                        words.append(word.filter(pa.array(keep)))
                        means.append(pa.array(total[q] / np.maximum(known[q], 1), mask=known[q] == 0))
                take = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([b.column("event").take(take), b.column("region").take(take), pa.array(np.concatenate(pos)), pa.concat_arrays(words), pa.concat_arrays(means)], ["event", "region", "pos", "kmer", "delta"])

    asked = effects.where("event is not null and region is not null and rel_pos is not null")
    spread = asked.select("event", "region", F.col("rel_pos").cast("long").alias("rel_pos"), F.col("delta").cast("double").alias("delta")).mapInArrow(packed, packed_type)
    first, size = F.col("first_pos").cast("long"), F.length("seq")
    whole = sequences.where((size >= k) & F.col("event").isNotNull() & F.col("region").isNotNull() & F.col("first_pos").isNotNull())
    cut = whole.select("event", "region", first.alias("_first"), "seq", F.explode(F.sequence(F.floor(first / stretch), F.floor((first + size - k) / stretch))).alias("_c"))
    start = F.greatest(F.col("_first"), F.col("_c") * stretch)
    end = F.least(F.col("_first") + F.length("seq"), (F.col("_c") + 1) * stretch + k - 1)
    piece = F.struct(start.alias("start"), F.col("seq").substr((start - F.col("_first") + 1).cast("int"), (end - start).cast("int")).alias("text"))
    pieces = cut.select("event", "region", F.col("_c").cast("long").alias("_c"), piece.alias("s"))
    rows = spread.select(*keys, F.struct("at", "x").alias("e")).unionByName(pieces, allowMissingColumns=True)
    groups = rows.groupBy(*keys).agg(F.collect_list("e").alias("e"), F.collect_set("s").alias("s")).where((F.size("e") > 0) & (F.size("s") > 0))
    out = T.StructType([*key_type, T.StructField("pos", T.LongType()), T.StructField("kmer", T.StringType()), T.StructField("delta", T.DoubleType())])
    return groups.mapInArrow(matched, out).withColumn("pos", F.col("pos").cast(place))


def motif_heatmap(effects: DataFrame, sequences: DataFrame, k: int, bins: Column, by_region: bool = False) -> DataFrame:
    """Mean effect of mutating each k-mer, by bin of its position: (kmer, bin, effect), with by_region (region, ...).

    effects: (event, region, rel_pos, delta), sequences: (event, region, seq, first_pos). k-mers are taken from the
    sequences and meet the effects of the positions they cover, instead of asking every event for every k-mer.
    First the positions of an occurrence are averaged, then the occurrences.
    """
    each = occurrences(effects, sequences, k)
    return each.withColumn("bin", bins).groupBy(*(["region"] if by_region else []), "kmer", "bin").agg(F.avg("delta").alias("effect"))


def region_heatmap(heat: DataFrame, bins: dict[str, list], key: str = "kmer") -> DataFrame:
    """Heat maps of several regions side by side, one row for each motif: (key, <region>_<bin>..., mean).

    heat: (key, region, bin, effect), of motif_heatmap with the region kept; bins: the bins of each region, in order.
    As joins to the first region's map from the left would have it, motifs that only later regions have are left
    out; one pivot does without the joins. Bins that are not named do not count; a bin without effects is null and
    stays out of the mean of the bins. Nulls of effect are left out, nulls of the key are a motif.
    """
    first = next(iter(bins))
    cell = lambda r, b: F.avg(F.when((F.col("region") == r) & (F.col("bin") == b), F.col("effect")))
    names = [f"{r}_{b}" for r, bs in bins.items() for b in bs]
    cells = [cell(r, b).alias(f"{r}_{b}") for r, bs in bins.items() for b in bs]
    wide = heat.groupBy(key).agg(*cells, F.count_if(F.col("region") == first).alias("_first")).where("_first > 0")
    return wide.select(key, *(F.col(f"`{n}`") for n in names), scores.row_mean([f"`{n}`" for n in names]).alias("mean"))


def pooled_regions(positions: DataFrame, keys: list[str], outputs: list[str], regions: list[str], floor: float | None = 0.0) -> DataFrame:
    """The greatest value of each model output over the positions of each region: (keys, <output>_<region>...).

    positions: (keys, region, outputs), one row for each scored window, in any order and in any number of parts. A
    value is at least `floor` (which a region without positions has, too), or null there if floor is None.
    """
    best = lambda o, r: F.max(F.when(F.col("region") == r, F.col(f"`{o}`").cast("double")))
    held = lambda c: c if floor is None else F.greatest(F.coalesce(c, F.lit(float(floor))), F.lit(float(floor)))
    return positions.groupBy(*keys).agg(*(held(best(o, r)).alias(f"{o}_{r}") for r in regions for o in outputs))


def floored_maxima(df: DataFrame, keys: list[str], position: str, regions: dict[str, tuple[int, int]], columns: list[str]) -> DataFrame:
    """The greatest value of each column over each region's positions, at least 0: (keys, <column>_<region>...)."""
    inside = lambda a, b: (F.col(position) >= a) & (F.col(position) < b)
    best = [F.greatest(F.coalesce(F.max(F.when(inside(a, b), F.col(c))), F.lit(0.0)), F.lit(0.0)).alias(f"{c}_{r}") for r, (a, b) in regions.items() for c in columns]
    return df.groupBy(*keys).agg(*best)
