"""Generators of mutants: all substitutions, motif changes, pairs of motif changes."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlume.functions.sequence import complement, motif_starts

BASES = ("A", "C", "G", "T")


def other_bases(ref) -> Column:
    c = F.col(ref) if isinstance(ref, str) else ref
    return F.array_except(F.array(*map(F.lit, BASES)), F.array(c))


def substitutions(df: DataFrame, seq: str) -> DataFrame:
    """A row for each position (0-based) and other base; for windows, not for whole chromosomes. N has no substitutions."""
    letters = df.select("*", F.posexplode(F.filter(F.split(seq, ""), lambda x: x != "")).alias("pos", "ref")).where(F.col("ref").isin(*BASES))
    return letters.withColumn("alt", F.explode(other_bases("ref")))


def region_labels(df: DataFrame) -> DataFrame:
    """Positions of an event's windows with labels in transcript order: c1 and c2 from -300 to +300 without 0's double,
    up -300 to -1, ex 1 to its length, dn +1 to +300.

    df: (event, strand, c1, me_start, me_end, c2, window), half-open microexon [me_start, me_end). Positions are 0-based on
    the genome, labels follow the transcript, so they run backwards on the minus strand.
    """
    w = F.col("window")
    n = F.col("me_end") - F.col("me_start")
    plus = F.col("strand") == "+"

    def spot(region: str, start: Column, size: Column, label) -> Column:
        offsets = F.sequence(F.lit(0).cast("long"), size.cast("long") - 1)
        return F.transform(offsets, lambda i: F.struct(F.lit(region).alias("region"), (start + F.when(plus, i).otherwise(size - 1 - i)).alias("pos"), label(i).alias("label")))

    flank = lambda region: (lambda i: F.format_string(f"{region}%+d", i - w + F.when(i >= w, 1).otherwise(0)))
    up = spot("up", F.when(plus, F.col("me_start") - w).otherwise(F.col("me_end")), w, lambda i: F.format_string("up%+d", i - w))
    ex = spot("ex", F.col("me_start"), n, lambda i: F.format_string("ex%d", i + 1))
    dn = spot("dn", F.when(plus, F.col("me_end")).otherwise(F.col("me_start") - w), w, lambda i: F.format_string("dn%+d", i + 1))
    c1 = spot("c1", F.col("c1") - w, 2 * w, flank("c1"))
    c2 = spot("c2", F.col("c2") - w, 2 * w, flank("c2"))
    return df.select("event", "strand", F.explode(F.concat(c1, up, ex, dn, c2)).alias("x")).select("event", "strand", "x.*")


def motif_changes(df: DataFrame, seq: str, motif: str) -> DataFrame:
    """A row for each occurrence of an IUPAC motif, position in it, and other base: (start, offset, ref, alt)."""
    hits = df.select("*", F.explode(motif_starts(seq, motif)).alias("start"))
    spots = hits.withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(len(motif) - 1))))
    spots = spots.withColumn("ref", F.substring(F.col(seq), F.col("start") + F.col("offset") + 1, F.lit(1)))
    return spots.withColumn("alt", F.explode(other_bases("ref")))


def double_changes(df: DataFrame, key: str, seq: str, motifs: list[str]) -> DataFrame:
    """Unordered pairs of complement changes in occurrences of two different motifs of one sequence, numbered afresh
    for each sequence and pair: (key, first, second, pos1, pos2, j)."""
    found = [df.select(key, F.lit(i).alias("i"), F.lit(m).alias("motif"), F.explode(motif_starts(seq, m)).alias("pos"), F.lit(len(m)).alias("size"), F.col(seq).alias("s")) for i, m in enumerate(motifs)]
    found = [f.withColumn("ref", F.substring(F.col("s"), F.col("pos") + 1, F.lit(1))).drop("s") for f in found]  # the pairs carry a letter, no sequence
    hits = found[0]
    for f in found[1:]:
        hits = hits.unionByName(f)
    x, y = hits.alias("x"), hits.alias("y")
    apart = (F.col("x.pos") + F.col("x.size") <= F.col("y.pos")) | (F.col("y.pos") + F.col("y.size") <= F.col("x.pos"))
    pairs = x.join(y, (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col("x.i") < F.col("y.i")) & apart)
    base = lambda t: F.col(f"{t}.ref")
    rows = pairs.select(F.col(f"x.{key}").alias(key), F.col("x.motif").alias("first"), F.col("y.motif").alias("second"), F.col("x.pos").alias("pos1"), F.col("y.pos").alias("pos2"), base("x").alias("ref1"), complement(base("x")).alias("alt1"), base("y").alias("ref2"), complement(base("y")).alias("alt2"))
    from pyspark.sql import Window

    return rows.withColumn("j", F.row_number().over(Window.partitionBy(key, "first", "second").orderBy("pos1", "pos2")) - 1)


def scan_positions(site, window: int, exon: Column, acceptor: bool) -> Column:
    """Positions around a splice site: from window before an acceptor to window past the exon's end, mirrored for a donor."""
    s = F.col(site) if isinstance(site, str) else site
    low, high = (s - window, s + window + exon) if acceptor else (s - window - exon, s + window)
    return F.sequence(low.cast("long"), high.cast("long"))


def kmer_words(k: int, letters: str = "ACGT") -> list[str]:
    """Every word of k letters, in order; k of at most 6 or so, as the words are in memory."""
    return ["".join(w) for w in itertools.product(letters, repeat=k)]


def all_kmers(spark, k: int) -> DataFrame:
    """Every word of k letters over A, C, G and T, in order: (kmer)."""
    letter = lambda i: F.substring(F.lit("ACGT"), F.shiftright(F.col("id"), 2 * (k - 1 - i)).bitwiseAND(F.lit(3)).cast("int") + 1, F.lit(1))
    return spark.range(4**k).select(F.concat(*(letter(i) for i in range(k))).alias("kmer"))
