"""k-mer counts, profiles, contingency tables and Fisher tests."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlume.functions.sequence import kmers


def kmer_counts(df: DataFrame, seq: str, k: int) -> DataFrame:
    """Rows (kmer, n) over all sequences. One pass of a look-ahead pattern gives a sequence's k-mers."""
    return df.select(F.explode(kmers(seq, k)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


def contingency(df: DataFrame, seq: str, k: int, foreground: str) -> DataFrame:
    """Rows (kmer, fg_count, bg_count, fg_total, bg_total); foreground is a boolean column."""
    rows = df.select(F.col(foreground).alias("fg"), F.explode(kmers(seq, k)).alias("kmer"))
    counts = rows.groupBy("kmer").agg(F.count_if("fg").alias("fg_count"), F.count_if(~F.col("fg")).alias("bg_count"))
    totals = counts.agg(F.coalesce(F.sum("fg_count"), F.lit(0)).alias("fg_total"), F.coalesce(F.sum("bg_count"), F.lit(0)).alias("bg_total"))
    return counts.join(F.broadcast(totals))  # one row


def hypergeometric_tails(fg: int, bg: int, fg_total: int, bg_total: int) -> tuple[float, float]:
    """One-sided p-values (enriched, depleted) of the table [[fg, bg], [fg_total - fg, bg_total - bg]]."""
    drawn, n = fg + bg, fg_total + bg_total
    choose = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    low, high = max(0, drawn - bg_total), min(drawn, fg_total)
    k = np.arange(low, high + 1)
    base = choose(n, drawn)
    steps = np.log(np.maximum((fg_total - k[:-1]) * (drawn - k[:-1]), 1e-300)) - np.log((k[:-1] + 1.0) * (bg_total - drawn + k[:-1] + 1.0))
    logp = choose(fg_total, low) + choose(bg_total, drawn - low) - base + np.concatenate([[0.0], np.cumsum(steps)])
    p = np.exp(logp)
    at = fg - low
    return min(float(p[at:].sum()), 1.0), min(float(p[: at + 1].sum()), 1.0)


def fisher(table: DataFrame) -> DataFrame:
    """Adds p_enriched and p_depleted to a contingency table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            tails = [hypergeometric_tails(*map(int, x)) for x in zip(b.fg_count, b.bg_count, b.fg_total, b.bg_total)]
            yield b.assign(p_enriched=[t[0] for t in tails], p_depleted=[t[1] for t in tails])

    columns = ", ".join(f"{c} {t}" for c, t in table.dtypes)
    return table.mapInPandas(run, f"{columns}, p_enriched double, p_depleted double")


def top_kmers(table: DataFrame, n: int, p_cut: float | None = None) -> DataFrame:
    """The n k-mers with the least p-value of either side, with the side they belong to."""
    both = table.withColumn("p_val_min", F.least("p_enriched", "p_depleted")).withColumn("set", F.when(F.col("p_enriched") <= F.col("p_depleted"), "enriched").otherwise("depleted"))
    if p_cut is not None:
        both = both.where(F.col("p_val_min") <= p_cut)
    return both.orderBy("p_val_min", "kmer").limit(n)


def motif_profile(seq: str, words: list[str], width: int) -> Column:
    """For each bin of `width` letters, whether one of the words (of one length) lies inside it."""
    k = len(words[0])
    inside = F.sequence(F.lit(1), F.lit(width - k + 1))
    s = F.col(seq)
    bins = F.slice(F.sequence(F.lit(0), F.floor(F.length(s) / width).cast("int")), F.lit(1), F.floor(F.length(s) / width).cast("int"))
    return F.transform(bins, lambda b: F.exists(inside, lambda j: s.substr(b * width + j, F.lit(k)).isin(*words)))


def sliding_profile(seq: str, words: list[str], length: int, width: int) -> Column:
    """Whether a word starts at one of the `width` positions of each bin of a sequence of `length` letters.

    Bins begin at every multiple of width below length - width - len(word) + width, so the last ones, in which not every
    start has room, are left out, as in the published features (18 bins of 3 for 60 letters).
    """
    k = len(words[0])
    s = F.col(seq)
    starts = F.array(*(F.lit(i) for i in range(0, length - k + 1 - width + 1, width)))
    return F.transform(starts, lambda b: F.exists(F.sequence(b, b + width - 1), lambda i: s.substr(i + 1, F.lit(k)).isin(*[w for w in words if len(w) == k])))
