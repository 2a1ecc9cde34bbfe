"""Personal sequences: all variants of a sample on the windows of its events, splice sites moved along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cohort import without_overlaps


def personal_windows(windows: DataFrame, variants: DataFrame, width: int = 1024) -> DataFrame:
    """(windows' columns, sample, mutated, shift): each window with each sample's variants that lie in it.

    windows: (event, chrom, start, seq) with 0-based start; variants: (sample, chrom, pos 0-based, ref, alt), first
    alternative allele only. A variant that begins before the end of the last one kept is left out. An allele that
    isn't there is an error. Only windows travel, never chromosomes; windows and variants meet by bins of positions.
    """
    bins = lambda first, last: F.explode(F.sequence(F.floor(first / width), F.floor(last / width)))
    placed = windows.withColumn("_bin", bins(F.col("start"), F.col("start") + F.length("seq")))
    known = variants.withColumn("_bin", F.floor(F.col("pos") / width))
    inside = placed.join(known, ["chrom", "_bin"]).where((F.col("pos") >= F.col("start")) & (F.col("pos") + F.length("ref") <= F.col("start") + F.length("seq"))).drop("_bin")
    first = F.get(F.split("alt", ","), F.lit(0))
    grouped = inside.groupBy("event", "chrom", "start", "seq", "sample").agg(F.collect_set(F.struct("pos", "ref", first.alias("alt"))).alias("v"))
    rows = grouped.withColumn("v", without_overlaps(F.col("v")))
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, v: Column) -> Column:
        p = v["pos"] - F.col("start")
        there = F.col("seq").substr((p + 1).cast("int"), F.length(v["ref"])) == v["ref"]
        kept = F.col("seq").substr((acc["at"] + 1).cast("int"), (p - acc["at"]).cast("int"))
        text = F.when(there, F.concat(acc["done"], kept, v["alt"])).otherwise(F.raise_error(F.concat(F.lit("reference allele mismatch at "), v["pos"].cast("string"))))
        return F.struct(text.alias("done"), (p + F.length(v["ref"])).cast("long").alias("at"))

    rows = rows.withColumn("_a", F.aggregate("v", start, step))
    rest = F.col("seq").substr((F.col("_a.at") + 1).cast("int"), F.length("seq"))
    shift = F.aggregate("v", F.lit(0), lambda acc, v: acc + F.length(v["alt"]) - F.length(v["ref"]))
    return rows.select("event", "chrom", "start", "seq", "sample", F.concat("_a.done", rest).alias("mutated"), shift.alias("shift"))


def moved_site(site: str, pos: str, change: Column) -> Column:
    """A splice site after a variant before it."""
    return F.when(F.col(pos) < F.col(site), F.col(site) + change).otherwise(F.col(site))


def site_candidates(site: Column, change: Column) -> Column:
    """Places to try for a site that the variant spans: from 3 before to 3 past the length change; none if it is -7 or less."""
    last = change + 3
    return F.when(last >= -3, F.transform(F.sequence(F.lit(-3), F.greatest(last, F.lit(-3)).cast("int")), lambda d: site + d)).otherwise(F.array().cast("array<bigint>"))


def site_score(scores: Column) -> Column:
    """The greatest of the candidates' scores."""
    return F.array_max(scores)


def checked_events(moved: DataFrame) -> DataFrame:
    """moved with reason: null for events to keep, else why they are skipped: "invalid event" where the coordinates of
    the moved exons are out of order or missing, "equal to reference" where no sequence differs.

    moved: (strand, upIntStart, upIntEnd, dnIntStart, dnIntEnd, and wt_<x> and mt_<x> for each sequence x); nulls of
    both sides are equal.
    """
    ordered = lambda *c: (F.col(c[0]) < F.col(c[1])) & (F.col(c[1]) < F.col(c[2])) & (F.col(c[2]) < F.col(c[3]))
    plus = ordered("upIntStart", "upIntEnd", "dnIntStart", "dnIntEnd")
    minus = ordered("dnIntStart", "dnIntEnd", "upIntStart", "upIntEnd")
    valid = F.when(F.col("strand") == "+", plus).when(F.col("strand") == "-", minus).otherwise(F.raise_error(F.lit("strand must be + or -")).cast("boolean"))
    equal = F.lit(True)
    for c in (c[3:] for c in moved.columns if c.startswith("wt_") and f"mt_{c[3:]}" in moved.columns):
        equal = equal & F.upper(f"wt_{c}").eqNullSafe(F.upper(f"mt_{c}"))
    return moved.withColumn("reason", F.when(~F.coalesce(valid, F.lit(False)), "invalid event").when(equal, "equal to reference"))
