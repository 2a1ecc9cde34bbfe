"""Chain files and the lift of positions, intervals and events from one assembly to another.

A chain is a row of blocks that two sequences share, with gaps between them; coordinates of a reversed target count
from that sequence's end. Blocks are joined to intervals by (chromosome, bin), and what a chain holds of an interval is
added up by (interval, chain), so neither a chromosome nor a chain has to fit a task.

Outcomes of an interval: `mapped` (one chain holds at least min_match of its bases), `duplicated` (several do), `split`
(only all chains together do), `partial` (fewer bases, but some) and `deleted` (none). A mapped interval reaches from
the first to the last of its bases that the chain holds, and turns its strand where the chain is reversed.

Edge cases: intervals without chromosome, start or end, and empty ones, are `deleted`; repeated rows need keys of
their own, as a key stands for one interval; a chain file without chains has no blocks; an event is mapped only if both
of its introns are, to one chromosome and strand, and otherwise carries the first reason that holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .intervals import overlap_join

WIDTH = 100_000


def chains(spark: SparkSession, path) -> DataFrame:
    """Blocks of chain files: (chain, chrom, block_start, block_end, to_chrom, to_start, to_size, reversed).

    chain is the chain's number, block_start and block_end are 0-based and closed, to_start is the target's place of
    the block's first base, counted from the end of the target (to_size) where it is reversed.
    """
    records = spark.read.option("lineSep", "\nchain ").text(path).select(F.split("value", "\r?\n").alias("lines"), F.col("_metadata.file_path").alias("file"))
    # the first record may follow comments; the others begin with the rest of their header line
    begin = F.array_position(F.transform("lines", lambda x: x.startswith("chain ")), F.lit(True)).cast("int")
    first = F.when(begin > 0, F.regexp_replace(F.get("lines", begin - 1), "^chain ", "")).otherwise(F.get("lines", F.lit(0)))
    rest = F.slice("lines", F.greatest(begin, F.lit(1)) + 1, F.size("lines"))
    heads = records.select("file", F.split(F.trim(first), r"\s+").alias("h"), rest.alias("rest")).where(F.size("h") >= 11)
    h = lambda i: F.get("h", F.lit(i))
    shape = heads.select(
        "file", F.get("h", F.lit(11)).alias("chain"), h(1).alias("chrom"), h(4).cast("long").alias("t"), h(6).alias("to_chrom"), h(7).cast("long").alias("to_size"), (h(8) == "-").alias("reversed"), h(9).cast("long").alias("q"),
        F.filter(F.transform("rest", lambda x: F.split(F.trim(x), r"\s+")), lambda x: F.get(x, F.lit(0)).rlike("^[0-9]+$")).alias("lines"),
    )
    number = lambda i: F.coalesce(F.get("line", F.lit(i)).cast("long"), F.lit(0))
    lines = shape.select("*", F.posexplode("lines").alias("n", "line")).withColumns({"size": number(0), "dt": number(1), "dq": number(2)})
    before = Window.partitionBy("file", "chain", "chrom", "t", "to_chrom", "q").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda c: F.coalesce(F.sum(F.col("size") + F.col(c)).over(before), F.lit(0))
    at = lines.withColumns({"block_start": F.col("t") + sums("dt"), "to_start": F.col("q") + sums("dq")})
    return at.where("size > 0").select("chain", "chrom", "block_start", (F.col("block_start") + F.col("size") - 1).alias("block_end"), "to_chrom", "to_start", "to_size", "reversed")


def _placed(offset: Column) -> Column:
    """The target's forward place of a base by its offset from the block's first base."""
    at = F.col("to_start") + offset
    return F.when(F.col("reversed"), F.col("to_size") - 1 - at).otherwise(at)


def lift_positions(points: DataFrame, blocks: DataFrame, position: str = "pos", width: int = WIDTH) -> DataFrame:
    """points (chrom, position, ...) with to_chrom and lifted, a row for each chain that holds them; null if none does."""
    asked = points.withColumns({"_from": F.col(position), "_to": F.col(position)})
    found = overlap_join(asked, blocks, left_span=("_from", "_to"), right_span=("block_start", "block_end"), width=width, how="left")
    return found.select(*points.columns, "to_chrom", _placed(F.col(position) - F.col("block_start")).alias("lifted"))


def lift_intervals(intervals: DataFrame, blocks: DataFrame, key: str, min_match: float = 0.95, width: int = WIDTH) -> DataFrame:
    """(key, outcome, to_chrom, to_start, to_end, reversed) for every interval (key, chrom, start, end), half open.

    key names an interval; the target's columns are null unless it is mapped.
    """
    spans = intervals.select(F.col(key).alias("_key"), "chrom", F.col("start").cast("long").alias("_start"), (F.col("end").cast("long") - 1).alias("_last"))
    met = overlap_join(spans.where("_start <= _last"), blocks, left_span=("_start", "_last"), right_span=("block_start", "block_end"), width=width)
    low, high = F.greatest("_start", "block_start"), F.least("_last", "block_end")
    ends = [_placed(x - F.col("block_start")) for x in (low, high)]
    pieces = met.select("_key", F.col("_last") - F.col("_start") + 1, *(F.col(c) for c in ("chain", "to_chrom", "reversed")), (high - low + 1).alias("bases"), F.least(*ends).alias("a"), F.greatest(*ends).alias("b")).toDF("_key", "length", "chain", "to_chrom", "reversed", "bases", "a", "b")
    held = pieces.groupBy("_key", "length", "chain", "to_chrom", "reversed").agg(F.sum("bases").alias("bases"), F.min("a").alias("a"), F.max("b").alias("b"))
    enough = F.col("bases") >= F.col("length") * F.lit(float(min_match))
    best = F.max_by(F.struct("to_chrom", "a", "b", "reversed"), F.when(enough, F.col("bases"))).alias("best")
    told = held.groupBy("_key", "length").agg(F.count_if(enough).alias("chains"), F.sum("bases").alias("bases"), best)
    outcome = F.when(F.col("chains") == 1, "mapped").when(F.col("chains") > 1, "duplicated").when(enough, "split").when(F.col("bases") > 0, "partial").otherwise("deleted")
    rows = intervals.select(F.col(key).alias("_asked")).join(told, F.col("_asked").eqNullSafe(F.col("_key")), "left").withColumn("outcome", outcome)
    mapped = lambda c: F.when(F.col("outcome") == "mapped", c)
    return rows.select(F.col("_asked").alias(key), "outcome", mapped(F.col("best.to_chrom")).alias("to_chrom"), mapped(F.col("best.a")).alias("to_start"), mapped(F.col("best.b") + 1).alias("to_end"), mapped(F.col("best.reversed")).alias("reversed"))


def lift_events(events: DataFrame, blocks: DataFrame, key: str = "event", min_match: float = 0.95, width: int = WIDTH) -> DataFrame:
    """events with outcome, to_chrom, to_strand and the lifted introns, both ends paired by the event.

    events: (key, chrom, strand, upIntStart, upIntEnd, dnIntStart, dnIntEnd). Both introns go through one lift. The
    outcome is `mapped`, that of the upstream intron, that of the downstream one, or `apart` where they came to lie on
    two chromosomes or strands.
    """
    half = lambda side: events.select(F.struct(F.col(key).alias("of"), F.lit(side).alias("side")).alias("half"), "chrom", F.col(f"{side}IntStart").alias("start"), F.col(f"{side}IntEnd").alias("end"))
    lifted = lift_intervals(half("up").unionByName(half("dn")), blocks, "half", min_match, width)
    pick = lambda side: F.max(F.when(F.col("half.side") == side, F.struct("outcome", "to_chrom", "to_start", "to_end", "reversed"))).alias(f"_{side}")
    both = lifted.groupBy(F.col("half.of").alias("_of")).agg(pick("up"), pick("dn"))
    rows = events.join(both, F.col(key).eqNullSafe(F.col("_of")), "left")
    apart = (F.col("_up.to_chrom") != F.col("_dn.to_chrom")) | (F.col("_up.reversed") != F.col("_dn.reversed"))
    outcome = F.when(F.col("_up.outcome") != "mapped", F.col("_up.outcome")).when(F.col("_dn.outcome") != "mapped", F.col("_dn.outcome")).when(apart, "apart").otherwise("mapped")
    rows = rows.withColumn("outcome", outcome)
    mapped = lambda c: F.when(F.col("outcome") == "mapped", c)
    turned = F.when(F.col("strand") == "+", "-").when(F.col("strand") == "-", "+")
    new = {"to_chrom": F.col("_up.to_chrom"), "to_strand": F.when(F.col("_up.reversed"), turned).otherwise(F.col("strand"))}
    new |= {f"to_{side}Int{end}": F.col(f"_{side}.to_{end.lower()}") for side in ("up", "dn") for end in ("Start", "End")}
    return rows.select(*events.columns, "outcome", *(mapped(c).alias(n) for n, c in new.items()))
