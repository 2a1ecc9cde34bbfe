"""Cohort operators: discordant groups, coordinate lift, non-overlapping variants, counts by affection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .groups import carried_sums


def discordant(df: DataFrame, group: str, code: str, values: tuple) -> DataFrame:
    """Groups with a row of every one of these codes."""
    present = [F.bool_or(F.col(code) == v).alias(f"_{i}") for i, v in enumerate(values)]
    all_there = F.lit(True)
    for i in range(len(values)):
        all_there = all_there & F.col(f"_{i}")
    return df.groupBy(group).agg(*present).where(all_there).select(group)


def lifted(points: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """points (key, coord, ...) with lifted: coord plus the length changes at positions pos with pos + 1 <= coord.

    Both sides are sorted together by ranges, with sums carried from range to range, instead of a join of every point
    with every change; a key may have any number of rows.
    """
    rows = points.select(key, F.col("coord").alias("_at"), F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_change"), F.struct(*points.columns).alias("_row"))
    moves = changes.groupBy(key, (F.col("pos") + 1).alias("_at")).agg(F.sum(F.col("change").cast("long")).alias("_change")).select(key, "_at", F.lit(0).alias("_kind"), "_change", F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"))
    both = carried_sums(rows.unionByName(moves), [key], ["_at", "_kind"], {"_sum": "_change"}).where("_kind = 1")
    return both.select("_row.*", (F.col("_at") + F.col("_sum")).alias("lifted"))


def without_overlaps(variants: Column) -> Column:
    """Of an array of struct(pos, ref, alt), those that don't start before the end of the last one kept."""
    ordered = F.array_sort(variants)
    empty = F.slice(ordered, 1, 0)
    end = lambda v: v["pos"] + F.length(v["ref"])
    return F.aggregate(
        ordered,
        empty,
        lambda kept, v: F.when((F.size(kept) == 0) | (v["pos"] >= end(F.try_element_at(kept, F.lit(-1)))), F.concat(kept, F.array(v))).otherwise(kept),
    )


def decoded_affection(code) -> Column:
    """1 unaffected, 2 affected; null for anything else."""
    c = F.col(code) if isinstance(code, str) else code
    return F.when(c == 1, "unaffected").when(c == 2, "affected")


def affection_name(code) -> Column:
    """The name of a code by its place: 0 non-ASD, 1 control, 2 ASD; an error for anything else but null."""
    c = F.col(code) if isinstance(code, str) else code
    named = F.get(F.array(F.lit("non-ASD"), F.lit("control"), F.lit("ASD")), c.cast("int"))
    return F.when(c.isNull() | named.isNotNull(), named).otherwise(F.raise_error(F.concat(F.lit("no affection code: "), c.cast("string"))))


def annotated_variants(variants: DataFrame, events: DataFrame, samples: DataFrame) -> DataFrame:
    """A row for each variant and interval that it is annotated with: events' columns, variant, interval, affected_exon,
    affected_region, sample_id, affection and mic_var_distance, in transcript order.

    variants: (sample, chrom, pos 1-based, ref, alt, intervals: names after commas); events: (event, strand, upIntStart,
    upIntEnd, dnIntStart, dnIntEnd, ...); samples: (sample, affection 0 to 2). Intervals of unknown events and null or
    empty lists have no row; repeated names have one each. Samples without a row have a null affection.
    """
    from seqlume.functions import sequence

    from .variants import span_distance

    name = F.explode(F.split("intervals", ",")).alias("interval")
    rows = variants.select(F.col("sample").alias("sample_id"), F.concat_ws(":", "chrom", F.col("pos").cast("string"), "ref", "alt").alias("variant"), (F.col("pos").cast("long") - 1).alias("_pos0"), F.col("ref").alias("_ref"), name)
    named = rows.withColumn("_p", sequence.interval_parts("interval")).select("*", F.col("_p.event").alias("event"), F.col("_p.exon").alias("affected_exon"), F.col("_p.region").alias("affected_region")).drop("_p")
    known = named.join(events, "event").join(samples.select(F.col("sample").alias("sample_id"), affection_name("affection").alias("affection")), "sample_id", "left")
    distance = span_distance(F.col("_pos0"), F.col("_ref"))
    return known.withColumn("mic_var_distance", F.when(F.col("strand") == "-", -distance).otherwise(distance)).drop("_pos0", "_ref")


def counts_by_affection(variants: DataFrame, samples: DataFrame, statistics: dict[str, Column]) -> DataFrame:
    """Counts of each statistic (a condition) by region set and affection; samples: (sample, affection)."""
    known = samples.withColumn("status", decoded_affection("affection")).where("status is not null").select("sample", "status")
    rows = variants.join(known, "sample")
    parts = [F.count_if(c).alias(n) for n, c in statistics.items()]
    return rows.groupBy("region_set").pivot("status", ["affected", "unaffected"]).agg(*parts)


def region_set_counts(variants: DataFrame, sets: DataFrame, samples: DataFrame, statistics: dict[str, Column], most: int = 4096) -> DataFrame:
    """(region_set, affected_<statistic>, unaffected_<statistic>...): counts over many overlapping sets of regions.

    variants: (sample, region, ...); sets: (region_set, region); samples: (sample, affection). A region carries the sets
    that it is in as bits, so a variant is joined once however many sets hold its region; rows are counted by (affection,
    bits) and only these counts are dealt out to the sets. Sets without a counted variant have 0; repeated rows of sets
    count once, those of variants as often as they stand there. More than `most` sets are an error.
    """
    named = sets.where("region_set is not null").select("region_set").distinct().limit(most + 1).collect()
    names = sorted(r["region_set"] for r in named)
    if len(names) > most:
        raise ValueError(f"more than {most} region sets")
    spark = variants.sparkSession
    bits = [f"_bits{i}" for i in range(max(-(-len(names) // 62), 1))]
    numbers = F.broadcast(spark.createDataFrame([(n, i // 62, 1 << (i % 62)) for i, n in enumerate(names)], "region_set string, _word int, _bit long"))
    masks = sets.join(numbers, "region_set").groupBy("region").agg(*(F.bit_or(F.when(F.col("_word") == i, F.col("_bit")).otherwise(F.lit(0).cast("long"))).alias(b) for i, b in enumerate(bits)))
    known = samples.withColumn("_status", decoded_affection("affection")).where("_status is not null").select("sample", "_status")
    counted = variants.join(masks, "region").join(known, "sample").groupBy("_status", *bits).agg(*(F.count_if(c).alias(n) for n, c in statistics.items()))
    held = counted.join(numbers, F.coalesce(*(F.when(F.col("_word") == i, F.col(b)) for i, b in enumerate(bits))).bitwiseAND(F.col("_bit")) != 0)
    totals = [F.coalesce(F.sum(F.when(F.col("_status") == s, F.col(n))), F.lit(0)).alias(f"{s}_{n}") for s in ("affected", "unaffected") for n in statistics]
    summed = held.groupBy("region_set").agg(*totals)
    every = spark.createDataFrame([(n,) for n in names], "region_set string").join(summed, "region_set", "left")
    return every.select("region_set", *(F.coalesce(c, F.lit(0)).alias(c) for c in summed.columns[1:]))
